"""The driver's entry points, also without optional libraries."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len([n for n in q if n != 'pipeline' and not n.startswith('op') or n.startswith('operator')]), len(q))"


def run(code: str) -> list[int]:
    return [int(x) for x in subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True).stdout.split()[-2:]]


def test_a_missing_library_leaves_the_other_queries():
    own, every = run(COUNT)
    without, left = run("import sys; sys.modules['ahocorasick'] = None; " + COUNT)
    assert own == without == left <= every
