"""The column-wise transform against sorting, and the window comparison against it."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from barloom.llm import bwt, suffix_dedup


def brute(docs):
    rows = sorted((d[s:] + b"", i, s) for i, d in enumerate(docs) for s in range(len(d) + 1))
    # an end is below every symbol, and earlier documents' ends come first: sorting by (suffix, document) does both
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_transform_equals_sorting(seed):
    r = random.Random(seed)
    docs = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 7))] + [b"", b"abab"]
    symbol, document, start, lcp = bwt.build(docs)
    want = brute(docs)
    assert [(i, s) for _, i, s in want] == list(zip(document.tolist(), start.tolist(), strict=True))
    assert symbol.tolist() == [docs[i][s - 1] if s else -1 for _, i, s in want]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]


def test_windows_of_the_operator_are_those_of_the_transform():
    r = random.Random(3)
    shared = bytes(r.choice(b"abcd") for _ in range(90))
    docs = [bytes(r.choice(b"abcd") for _ in range(r.randrange(60))) + shared[r.randrange(30) :] + bytes(r.choice(b"abcd") for _ in range(r.randrange(60))) for _ in range(8)] + [b"ab" * 40, b"", b"a" * 39]
    hashes = {}
    for i, d in enumerate(docs):
        if len(d) >= 40:
            for s, h in enumerate(suffix_dedup.Hashes(np.frombuffer(d, np.uint8)).every(40).tolist()):
                hashes.setdefault(h, []).append((i, s))
    assert bwt.repeated_windows(docs, 40) == {x for own in hashes.values() if len(own) > 1 for x in own}


def test_runs_cover_every_window_once():
    r = random.Random(9)
    d = bytes(r.choice(b"abcdefgh") for _ in range(5000))
    anchors, regions, first = suffix_dedup.runs(d, 200)
    assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] <= len(d) - 200 and len(anchors) == len(regions) == len(first)


def test_strips_cover_their_runs_and_equal_windows_share_a_key():
    r = random.Random(5)
    shared = bytes(r.choice(b"abcdefgh") for _ in range(700))
    docs = [bytes(r.choice(b"abcdefgh") for _ in range(r.randrange(400))) + shared[r.randrange(200) :] for _ in range(6)]
    keys = {}
    for d in docs:
        anchors, _, first = suffix_dedup.runs(d, 200)
        last = np.append(first[1:], len(d) - 199) - 1
        found = suffix_dedup.strips(d, anchors, first, last, 200)
        at = np.concatenate([np.arange(f, f + n) for f, n in zip(found.first, found.size, strict=True)])
        assert (at == np.arange(len(d) - 199)).all() and found.size.max() <= suffix_dedup.STRIP
        for a, k, f, n in zip(anchors[found.run].tolist(), found.key.tolist(), found.first.tolist(), found.size.tolist(), strict=True):
            for s in range(f, f + n):
                keys.setdefault(d[s : s + 200], set()).add((a, k))
    assert all(len(own) == 1 for own in keys.values())


def test_cost_grows_with_rounds_times_rows():
    """The reason for not using it on whole documents."""
    r = random.Random(1)

    def took(n):
        docs = [bytes(r.choice(b"abcdefgh") for _ in range(n)) for _ in range(20)]
        start = time.perf_counter()
        bwt.build(docs, 200)
        return time.perf_counter() - start

    assert took(2000) > 3 * took(500)
