"""Burrows-Wheeler transform of a collection, built one column at a time.

Each round puts one more symbol in front of every document's suffix, from the ends to
the starts.  The transform is a file of rows in suffix order; a round reads it from
start to end and writes the next one, with the new rows merged in at the places that
counting symbols gives (the row of ``c + suffix`` is the number of smaller symbols plus
the number of ``c`` before the suffix's row).  Common prefixes with the row above are
updated in the same pass, up to ``cap``: those of new rows follow from the least value
between a row and the last one before it with the same symbol.

The number of rounds is the length of the longest document, and each round passes over
everything that was built so far.  That suits many short documents; README.md tells
what it means for whole web documents, and why ``suffix_dedup`` works otherwise.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


def _after_smaller(lcp: np.ndarray, previous: np.ndarray, rows: np.ndarray, cap: int) -> np.ndarray:
    """1 + the least common prefix in ``previous + 1 .. row`` of each row, 0 where nothing precedes."""
    out = np.zeros(len(rows), np.int32)
    has = np.flatnonzero(previous >= 0)
    if len(has):
        # Least values over ranges by doubling: spans of a power of two cover each range.
        low, high = previous[has] + 1, rows[has] + 1
        step = np.floor(np.log2(np.maximum(high - low, 1))).astype(int)
        table, width = lcp.copy(), 0
        least = np.empty(len(has), np.int32)
        for k in range(int(step.max()) + 1):
            at = np.flatnonzero(step == k)
            least[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
            width = 1 << k
            if k < step.max():
                table = np.minimum(table, np.append(table[width:], np.full(width, np.iinfo(np.int32).max, np.int32)))[: len(lcp)]
        out[has] = np.minimum(least + 1, cap)
    return out


def build(documents: list[bytes], cap: int = 1 << 30, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol before, document, start, common prefix with the row above) of every suffix, in order.

    Suffixes are compared with their document's end as a mark below all symbols, earlier
    documents first.  The symbol before a whole document is -1.
    """
    n = len(documents)
    texts = [np.frombuffer(d, np.uint8) for d in documents]
    length = np.array([len(t) for t in texts], np.int64)
    before = lambda i, k: np.int16(texts[i][length[i] - k - 1]) if k < length[i] else np.int16(-1)
    with tempfile.TemporaryDirectory(dir=folder) as here:
        path = os.path.join(here, "rows")
        kind = np.dtype([("symbol", np.int16), ("document", np.int32), ("start", np.int64), ("lcp", np.int32)])
        rows = np.zeros(n, kind)
        rows["symbol"], rows["document"], rows["start"] = [before(i, 0) for i in range(n)], np.arange(n), length
        rows.tofile(path)
        place = np.arange(n)  # the row of each document's present suffix
        for k in range(int(length.max(initial=0))):
            rows = np.fromfile(path, kind)
            live = np.flatnonzero(length > k)
            order = np.argsort(rows["symbol"], kind="stable")
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            ended = int((rows["symbol"] < 0).sum())
            # Rows that begin with a mark come first; then one row for each symbol in the transform.
            target = n + rank[place[live]] - ended
            new = np.zeros(len(live), kind)
            new["symbol"], new["document"], new["start"] = [before(i, k + 1) for i in live], live, length[live] - k - 1
            previous = np.full(len(rows), -1, np.int64)
            same = rows["symbol"][order][1:] == rows["symbol"][order][:-1]
            previous[order[1:][same]] = order[:-1][same]
            merged = np.empty(len(rows) + len(live), kind)
            fresh = np.zeros(len(merged), bool)
            fresh[target] = True
            merged[target], merged[~fresh] = new, rows
            # The row after a new one may now have another neighbour: both are looked up.
            follow = np.flatnonzero(fresh | np.concatenate([[False], fresh[:-1]]))
            follow = follow[follow >= n]
            source = order[follow - n + ended]
            merged["lcp"][follow] = _after_smaller(rows["lcp"], previous[source], source, cap)
            place[live] = target
            shift = np.cumsum(fresh)
            rest = np.flatnonzero(length <= k)
            if len(rest):
                kept = np.flatnonzero(~fresh)
                place[rest] = kept[place[rest]]
            assert shift[-1] == len(live)
            merged.tofile(path + ".next")
            os.replace(path + ".next", path)
        rows = np.fromfile(path, kind)
    return rows["symbol"], rows["document"], rows["start"], rows["lcp"]


def repeated_windows(documents: list[bytes], length: int) -> set[tuple[int, int]]:
    """(document, start) of every window that starts anywhere else too: neighbours in suffix order that share ``length`` symbols."""
    _, document, start, lcp = build(documents, length)
    again = lcp >= length
    again[:-1] |= again[1:]
    return set(zip(document[again].tolist(), start[again].tolist(), strict=True))
