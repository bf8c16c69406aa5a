"""Repeated byte strings across documents: every byte under a string of ``LENGTH`` bytes that starts anywhere else goes.

The named method (adding one symbol per document each round to a collection's
Burrows-Wheeler transform) is not used here: it takes as many passes over the whole
transform as a text, or a piece of one, has bytes.  README.md has the figures.  What it
would find, equal neighbours of at least ``LENGTH`` symbols in suffix order, is found by
comparing windows of ``LENGTH`` bytes under keys that equal windows share, in three steps
of the same form, each on what the one before left open:

1. *Runs.*  In each window the smallest hash of its 64-byte strings (the leftmost of
   equal ones) is its anchor.  Equal windows have equal anchors at equal places, and
   neighbouring windows mostly share theirs, so a text is a short list of runs of
   windows.  Their key is the anchor's hash; they also carry a hash of all their bytes
   and their shape.  A key that occurs once settles its runs: nothing in them repeats.
   Runs that are equal as a whole to another run repeat as a whole.
2. *Strips.*  What remains is cut into strips of up to ``STRIP`` windows, at fixed
   distances from the anchor.  All windows that can be in a strip hold the same middle
   bytes, so the key of a strip is (anchor, hash of the middle); it also carries a hash
   of all its bytes and its shape, and is settled like a run.
3. *Windows.*  Only strips whose middle repeats but which have no equal remain: at most
   one at each end of a repeat.  Their windows are counted by (anchor, hash).

Of equal runs or strips one goes on, for the others' comparison.  Every step is an
aggregation and a join with its result, whose rows are those that went in: the number of
rows follows the input and not the square of any group, there is one path for groups of
all sizes, and no group's rows have to meet in one task.  Two strings are equal where two
64-bit hashes are, that of the anchor and that of the string.

Null texts are empty.  Matches never cross documents.  Repeated rows are each other's
copies; rows are told apart by (id, text hash), which only rows with the same result
share.  Texts of any length are processed whole.  An empty table gives an empty result;
other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.workspace import tidy
from barloom.session import durable, release, ship_package

LENGTH = 200
ANCHOR = 64
#: Windows in a strip.
STRIP = 12
#: Tables are broadcast up to so many bytes in memory; beyond, their joins shuffle.
BROADCAST_BYTES = 96_000_000
#: Bytes in memory of a row of hashes, and of an entry of a list of runs or spans.
ROW_BYTES, ENTRY_BYTES = 64, 48
#: Windows that a Python worker gathers before it hands strips on.
BATCH_WINDOWS = 500_000
#: Longer texts are hashed piece by piece.
PIECE = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13
_SHAPE = np.array([0x165667B19E3779F9, 0xC2B2AE3D27D4EB4F], _U)
_PLACE = _U(PIECE * 2 - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


@lru_cache(1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd numbers for bytes; powers of the base and of its inverse, modulo 2**64."""
    letters = _mix(np.arange(1, 257, dtype=_U)) | _U(1)
    up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return letters, np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


class Hashes:
    """Hashes of any part of a byte string, from one running sum."""

    def __init__(self, data: np.ndarray):
        letters, up, self.down = _tables(1 << max(16, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(letters[data] * up[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, run hash, first window) of each run of one piece; the last ends with the piece."""
    h = Hashes(data)
    anchor = min(ANCHOR, length)
    grams = h.every(anchor)
    wide = length - anchor + 1
    m = len(grams)
    keyed = (grams & ~_PLACE) | np.arange(m, dtype=_U)
    table = np.concatenate([keyed, np.full(-m % wide, ~_U(0), _U)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: m - wide + 1], ahead[wide - 1 : m]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    region = _mix(h.parts(first, last + length) + (place - first).astype(_U) * _SHAPE[0] + (last - first).astype(_U) * _SHAPE[1])
    return grams[place], region, first


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a whole text.  Pieces of long texts overlap, so that each window is in one."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < length:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
    out = [(a, r, f + s) for s in range(0, len(x) - length + 1, PIECE) for a, r, f in [_runs(x[s : s + PIECE + length - 1], length)]]
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _ragged(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for ``size`` numbers each."""
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


class Strips(NamedTuple):
    """Strips of listed runs: which run, key and hash of all bytes, first window, hashes of the windows (``size`` each)."""

    run: np.ndarray
    key: np.ndarray
    region: np.ndarray
    first: np.ndarray
    size: np.ndarray
    hashes: np.ndarray


def strips(data: bytes, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> Strips:
    """The strips of the given runs (anchor hash, first and last window) of a text."""
    x = np.frombuffer(data, np.uint8)
    wide = min(ANCHOR, length)
    strip = min(STRIP, length - wide + 1)
    out = []
    for base in np.unique(first // PIECE).tolist():
        own = np.flatnonzero(first // PIECE == base)
        h = Hashes(x[base * PIECE : (base + 1) * PIECE + length - 1])
        low, high = first[own] - base * PIECE, last[own] - base * PIECE
        # The anchor stands at the first place in all windows of the run where its hash is found.
        tries = low + length - wide + 1 - high
        at = _ragged(high, tries)
        found = np.where(h.parts(at, at + wide) == np.repeat(anchor[own], tries), at, np.iinfo(np.int64).max)
        place = np.minimum.reduceat(found, np.cumsum(tries) - tries)
        size = high - low + 1
        window, run = _ragged(low, size), np.repeat(np.arange(len(own)), size)
        step = (place[run] - window) // strip
        opens = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (run[1:] != run[:-1])]))
        run, step, count = run[opens], step[opens], np.diff(np.append(opens, len(window)))
        start, middle = window[opens], place[run] - step * strip
        key = _mix(h.parts(middle, middle + length - strip + 1) + step.astype(_U) * _SHAPE[0])
        region = _mix(h.parts(start, start + count - 1 + length) + (place[run] - start).astype(_U) * _SHAPE[0] + (count - 1).astype(_U) * _SHAPE[1])
        out.append(Strips(own[run], key, region, start + base * PIECE, count, h.parts(window, window + length)))
    return Strips(*(np.concatenate(p) for p in zip(*out, strict=True)))


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def describe(docs: DataFrame, length: int) -> DataFrame:
    """(id, text_key, n, anchors, regions, firsts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = [], []
            for t in b.column(2):
                data = _bytes(t)
                n.append(len(data))
                found.append(runs(data, length))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int64) if k == 2 else np.concatenate([f[k] for f in found]).view(np.int64)))
                for k in range(3)
            ] if found else [pa.array([], pa.list_(pa.int64()))] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], names=["id", "text_key", "n", "anchors", "regions", "firsts"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy("suffix_dedup", run), f"id {kind}, text_key long, n long, anchors array<long>, regions array<long>, firsts array<long>")


def _strip_rows(listed: DataFrame, length: int) -> DataFrame:
    """A row for each strip of the runs listed with each text."""
    kind = listed.schema["id"].dataType.simpleString()
    schema = f"anchor long, key long, region long, shared boolean, id {kind}, text_key long, first long, size long, hashes array<long>"
    names = ["anchor", "key", "region", "shared", "id", "text_key", "first", "size", "hashes"]

    def batch(b: pa.RecordBatch, rows: list[tuple[int, Strips, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        join = lambda f: np.concatenate([f(r) for r in rows])
        size = join(lambda r: r[1].size)
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        take = pa.array(np.repeat([r[0] for r in rows], [len(r[1].key) for r in rows]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(join(lambda r: r[2][r[1].run])), pa.array(join(lambda r: r[1].key).view(np.int64)), pa.array(join(lambda r: r[1].region).view(np.int64)), pa.array(join(lambda r: r[3][r[1].run])),
                b.column(0).take(take), b.column(1).take(take), pa.array(join(lambda r: r[1].first)), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(join(lambda r: r[1].hashes).view(np.int64))),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            lists = b.column(3)
            ends, runs_ = lists.offsets.to_numpy(), lists.values
            fields = {k: runs_.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "shared", "first", "last")}
            for i, t in enumerate(b.column(2)):
                own = slice(ends[i], ends[i + 1])
                anchor, shared, first, last = (fields[k][own] for k in ("anchor", "shared", "first", "last"))
                found = strips(_bytes(t), anchor.view(_U), first, last, length)
                rows.append((i, found, anchor, shared))
                held += len(found.hashes)
                if held >= BATCH_WINDOWS:
                    yield batch(b, rows)
                    rows, held = [], 0
            if rows:
                yield batch(b, rows)

    return listed.mapInArrow(tidy("suffix_dedup", run), schema)


def _small(table: DataFrame, entries: int | None = None) -> DataFrame:
    """``table``, to be broadcast where it is known to be small enough."""
    size = table.count() * ROW_BYTES if entries is None else entries * ENTRY_BYTES
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def repeated_spans(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(list_id, list_key, own): what goes from each text, as maximal spans.  Takes ``rows`` and releases it."""
    span = lambda t, last: t.select("id", "text_key", F.col("first").alias("start"), (last + length).alias("end"))
    held: list[DataFrame] = []

    def keep(table: DataFrame, name: str) -> DataFrame:
        held.append(durable(table, name))
        return held[-1]

    def merged(*spans: DataFrame) -> DataFrame:
        out = durable(merged_spans(reduce(DataFrame.unionByName, spans)), "spans")
        for t in held:
            release(t)
        return out

    spread = rows.select("id", "text_key", "n", "anchors", "regions", "firsts", F.posexplode("firsts").alias("i", "first")).select(
        "id", "text_key", F.expr("anchors[i]").alias("anchor"), F.expr("regions[i]").alias("region"), "first",
        F.expr(f"coalesce(get(firsts, i + 1), n - {length} + 1) - 1").alias("last"),
    )
    repeats = (F.count(F.lit(1)).alias("n"), F.min("region").alias("low"), F.max("region").alias("high"))
    mixed = (F.col("low") != F.col("high")).alias("mixed")

    # Runs.
    anchors = keep(spread.groupBy("anchor").agg(*repeats).where("n > 1").select("anchor", mixed), "anchors")
    near = keep(spread.join(_small(anchors), "anchor"), "near")
    release(rows)
    classes = keep(near.where("mixed").groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "text_key", "first", "last")).alias("at")), "classes")
    equal = keep(classes.where("n > 1").select("anchor", "region"), "equal")
    whole = near.where("not mixed").unionByName(near.where("mixed").join(_small(equal), ["anchor", "region"]).select(near.columns))
    runs_ = span(whole, F.col("last"))
    open_ = classes.groupBy("anchor").agg(F.min("n").alias("least")).where("least = 1").select("anchor")
    one = F.struct("anchor", (F.col("n") > 1).alias("shared"), F.col("at.first").alias("first"), F.col("at.last").alias("last"))
    lists = classes.join(open_, "anchor").groupBy(F.col("at.id").alias("list_id"), F.col("at.text_key").alias("list_key")).agg(F.sort_array(F.collect_list(one)).alias("own"))
    lists = keep(lists, "lists")
    entries = lists.agg(F.sum(F.size("own")).alias("n")).first()["n"]
    if not entries:
        return merged(runs_)

    # Strips.
    listed = _with_lists(docs, lists, "inner", entries).select("id", "text_key", "text", "own")
    cut_up = keep(_strip_rows(listed, length), "strips")
    keys = keep(cut_up.groupBy("anchor", "key").agg(*repeats).where("n > 1").select("anchor", "key", mixed), "keys")
    met = keep(cut_up.join(_small(keys), ["anchor", "key"]), "met")
    held.remove(cut_up)
    release(cut_up)
    last = F.col("first") + F.col("size") - 1
    split = met.where("mixed")
    one = F.struct("shared", "id", "text_key", "first", "hashes")
    kinds = keep(split.groupBy("anchor", "key", "region").agg(F.count(F.lit(1)).alias("n"), F.first(one).alias("at")), "kinds")
    equal = keep(kinds.where("n > 1").select("anchor", "key", "region"), "equal")
    strips_ = span(met.where("not mixed and not shared"), last).unionByName(span(split.where("not shared").join(_small(equal), ["anchor", "key", "region"]), last))

    # Windows.
    single = kinds.select("anchor", (F.col("at.shared") | (F.col("n") > 1)).alias("shared"), "at.id", "at.text_key", F.col("at.first").alias("from"), F.posexplode("at.hashes").alias("i", "window"))
    twice = keep(single.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window"), "twice")
    hit = single.where("not shared").join(_small(twice), ["anchor", "window"]).withColumn("first", F.col("from") + F.col("i"))
    return merged(runs_, strips_, span(hit, F.col("first")))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str, entries: int) -> DataFrame:
    lists = _small(lists, entries)
    return docs.join(lists, docs["text_key"].eqNullSafe(lists["list_key"]) & docs["id"].eqNullSafe(lists["list_id"]), how)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(list_id, list_key, own): the maximal spans of each text."""
    text = Window.partitionBy("id", "text_key").orderBy("start", "end")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(F.col("id").alias("list_id"), F.col("text_key").alias("list_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("own"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = durable(describe(docs, length), "runs")
    lists = repeated_spans(docs, rows, length)
    entries = lists.agg(F.sum(F.size("own")).alias("n")).first()["n"] or 0
    joined = _with_lists(docs, lists, "left", entries + lists.count()).select("id", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("n", "removed", "spans", "sha", "kept")}
            for t, own in zip(b.column(1), b.column(2), strict=True):
                data, spans = _bytes(t), own.as_py() or ()
                kept, at = [], 0
                for s in spans:
                    kept.append(data[at : s["start"]])
                    at = s["end"]
                rest = b"".join(kept) + data[at:] if spans else data
                out["n"].append(len(data))
                out["removed"].append(len(data) - len(rest))
                out["spans"].append(len(spans))
                out["sha"].append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    out["kept"].append(rest)
            columns = [b.column(0), pa.array(out["n"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["spans"], pa.int64()), pa.array(out["sha"], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(out["kept"], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(tidy("suffix_dedup", run), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
