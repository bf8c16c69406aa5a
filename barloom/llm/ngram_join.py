"""Jaccard self-join of documents on word n-gram sets, by count vectors in R-trees.

A document's set holds its distinct three-word shingles (hashed to 64 bits); equal sets
are one *class*, and all that follows is done once a class.  Two sets link when
``100 * |A & B| >= 90 * |A | B|``, that is when they differ in at most
``(|A| + |B|) / 19`` shingles.

1. *Co-location.*  Shingles are hashed into groups (ranges of the hash), more groups
   than two linked sets of that size can differ in.  So linked sets agree on the whole
   content of at least one non-empty group, and its signature is a key to meet under.
   A passage that many documents share fills no group alone and makes no hot key.  Sets
   that are small, or leave more groups empty than the scheme allows, are keyed by the
   prefix of their smallest hashes instead (two such sets that link share one).
   Sets under nine shingles link only with equal sets.
2. *Coarse parts.*  Under each key, neighbours in class order are joined into a chain
   (never all pairs).  The parts connected by chains contain every link.
3. *First links.*  Each class is compared with the neighbour that it shares most keys
   with, exactly, on the sets.  This is linear and already joins most copies.
4. *R-tree search.*  In each coarse part that isn't yet one component, classes outside
   its largest component query R-trees over count vectors: shingles are hashed into 32
   groups, the counts are a point, and a box (or point) can only hold a partner if the
   summed coordinate minima reach ``9/19 * (|A| + |B|)``.  Boxes within the component of
   the query are skipped; surviving pairs are verified on the sets.  A part is cut into
   blocks of bounded bytes; every querying class meets every block that its size allows.

Links that would join what is joined already are not looked for, so copies in any
number cost no pairs, and no link between different components is lost.

These numbers are those of ``OP9``, the rule of the query: three words and 0.9.  A `Rule` of another
width and similarity gives its own; below 0.9 ``_link_by_prefix`` takes the place of steps 1 to 3.

Null texts and texts without words have an empty set and link with nothing.  A text with
fewer words than a shingle has its whole sequence as one shingle.  Repeated rows and null ids
take part as any row; a component is named by the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.components import connected_components
from barloom.llm.workspace import settle, tidy
from barloom.session import durable, release, ship_package

VECTOR = 32
#: Sets under this size are keyed by prefix, others by groups.
GROUPED_FROM = 64
SPARE = 3
#: Bytes of sets in a block of the R-tree search, and bytes of querying sets in a chunk.
BLOCK_BYTES = 24_000_000
#: Keys of representatives are broadcast up to this many (16 bytes each).
BROADCAST_KEYS = 4_000_000
#: Passes over the texts in which shingles are counted, so that a pass shuffles a part of them, and texts that a task cuts at a time.
SLICES = 3
ORDER_TEXTS = 2_048
#: Keys of up to so many classes give pairs; larger ones are chained and searched.
PAIRED = 64
LEAF = 32

_U = np.uint64
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)


class Rule(NamedTuple):
    """Sets of ``width``-word shingles link when their similarity is ``percent`` or more."""

    width: int = 3
    percent: int = 90

    @property
    def grouped(self) -> bool:
        """Whether hash groups hold enough shingles to be keys; the lower the similarity, the more groups there are."""
        return self.percent >= 90

    @property
    def apart(self) -> int:
        """Two linked sets differ in at most ``apart / total`` of their summed sizes."""
        return 100 - self.percent

    @property
    def total(self) -> int:
        return 100 + self.percent

    @property
    def least(self) -> int:
        """The smallest set that links with another than itself."""
        return -(-self.percent // self.apart)

    def smallest(self, n):
        """The size that a partner of ``n`` shingles has at least."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        """How many shingles, in any fixed order, must hold one of every partner."""
        return n - self.smallest(n) + 1

    def groups(self, most: int) -> int:
        """Groups for sets of up to ``most`` shingles, of which ``SPARE`` may be empty."""
        return 2 * most * self.apart // self.total + 1 + SPARE


OP9 = Rule()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def shingle_set(data: bytes, rule: Rule = OP9) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's UTF-8 bytes."""
    words = data.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    k = _factors(rule.width)
    if len(w) < rule.width:
        return _mix((w * k[: len(w)]).sum(keepdims=True) + _U(len(w)))
    last = len(w) - rule.width + 1
    return np.unique(_mix(sum((w[i : i + last] * k[i] for i in range(1, rule.width)), w[:last] * k[0])))


@lru_cache(16)
def _factors(width: int) -> np.ndarray:
    """One odd factor for each word of a shingle."""
    more = [_mix(_K[:1] + _U(i))[0] | _U(1) for i in range(3, width)]
    return np.concatenate([_K, np.array(more, _U)])[:width]


@lru_cache(1)
def _levels() -> list[int]:
    out = [GROUPED_FROM]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 3 // 2 + 1)
    return out


@lru_cache(4096)
def _edges(groups: int) -> np.ndarray:
    return np.array([(i << 64) // groups for i in range(1, groups)], _U)


def keys_of(h: np.ndarray, rule: Rule = OP9) -> np.ndarray:
    """Keys under which a set meets every set it links with."""
    n = len(h)
    if n < rule.least:
        return np.empty(0, _U)
    partner = n * 100 // rule.percent
    bounds = _levels()
    out, sparse = [], n < GROUPED_FROM
    if partner >= GROUPED_FROM:
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(h + _K[1]), dtype=_U)])
        own = max(0, int(np.searchsorted(bounds, n, "right")) - 1)
        last = int(np.searchsorted(bounds, partner, "right")) - 1
        for level in range(own, last + 1):
            groups = rule.groups(bounds[level + 1] - 1)
            cut = np.concatenate([[0], np.searchsorted(h, _edges(groups)), [n]])
            full = cut[1:] > cut[:-1]
            sparse = sparse or int(groups - full.sum()) > SPARE
            signature = sums[cut[1:]] - sums[cut[:-1]]
            out.append(_mix((signature ^ _mix(np.arange(groups, dtype=_U) + np.array([groups], _U) * _K[2]))[full]))
    if sparse:
        out.append(_mix(h[: rule.prefix(n)] ^ _K[0]))
    return np.concatenate(out)


def prefix_of(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], rule: Rule) -> np.ndarray:
    """The keys of a set by prefix, ``common`` shingles (sorted hashes, ranks) last: what ``_prefixes`` finds for one set."""
    if len(h) < rule.least:
        return np.empty(0, _U)
    hashes, ranks = common
    rank = np.zeros(len(h), np.int8)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        rank = np.where(hashes[at] == h, ranks[at], rank)
    return h[np.argsort(rank, kind="stable")[: rule.prefix(len(h))]]


def class_of(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([_mix(h + _K[0]).sum(dtype=_U), _mix(h ^ _K[2]).sum(dtype=_U) + _U(len(h))], _U).tobytes()


def short_of(h: np.ndarray, rule: Rule) -> np.ndarray:
    """64 bits that stand for a set; none, if it is too small to link with another."""
    return np.frombuffer(class_of(h), _U, 1) if len(h) >= rule.least else np.empty(0, _U)


def vector_of(h: np.ndarray) -> np.ndarray:
    return np.bincount((h & _U(VECTOR - 1)).astype(np.int64), minlength=VECTOR).astype(np.int32)


def links(a: np.ndarray, b: np.ndarray, rule: Rule = OP9) -> bool:
    """Whether two sorted sets link."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= rule.percent * (len(a) + len(b) - i)


class RTree:
    """Count vectors packed by size and then by their largest differences, with a box of maxima over each node."""

    def __init__(self, points: np.ndarray, component: list[int], rule: Rule = OP9):
        self.rule = rule
        sizes = points.sum(1)
        spread = points - np.outer(sizes, points.sum(0) / max(1, points.sum()))
        turn = spread @ np.linalg.svd(spread.astype(float), full_matrices=False)[2][0] if len(points) > LEAF else np.zeros(len(points))
        self.order = np.lexsort((turn, np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.05))))
        self.points, self.sizes = points[self.order], sizes[self.order]
        own = np.array(component)[self.order]
        level = (self.points, self.sizes, self.sizes, own)
        self.levels = []
        while len(level[0]) > LEAF or not self.levels:
            at = np.arange(0, len(level[0]), LEAF)
            mixed = np.minimum.reduceat(level[3], at) != np.maximum.reduceat(level[3], at)
            level = (
                np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at),
                np.where(mixed, -1, np.minimum.reduceat(level[3], at)),
            )
            self.levels.append(level)

    def search(self, q: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Numbers of the points whose bound admits a link; ``same[c]`` tells the components to skip."""
        n, (percent, total) = int(q.sum()), (self.rule.percent, self.rule.total)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most, own = (a[nodes] for a in self.levels[depth])
            open_ = (percent * n <= 100 * most) & (percent * least <= 100 * n) & ~((own >= 0) & same[own])
            open_ &= total * np.minimum(high, q).sum(1, dtype=np.int64) >= percent * (n + np.maximum(least, self.rule.smallest(n)))
            nodes = nodes[open_]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        fits = total * np.minimum(self.points[nodes], q).sum(1, dtype=np.int64) >= percent * (n + self.sizes[nodes])
        fits &= (percent * n <= 100 * self.sizes[nodes]) & (percent * self.sizes[nodes] <= 100 * n)
        return self.order[nodes[fits]]


def search_block(classes: list[bytes], sets: list[np.ndarray], component: list[bytes], queries: list[int], index: list[int], rule: Rule = OP9) -> list[tuple[bytes, bytes]]:
    """Verified links that join components, between ``queries`` and ``index`` (positions)."""
    if not queries or not index:
        return []
    names = {c: i for i, c in enumerate(dict.fromkeys(component))}
    own = [names[c] for c in component]
    root = np.arange(len(names))
    tree = RTree(np.stack([vector_of(sets[i]) for i in index]), [own[i] for i in index], rule)
    out = []
    for q in queries:
        mine = root[own[q]]
        for k in tree.search(vector_of(sets[q]), root == mine):
            i = index[k]
            other = root[own[i]]
            if other != mine and links(sets[q], sets[i], rule):
                out.append((classes[q], classes[i]))
                root[root == other] = mine
    return out


def _arrow(df: DataFrame, schema: str, f) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(tidy("ngram_join", f), schema)


def describe(docs: DataFrame, id_col: str, text_col: str, rule: Rule = OP9) -> DataFrame:
    """(id, text_key, n, class, keys) of every row; for a rule without groups, keys has the short name of a set that can link, and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, classes, keys = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", rule)
                n.append(len(h))
                classes.append(class_of(h) if len(h) else None)
                keys.append((keys_of(h, rule) if rule.grouped else short_of(h, rule)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), lists], names=["id", "text_key", "n", "class", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _arrow(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")), f"id {kind}, text_key long, n long, class binary, keys array<long>", run)


def _sets(texts: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", rule) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["class", "n", "set"])

    return _arrow(texts, "class binary, n long, set binary", run)


def _verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["u", "v"]).filter(pa.array([links(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), rule) for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_()))

    return _arrow(pairs.select("u", "v", "set_u", "set_v"), "u binary, v binary", run)


def _searched(tasks: DataFrame, rule: Rule) -> DataFrame:
    """Links found in each (part, block, chunk) task."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table["set"]]
        asks = table["asks"].to_pylist()
        found = search_block(table["class"].to_pylist(), sets, table["component"].to_pylist(), [i for i, a in enumerate(asks) if a], [i for i, a in enumerate(asks) if not a], rule)
        settle()
        return pa.table({"u": pa.array([x for x, _ in found], pa.binary()), "v": pa.array([y for _, y in found], pa.binary())})

    ship_package(tasks.sparkSession)
    return tasks.groupBy("part", "block", "chunk").applyInArrow(run, "u binary, v binary")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = OP9) -> DataFrame:
    """(id, text_key, n_shingles, group_key, component_id) for every row of ``docs``."""
    if not rule.grouped:
        return _link_by_prefix(docs, id_col, text_col, rule)
    rows = durable(describe(docs, id_col, text_col, rule), "rows")
    classes = rows.where(F.size("keys") > 0).dropDuplicates(["class"]).select("class", "text_key", F.explode("keys").alias("key"))
    under = Window.partitionBy("key").orderBy("class")
    chains = (
        classes.select("key", "class", F.lag("class").over(under).alias("before")).where("before is not null and before <> class")
        .groupBy(F.col("class").alias("u"), F.col("before").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    )
    chains = durable(chains, "chains")
    if chains.isEmpty():
        return _named(rows, None)

    parts = durable(connected_components(chains.select("u", "v")), "parts")
    sets = _sets_of(docs, text_col, rows, parts.select(F.col("node").alias("class")), rule)
    best = chains.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    first = durable(_verified(_with_sets(best, sets), rule), "links")
    joined = connected_components(first).select(F.col("node").alias("class"), "component")
    return _named(rows, connected_components(first.union(_search_parts(sets, parts, joined, rule))))


def _sets_of(docs: DataFrame, text_col: str, rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(class, n, set) of ``classes``; one text stands for each."""
    texts = rows.join(classes, "class").groupBy("class").agg(F.min("text_key").alias("text_key")).select("text_key").distinct()
    texts = durable(texts, "text-keys")
    if texts.count() <= BROADCAST_KEYS:
        texts = F.broadcast(texts)
    near = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    # The Python step of this branch reads text, so keep the hash out of it.
    return durable(_sets(near.join(texts, "text_key", "left_semi").select("text"), rule).dropDuplicates(["class"]), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("class").alias("u"), F.col("set").alias("set_u"))
    right = sets.select(F.col("class").alias("v"), F.col("set").alias("set_v"))
    return pairs.select("u", "v").join(left, "u").join(right, "v")


def _counted(docs: DataFrame, text_col: str, rule: Rule, part: int) -> DataFrame:
    """(short, key, sets) of the shingles of a slice that several sets have, with their exact number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, ORDER_TEXTS):
                shorts, keys = [np.empty(0, _U)], [np.empty(0, _U)]
                for t in b.column(0).slice(at, ORDER_TEXTS):
                    h = shingle_set(t.as_buffer().to_pybytes(), rule)
                    for short in short_of(h, rule).tolist():
                        if short not in seen:
                            seen.add(short)
                            keys.append(h[h % _U(SLICES) == _U(part)])
                            shorts.append(np.full(len(keys[-1]), short, _U))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (shorts, keys)], names=["short", "key"])

    cut = _arrow(docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()), "short long, key long", run)
    under = Window.partitionBy("key")
    once = cut.withColumn("before", F.lag("short").over(under.orderBy("short"))).where("before is null or before <> short")  # a set may come from several tasks
    return once.select("short", "key", F.count(F.lit(1)).over(under).alias("sets")).where("sets > 1")


def _prefixes(docs: DataFrame, text_col: str, rows: DataFrame, rule: Rule) -> DataFrame:
    """(class, n, key): the shingles in the prefix of each class that another class has too.

    The order of shingles is by their number of sets, over all documents, then by hash.  Those of one
    set come first and meet nothing, so only shared ones are shuffled by class.
    """
    slices = [durable(_counted(docs, text_col, rule, part), "shared") for part in range(SLICES)]
    shared = slices[0]
    for more in slices[1:]:
        shared = shared.union(more)
    own = Window.partitionBy("short")
    ranked = shared.withColumn("turn", F.row_number().over(own.orderBy("sets", "key"))).withColumn("shared", F.count(F.lit(1)).over(own))
    classes = rows.where(F.size("keys") > 0).dropDuplicates(["class"]).select("class", "n", F.col("keys")[0].alias("short"))
    # The prefix ends where fewer shingles are left than a partner must share.
    found = ranked.join(classes, "short").where(f"shared - turn + 1 >= floor(({rule.percent} * n + 99) / 100)")
    found = durable(found.select("class", "n", "key"), "prefixes")
    for used in slices:
        release(used)
    return found


def _link_by_prefix(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """As :func:`link_documents`, for similarities at which groups hold too few shingles.

    Sets meet under the prefix of their rarest shingles, which are counted over all documents.  Under a key of up to ``PAIRED`` classes
    all pairs are counted; of two linked sets, the one whose prefix ends first has there all but
    the shingles that it may have alone, so pairs that share fewer keys go.  Larger keys are joined by
    chains and searched as parts.
    """
    rows = durable(describe(docs, id_col, text_col, rule), "rows")
    classes = _prefixes(docs, text_col, rows, rule)
    under = Window.partitionBy("key")
    met = classes.withColumn("size", F.count(F.lit(1)).over(under)).withColumn("before", F.lag("class").over(under.orderBy("class"))).where("size > 1")
    met = durable(met, "met")
    release(classes)
    if met.isEmpty():
        return _named(rows, None)

    small, large = met.where(F.col("size") <= PAIRED), met.where(F.col("size") > PAIRED)
    a = small.select("key", F.col("class").alias("u"), F.col("n").alias("nu"))
    b = small.select("key", F.col("class").alias("v"), F.col("n").alias("nv"))
    sized = f"u < v and {rule.percent} * nu <= 100 * nv and {rule.percent} * nv <= 100 * nu"
    pairs = a.join(b, "key").where(sized).groupBy("u", "v", "nu", "nv").agg(F.count(F.lit(1)).alias("shared"))
    under_large = durable(large.groupBy("class").agg(F.count(F.lit(1)).alias("more")), "under-large")
    for x in "uv":
        pairs = pairs.join(under_large.select(F.col("class").alias(x), F.col("more").alias(f"more_{x}")), x, "left")
    both = F.floor((rule.percent * (F.col("nu") + F.col("nv")) + rule.total - 1) / rule.total)
    must = lambda n: F.floor((rule.apart * n) / 100) + 1 - (n - both)
    pairs = pairs.where(F.col("shared") + F.least(F.coalesce("more_u", F.lit(0)), F.coalesce("more_v", F.lit(0))) >= F.least(must(F.col("nu")), must(F.col("nv"))))
    pairs = kept = durable(pairs.select("u", "v", "shared"), "pairs")
    chains = large.where("before is not null").groupBy(F.col("class").alias("u"), F.col("before").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    chains = durable(chains, "chains")
    release(met)
    release(under_large)
    near = pairs.unionByName(chains)
    sets = _sets_of(docs, text_col, rows, near.select(F.col("u").alias("class")).union(near.select("v")).distinct(), rule)

    best = near.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    first = durable(_verified(_with_sets(best, sets), rule), "links")
    joined = durable(connected_components(first).select(F.col("node").alias("class"), "component"), "joined")
    for x in "uv":
        pairs = pairs.join(joined.select(F.col("class").alias(x), F.col("component").alias(f"component_{x}")), x, "left")
    open_ = pairs.where("component_u is null or component_v is null or component_u <> component_v")
    first = first.union(durable(_verified(_with_sets(open_, sets), rule), "links"))
    if not chains.isEmpty():
        parts = durable(connected_components(chains.select("u", "v")), "parts")
        joined = connected_components(first).select(F.col("node").alias("class"), "component")
        first = first.union(_search_parts(sets, parts, joined, rule))
    components = connected_components(first)
    for used in (sets, kept, chains):
        release(used)
    return _named(rows, components)


def _search_parts(sets: DataFrame, parts: DataFrame, joined: DataFrame, rule: Rule) -> DataFrame:
    """Links between components of a part: what is left are classes outside the largest component."""
    members = durable(
        sets.select("class", "n", F.length("set").alias("bytes")).join(parts.select(F.col("node").alias("class"), F.col("component").alias("part")), "class")
        .join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")), "members",
    )
    sizes = members.groupBy("part", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("part").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("components"))
    open_ = members.join(largest.where("components > 1"), "part").withColumn("asks", F.col("component") != F.col("largest"))
    by_size = lambda *p: Window.partitionBy(*p).orderBy("n", "class").rowsBetween(Window.unboundedPreceding, 0)
    placed = open_.withColumn("block", F.floor(F.sum("bytes").over(by_size("part")) / BLOCK_BYTES)).withColumn("chunk", F.floor(F.sum("bytes").over(by_size("part", "asks")) / BLOCK_BYTES))
    placed = durable(placed, "placed")
    blocks = placed.groupBy("part", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    chunks = placed.where("asks").groupBy("part", "chunk").agg(F.min("n").alias("from"), F.max("n").alias("to"))
    meets = blocks.join(chunks, "part").where(f"{rule.percent} * low <= 100 * to and {rule.percent} * from <= 100 * high").select("part", "block", "chunk")
    data = sets.select("class", "set")
    tasks = (
        placed.drop("chunk").join(meets, ["part", "block"]).select("part", "block", "chunk", "class", "component", F.lit(False).alias("asks"))
        .unionByName(placed.where("asks").drop("block").join(meets, ["part", "chunk"]).select("part", "block", "chunk", "class", "component", F.lit(True).alias("asks")))
        .join(data, "class")
    )
    return durable(_searched(tasks, rule), "more-links")


def _named(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        keyed = rows.withColumn("group_key", F.col("class"))
    else:
        named = components.select(F.col("node").alias("class"), "component")
        keyed = rows.join(named, "class", "left").withColumn("group_key", F.coalesce("component", "class"))
    thin = keyed.select("id", "text_key", F.col("n").alias("n_shingles"), "group_key")
    least = thin.where("group_key is not null").groupBy("group_key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    return thin.join(least, "group_key", "left").select("id", "text_key", "n_shingles", "group_key", F.coalesce("least", "id").alias("component_id"), F.coalesce("size", F.lit(1)).alias("size"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = OP9) -> DataFrame:
    """One row of each group of linked documents: the smallest id, then the smallest text hash.

    Rows that go are few as a rule and are removed by an anti-join on (id, text hash).
    """
    linked = link_documents(docs, id_col, text_col, rule).where("size > 1")
    counted = linked.groupBy("group_key", "id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("absent"), "id", "text_key")
    best = counted.groupBy("group_key").agg(F.min(rank).alias("best"))
    fate = durable(counted.join(best, "group_key").select("id", "text_key", (rank == F.col("best")).alias("stays"), "copies").where("not stays or copies > 1"), "fate")
    hint = F.broadcast if fate.count() <= BROADCAST_KEYS else (lambda x: x)
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    match = lambda right: keyed["__key"].eqNullSafe(right["text_key"]) & keyed[id_col].eqNullSafe(right["id"])
    rest = keyed.join(hint(fate), match(fate), "left_anti")
    twice = fate.where("stays")
    again = keyed.join(hint(twice), match(twice), "left_semi").dropDuplicates([id_col, "__key"])
    return rest.unionByName(again).select(*docs.columns)


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, len(s)::bigint as n from s),
x as (select doc_id, unnest(s) as g from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 90 * (na.n + nb.n - i)),
r as (select doc_id as a, doc_id as root from n union select l.b, r.root from r join l on l.a = r.a)
select doc_id, n as n_shingles, min(root) as component_id from n join r on r.a = doc_id group by doc_id, n
"""
