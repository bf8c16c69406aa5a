"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and of code
points above U+007F.  A window is ten consecutive words of an item (the whole
item, if it has fewer).  A document word is hit if an occurrence of any window
covers it.

A window is a set of *shingles* (runs of three words with their position in the
window; runs of one or two words for windows that short).  A document contains the
window only if it contains every one of them, so the prefix that must be joined is
a single shingle: the rarest one, by its count over all documents.  Each document
shingle that equals some window's rarest shingle is a candidate; its position in
the document fixes where the window would have to start (positional bound) and
whether it would fit (length bound), and only then are the words compared one by
one.

The windows of the benchmark are broadcast while there are at most
``BROADCAST_WINDOWS`` of them.  A larger benchmark is joined by shingle, with thin
rows: candidates then meet their documents in a second join.

Results depend on the text alone, so they are computed per distinct text and joined
back; copies in any number cost one row each.  Null texts have no words.  Repeated
rows and null ids each get their result.  Extra columns pass through; the added
names replace any that clash.  Helper columns that meet the input's begin with two
underscores; names of that form are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import durable

WINDOW = 10
SHINGLE = 3
#: A window row is below 1 kB, so at most 100 MB are broadcast.
BROADCAST_WINDOWS = 100_000
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")

_SEPARATORS = "".join(chr(c) for c in range(0x80) if not (chr(c).isdigit() or chr(c).isalpha()))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Lower-cased words; one pass maps every separator to a space and A-Z to a-z."""
    flat = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(flat, " "), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """Distinct (item, words) windows."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.expr(f"slice(w, s + 1, {size})").alias("words")).distinct()


def _shingle(words: str, at: str, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.expr(f"get({words}, {at} + {k})") for k in range(width)])


def window_shingles(windows: DataFrame, widths: list[int]) -> DataFrame:
    """(item_id, words, offset, shingle) for every shingle of every window."""
    out = None
    for width in widths:
        own = windows.where(F.size("words") >= SHINGLE) if width == SHINGLE else windows.where(F.size("words") == width)
        own = own.select("item_id", "words", F.explode(F.expr(f"sequence(0, size(words) - {width})")).alias("offset"))
        own = own.withColumn("shingle", _shingle("words", "offset", width))
        out = own if out is None else out.unionByName(own)
    return out


def document_shingles(texts: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """(keep..., w, pos, shingle) for every shingle of every text; ``w`` is the array of its words."""
    spread = texts.select(*keep, "w", F.posexplode("w").alias("pos", "__word"))
    if len(widths) == 1:
        return spread.withColumn("shingle", _shingle("w", "pos", widths[0])).drop("__word")
    return spread.withColumn("shingle", F.explode(F.array(*[_shingle("w", "pos", k) for k in widths]))).drop("__word")


def find_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_limit: int = BROADCAST_WINDOWS
) -> DataFrame:
    """(text_key, start, n, item_id): every verified occurrence of a window in a distinct text."""
    windows = durable(item_windows(items, item_id, item_text), "windows")
    sizes = windows.groupBy(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).count().collect()  # at most three rows
    widths = sorted(r["k"] for r in sizes)
    total = sum(r["count"] for r in sizes)
    small = total <= broadcast_limit
    hint = F.broadcast if small else (lambda x: x)
    texts = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    if not widths:
        return texts.select("text_key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("item_id")).where(F.lit(False))

    pieces = window_shingles(windows, widths)
    wanted = pieces.select("shingle").distinct()
    counts = (
        document_shingles(texts.drop("text_key"), widths, []).select("shingle").join(hint(wanted), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    )
    rarest = F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("df", F.lit(0)), "offset"))
    prefix = (
        pieces.join(counts, "shingle", "left").groupBy("item_id", "words").agg(rarest.alias("r"), F.max("df").alias("seen"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
        # a window with a shingle that occurs nowhere can't occur
        .where("least > 0").select(F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), "item_id", "words")
        .groupBy("shingle", "offset", "words").agg(F.collect_set("item_id").alias("items"))
    )
    prefix = durable(prefix, "prefix")
    start, n = F.col("pos") - F.col("offset"), F.size("words")
    fits = (start >= 0) & (start + n <= F.size("w"))
    same = F.expr("slice(w, pos - offset + 1, size(words)) = words")
    if small:
        # The bounds come first, so that slice() never sees a start before the first word.
        found = (
            document_shingles(texts, widths, ["text_key"]).join(F.broadcast(prefix), "shingle").where(F.when(fits, same).otherwise(False))
            .select("text_key", start.alias("start"), n.alias("n"), "items")
        )
    else:
        thin = document_shingles(texts, widths, ["text_key"]).select("text_key", "pos", F.size("w").alias("n_words"), "shingle")
        near = thin.join(prefix, "shingle").where((start >= 0) & (start + n <= F.col("n_words"))).drop("shingle", "n_words").distinct()
        found = near.join(texts.dropDuplicates(["text_key"]), "text_key").where(F.when(fits, same).otherwise(False)).select("text_key", start.alias("start"), n.alias("n"), "items")
    return found.distinct().select("text_key", "start", "n", F.explode("items").alias("item_id"))


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, contaminated``; items are sorted as strings."""
    hits = durable(find_hits(docs, items, text_col, **options), "hits")
    by_end = Window.partitionBy("text_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("text_key", "start", "n").distinct().withColumn("until", F.coalesce(F.max(F.col("start") + F.col("n")).over(by_end), F.lit(0)))
        .groupBy("text_key").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "until"))).cast("bigint").alias("n_hit"))
    )
    which = hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = covered.join(which, "text_key").select(F.col("text_key").alias("__hit_key"), F.col("n_hit").alias("__n_hit"), F.col("items").alias("__items"))
    names = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(*names, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__key"), F.size(words_of(F.col(text_col))).cast("bigint").alias("__n_words"))
    return keyed.join(result, F.col("__key") == F.col("__hit_key"), "left").select(
        *names, F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(F.size("__items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("__n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs.

    Only the digests of contaminated texts are joined with the rows.
    """
    hits = durable(find_hits(docs, items, text_col, **options).select(F.col("text_key").alias("__hit_key")).distinct(), "hit-texts")
    if hits.count() <= 1_000_000:  # 100 MB of digests
        hits = F.broadcast(hits)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.withColumn("__key", key).join(hits, F.col("__key") == F.col("__hit_key"), "left_anti").select(*docs.columns)


ORACLE = r"""
with
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, list_slice(w, s, s + least(10, len(w)) - 1) as win, least(10, len(w)) as n
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from bw where len(w) > 0)),
ns as (select distinct n from win),
dpos as (select doc_id, w, s from (select doc_id, w, unnest(range(1, len(w) + 1)) as s from dw)),
dwin as (select doc_id, s, n, list_slice(w, s, s + n - 1) as win from dpos join ns on s + n - 1 <= len(w)),
hit as (select doc_id, s, win.n as n, item_id from dwin join win on dwin.win = win.win),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov using (doc_id) left join it using (doc_id)
"""
