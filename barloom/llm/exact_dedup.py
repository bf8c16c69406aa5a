"""Exact duplicates by a two-pass Bloom filter, in DataFrame operations only.

Texts are equal when they are identical after every ASCII white-space character
(tab to carriage return, and space) is deleted.

Pass one counts, per 64-bit filter block, how often each bit mask of a text hash
occurs and keeps the masks that occur at least twice: a register-blocked Bloom
filter of the *possibly repeated* hashes.  Its shuffle carries eight-byte masks
that are already summed on the map side, so a mask shared by a third of all rows
costs one row per task.  Pass two probes every row against that filter.  Rows it
rejects are certainly unique and pass straight through; only the rest are shuffled
by their SHA-256 digest, and only with their keys.

The filter holds repeated hashes only.  Up to ``BROADCAST_BLOCKS`` blocks it is
broadcast; a larger one is joined by block, with the text left behind.

Of equal texts the row with the most code points stays, then the smallest
``doc_id`` (null ids last), then the smallest hash of the whole row; of rows
identical in every column one is kept.  A null text counts as empty.  Columns of
the input pass through; the added names replace any that clash.  Helper columns begin
with two underscores; names of that form are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import durable

#: Address space of the filter in 64-bit blocks.
FILTER_BLOCKS = 1 << 32
#: Filters of at most this many stored blocks (16 bytes each) are broadcast.
BROADCAST_BLOCKS = 2_000_000
#: The code points \x20 and \x09-\x0D.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    # The digest is computed once; block and mask are taken from its bits.
    h1 = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("bigint")
    bits = [F.conv(F.substring("text_sha256", 16 + 2 * i, 2), 16, 10).cast("int") % 64 for i in range(3)]
    mask = F.lit(0).cast("bigint")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
    return (
        docs.drop(*ADDED)
        .withColumn("text_sha256", F.sha2(normalised(F.col(text_col)), 256))
        .withColumn("__block", h1 % FILTER_BLOCKS)
        .withColumn("__mask", mask)
    )


def repeat_filter(keyed: DataFrame) -> DataFrame:
    """(__at, __bits), block and bits: the Bloom filter of hashes that may occur more than once."""
    return (
        keyed.groupBy("__block", "__mask")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.col("__block").alias("__at"))
        .agg(F.bit_or("__mask").alias("__bits"))
    )


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``keep_id, group_size, kept, text_sha256``.

    With ``payload=False`` only the id, those four columns and the columns ``carry``
    are returned, and no text takes part in any shuffle.
    """
    names = [c for c in docs.columns if c not in ADDED] if payload else [id_col, *carry]
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    keyed = (
        _keyed(docs, text_col)
        .withColumn("__rank", F.struct((-length).alias("n"), F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.xxhash64(*[c for c in docs.columns if c not in ADDED]).alias("h")))
        .select(*names, "text_sha256", "__block", "__mask", "__rank")
    )
    if not payload:
        # Keys only (about 100 bytes a row): written once, so that each text is read and hashed once.
        keyed = durable(keyed, "keys")
    bloom = durable(repeat_filter(keyed.select("__block", "__mask")), "repeat-filter")
    if bloom.count() <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    probed = keyed.join(bloom, keyed["__block"] == bloom["__at"], "left").withColumn(
        "__maybe", F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    ).drop("__at", "__bits", "__block", "__mask")

    unique = probed.where(~F.col("__maybe")).select(
        *names, F.col(id_col).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.where("__maybe")
    groups = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min("__rank").alias("__best"))
    joined = maybe.join(groups, "text_sha256").withColumn("__first", F.col("__rank") == F.col("__best"))
    # Rows identical in every column share the best rank; number only those, which are one a group as a rule.
    losers = joined.where(~F.col("__first")).withColumn("kept", F.lit(False))
    winners = joined.where("__first").withColumn(
        "kept", F.row_number().over(Window.partitionBy("text_sha256").orderBy("__rank")) == 1
    )
    repeated = losers.unionByName(winners).select(
        *names, F.col("__best.id").alias("keep_id"), "group_size", "kept", "text_sha256"
    )
    return unique.unionByName(repeated)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had.

    Keys are decided first, without the text.  The ranks of the rows that go are then
    removed by an anti-join; they are broadcast while there are at most
    ``BROADCAST_BLOCKS`` of them.  Rows identical in every column share a rank: those,
    if any, are taken out with the others and one of each is put back.
    """
    rank = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns], F.lit(3))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("h"), rank.alias("g")))
    marked = mark_exact_duplicates(keyed.select(id_col, text_col, "__row"), id_col, text_col, payload=False, carry=("__row",))
    repeated = marked.where("group_size > 1").groupBy("__row").agg(F.count(F.lit(1)).alias("copies"), F.max("kept").alias("stays")).where("not stays or copies > 1")
    fate = durable(repeated, "fate")
    hint = F.broadcast if fate.count() <= BROADCAST_BLOCKS else (lambda x: x)
    rest = keyed.join(hint(fate), "__row", "left_anti")
    again = keyed.join(hint(fate.where("stays")), "__row", "left_semi").dropDuplicates(["__row"])
    return rest.unionByName(again).select(*docs.columns)


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
         row_number() over w = 1 as kept
  from t window w as (partition by text_sha256 order by length(text) desc, doc_id))
select doc_id, keep_id, group_size, kept, text_sha256 from g
"""
