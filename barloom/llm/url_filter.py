"""URL filter lists, matched the way hash-prefix blocklists are.

Each rule is a host and a path prefix.  A rule fits a URL when its host is the
URL's host or a parent domain of it and the URL's path starts with the rule's
path; of the rules that fit, the one with the longest ``host + path`` decides.

Every URL is expanded into host-suffix x path-prefix expressions, but only for
the (label count, path length) pairs that occur in the rule list, so the
expansion is bounded by the rules and not by the URL.  Expressions and rules
meet in equi-joins on the first four bytes of their SHA-256, with the full digest
compared there, and rule precedence is settled per URL.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; repeated rows each get their verdict; no rule means the default
verdict (``allow``: a filter list blocks what it names); extra columns pass
through, and ``host, path, rule, verdict`` replace columns of those names (names
that begin with two underscores are reserved).  An empty rule list gives every URL
the default, an empty table an empty result.  Of rules with the same host and path
the last one holds.  URLs of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
DEFAULT_RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The rule table is broadcast up to this many rows (about 25 MB); beyond it the join shuffles.
BROADCAST_RULES = 200_000
#: Up to so many shapes (label count, path length) are joined one by one.
JOINED_SHAPES = 32
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES,
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``."""
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    judged = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if not rules:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))

    table = {h.lower() + p: ((h.count(".") + 1, len(p)), v) for v, h, p in rules}
    shapes = sorted({shape for shape, _ in table.values()}, key=lambda s: (-sum(s), s))
    listed = spark.createDataFrame([(f"{k}:{n}", r, v) for r, ((k, n), v) in sorted(table.items())], "__shape string, __rule string, __verdict string")
    listed = listed.withColumn("__digest", F.sha2("__rule", 256)).withColumn("__prefix", F.substring("__digest", 1, PREFIX_HEX))
    if len(table) <= BROADCAST_RULES and len(shapes) <= JOINED_SHAPES:
        found = _by_shape(judged, listed, shapes)
    else:
        found = _by_expression(judged, F.broadcast(listed) if len(table) <= BROADCAST_RULES else listed, shapes)
    return found.select(*pages.columns, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def _expression(labels: int, size: int) -> Column:
    """The URL's last ``labels`` host labels and first ``size`` characters of its path; null for shorter paths."""
    return F.when(F.length("path") >= size, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, size)))


def _by_shape(judged: DataFrame, listed: DataFrame, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """One join for each shape; a URL meets one rule of a shape at most, so rows stay as they are and nothing shuffles."""
    found, best = judged, []
    for i, (k, n) in enumerate(shapes):
        one = F.col(f"__rule_{i}")
        own = F.broadcast(listed.where(F.col("__shape") == f"{k}:{n}")).select(
            F.col("__prefix").alias(f"__prefix_{i}"), F.col("__digest").alias(f"__digest_{i}"), F.struct(F.length("__rule").alias("n"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict")).alias(f"__rule_{i}")
        )
        found = found.withColumn("__digest", F.sha2(_expression(k, n), 256))
        met = (F.substring("__digest", 1, PREFIX_HEX) == F.col(f"__prefix_{i}")) & (F.col("__digest") == F.col(f"__digest_{i}"))
        found = found.join(own, met, "left").drop("__digest", f"__prefix_{i}", f"__digest_{i}")
        best.append(one)
    # Two rules that fit and have one length are one rule (a host's suffix and a path's prefix of given lengths), but for shapes that add up alike.
    return found.withColumn("__best", F.greatest(*best) if len(best) > 1 else best[0])


def _by_expression(judged: DataFrame, listed: DataFrame, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """All expressions of each distinct URL in one join, for long lists of many shapes."""
    best = (
        judged.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_distinct(F.array_compact(F.array(*[_expression(k, n) for k, n in shapes])))).alias("__expression"))
        .withColumn("__digest_of_url", F.sha2("__expression", 256)).withColumn("__prefix", F.substring("__digest_of_url", 1, PREFIX_HEX))
        .join(listed, "__prefix").where(F.col("__digest_of_url") == F.col("__digest"))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("__rule").alias("n"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))).alias("__best"))
    )
    return judged.join(best, ["host", "path"], "left")


ORACLE = r"""
with u as (
  select page_id, coalesce(url, '') as url from pages),
h as (
  select page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from u),
r(rule_verdict, rhost, rpath) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
         arg_max(rule_verdict, length(rhost || rpath)) as rule_verdict
  from (select distinct host, path from h) d
  join r on (d.host = rhost or ends_with(d.host, '.' || rhost)) and starts_with(d.path, rpath)
  group by host, path)
select page_id, h.host, h.path, rule, coalesce(rule_verdict, 'allow') as verdict
from h left join best using (host, path)
"""
