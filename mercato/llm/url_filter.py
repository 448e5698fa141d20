"""URL allow/block rules by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into expressions "host suffix + path
prefix", limited to the label counts and path lengths that occur in the
rules (a rule can fit no other).  Expressions meet the rules by an equi-join
on a short prefix of their SHA-256; the full digest confirms a meeting, and
the longest fitting rule decides.

Verdicts are computed once per distinct (host, path) and joined back, so a
host or page that holds a third of all rows is expanded once; verdicts are
written before they are joined back, and rows without a host are not joined.  The join side
of the rules is left to the optimizer, which broadcasts it when its size is
below the session's threshold and shuffles it otherwise.

Defined cases: a null URL or one without ``://`` has an empty host and path
and fits no rule.  Equal-length fitting rules: the longer host wins, then
``block``.  No fitting rule: ``default`` (allow).  Repeated rows each get a
result; an empty table or an empty rule list is fine.  Only the id and URL
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_HEX = 8  # hex digits of the join key: 32 bits
Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end; path: then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    table = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    rule = F.concat("rule_host", "rule_path")
    return table.select("verdict", rule.alias("rule"), F.length("rule_host").alias("host_len"),
                        _digest(rule).alias("digest"),
                        F.substring(_digest(rule), 1, SHORT_HEX).alias("short"))


def expressions(rules: Sequence[Rule]) -> Column:
    """Array of expressions of the columns ``host`` and ``path``, in the shapes that the rules have.

    A shape is (labels of the host suffix, characters of the path prefix).
    """
    shapes = sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})
    labels = F.size(F.split("host", r"\."))
    found = []
    for k, n in shapes:
        suffix = F.substring_index("host", ".", -k)
        fits = (labels >= k) & (F.length("path") >= n) & (F.length("host") > 0)
        found.append(F.when(fits, F.concat(suffix, F.substring("path", 1, n))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    places = rows.filter("host <> ''").select("host", "path").distinct()
    expanded = (places.select("host", "path", F.explode(expressions(rules)).alias("expression"))
                .withColumn("digest", _digest(F.col("expression")))
                .withColumn("short", F.substring("digest", 1, SHORT_HEX)))
    table = rule_table(spark, rules).withColumnRenamed("digest", "rule_digest")
    met = expanded.join(table, "short").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule").alias("l"), F.col("host_len"),
                    (F.col("verdict") == "block").cast("int").alias("b"), "rule", "verdict")
    # written before it is joined, so that its size is known and adaptive execution can split a hot place
    best = store(met.groupBy("host", "path").agg(F.max(rank).alias("best")), "url-best")
    placed = rows.filter("host <> ''").join(best, ["host", "path"], "left")
    out = placed.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    # rows without a host fit no rule and meet nothing
    rest = rows.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                                           F.lit(default).alias("verdict"))
    return out.unionByName(rest)
