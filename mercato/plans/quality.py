"""Data-quality audits: declared constraints and documented references.

Spark does not enforce keys on Parquet, so the constraints the source
schema declares become reports.  Each table is read once per rule
family; duplicate keys are found with a grouped count (partial
aggregation map-side), orphans with a left anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import count_where
from mercato.plans.facts import Tables
from mercato.session import at_once
from mercato.sources.schemas import (MAX_LENGTHS, PRIMARY_KEYS, RANGE_CHECKS, REFERENCES,
                                     SCHEMAS)


def _one_row(table: str, rule: str, n_col: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     F.coalesce(F.col(n_col).cast("bigint"), F.lit(0).cast("bigint")).alias("n_violations"))


def _row_checks(table: str) -> list[tuple[str, Column]]:
    checks = [(f"not_null({f.name})", F.col(f.name).isNull())
              for f in SCHEMAS[table].fields if not f.nullable]
    checks += [(f"max_length({c}) <= {n}", F.length(F.col(c)) > n)
               for c, n in MAX_LENGTHS.get(table, {}).items()]
    checks += [(f"check({c} between {lo} and {hi})", ~F.col(c).between(lo, hi))
               for t, c, lo, hi in RANGE_CHECKS if t == table]
    return checks


def row_rules(table: str) -> list[tuple[str, Column]]:
    """The NOT NULL and CHECK rules of a table, each true for a row that breaks it."""
    return [(rule, F.coalesce(broken, F.lit(False))) for rule, broken in _row_checks(table) if not rule.startswith("max_length")]


def constraint_audit(t: Tables, keys: bool = True) -> DataFrame:
    """table_name, rule, n_violations for PK uniqueness, NOT NULL, CHECK and length rules.

    Per table: one grouped count for the key (partial aggregation map-side)
    and one single-pass aggregate for all row rules, unpivoted with stack.
    """
    parts = []
    for table in sorted(t):
        df = t[table]
        pk = PRIMARY_KEYS.get(table)
        if pk and keys:
            parts.append(_one_row(table, f"primary_key({', '.join(pk)})", "n",
                                  duplicate_keys(df, pk).agg(F.sum(F.col("c") - 1).alias("n"))))
        checks = _row_checks(table)
        if checks:
            agg = df.agg(*[count_where(cond).alias(f"c{i}") for i, (_, cond) in enumerate(checks)])
            pairs = [x for i, (rule, _) in enumerate(checks) for x in (F.lit(rule), F.col(f"c{i}"))]
            long = agg.select(F.stack(F.lit(len(checks)), *pairs).alias("rule", "n"))
            parts.append(long.select(F.lit(table).alias("table_name"), "rule",
                                     F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n_violations")))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)


def require_unique_keys(t: Tables) -> None:
    """Raise if a table breaks its declared primary key (run by the loads, after writing)."""
    found = {name: duplicate_keys(df, PRIMARY_KEYS[name]).limit(3) for name, df in t.items() if PRIMARY_KEYS.get(name)}
    if not found:
        return
    rows = at_once(next(iter(found.values())).sparkSession, [df.collect for df in found.values()])
    broken = {name: [tuple(r) for r in some] for name, some in zip(found, rows) if some}
    if broken:
        raise ValueError(f"duplicate primary keys (key, rows): {broken}")


def require_constraints(t: Tables, lengths: bool = False) -> None:
    """Raise if a table breaks a declared key, NOT NULL or CHECK rule, with ``lengths`` a declared length too.

    Loads run it on what they have written, before they publish it.
    """
    require_unique_keys(t)
    broken = constraint_audit(t, keys=False).filter("n_violations > 0")
    if not lengths:
        broken = broken.filter(~F.col("rule").startswith("max_length"))
    broken = [(r["table_name"], r["rule"], r["n_violations"]) for r in broken.collect()]
    if broken:
        raise ValueError(f"broken constraints (table, rule, rows): {broken}")


def orphan_audit(t: Tables) -> DataFrame:
    """child, parent, n_orphans: child rows whose non-NULL reference has no parent row."""
    parts = []
    for child, ccol, parent, pcol in REFERENCES:
        keys = t[parent].select(F.col(pcol).alias(ccol))
        # child rows are counted per key first: a hot key reaches the join as one row a task
        counted = t[child].select(ccol).filter(F.col(ccol).isNotNull()).groupBy(ccol).agg(F.count(F.lit(1)).alias("n"))
        orphans = counted.join(keys, ccol, "left_anti")
        parts.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_orphans")).select(
            F.lit(f"{child}.{ccol}").alias("child"), F.lit(f"{parent}.{pcol}").alias("parent"),
            "n_orphans"))
    return reduce(DataFrame.unionByName, parts)
