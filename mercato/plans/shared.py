"""Work that several reports of one run share.

A run of many reports reads the same tables again and again, shuffles them on
``order_id`` for every join and derives the same facts.  Here the reports are
first planned (nothing runs), and what they have in common is written once:

* **Co-bucketed tables.** The planned exchanges on ``order_id`` are counted over
  all reports.  If there are more than ``MOVES`` for each order-grain table, a
  rewrite that moves every row once is cheaper than the run's moves: the four
  tables are written in buckets of ``order_id``, sorted by it, with one number of
  buckets, and joins and aggregates on it need no exchange any more.
* **Shared facts.** A fact (``facts.shared_fact``) that at least ``USERS`` of the
  reports ask for is derived and written once, in the same buckets; a fact with
  one user stays part of that report's plan.

Both are copies in the checkpoint folder; the reports' results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from mercato.plans import facts
from mercato.plans.facts import Tables
from mercato.sources.catalog import ORDER_GRAIN, bucket_count, planned_bytes, store_bucketed

USERS = 2
MOVES = 2
_ON_ORDER = re.compile(r"Exchange hashpartitioning\(order_id#\d+L?, \d+\)")


class SharedTables(dict):
    """Star tables that hand out written facts, or note which facts are asked for."""

    def __init__(self, tables: Tables, written: dict[str, DataFrame] | None = None):
        super().__init__(tables)
        self.written = written or {}
        self.asked: set[str] = set()

    def fact(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        self.asked.add(name)
        return self.written[name] if name in self.written else build(self)


def order_moves(df: DataFrame) -> int:
    """Exchanges on ``order_id`` in a planned query."""
    return len(_ON_ORDER.findall(df._jdf.queryExecution().executedPlan().toString()))


def survey(t: Tables, plans: Iterable[Callable[[Tables], DataFrame]]) -> tuple[dict[str, int], int]:
    """How many of the plans ask for each fact, and their exchanges on ``order_id``."""
    users: dict[str, int] = {}
    moves = 0
    for plan in plans:
        noted = SharedTables(t)
        moves += order_moves(plan(noted))
        for name in noted.asked:
            users[name] = users.get(name, 0) + 1
    return users, moves


def share(t: Tables, plans: Iterable[Callable[[Tables], DataFrame]], buckets: int | None = None) -> Tables:
    """``t`` with what the plans share written once (see above).

    The plans must be lazy: they are built to be looked at.
    """
    users, moves = survey(t, plans)
    tables = dict(t)
    grain = [name for name in ORDER_GRAIN if name in t]
    co_bucketed = moves > MOVES * len(grain)
    if co_bucketed:
        buckets = buckets or bucket_count(max(planned_bytes({name: t[name]}) for name in grain))
        for name in grain:
            tables[name] = store_bucketed(t[name], f"shared-{name}", "order_id", buckets)
    written = {}
    for name, n in sorted(users.items()):
        if n >= USERS:
            fact = facts.SHARED[name](tables)
            written[name] = store_bucketed(fact, f"shared-{name}", "order_id", buckets or bucket_count(
                planned_bytes({name: fact})))
    return SharedTables(tables, written)
