"""Write every report to storage for the dashboards (the result hand-over).

What the reports of a run have in common is written once (``plans.shared``),
and the two RFM reports share one tiling pass; everything else is one job per
report.  Reports are written, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from mercato.plans import experience
from mercato.plans.facts import Tables
from mercato.plans.registry import JOBS, MEASURES, REPORTS
from mercato.plans.shared import share
from mercato.sources.catalog import write_report

RFM = {"rfm_scores", "rfm_segment_summary"}


def build_reports(t: Tables, names: list[str] | None = None) -> dict[str, DataFrame]:
    wanted = names or list(REPORTS)
    out: dict[str, DataFrame] = {}
    if RFM & set(wanted):
        out["rfm_scores"], out["rfm_segment_summary"] = experience.rfm_reports(t)
    for name in wanted:
        if name not in out:
            out[name] = {**JOBS, **MEASURES}[name](t)
    return {n: out[n] for n in wanted}


def shared_tables(t: Tables, names: list[str] | None = None) -> Tables:
    """The tables for a run of the named reports, with what they share written once."""
    wanted = names or list(REPORTS)
    # building these runs jobs: their base stands for the RFM reports, other measures run on their own
    plans = [JOBS[n] for n in wanted if n in JOBS and n not in RFM] + [experience.rfm_base] * bool(RFM & set(wanted))
    return share(t, plans)


def run_reports(t: Tables, out_root: str, names: list[str] | None = None, shared: bool = True) -> dict[str, str]:
    """Overwrite ``<out_root>/<report>`` for each report; returns the paths."""
    tables = shared_tables(t, names) if shared else t
    return {name: write_report(df, out_root, name) for name, df in build_reports(tables, names).items()}
