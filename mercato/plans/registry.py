"""Name -> job.  Every job maps the nine star tables to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from mercato.plans import experience, measures, metrics, operations, profiling, quality, sales
from mercato.plans.facts import Tables

Job = Callable[[Tables], DataFrame]

JOBS: dict[str, Job] = {
    # profiling
    "row_counts": profiling.row_counts,
    **{f"preview_{table}": partial(profiling.preview, table=table) for table in profiling.PREVIEW_TABLES},
    "load_check": profiling.load_check,
    "null_profile": profiling.null_profile,
    "period_coverage": profiling.period_coverage,
    "status_profile": profiling.status_profile,
    "score_distribution": profiling.score_distribution,
    # sales
    "sales_kpis": sales.sales_kpis,
    "monthly_revenue": sales.monthly_revenue,
    "monthly_revenue_filled": partial(sales.monthly_revenue, fill_gaps=True),
    "category_revenue_top": sales.category_revenue_top,
    "state_revenue": sales.state_revenue,
    "payment_mix": sales.payment_mix,
    "installment_tranches": sales.installment_tranches,
    # operations
    "delivery_delay_kpis": operations.delivery_delay_kpis,
    "punctuality_buckets": operations.punctuality_buckets,
    "state_delivery": operations.state_delivery,
    "order_status_mix": operations.order_status_mix,
    "seller_dispatch_top": operations.seller_dispatch_top,
    "seller_dispatch_bottom": operations.seller_dispatch_bottom,
    # customer experience
    "satisfaction_kpis": experience.satisfaction_kpis,
    "category_satisfaction": experience.category_satisfaction,
    "delay_vs_score": experience.delay_vs_score,
    "seller_satisfaction": experience.seller_satisfaction,
    "rfm_scores": experience.rfm_scores,
    "rfm_segment_summary": experience.rfm_segment_summary,
    # quality
    "constraint_audit": quality.constraint_audit,
    "orphan_audit": quality.orphan_audit,
    # metrics defined in prose / dashboard measures
    "item_revenue": metrics.item_revenue,
    "basket_per_order": sales.basket_per_order,
    "avg_installments": metrics.avg_installments,
    "product_volume": metrics.product_volume,
    "zip_centroid": metrics.zip_centroid,
    "freight_by_category": metrics.freight_by_category,
    "monthly_delivery_delay": metrics.monthly_delivery_delay,
    "cancellation_rate": metrics.cancellation_rate,
    "on_time_rates": metrics.on_time_rates,
    "review_coverage": metrics.review_coverage,
    "review_polarity": experience.review_polarity,
    "late_rate_by_state": metrics.late_rate_by_state,
    "late_rate_by_customer_city": metrics.late_rate_by_customer_city,
    "late_rate_by_customer_zip": metrics.late_rate_by_customer_zip,
    "late_rate_by_seller": metrics.late_rate_by_seller,
    "late_rate_by_seller_state": metrics.late_rate_by_seller_state,
    "late_rate_by_seller_city": metrics.late_rate_by_seller_city,
    "late_rate_by_seller_zip": metrics.late_rate_by_seller_zip,
    "seller_dispatch_calendar_days": metrics.seller_dispatch_calendar_days,
    "late_cliff": metrics.late_cliff,
}

# Dashboard measures over any dimension or grain (written on demand, not by default; some run jobs while they are built).
MEASURES: dict[str, Job] = {
    "late_rates": measures.late_rates,
    "distinct_persons": measures.distinct_persons,
}

# Every report and metric (what ``run_reports`` writes by default).
REPORTS: tuple[str, ...] = tuple(JOBS)

# The report groups a dashboard consumes, in the order the source lists its queries.
GROUPS: dict[str, tuple[str, ...]] = {
    "profiling": ("row_counts", "period_coverage", "status_profile", "null_profile",
                  "score_distribution"),
    "sales": ("sales_kpis", "monthly_revenue", "category_revenue_top", "state_revenue",
              "payment_mix", "installment_tranches"),
    "operations": ("delivery_delay_kpis", "punctuality_buckets", "state_delivery",
                   "order_status_mix", "seller_dispatch_top", "seller_dispatch_bottom"),
    "experience": ("satisfaction_kpis", "category_satisfaction", "delay_vs_score",
                   "seller_satisfaction", "rfm_scores", "rfm_segment_summary"),
    "quality": ("constraint_audit", "orphan_audit"),
}
