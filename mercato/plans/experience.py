"""Customer-experience reports: satisfaction, categories, delay vs score, sellers, RFM.

Review x item fan-out is kept where the source query keeps it (a review
of a three-item order weighs three times in category and seller
figures), but as weights: both sides are reduced before they meet and the
row counts multiplied, never as averages of averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import (count_where, elapsed_micros, money, percent,
                                     round_ratio, rounded_scaled, whole_days)
from mercato.functions.labels import delay_score_bucket, rfm_segment
from mercato.operators.ranking import ntile_by_cuts, rank_over, top_k
from mercato.operators.shares import whole, with_share
from mercato.plans.facts import (Tables, category_dim, delivered_orders, item_rows,
                                 payments_per_order, seller_dim)
from mercato.session import store


def _score() -> Column:
    return F.col("review_score")


def _scored_reviews(t: Tables) -> DataFrame:
    return t["order_reviews"].filter(_score().isNotNull()).select("review_id", "order_id", "review_score")


def satisfaction_kpis(t: Tables) -> DataFrame:
    """Average score, counts per score and a simplified NPS.

    Shares per score are rounded to 2 decimals first and the group shares
    are sums of those rounded values, then rounded to 1 decimal (as the
    source computes them).  Everything comes from one aggregate per score.
    """
    per_score = _scored_reviews(t).groupBy("review_score").agg(
        F.count(F.lit(1)).alias("n"), F.count("review_id").alias("n_ids"))
    # integer hundredths of a percent, per score
    hundredths = rounded_scaled(F.col("n") * 100, F.sum("n").over(whole()), 2)
    scored = per_score.withColumn("h", hundredths)

    def n_of(s: int) -> Column:
        return F.sum(F.when(_score() == s, F.col("n")).otherwise(0)).cast("bigint")

    def h_of(*scores: int) -> Column:
        return F.sum(F.when(_score().isin(*scores), F.col("h")).otherwise(0))

    agg = scored.agg(
        F.sum(_score().cast("bigint") * F.col("n")).alias("score_sum"),
        F.sum("n").alias("n_all"),
        F.sum("n_ids").alias("n_reviews"),
        *[n_of(s).alias(f"n_score_{s}") for s in (5, 4, 3, 2, 1)],
        h_of(5).alias("h_pro"), h_of(3, 4).alias("h_neu"), h_of(1, 2).alias("h_det"))
    return agg.select(
        round_ratio(F.col("score_sum"), F.col("n_all"), 2).alias("avg_score"),
        F.col("n_reviews").cast("bigint"),
        *[F.col(f"n_score_{s}") for s in (5, 4, 3, 2, 1)],
        round_ratio(F.col("h_pro"), F.lit(100), 1).alias("pct_promoters"),
        round_ratio(F.col("h_neu"), F.lit(100), 1).alias("pct_neutral"),
        round_ratio(F.col("h_det"), F.lit(100), 1).alias("pct_detractors"),
        round_ratio(F.col("h_pro") - F.col("h_det"), F.lit(100), 1).alias("nps"))


def _delivered_reviews(t: Tables) -> DataFrame:
    """Scored reviews of delivered orders."""
    return _scored_reviews(t).join(delivered_orders(t).select("order_id"), "order_id")


def _score_sums(weight: Column | None = None) -> list[Column]:
    w = weight if weight is not None else F.lit(1)
    return [F.sum(w).alias("n_rows"),
            F.sum(_score().cast("bigint") * w).alias("score_sum"),
            F.sum(F.when(_score() >= 4, w).otherwise(0)).alias("n_pos"),
            F.sum(F.when(_score() <= 2, w).otherwise(0)).alias("n_neg")]


def _merge_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n_rows", "score_sum", "n_pos", "n_neg")]


def _exact_avg() -> Column:
    """The average with 18 decimals: a sort key that tells any two averages of up to 10^9 rows apart."""
    return F.col("score_sum").cast("decimal(19,0)") / F.col("n_rows").cast("decimal(19,0)")


def category_satisfaction(t: Tables, min_rows: int = 100) -> DataFrame:
    """Per category (> ``min_rows`` review x item rows): average score, shares, rank.

    Each review weighs once per item of its order, but review x item rows
    are never formed: reviews are summed per order and items counted per
    (order, product) before they meet, and the sums are multiplied.  They are
    reduced per product before the category lookup.
    """
    per_order = _delivered_reviews(t).groupBy("order_id").agg(*_score_sums())
    items = item_rows(t).groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n_items"))
    per_product = per_order.join(items, "order_id").groupBy("product_id").agg(
        *[F.sum(F.col(c) * F.col("n_items")).alias(c) for c in ("n_rows", "score_sum", "n_pos", "n_neg")])
    per_cat = per_product.join(category_dim(t), "product_id").groupBy("category").agg(*_merge_sums()) \
        .filter(F.col("n_rows") > min_rows)
    ranked = rank_over(per_cat, [F.desc_nulls_first(_exact_avg())], "satisfaction_rank")
    return ranked.select(
        "category",
        F.col("n_rows").cast("bigint").alias("n_reviews"),
        round_ratio(F.col("score_sum"), F.col("n_rows"), 2).alias("avg_score"),
        percent(F.col("n_pos"), F.col("n_rows"), 1).alias("pct_positive"),
        percent(F.col("n_neg"), F.col("n_rows"), 1).alias("pct_negative"),
        "satisfaction_rank").orderBy(F.desc_nulls_first("avg_score"), F.asc("category"))


def delay_vs_score(t: Tables) -> DataFrame:
    """Review scores by delivery gap rounded to whole days (7 buckets)."""
    o = delivered_orders(t).filter(
        F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull()).select(
        "order_id", whole_days(elapsed_micros(F.col("order_estimated_delivery_date"),
                                              F.col("order_delivered_customer_date"))).alias("gap_days"))
    rows = o.join(_scored_reviews(t), "order_id")
    per = rows.groupBy(delay_score_bucket(F.col("gap_days")).alias("bucket")).agg(
        *_score_sums(), F.min("gap_days").alias("_first"))
    return per.orderBy(F.asc_nulls_last("_first")).select(
        "bucket",
        F.col("n_rows").cast("bigint"),
        round_ratio(F.col("score_sum"), F.col("n_rows"), 2).alias("avg_score"),
        percent(F.col("n_pos"), F.col("n_rows"), 1).alias("pct_positive"),
        percent(F.col("n_neg"), F.col("n_rows"), 1).alias("pct_negative"))


def seller_satisfaction(t: Tables, min_reviews: int = 30, k: int = 15) -> DataFrame:
    """Top-k sellers by average score (>= ``min_reviews`` distinct reviews).

    Items are reduced to (order, seller) before they meet the reviews, on
    the order-key partitioning, so a large order makes one row per review and
    seller.  (seller, review) then makes review ids distinct, and the seller
    level is partially aggregated map-side, so a dominant seller does not
    land in one task.  Rank is the global rank by the
    unrounded average; it is computed on the k best rows, which hold
    every seller ranked above any of them.
    """
    items = item_rows(t).groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("w"), F.sum("price_cents").alias("cents"))
    lvl1 = _delivered_reviews(t).join(items, "order_id")
    lvl2 = lvl1.groupBy("seller_id", "review_id").agg(
        *_score_sums(F.col("w")), F.sum("cents").alias("cents"))
    lvl3 = lvl2.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), *_merge_sums(), F.sum("cents").alias("cents")) \
        .filter(F.col("n_reviews") >= min_reviews)
    best = top_k(lvl3.join(seller_dim(t), "seller_id"),
                 [F.desc_nulls_first(_exact_avg()), F.asc("seller_id")], k)
    ranked = rank_over(best, [F.desc_nulls_first(_exact_avg())], "satisfaction_rank")
    return ranked.select(
        "seller_id", "seller_state", "seller_city",
        F.col("n_reviews").cast("bigint"),
        round_ratio(F.col("score_sum"), F.col("n_rows"), 2).alias("avg_score"),
        percent(F.col("n_pos"), F.col("n_rows"), 1).alias("pct_positive"),
        percent(F.col("n_neg"), F.col("n_rows"), 1).alias("pct_negative"),
        money(F.col("cents")).alias("revenue"),
        "satisfaction_rank").orderBy(F.asc("satisfaction_rank"), F.asc("seller_id"))


def rfm_base(t: Tables) -> DataFrame:
    """Per person: recency (whole days before the last delivered purchase), frequency, cents."""
    delivered = delivered_orders(t).select("order_id", "customer_id", "order_purchase_timestamp")
    date_max = delivered.select(F.max("order_purchase_timestamp")).scalar()
    people = t["customers"].select("customer_id", "customer_unique_id")
    per_order = delivered.join(payments_per_order(t).select("order_id", "pay_cents"), "order_id") \
        .join(people, "customer_id")
    per_person = per_order.groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("last_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("pay_cents").alias("cents"))
    return per_person.select(
        "customer_unique_id",
        whole_days(elapsed_micros(F.col("last_purchase"), date_max)).alias("recency_days"),
        F.col("frequency").cast("bigint"),
        F.col("cents"))


def rfm_scored(t: Tables) -> DataFrame:
    """RFM tiles per person, keeping exact cents (shared by both RFM reports).

    NTILE(3) on recency asc (inverted), frequency asc and monetary asc;
    ties at a tile boundary are broken by the person id, so the result is
    deterministic.  The people are written once; the six boundary rows are
    found by counting over them (``ranking.ntile_by_cuts``: some jobs that
    return counts, run while this frame is built), and tiles are assigned by
    comparison.
    """
    scored = ntile_by_cuts(store(rfm_base(t), "rfm-base"), ("recency_days", "frequency", "cents"),
                           "customer_unique_id", 3)
    r = (F.lit(4) - F.col("recency_days_tile")).cast("bigint")
    f, m = F.col("frequency_tile"), F.col("cents_tile")
    return scored.select(
        "customer_unique_id", "recency_days", "frequency", "cents",
        r.alias("r_score"), f.alias("f_score"), m.alias("m_score"),
        rfm_segment(r, f, m).alias("segment"))


def rfm_scores(t: Tables, sort: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """One row per person: recency_days, frequency, monetary, r/f/m scores, segment.

    ``sort`` orders by monetary descending (a distributed range sort).
    """
    s = scored if scored is not None else rfm_scored(t)
    out = s.select("customer_unique_id", "recency_days", "frequency",
                   money(F.col("cents")).alias("monetary"),
                   "r_score", "f_score", "m_score", "segment")
    if sort:
        out = out.orderBy(F.desc_nulls_first("monetary"), F.asc_nulls_last("customer_unique_id"))
    return out


def rfm_segment_summary(t: Tables, scored: DataFrame | None = None) -> DataFrame:
    """Per RFM segment: people, share, averages and revenue."""
    s = scored if scored is not None else rfm_scored(t)
    per = s.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.sum("cents").alias("cents"), F.count("cents").alias("n_money"),
        F.sum("recency_days").alias("rec_sum"), F.count("recency_days").alias("n_rec"),
        F.sum("frequency").alias("freq_sum"), F.count("frequency").alias("n_freq"))
    shared = with_share(per, "n_customers", "pct_customers", 1)
    return shared.select(
        "segment",
        F.col("n_customers").cast("bigint"),
        "pct_customers",
        round_ratio(F.col("cents"), F.col("n_money") * 100, 2).alias("avg_monetary"),
        round_ratio(F.col("rec_sum"), F.col("n_rec"), 0).alias("avg_recency_days"),
        round_ratio(F.col("freq_sum"), F.col("n_freq"), 2).alias("avg_frequency"),
        money(F.col("cents")).alias("revenue")).orderBy(F.desc_nulls_first("revenue"), F.asc("segment"))


def rfm_reports(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Both RFM reports from one tiling pass."""
    scored = rfm_scored(t)
    return rfm_scores(t, scored=scored), rfm_segment_summary(t, scored=scored)


def review_polarity(t: Tables) -> DataFrame:
    """Overall share of scores 4-5 and 1-2 among scored reviews."""
    agg = _scored_reviews(t).agg(F.count(F.lit(1)).alias("n"),
                                 count_where(_score() >= 4).alias("n_pos"),
                                 count_where(_score() <= 2).alias("n_neg"))
    return agg.select(F.col("n").cast("bigint").alias("n_reviews"),
                      percent(F.col("n_pos"), F.col("n"), 2).alias("pct_positive"),
                      percent(F.col("n_neg"), F.col("n"), 2).alias("pct_negative"))
