"""Hand-computed expectations on tiny star tables: edges, NULLs, fan-out, thresholds."""

from __future__ import annotations

from handmade import tables, ts
from pyspark.sql import functions as F

from mercato.functions import labels as L
from mercato.plans import experience, metrics, operations, profiling, quality, sales


def rows(df):
    return [r.asDict() for r in df.collect()]


# ----------------------------------------------------------------- sales
def _sales(spark):
    o = [("o1", "c1", "delivered", "2017-01-10 10:00:00"),
         ("o2", "c2", "delivered", "2017-01-20 09:00:00"),
         ("o3", "c3", "delivered", "2017-03-05 08:00:00"),
         ("o4", "c4", "canceled", "2017-01-15 08:00:00"),
         ("o5", "c5", "delivered", "2017-04-01 08:00:00"),   # no payment -> dropped
         ("o6", "c6", "delivered", "2017-05-02 08:00:00"),
         ("o7", "c7", "delivered", "2017-06-02 08:00:00")]
    c = [("c1", "u1", "SP"), ("c2", "u1", "SP"), ("c3", "u2", "RJ"), ("c4", "u3", "SP"),
         ("c5", "u3", "MG"), ("c6", "u4", "MG"), ("c7", "u4", "MG")]
    p = [("o1", 1, "credit_card", 1, "100.00"), ("o1", 2, "voucher", 1, "20.00"),
         ("o2", 1, "credit_card", 3, "50.01"), ("o3", 1, "boleto", 1, "30.00"),
         ("o4", 1, "credit_card", 2, "999.00"), ("o6", 1, "voucher", 1, "0.00"),
         ("o7", 1, "debit_card", 1, "10.00")]
    return tables(
        spark,
        orders=[dict(order_id=a, customer_id=b, order_status=s, order_purchase_timestamp=d) for a, b, s, d in o],
        customers=[dict(customer_id=a, customer_unique_id=u, customer_state=s) for a, u, s in c],
        order_payments=[dict(order_id=a, payment_sequential=n, payment_type=t, payment_installments=i,
                             payment_value=v) for a, n, t, i, v in p])


def test_sales_kpis(spark):
    (r,) = rows(sales.sales_kpis(_sales(spark)))
    assert r == dict(revenue=210.01, n_orders=5, avg_payment=35.0, n_customers=3,
                     revenue_per_customer=70.0)


def test_monthly_revenue_gap_and_zero_previous(spark):
    got = rows(sales.monthly_revenue(_sales(spark)))
    assert got == [
        dict(month="2017-01", revenue=170.01, n_orders=2, prev_revenue=None, growth_pct=None),
        dict(month="2017-03", revenue=30.0, n_orders=1, prev_revenue=170.01, growth_pct=-82.4),
        dict(month="2017-05", revenue=0.0, n_orders=1, prev_revenue=30.0, growth_pct=-100.0),
        dict(month="2017-06", revenue=10.0, n_orders=1, prev_revenue=0.0, growth_pct=None),
    ]


def test_monthly_revenue_fill_gaps(spark):
    got = [(r["month"], r["revenue"], r["n_orders"], r["growth_pct"])
           for r in rows(sales.monthly_revenue(_sales(spark), fill_gaps=True))]
    assert got == [("2017-01", 170.01, 2, None), ("2017-02", 0.0, 0, -100.0),
                   ("2017-03", 30.0, 1, None), ("2017-04", 0.0, 0, -100.0),
                   ("2017-05", 0.0, 1, None), ("2017-06", 10.0, 1, None)]


def test_state_revenue_rank_and_share(spark):
    got = {r["state"]: r for r in rows(sales.state_revenue(_sales(spark)))}
    assert set(got) == {"SP", "RJ", "MG"}
    assert got["SP"]["revenue"] == 170.01 and got["SP"]["revenue_rank"] == 1
    assert got["SP"]["avg_payment"] == 56.67            # 170.01 / 3 payment rows
    assert got["MG"]["n_orders"] == 2 and got["MG"]["revenue_rank"] == 3
    assert got["SP"]["revenue_share_pct"] == 80.95      # 170.01 / 210.01
    assert got["RJ"]["revenue_share_pct"] == 14.29      # 14.28503... rounds up


def test_installment_tranches_edges(spark):
    pays = [(1, 1), (2, 0), (3, 3), (4, 6), (5, 12), (6, 13), (7, None)]
    t = tables(
        spark,
        orders=[dict(order_id=f"t{i}", customer_id=f"c{i}", order_status="delivered") for i, _ in pays],
        order_payments=[dict(order_id=f"t{i}", payment_sequential=1, payment_type="credit_card",
                             payment_installments=n, payment_value="10.00") for i, n in pays]
        + [dict(order_id="t1", payment_sequential=2, payment_type="boleto", payment_installments=1,
                payment_value="5.00")])
    got = [(r["tranche"], r["n_payments"]) for r in rows(sales.installment_tranches(t))]
    tr = L.INSTALLMENT_TRANCHES
    # ordered by the smallest installment count in each tranche: 0 comes first
    assert got == [(tr[1], 2), (tr[0], 1), (tr[2], 1), (tr[3], 1), (tr[4], 2)]


def test_category_label_fallbacks(spark):
    t = tables(
        spark,
        orders=[dict(order_id="o1", order_status="delivered"), dict(order_id="o2", order_status="shipped")],
        order_items=[dict(order_id="o1", order_item_id=1, product_id="p1", price="10.00"),
                     dict(order_id="o1", order_item_id=2, product_id="p2", price="20.00"),
                     dict(order_id="o1", order_item_id=3, product_id="p3", price="30.00"),
                     dict(order_id="o2", order_item_id=1, product_id="p1", price="99.00")],
        products=[dict(product_id="p1", product_category_name="beleza_saude"),
                  dict(product_id="p2", product_category_name="sem_traducao"),
                  dict(product_id="p3", product_category_name=None)],
        product_category_translation=[dict(product_category_name="beleza_saude",
                                           product_category_name_english="health_beauty")])
    got = {r["category"]: (r["revenue"], r["revenue_share_pct"]) for r in rows(sales.category_revenue_top(t))}
    assert got == {L.UNCATEGORISED: (30.0, 50.0), "sem_traducao": (20.0, 33.33),
                   "health_beauty": (10.0, 16.67)}


# ----------------------------------------------------------------- operations
EST = "2018-01-20 00:00:00"
DAY = 86400


def _punctual(spark, offsets_seconds):
    orders, reviews = [], []
    for i, off in enumerate(offsets_seconds):
        orders.append(dict(order_id=f"o{i}", customer_id=f"c{i}", order_status="delivered",
                           order_purchase_timestamp=ts("2018-01-01 00:00:00"),
                           order_estimated_delivery_date=ts(EST),
                           order_delivered_customer_date=ts(EST, seconds=off)))
        reviews.append(dict(review_id=f"r{i}", order_id=f"o{i}", review_score=1 + i % 5))
    return tables(spark, orders=orders, order_reviews=reviews)


def test_punctuality_bucket_edges(spark):
    offs = [-7 * DAY - 1, -7 * DAY, -DAY // 10, 0, 7 * DAY, 7 * DAY + 1]
    got = {r["bucket"]: r["n_orders"] for r in rows(operations.punctuality_buckets(_punctual(spark, offs)))}
    b = L.PUNCTUALITY_BUCKETS
    assert got == {b[0]: 1, b[1]: 2, b[2]: 1, b[3]: 1, b[4]: 1}


def test_delay_vs_score_whole_day_edges(spark):
    offs = [int(-10.5 * DAY), -10 * DAY, -3 * DAY, int(-0.4 * DAY), DAY // 2, 3 * DAY,
            int(3.5 * DAY), 10 * DAY, int(10.5 * DAY)]
    got = [(r["bucket"], r["n_rows"]) for r in rows(experience.delay_vs_score(_punctual(spark, offs)))]
    b = L.DELAY_SCORE_BUCKETS
    assert got == [(b[0], 1), (b[1], 1), (b[2], 1), (b[3], 1), (b[4], 2), (b[5], 2), (b[6], 1)]


def test_delivery_kpis_skip_undelivered_and_null_handling(spark):
    t = tables(spark, orders=[
        dict(order_id="a", order_status="delivered", order_purchase_timestamp=ts(EST),
             order_approved_at=ts(EST, seconds=3600), order_delivered_carrier_date=ts(EST, days=2),
             order_delivered_customer_date=ts(EST, days=10), order_estimated_delivery_date=ts(EST, days=20)),
        dict(order_id="b", order_status="delivered", order_purchase_timestamp=ts(EST),
             order_approved_at=None, order_delivered_carrier_date=None,
             order_delivered_customer_date=ts(EST, days=5), order_estimated_delivery_date=ts(EST, days=4)),
        dict(order_id="c", order_status="delivered", order_purchase_timestamp=ts(EST),
             order_delivered_customer_date=None, order_estimated_delivery_date=ts(EST, days=4))])
    (r,) = rows(operations.delivery_delay_kpis(t))
    # handling averages only order a (approved NULL on b): 2 days - 1 hour
    assert r == dict(actual_days=7.5, promised_days=12.0, gap_days=-4.5, handling_days=2.0, n_orders=2)


def test_order_status_mix_unknown_status(spark):
    t = tables(spark, orders=[dict(order_id="1", order_status="delivered"),
                              dict(order_id="2", order_status="on_hold"),
                              dict(order_id="3", order_status="delivered")])
    got = {r["order_status"]: (r["description"], r["n_orders"], r["pct"])
           for r in rows(operations.order_status_mix(t))}
    assert got == {"delivered": (L.STATUS_DESCRIPTIONS[0][1], 2, 66.67),
                   "on_hold": (L.STATUS_OTHER, 1, 33.33)}


def _sellers(spark, min_orders_extra=0):
    orders, items = [], []
    # seller s1: 2 orders, dispatch 1 day; seller s2: 3 orders, dispatch 3 days,
    # one of them late and one without delivery date
    spec = [("s1", 1, 2, 0), ("s1", 1, 2, 0), ("s2", 3, 1, 5), ("s2", 3, 1, 5), ("s2", 3, 2, None)]
    for i, (seller, disp, n_items, late) in enumerate(spec):
        orders.append(dict(order_id=f"o{i}", customer_id=f"c{i}", order_status="delivered",
                           order_purchase_timestamp=ts(EST, days=-10), order_approved_at=ts(EST, days=-9),
                           order_delivered_carrier_date=ts(EST, days=-9 + disp),
                           order_delivered_customer_date=None if late is None else ts(EST, days=late - 2),
                           order_estimated_delivery_date=ts(EST, days=0)))
        for j in range(n_items):
            items.append(dict(order_id=f"o{i}", order_item_id=j + 1, seller_id=seller, price="10.00",
                              product_id="p"))
    return tables(spark, orders=orders, order_items=items,
                  sellers=[dict(seller_id="s1", seller_state="SP", seller_city="x"),
                           dict(seller_id="s2", seller_state="RJ", seller_city="y")])


def test_seller_dispatch_weighting_and_threshold(spark):
    t = _sellers(spark)
    top = rows(operations.seller_dispatch_top(t, min_orders=2))
    assert [r["seller_id"] for r in top] == ["s1", "s2"]
    s2 = top[1]
    # s2 item rows: 1 + 1 + 2 = 4; late rows: both one-item orders (delivered 3 days late)
    assert (s2["n_orders"], s2["dispatch_days"], s2["late_pct"], s2["revenue"]) == (3, 3.0, 50.0, 40.0)
    assert s2["delivery_days"] == 13.0
    assert [r["seller_id"] for r in rows(operations.seller_dispatch_top(t, min_orders=3))] == ["s2"]
    assert [r["seller_id"] for r in rows(operations.seller_dispatch_bottom(t, min_orders=2))] == ["s2", "s1"]


def test_dispatch_calendar_days_differs_per_seller(spark):
    """Regression: a measure anchored on orders gave every seller the same value."""
    got = {r["seller_id"]: r["dispatch_calendar_days"]
           for r in rows(metrics.seller_dispatch_calendar_days(_sellers(spark)))}
    assert got == {"s1": 1.0, "s2": 3.0}


def test_late_rate_by_seller_counts_distinct_orders(spark):
    got = {r["seller_id"]: (r["n_delivered"], r["n_late"], r["late_rate"])
           for r in rows(metrics.late_rate_by_seller(_sellers(spark)))}
    assert got == {"s1": (2, 0, 0.0), "s2": (2, 2, 1.0)}


def test_late_rate_by_seller_state_counts_each_order_once_per_state(spark):
    t = _sellers(spark)
    t = {**t, "sellers": t["sellers"].withColumn("seller_state", F.lit("SP"))}
    (r,) = rows(metrics.late_rate_by(t, "seller_state"))
    # five distinct orders, four with a delivery date, two of them late
    assert (r["seller_state"], r["n_delivered"], r["n_late"], r["late_rate"]) == ("SP", 4, 2, 0.5)


# ----------------------------------------------------------------- experience
def test_satisfaction_nps_two_step_rounding(spark):
    # 3 x score 5, 1 x score 4, 2 x score 1, 1 NULL (ignored): shares 50.00 / 16.67 / 33.33
    scores = [5, 5, 5, 4, 1, 1, None]
    t = tables(spark, order_reviews=[dict(review_id=f"r{i}", order_id=f"o{i}", review_score=s)
                                     for i, s in enumerate(scores)])
    (r,) = rows(experience.satisfaction_kpis(t))
    assert r == dict(avg_score=3.5, n_reviews=6, n_score_5=3, n_score_4=1, n_score_3=0,
                     n_score_2=0, n_score_1=2, pct_promoters=50.0, pct_neutral=16.7,
                     pct_detractors=33.3, nps=16.7)


def test_seller_satisfaction_fanout_and_distinct_reviews(spark):
    t = tables(
        spark,
        orders=[dict(order_id="o1", order_status="delivered"), dict(order_id="o2", order_status="delivered")],
        order_items=[dict(order_id="o1", order_item_id=i, seller_id="s1", price="10.00") for i in (1, 2, 3)]
        + [dict(order_id="o2", order_item_id=1, seller_id="s1", price="7.00")],
        order_reviews=[dict(review_id="r1", order_id="o1", review_score=5),
                       dict(review_id="r2", order_id="o1", review_score=1),
                       dict(review_id="r3", order_id="o2", review_score=4)],
        sellers=[dict(seller_id="s1", seller_state="SP", seller_city="x")])
    (r,) = rows(experience.seller_satisfaction(t, min_reviews=3))
    # 7 review x item rows: 3 x 5, 3 x 1, 1 x 4 -> avg 22/7; revenue repeats per review
    assert (r["n_reviews"], r["avg_score"], r["pct_positive"], r["pct_negative"], r["revenue"],
            r["satisfaction_rank"]) == (3, 3.14, 57.1, 42.9, 67.0, 1)
    assert rows(experience.seller_satisfaction(t, min_reviews=4)) == []


def test_rfm_segments_and_summary_totals(spark):
    orders, cust, pays = [], [], []
    for i in range(9):
        for k in range(1 + i % 3):
            oid = f"o{i}_{k}"
            orders.append(dict(order_id=oid, customer_id=oid, order_status="delivered",
                               order_purchase_timestamp=ts("2018-01-01 00:00:00", days=i * 3 + k)))
            cust.append(dict(customer_id=oid, customer_unique_id=f"u{i}"))
            pays.append(dict(order_id=oid, payment_sequential=1, payment_value=f"{10 * (i + 1)}.00"))
    t = tables(spark, orders=orders, customers=cust, order_payments=pays)
    scored = experience.rfm_scored(t)
    per = {r["customer_unique_id"]: r for r in rows(experience.rfm_scores(t, scored=scored))}
    assert len(per) == 9
    assert per["u8"]["recency_days"] == 0 and per["u8"]["r_score"] == 3
    assert per["u8"]["frequency"] == 3 and per["u8"]["f_score"] == 3 and per["u8"]["m_score"] == 3
    assert per["u8"]["segment"] == L.RFM_SEGMENTS[0]
    assert per["u0"]["r_score"] == 1 and per["u0"]["f_score"] == 1
    summary = rows(experience.rfm_segment_summary(t, scored=scored))
    assert sum(r["n_customers"] for r in summary) == 9
    assert round(sum(r["revenue"] for r in summary), 2) == round(sum(r["monetary"] for r in per.values()), 2)


# ----------------------------------------------------------------- profiling & quality
def test_score_distribution_null_group_and_bar(spark):
    t = tables(spark, order_reviews=[dict(review_id=f"r{i}", order_id="o", review_score=None if i < 1 else 5)
                                     for i in range(2001)])
    got = {r["review_score"]: (r["n_reviews"], r["pct"], r["bar"]) for r in rows(profiling.score_distribution(t))}
    assert got == {None: (1, 0.0, ""), 5: (2000, 100.0, L.SCORE_BAR_MARK * 2)}


def test_constraint_and_orphan_audits(spark):
    t = tables(
        spark,
        orders=[dict(order_id="o1", customer_id="c1"), dict(order_id="o1", customer_id="c9"),
                dict(order_id=None, customer_id="c1")],
        customers=[dict(customer_id="c1", customer_state="SPX")],
        order_reviews=[dict(review_id="r1", order_id="o1", review_score=7)])
    audit = {(r["table_name"], r["rule"]): r["n_violations"] for r in rows(quality.constraint_audit(t))}
    assert audit[("orders", "primary_key(order_id)")] == 1
    assert audit[("orders", "not_null(order_id)")] == 1
    assert audit[("customers", "max_length(customer_state) <= 2")] == 1
    assert audit[("order_reviews", "check(review_score between 1 and 5)")] == 1
    assert audit[("sellers", "primary_key(seller_id)")] == 0
    orphans = {r["child"]: r["n_orphans"] for r in rows(quality.orphan_audit(t))}
    assert orphans["orders.customer_id"] == 1
    assert orphans["order_reviews.order_id"] == 0


def test_load_check_against_expected_counts(spark):
    t = tables(spark, sellers=[dict(seller_id="s1"), dict(seller_id="s2")],
               orders=[dict(order_id="o1")])
    got = {r["table_name"]: (r["n_rows"], r["expected_rows"], r["ok"])
           for r in rows(profiling.load_check(t, {"sellers": 2, "orders": 5}))}
    assert got["sellers"] == (2, 2, True)
    assert got["orders"] == (1, 5, False)
    assert got["customers"] == (0, None, None)
    default = {r["table_name"]: r["expected_rows"] for r in rows(profiling.load_check(t))}
    assert default["geolocation"] == 1_000_163 and default["product_category_translation"] is None


def test_preview_every_listed_table(small_tables):
    for table in profiling.PREVIEW_TABLES:
        got = profiling.preview(small_tables, table).collect()
        assert 0 < len(got) <= 5, table
        keys = [tuple(r[k] for k in profiling.PRIMARY_KEYS[table]) for r in got]
        assert keys == sorted(keys), table


def test_null_groups_state_and_month(spark):
    t = _sales(spark)
    extra = tables(
        spark,
        orders=[dict(order_id="o8", customer_id="c8", order_status="delivered",
                     order_purchase_timestamp=None)],
        customers=[dict(customer_id="c8", customer_unique_id="u8", customer_state=None)],
        order_payments=[dict(order_id="o8", payment_sequential=1, payment_type="boleto",
                             payment_installments=1, payment_value="5.00")])
    t = {n: t[n].unionByName(extra[n]) for n in t}
    months = rows(sales.monthly_revenue(t))
    assert months[-1] == dict(month=None, revenue=5.0, n_orders=1, prev_revenue=10.0, growth_pct=-50.0)
    states = {r["state"]: (r["revenue"], r["revenue_rank"]) for r in rows(sales.state_revenue(t))}
    assert states[None] == (5.0, 4) and states["SP"] == (170.01, 1)


def test_an_order_that_stands_twice_counts_once_per_seller(spark):
    t = _sellers(spark)
    twice = {**t, "orders": t["orders"].unionByName(t["orders"])}
    assert rows(metrics.late_rate_by_seller(twice)) == rows(metrics.late_rate_by_seller(t))
    once, both = (sorted(rows(operations.seller_dispatch(x, 1)), key=lambda r: r["seller_id"]) for x in (t, twice))
    assert [r["n_orders"] for r in both] == [r["n_orders"] for r in once]
    assert [r["revenue"] for r in both] == [2 * r["revenue"] for r in once]
