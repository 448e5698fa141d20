"""Independent SQL oracle (DuckDB dialect) for every registered job.

Each statement starts with the adapter CTEs (``mk_*``, the nine star
tables derived from the driver's test views with the same rules as
``sources.testdata``) and then states the report the way a SQL analyst
would: joins at the raw grain, COUNT(DISTINCT ...), window functions
over the whole result.  Rounding uses the same exact integer formula as
the Spark side (half away from zero), written in SQL, so both sides
produce identical DOUBLEs.
"""

from __future__ import annotations

DAY_US = 86_400_000_000

# ---------------------------------------------------------------------------
# Fixed values of the published results and of the declared schema, stated here
# on their own (nothing is imported from the code under test).
# ---------------------------------------------------------------------------
UNCATEGORISED = "Non catégorisé"
SCORE_BAR_MARK = "█"
SELLER_TOP_LABEL, SELLER_BOTTOM_LABEL = "🏆 Top vendeur", "⚠️ À surveiller"

PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "geolocation": [],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
    "orders": ["order_id"],
    "product_category_translation": ["product_category_name"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
}
# declared text widths
WIDTHS = """
customers customer_id 50, customers customer_unique_id 50, customers customer_zip_code 10,
customers customer_city 100, customers customer_state 2,
geolocation geolocation_zip_code 10, geolocation geolocation_city 100, geolocation geolocation_state 2,
order_items order_id 50, order_items product_id 50, order_items seller_id 50,
order_payments order_id 50, order_payments payment_type 30,
order_reviews review_id 50, order_reviews order_id 50, order_reviews review_comment_title 255,
orders order_id 50, orders customer_id 50, orders order_status 30,
product_category_translation product_category_name 100,
product_category_translation product_category_name_english 100,
products product_id 50, products product_category_name 100,
sellers seller_id 50, sellers seller_zip_code 10, sellers seller_city 100, sellers seller_state 2
"""
# child.column -> parent.column
REFERENCES = """
orders.customer_id customers.customer_id, order_items.order_id orders.order_id,
order_items.product_id products.product_id, order_items.seller_id sellers.seller_id,
order_payments.order_id orders.order_id, order_reviews.order_id orders.order_id,
products.product_category_name product_category_translation.product_category_name
"""
EXPECTED_COUNTS = {"customers": 99441, "geolocation": 1000163, "order_items": 112650, "order_payments": 103886,
                   "order_reviews": 99224, "orders": 99441, "products": 32951, "sellers": 3095}
# thresholds at the sf0.01 medians, for the variants whose HAVING removes groups there
MEDIAN_ORDERS, MEDIAN_REVIEWS, MEDIAN_ROWS = 463, 418, 1715
# the test adapter's translated categories, and the brand without one
BRANDS = {"Brand#1": "health_beauty", "Brand#2": "bed_bath_table", "Brand#3": "sports_leisure",
          "Brand#4": "furniture_decor", "Brand#5": "computers_accessories"}
NO_BRAND = "Brand#9"


# ---------------------------------------------------------------- SQL helpers
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rs(num: str, den: str, d: int) -> str:
    """Exact round(num/den, d) * 10^d as an integer expression."""
    s = 10 ** d
    return (f"(CASE WHEN ({den}) = 0 THEN NULL "
            f"WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END"
            f" * ((2 * abs({num}) * {s} + abs({den})) // (2 * abs({den}))))")


def rr(num: str, den: str, d: int) -> str:
    """Exact ROUND(num/den, d) as DOUBLE."""
    return f"(CAST({rs(num, den, d)} AS DOUBLE) / {10 ** d})"


def pct(part: str, whole: str, d: int) -> str:
    return rr(f"({part}) * 100", whole, d)


def money(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) / 100)"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS BIGINT)"


def micros(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a}))"


def avg_days(s: str, n: str, d: int = 1) -> str:
    return rr(s, f"CAST({n} AS HUGEINT) * {DAY_US}", d)


def whole_days(u: str) -> str:
    return f"(CASE WHEN ({u}) < 0 THEN -1 ELSE 1 END * ((abs({u}) + {DAY_US // 2}) // {DAY_US}))"


def case(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {q(v)}" for c, v in cases) + f" ELSE {q(default)} END"


def _money_from_cents(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2))"


def _cents_of(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


# ---------------------------------------------------------------- adapter
_LINE_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))


def _adapter() -> str:
    k, u, d0 = "o_orderkey", "o_custkey", "o_orderdate"
    day0 = f"CAST(CAST({d0} AS DATE) AS TIMESTAMP)"

    def hours(ts, n):
        return f"({ts} + to_hours(CAST({n} AS INTEGER)))"

    def days(ts, n):
        return f"({ts} + to_days(CAST({n} AS INTEGER)))"

    purchase = hours(d0, f"{k} % 24")
    approved = f"(CASE WHEN {k} % 89 = 0 THEN NULL ELSE {hours(d0, f'24 + {k} % 49')} END)"
    carrier = days(approved, f"({k} * 7) % 11")
    estimated = days(day0, f"20 + {k} % 15")
    delivered = (f"(CASE WHEN {k} % 97 = 0 THEN NULL WHEN {k} % 50 = 10 THEN {estimated} "
                 f"ELSE {days(purchase, f'6 + ({k} * 7) % 11 + ({u} * 13) % 25')} END)")
    statuses = ["canceled", "shipped", "invoiced", "processing", "approved", "created",
                "unavailable", "on_hold"]
    status = ("CASE " + " ".join(f"WHEN {k} % 40 = {i} THEN {q(s)}" for i, s in enumerate(statuses))
              + " ELSE 'delivered' END")
    translation = ", ".join(f"({q(a)}, {q(b)})" for a, b in BRANDS.items())
    pay_type = ("CASE WHEN o_orderpriority = '5-LOW' THEN 'boleto' "
                "WHEN o_orderpriority = '3-MEDIUM' THEN 'debit_card' ELSE 'credit_card' END")
    created = days(day0, f"25 + {k} % 10")

    def review(n: int, score: str) -> str:
        return (f"SELECT CAST({k} AS VARCHAR) || '-{n}' AS review_id, CAST({k} AS VARCHAR) AS order_id, "
                f"CAST({score} AS INTEGER) AS review_score, "
                f"CASE WHEN {k} % 4 = 0 THEN 'title ' || CAST({k} AS VARCHAR) END AS review_comment_title, "
                f"CASE WHEN {k} % 2 = 0 THEN 'message ' || CAST({k} AS VARCHAR) END AS review_comment_message, "
                f"{created} AS review_creation_date, {hours(created, f'1 + {k} % 48')} AS review_answer_timestamp "
                f"FROM orders")

    price_c = _cents_of("l_extendedprice")
    total_c = _cents_of("o_totalprice")
    lat = "CAST(round(c_acctbal * 100) AS DECIMAL(18,0))"
    return f"""
mk_customers AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS customer_id, CAST(o.o_custkey AS VARCHAR) AS customer_unique_id,
         CAST(c.c_nationkey AS VARCHAR) AS customer_zip_code, c.c_mktsegment AS customer_city,
         n.n_name AS customer_state
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
mk_sellers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, CAST(s_nationkey AS VARCHAR) AS seller_zip_code,
         s_name AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
mk_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_brand = {q(NO_BRAND)} THEN NULL ELSE p_brand END AS product_category_name,
         CAST(length(p_name) AS INTEGER) AS product_name_length,
         CAST(length(p_type) AS INTEGER) AS product_description_length,
         CAST(1 + p_size % 4 AS INTEGER) AS product_photos_qty,
         CAST(p_size * 100 AS DECIMAL(10,2)) AS product_weight_g,
         CAST(p_size AS DECIMAL(10,2)) AS product_length_cm,
         CAST(p_size + 1 AS DECIMAL(10,2)) AS product_height_cm,
         CAST(p_size + 2 AS DECIMAL(10,2)) AS product_width_cm
  FROM part),
mk_product_category_translation AS (
  SELECT * FROM (VALUES {translation}) AS v(product_category_name, product_category_name_english)),
mk_orders AS (
  SELECT CAST({k} AS VARCHAR) AS order_id, CAST({k} AS VARCHAR) AS customer_id, {status} AS order_status,
         {purchase} AS order_purchase_timestamp, {approved} AS order_approved_at,
         {carrier} AS order_delivered_carrier_date, {delivered} AS order_delivered_customer_date,
         {estimated} AS order_estimated_delivery_date
  FROM orders),
mk_order_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS INTEGER) AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_shipdate AS shipping_limit_date,
         {_money_from_cents(price_c)} AS price,
         {_money_from_cents(f"({price_c}) // 20")} AS freight_value
  FROM lineitem),
mk_order_payments AS (
  SELECT CAST({k} AS VARCHAR) AS order_id, CAST(1 AS INTEGER) AS payment_sequential,
         {pay_type} AS payment_type,
         CAST(CASE WHEN ({pay_type}) = 'credit_card' THEN {k} % 15 ELSE 1 END AS INTEGER) AS payment_installments,
         {_money_from_cents(total_c)} AS payment_value
  FROM orders WHERE {k} % 200 <> 9
  UNION ALL
  SELECT CAST({k} AS VARCHAR), CAST(2 AS INTEGER), 'voucher', CAST(1 AS INTEGER),
         {_money_from_cents(f"({total_c}) // 10")}
  FROM orders WHERE {k} % 5 = 0),
mk_order_reviews AS (
  {review(1, f"CASE WHEN {k} % 83 = 0 THEN NULL ELSE 1 + ({k} * 3 + {u}) % 5 END")} WHERE {k} % 10 < 9
  UNION ALL
  {review(2, "1")} WHERE {k} % 40 = 20),
mk_geolocation AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS geolocation_zip_code,
         CAST({lat} * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(9,6)) AS geolocation_lat,
         CAST(-{lat} * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(9,6)) AS geolocation_lng,
         c_mktsegment AS geolocation_city, n_name AS geolocation_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


ADAPTER = _adapter()


def with_adapter(body: str, extra_ctes: str = "") -> str:
    ctes = ADAPTER + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------- shared CTEs
CAT = f"""
cat AS (
  SELECT p.product_id,
         COALESCE(t.product_category_name_english, p.product_category_name, {q(UNCATEGORISED)}) AS category
  FROM mk_products p LEFT JOIN mk_product_category_translation t
       ON p.product_category_name = t.product_category_name)"""

PAY = f"""
pay AS (
  SELECT order_id, payment_type, payment_installments, {cents('payment_value')} AS c
  FROM mk_order_payments)"""

TIMED = f"""
timed AS (
  SELECT o.*,
    {micros('order_purchase_timestamp', 'order_delivered_customer_date')} AS actual,
    {micros('order_purchase_timestamp', 'order_estimated_delivery_date')} AS promised,
    {micros('order_estimated_delivery_date', 'order_delivered_customer_date')} AS gap,
    {micros('order_approved_at', 'order_delivered_carrier_date')} AS handling
  FROM mk_orders o)"""

DELIVERED = "order_status = 'delivered'"


def _status_desc(col: str) -> str:
    return f"""CASE {col}
         WHEN 'delivered' THEN '✅ Livré au client' WHEN 'shipped' THEN '🚚 En transit'
         WHEN 'canceled' THEN '❌ Annulé' WHEN 'invoiced' THEN '🧾 Facturé'
         WHEN 'processing' THEN '⚙️ En traitement' WHEN 'approved' THEN '✔️ Paiement approuvé'
         WHEN 'created' THEN '🆕 Créé' WHEN 'unavailable' THEN '⛔ Indisponible' ELSE 'Autre' END"""


def _tranche(col: str) -> str:
    return case([(f"{col} = 1", "1 - Comptant"), (f"{col} <= 3", "2-3 mensualités"),
                 (f"{col} <= 6", "4-6 mensualités"), (f"{col} <= 12", "7-12 mensualités")], "12+ mensualités")


def _punctuality(col: str) -> str:
    w = 7 * DAY_US
    return case([(f"{col} < -{w}", "🟢 Très en avance (>7j avant)"), (f"{col} < 0", "🟡 En avance (1-7j avant)"),
                 (f"{col} = 0", "✅ À temps (jour J)"), (f"{col} <= {w}", "🟠 Retard léger (1-7j)")],
                "🔴 Retard important (>7j)")


def _delay_bucket(col: str) -> str:
    return case([(f"{col} < -10", "Très en avance (>10j avant)"), (f"{col} < -3", "En avance (3-10j avant)"),
                 (f"{col} < 0", "Légèrement en avance (1-3j)"), (f"{col} = 0", "À temps (jour J)"),
                 (f"{col} <= 3", "Léger retard (1-3j)"), (f"{col} <= 10", "Retard modéré (3-10j)")],
                "Retard important (>10j)")


def _segment() -> str:
    return case([("r_score = 3 AND f_score = 3 AND m_score = 3", "🏆 Champion"),
                 ("f_score = 3 AND m_score = 3", "💛 Client Fidèle"),
                 ("r_score = 3 AND f_score >= 2", "🌱 Potentiel"),
                 ("r_score = 3 AND f_score = 1", "🆕 Nouveau Client"),
                 ("r_score = 2 AND f_score >= 2", "⚠️ À Risque"),
                 ("r_score = 1 AND f_score >= 2", "🔴 Presque Perdu")], "💤 Client Inactif")


def _sum_if(cond: str) -> str:
    return f"SUM(CASE WHEN {cond} THEN 1 ELSE 0 END)"


# ---------------------------------------------------------------- profiling
def _row_counts() -> str:
    parts = [f"SELECT {q(t)} AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM mk_{t}"
             for t in sorted(PRIMARY_KEYS)]
    return with_adapter("\nUNION ALL\n".join(parts))


def _preview(table: str) -> str:
    keys = ", ".join(f"{k} ASC NULLS LAST" for k in PRIMARY_KEYS[table])
    return with_adapter(f"SELECT * FROM mk_{table} ORDER BY {keys} LIMIT 5")


def _null_profile() -> str:
    spec = {"orders": ("order_delivered_customer_date", "order_approved_at"),
            "order_reviews": ("review_comment_message", "review_comment_title")}
    parts = [f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, "
             f"CAST({_sum_if(f'{c} IS NULL')} AS BIGINT) AS n_null FROM mk_{t}"
             for t, cols in spec.items() for c in cols]
    return with_adapter("\nUNION ALL\n".join(parts))


SQL: dict[str, str] = {}

SQL["row_counts"] = _row_counts()
for _table in ("customers", "orders", "order_items", "order_payments", "order_reviews", "products", "sellers"):
    SQL[f"preview_{_table}"] = _preview(_table)
SQL["load_check"] = with_adapter("SELECT table_name, n_rows, CAST(expected AS BIGINT) AS expected_rows, "
                                 "n_rows = expected AS ok FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT {q(t)} AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows, {EXPECTED_COUNTS.get(t, 'NULL')} AS expected "
    f"FROM mk_{t}" for t in sorted(PRIMARY_KEYS)) + ") x")
SQL["null_profile"] = _null_profile()
SQL["period_coverage"] = with_adapter("""
SELECT strftime(MIN(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') AS first_order,
       strftime(MAX(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') AS last_order,
       CAST(COUNT(DISTINCT date_trunc('month', order_purchase_timestamp)) AS BIGINT) AS n_months
FROM mk_orders""")
SQL["status_profile"] = with_adapter(f"""
SELECT order_status, CAST(n AS BIGINT) AS n_orders, {pct('n', 'SUM(n) OVER ()', 2)} AS pct
FROM (SELECT order_status, COUNT(*) AS n FROM mk_orders GROUP BY order_status) x""")
SQL["score_distribution"] = with_adapter(f"""
SELECT review_score, CAST(n AS BIGINT) AS n_reviews, {pct('n', 'SUM(n) OVER ()', 1)} AS pct,
       repeat({q(SCORE_BAR_MARK)}, CAST(n // 1000 AS INTEGER)) AS bar
FROM (SELECT review_score, COUNT(*) AS n FROM mk_order_reviews GROUP BY review_score) x""")

# ---------------------------------------------------------------- sales
SQL["sales_kpis"] = with_adapter(f"""
SELECT {money('SUM(op.c)')} AS revenue,
       CAST(COUNT(DISTINCT o.order_id) AS BIGINT) AS n_orders,
       {rr('SUM(op.c)', 'COUNT(op.c) * 100', 2)} AS avg_payment,
       CAST(COUNT(DISTINCT cu.customer_unique_id) AS BIGINT) AS n_customers,
       {rr('SUM(op.c)', 'COUNT(DISTINCT cu.customer_unique_id) * 100', 2)} AS revenue_per_customer
FROM mk_orders o JOIN pay op ON o.order_id = op.order_id
JOIN mk_customers cu ON o.customer_id = cu.customer_id
WHERE o.{DELIVERED}""", PAY)

SQL["monthly_revenue"] = with_adapter(f"""
SELECT month, {money('rev')} AS revenue, CAST(n AS BIGINT) AS n_orders, {money('prev')} AS prev_revenue,
       {rr('(rev - prev) * 100', 'NULLIF(prev, 0)', 1)} AS growth_pct
FROM (
  SELECT *, LAG(rev) OVER (ORDER BY month ASC NULLS LAST) AS prev FROM (
    SELECT strftime(o.order_purchase_timestamp, '%Y-%m') AS month, SUM(op.c) AS rev,
           COUNT(DISTINCT o.order_id) AS n
    FROM mk_orders o JOIN pay op ON o.order_id = op.order_id
    WHERE o.{DELIVERED} GROUP BY 1) m) x
ORDER BY month""", PAY)

SQL["monthly_revenue_filled"] = with_adapter(f"""
SELECT strftime(m.d, '%Y-%m') AS month, {money('rev')} AS revenue, CAST(n AS BIGINT) AS n_orders,
       {money('prev')} AS prev_revenue, {rr('(rev - prev) * 100', 'NULLIF(prev, 0)', 1)} AS growth_pct
FROM (
  SELECT *, LAG(rev) OVER (ORDER BY d) AS prev FROM (
    SELECT c.d, COALESCE(SUM(p.c), 0) AS rev, COUNT(DISTINCT p.order_id) AS n
    FROM (SELECT unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS d FROM paid) c
    LEFT JOIN paid p ON p.month = c.d GROUP BY 1) s) m""", PAY + f""",
paid AS (
  SELECT o.order_id, CAST(date_trunc('month', o.order_purchase_timestamp) AS TIMESTAMP) AS month, op.c
  FROM mk_orders o JOIN pay op ON o.order_id = op.order_id WHERE o.{DELIVERED})""")

SQL["category_revenue_top"] = with_adapter(f"""
SELECT category, {money('cents')} AS revenue, CAST(n AS BIGINT) AS n_orders,
       {rr('cents', 'np * 100', 2)} AS avg_price,
       {pct('cents', 'total', 2)} AS revenue_share_pct
FROM (
  SELECT *, SUM(cents) OVER () AS total FROM (
    SELECT cat.category, SUM({cents('oi.price')}) AS cents, COUNT(DISTINCT oi.order_id) AS n,
           COUNT(oi.price) AS np
    FROM mk_order_items oi JOIN mk_orders o ON oi.order_id = o.order_id
    JOIN cat ON oi.product_id = cat.product_id
    WHERE o.{DELIVERED} GROUP BY 1) x) y
ORDER BY cents DESC NULLS FIRST, category LIMIT 10""", CAT)

SQL["state_revenue"] = with_adapter(f"""
SELECT state, CAST(n AS BIGINT) AS n_orders, {money('rev')} AS revenue,
       {rr('rev', 'nv * 100', 2)} AS avg_payment,
       CAST(RANK() OVER (ORDER BY rev DESC NULLS FIRST) AS BIGINT) AS revenue_rank,
       {pct('rev', 'SUM(rev) OVER ()', 2)} AS revenue_share_pct
FROM (
  SELECT cu.customer_state AS state, COUNT(DISTINCT o.order_id) AS n, SUM(op.c) AS rev, COUNT(op.c) AS nv
  FROM mk_orders o JOIN mk_customers cu ON o.customer_id = cu.customer_id
  JOIN pay op ON o.order_id = op.order_id
  WHERE o.{DELIVERED} GROUP BY 1) x""", PAY)

SQL["payment_mix"] = with_adapter(f"""
SELECT payment_type, CAST(n AS BIGINT) AS n_payments, {money('cents')} AS amount,
       {rr('cents', 'nv * 100', 2)} AS avg_amount,
       {pct('n', 'SUM(n) OVER ()', 2)} AS share_count_pct,
       {pct('cents', 'SUM(cents) OVER ()', 2)} AS share_amount_pct
FROM (
  SELECT op.payment_type, COUNT(*) AS n, SUM(op.c) AS cents, COUNT(op.c) AS nv
  FROM pay op JOIN mk_orders o ON op.order_id = o.order_id
  WHERE o.{DELIVERED} GROUP BY 1) x""", PAY)

SQL["installment_tranches"] = with_adapter(f"""
SELECT tranche, CAST(n AS BIGINT) AS n_payments, {rr('cents', 'nv * 100', 2)} AS avg_payment,
       {money('cents')} AS revenue, {pct('n', 'SUM(n) OVER ()', 2)} AS share_pct
FROM (
  SELECT {_tranche('op.payment_installments')} AS tranche, COUNT(*) AS n, SUM(op.c) AS cents,
         COUNT(op.c) AS nv
  FROM pay op JOIN mk_orders o ON op.order_id = o.order_id
  WHERE o.{DELIVERED} AND op.payment_type = 'credit_card' GROUP BY 1) x""", PAY)

# ---------------------------------------------------------------- operations
SQL["delivery_delay_kpis"] = with_adapter(f"""
SELECT {avg_days('SUM(actual)', 'COUNT(actual)')} AS actual_days,
       {avg_days('SUM(promised)', 'COUNT(promised)')} AS promised_days,
       {avg_days('SUM(gap)', 'COUNT(gap)')} AS gap_days,
       {avg_days('SUM(handling)', 'COUNT(handling)')} AS handling_days,
       CAST(COUNT(*) AS BIGINT) AS n_orders
FROM timed
WHERE {DELIVERED} AND order_delivered_customer_date IS NOT NULL
  AND order_purchase_timestamp IS NOT NULL""", TIMED)

SQL["punctuality_buckets"] = with_adapter(f"""
SELECT bucket, CAST(n AS BIGINT) AS n_orders, {pct('n', 'SUM(n) OVER ()', 2)} AS pct
FROM (
  SELECT {_punctuality('gap')} AS bucket, COUNT(*) AS n FROM timed
  WHERE {DELIVERED} AND order_delivered_customer_date IS NOT NULL
    AND order_estimated_delivery_date IS NOT NULL
  GROUP BY 1) x""", TIMED)

SQL["state_delivery"] = with_adapter(f"""
SELECT cu.customer_state AS state, CAST(COUNT(DISTINCT o.order_id) AS BIGINT) AS n_orders,
       {avg_days('SUM(o.actual)', 'COUNT(o.actual)')} AS actual_days,
       {avg_days('SUM(o.promised)', 'COUNT(o.promised)')} AS promised_days,
       {pct(_sum_if('o.order_delivered_customer_date > o.order_estimated_delivery_date'), 'COUNT(*)', 2)} AS late_pct
FROM timed o JOIN mk_customers cu ON o.customer_id = cu.customer_id
WHERE o.{DELIVERED} AND o.order_delivered_customer_date IS NOT NULL
GROUP BY 1""", TIMED)

SQL["order_status_mix"] = with_adapter(f"""
SELECT order_status, {_status_desc('order_status')} AS description, CAST(n AS BIGINT) AS n_orders,
       {pct('n', 'SUM(n) OVER ()', 2)} AS pct
FROM (SELECT order_status, COUNT(*) AS n FROM mk_orders GROUP BY 1) x""")

def _seller_perf(min_orders: int) -> str:
    return f"""
perf AS (
  SELECT oi.seller_id, s.seller_state, s.seller_city, COUNT(DISTINCT o.order_id) AS n,
         SUM(o.handling) AS hs, COUNT(o.handling) AS hn, SUM(o.actual) AS acs, COUNT(o.actual) AS acn,
         {_sum_if('o.order_delivered_customer_date > o.order_estimated_delivery_date')} AS late,
         COUNT(*) AS n_rows, SUM({cents('oi.price')}) AS cents
  FROM mk_order_items oi JOIN timed o ON oi.order_id = o.order_id
  JOIN mk_sellers s ON oi.seller_id = s.seller_id
  WHERE o.{DELIVERED} AND o.order_delivered_carrier_date IS NOT NULL AND o.order_approved_at IS NOT NULL
  GROUP BY 1, 2, 3
  HAVING COUNT(DISTINCT o.order_id) >= {min_orders}),
perf_out AS (
  SELECT seller_id, seller_state, seller_city, CAST(n AS BIGINT) AS n_orders,
         {avg_days('hs', 'hn')} AS dispatch_days, {avg_days('acs', 'acn')} AS delivery_days,
         {pct('late', 'n_rows', 2)} AS late_pct, {money('cents')} AS revenue
  FROM perf)"""


def seller_dispatch_sql(top: bool, min_orders: int = 30) -> str:
    label, order = ((SELLER_TOP_LABEL, "dispatch_days ASC NULLS LAST") if top
                    else (SELLER_BOTTOM_LABEL, "dispatch_days DESC NULLS FIRST"))
    return with_adapter(f"""
SELECT *, {q(label)} AS label FROM perf_out
ORDER BY {order}, seller_id LIMIT 10""", TIMED + "," + _seller_perf(min_orders))


SQL["seller_dispatch_top"] = seller_dispatch_sql(True)
SQL["seller_dispatch_bottom"] = seller_dispatch_sql(False)

# ---------------------------------------------------------------- experience
SQL["satisfaction_kpis"] = with_adapter(f"""
SELECT {rr('SUM(r.review_score)', 'COUNT(r.review_score)', 2)} AS avg_score,
       CAST(COUNT(r.review_id) AS BIGINT) AS n_reviews,
       {", ".join(f"CAST({_sum_if(f'r.review_score = {s}')} AS BIGINT) AS n_score_{s}" for s in (5, 4, 3, 2, 1))},
       {rr('(SELECT hp FROM nps)', '100', 1)} AS pct_promoters,
       {rr('(SELECT hn FROM nps)', '100', 1)} AS pct_neutral,
       {rr('(SELECT hd FROM nps)', '100', 1)} AS pct_detractors,
       {rr('(SELECT hp - hd FROM nps)', '100', 1)} AS nps
FROM mk_order_reviews r WHERE r.review_score IS NOT NULL""", f"""
scores AS (
  SELECT review_score, {rs('COUNT(*) * 100', 'SUM(COUNT(*)) OVER ()', 2)} AS h
  FROM mk_order_reviews WHERE review_score IS NOT NULL GROUP BY review_score),
nps AS (
  SELECT SUM(CASE WHEN review_score = 5 THEN h ELSE 0 END) AS hp,
         SUM(CASE WHEN review_score IN (3, 4) THEN h ELSE 0 END) AS hn,
         SUM(CASE WHEN review_score IN (1, 2) THEN h ELSE 0 END) AS hd
  FROM scores)""")

def category_satisfaction_sql(min_rows: int = 100) -> str:
    return with_adapter(f"""
SELECT category, CAST(n AS BIGINT) AS n_reviews, {rr('s', 'ns', 2)} AS avg_score,
       {pct('pos', 'rows_', 1)} AS pct_positive, {pct('neg', 'rows_', 1)} AS pct_negative,
       CAST(RANK() OVER (ORDER BY CAST(s AS DOUBLE) / CAST(ns AS DOUBLE) DESC NULLS FIRST) AS BIGINT)
         AS satisfaction_rank
FROM (
  SELECT cat.category, COUNT(r.review_id) AS n, SUM(r.review_score) AS s, COUNT(r.review_score) AS ns,
         {_sum_if('r.review_score >= 4')} AS pos, {_sum_if('r.review_score <= 2')} AS neg,
         COUNT(*) AS rows_
  FROM mk_order_reviews r JOIN mk_orders o ON r.order_id = o.order_id
  JOIN mk_order_items oi ON o.order_id = oi.order_id
  JOIN cat ON oi.product_id = cat.product_id
  WHERE o.{DELIVERED} AND r.review_score IS NOT NULL
  GROUP BY 1 HAVING COUNT(r.review_id) > {min_rows}) x""", CAT)


SQL["category_satisfaction"] = category_satisfaction_sql()

SQL["delay_vs_score"] = with_adapter(f"""
SELECT {_delay_bucket('d')} AS bucket, CAST(COUNT(*) AS BIGINT) AS n_rows,
       {rr('SUM(review_score)', 'COUNT(review_score)', 2)} AS avg_score,
       {pct(_sum_if('review_score >= 4'), 'COUNT(*)', 1)} AS pct_positive,
       {pct(_sum_if('review_score <= 2'), 'COUNT(*)', 1)} AS pct_negative
FROM (
  SELECT o.order_id, r.review_score, {whole_days('o.gap')} AS d
  FROM timed o JOIN mk_order_reviews r ON o.order_id = r.order_id
  WHERE o.{DELIVERED} AND o.order_delivered_customer_date IS NOT NULL
    AND o.order_estimated_delivery_date IS NOT NULL AND r.review_score IS NOT NULL) l
GROUP BY 1""", TIMED)

def seller_satisfaction_sql(min_reviews: int = 30) -> str:
    return with_adapter(f"""
SELECT seller_id, seller_state, seller_city, CAST(n AS BIGINT) AS n_reviews,
       {rr('s', 'ns', 2)} AS avg_score, {pct('pos', 'rows_', 1)} AS pct_positive,
       {pct('neg', 'rows_', 1)} AS pct_negative, {money('cents')} AS revenue,
       CAST(rk AS BIGINT) AS satisfaction_rank
FROM (
  SELECT *, CAST(s AS DOUBLE) / CAST(ns AS DOUBLE) AS a,
         RANK() OVER (ORDER BY CAST(s AS DOUBLE) / CAST(ns AS DOUBLE) DESC NULLS FIRST) AS rk
  FROM (
    SELECT oi.seller_id, sl.seller_state, sl.seller_city, COUNT(DISTINCT r.review_id) AS n,
           SUM(r.review_score) AS s, COUNT(r.review_score) AS ns,
           {_sum_if('r.review_score >= 4')} AS pos, {_sum_if('r.review_score <= 2')} AS neg,
           COUNT(*) AS rows_, SUM({cents('oi.price')}) AS cents
    FROM mk_order_reviews r JOIN mk_orders o ON r.order_id = o.order_id
    JOIN mk_order_items oi ON o.order_id = oi.order_id
    JOIN mk_sellers sl ON oi.seller_id = sl.seller_id
    WHERE o.{DELIVERED} AND r.review_score IS NOT NULL
    GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT r.review_id) >= {min_reviews}) x) y
ORDER BY a DESC NULLS FIRST, seller_id LIMIT 15""")


SQL["seller_satisfaction"] = seller_satisfaction_sql()


def _third(at: str) -> str:
    """0, 1 or 2: the third of ``n`` rows in which position ``at`` (from 0) lies."""
    ends = [f"(n // 3) * {j} + LEAST(n % 3, {j})" for j in (1, 2)]
    return "(" + " + ".join(f"CAST({at} >= {end} AS INTEGER)" for end in ends) + ")"


# One row per paid delivered order, then per person; thirds by position (the first thirds take what is left over).
_RFM = f"""
spent AS (SELECT order_id, SUM({cents('payment_value')}) AS total FROM mk_order_payments GROUP BY order_id),
bought AS (
  SELECT customer_unique_id, order_purchase_timestamp AS bought_at, total
  FROM spent JOIN mk_orders USING (order_id) JOIN mk_customers USING (customer_id)
  WHERE {DELIVERED}),
newest AS (SELECT MAX(order_purchase_timestamp) AS newest_at FROM mk_orders WHERE {DELIVERED}),
people AS (
  SELECT customer_unique_id, MAX(bought_at) AS last_at, COUNT(*) AS frequency, SUM(total) AS cents
  FROM bought GROUP BY customer_unique_id),
aged AS (SELECT people.*, {whole_days(micros('last_at', 'newest_at'))} AS recency_days FROM people, newest),
placed AS (
  SELECT *, COUNT(*) OVER () AS n,
         ROW_NUMBER() OVER (ORDER BY recency_days NULLS LAST, customer_unique_id NULLS LAST) - 1 AS r_at,
         ROW_NUMBER() OVER (ORDER BY frequency NULLS LAST, customer_unique_id NULLS LAST) - 1 AS f_at,
         ROW_NUMBER() OVER (ORDER BY cents NULLS LAST, customer_unique_id NULLS LAST) - 1 AS m_at
  FROM aged),
thirds AS (SELECT *, 3 - {_third('r_at')} AS r_score, 1 + {_third('f_at')} AS f_score, 1 + {_third('m_at')} AS m_score FROM placed),
rfm_seg AS (SELECT *, {_segment()} AS segment FROM thirds)"""

SQL["rfm_scores"] = with_adapter("""
SELECT customer_unique_id, CAST(recency_days AS BIGINT) AS recency_days,
       CAST(frequency AS BIGINT) AS frequency, """ + money("cents") + """ AS monetary,
       CAST(r_score AS BIGINT) AS r_score, CAST(f_score AS BIGINT) AS f_score,
       CAST(m_score AS BIGINT) AS m_score, segment
FROM rfm_seg ORDER BY monetary DESC NULLS FIRST, customer_unique_id""", _RFM)

SQL["rfm_segment_summary"] = with_adapter(f"""
SELECT segment, CAST(n AS BIGINT) AS n_customers, {pct('n', 'SUM(n) OVER ()', 1)} AS pct_customers,
       {rr('cs', 'cn * 100', 2)} AS avg_monetary, {rr('rsum', 'rn', 0)} AS avg_recency_days,
       {rr('fsum', 'fn', 2)} AS avg_frequency, {money('cs')} AS revenue
FROM (
  SELECT segment, COUNT(*) AS n, SUM(cents) AS cs, COUNT(cents) AS cn,
         SUM(recency_days) AS rsum, COUNT(recency_days) AS rn, SUM(frequency) AS fsum, COUNT(frequency) AS fn
  FROM rfm_seg GROUP BY segment) x""", _RFM)

SQL["review_polarity"] = with_adapter(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_reviews,
       {pct(_sum_if('review_score >= 4'), 'COUNT(*)', 2)} AS pct_positive,
       {pct(_sum_if('review_score <= 2'), 'COUNT(*)', 2)} AS pct_negative
FROM mk_order_reviews WHERE review_score IS NOT NULL""")


# ---------------------------------------------------------------- quality
def _constraint_audit() -> str:
    parts = []
    widths = [w.split() for w in WIDTHS.replace("\n", " ").split(",")]
    for table, pk in sorted(PRIMARY_KEYS.items()):
        if pk:
            cols = ", ".join(pk)
            parts.append(
                f"SELECT {q(table)} AS table_name, {q(f'primary_key({cols})')} AS rule, "
                f"CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS n_violations "
                f"FROM (SELECT COUNT(*) AS c FROM mk_{table} GROUP BY {cols} HAVING COUNT(*) > 1) d")
        # the key columns are the ones declared NOT NULL
        checks = [(f"not_null({c})", f"{c} IS NULL") for c in pk]
        checks += [(f"max_length({c}) <= {n}", f"length({c}) > {n}") for t, c, n in widths if t == table]
        if table == "order_reviews":
            checks.append(("check(review_score between 1 and 5)", "review_score < 1 OR review_score > 5"))
        for rule, cond in checks:
            parts.append(f"SELECT {q(table)}, {q(rule)}, "
                         f"CAST(COALESCE({_sum_if(cond)}, 0) AS BIGINT) FROM mk_{table}")
    return with_adapter("\nUNION ALL\n".join(parts))


def _orphan_audit() -> str:
    pairs = [r.split() for r in REFERENCES.replace("\n", " ").split(",")]
    parts = [f"SELECT {q(child)} AS child, {q(parent)} AS parent, "
             f"CAST(COUNT(*) AS BIGINT) AS n_orphans FROM mk_{child.split('.')[0]} x "
             f"WHERE x.{child.split('.')[1]} IS NOT NULL AND NOT EXISTS "
             f"(SELECT 1 FROM mk_{parent.split('.')[0]} y WHERE y.{parent.split('.')[1]} = x.{child.split('.')[1]})"
             for child, parent in pairs]
    return with_adapter("\nUNION ALL\n".join(parts))


SQL["constraint_audit"] = _constraint_audit()
SQL["orphan_audit"] = _orphan_audit()

# ---------------------------------------------------------------- metrics
SQL["item_revenue"] = with_adapter(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_items, {money('SUM(p)')} AS price_total,
       {money('SUM(f)')} AS freight_total, {money('SUM(p) + SUM(f)')} AS item_revenue
FROM (SELECT {cents('price')} AS p, {cents('freight_value')} AS f FROM mk_order_items) x""")

SQL["basket_per_order"] = with_adapter(f"""
SELECT {money('SUM(op.c)')} AS revenue, CAST(COUNT(DISTINCT o.order_id) AS BIGINT) AS n_orders,
       {rr('SUM(op.c)', 'COUNT(DISTINCT o.order_id) * 100', 2)} AS basket_per_order
FROM mk_orders o JOIN pay op ON o.order_id = op.order_id WHERE o.{DELIVERED}""", PAY)

SQL["avg_installments"] = with_adapter(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_payments,
       {rr('SUM(payment_installments)', 'COUNT(payment_installments)', 2)} AS avg_installments
FROM mk_order_payments""")

SQL["product_volume"] = with_adapter("""
SELECT product_id, CAST(product_length_cm * product_height_cm * product_width_cm AS DOUBLE) AS volume_cm3
FROM mk_products""")

SQL["zip_centroid"] = with_adapter(f"""
SELECT geolocation_zip_code AS zip_code, CAST(COUNT(*) AS BIGINT) AS n_points,
       {rr('SUM(CAST(geolocation_lat * 1000000 AS BIGINT))', 'COUNT(geolocation_lat) * 1000000', 6)} AS avg_lat,
       {rr('SUM(CAST(geolocation_lng * 1000000 AS BIGINT))', 'COUNT(geolocation_lng) * 1000000', 6)} AS avg_lng
FROM mk_geolocation GROUP BY 1""")

SQL["freight_by_category"] = with_adapter(f"""
SELECT cat.category, CAST(COUNT(*) AS BIGINT) AS n_items, {money('SUM(oi.f)')} AS freight_total,
       {rr('SUM(oi.f)', 'COUNT(oi.f) * 100', 2)} AS avg_freight
FROM (SELECT product_id, {cents('freight_value')} AS f FROM mk_order_items) oi
JOIN cat ON oi.product_id = cat.product_id GROUP BY 1""", CAT)

SQL["monthly_delivery_delay"] = with_adapter(f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS n_orders,
       {avg_days('SUM(actual)', 'COUNT(actual)')} AS actual_days,
       {avg_days('SUM(promised)', 'COUNT(promised)')} AS promised_days,
       {avg_days('SUM(gap)', 'COUNT(gap)')} AS gap_days,
       {avg_days('SUM(handling)', 'COUNT(handling)')} AS handling_days
FROM timed
WHERE {DELIVERED} AND order_delivered_customer_date IS NOT NULL AND order_purchase_timestamp IS NOT NULL
GROUP BY 1""", TIMED)

SQL["cancellation_rate"] = with_adapter(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_orders, CAST({_sum_if("order_status = 'canceled'")} AS BIGINT) AS n_canceled,
       {pct(_sum_if("order_status = 'canceled'"), 'COUNT(*)', 2)} AS cancel_pct
FROM mk_orders""")

_LATE = "order_delivered_customer_date > order_estimated_delivery_date"
SQL["on_time_rates"] = with_adapter(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_orders, CAST({_sum_if(_LATE)} AS BIGINT) AS n_late,
       {pct(f'COUNT(*) - {_sum_if(_LATE)}', 'COUNT(*)', 2)} AS on_time_pct,
       {pct(_sum_if(_LATE), 'COUNT(*)', 2)} AS late_pct
FROM mk_orders WHERE {DELIVERED} AND order_delivered_customer_date IS NOT NULL""")

SQL["review_coverage"] = with_adapter(f"""
SELECT CAST(COUNT(DISTINCT c.customer_unique_id) AS BIGINT) AS n_customers,
       CAST(COUNT(DISTINCT CASE WHEN r.order_id IS NOT NULL THEN c.customer_unique_id END) AS BIGINT) AS n_reviewed,
       {pct('COUNT(DISTINCT CASE WHEN r.order_id IS NOT NULL THEN c.customer_unique_id END)',
            'COUNT(DISTINCT c.customer_unique_id)', 2)} AS coverage_pct
FROM mk_customers c LEFT JOIN mk_orders o ON c.customer_id = o.customer_id
LEFT JOIN (SELECT DISTINCT order_id FROM mk_order_reviews) r ON o.order_id = r.order_id""")


def _late_by_customer(column: str) -> str:
    return with_adapter(f"""
SELECT {column}, CAST(total AS BIGINT) AS n_delivered, CAST(late AS BIGINT) AS n_late,
       COALESCE({rr('late', 'total', 4)}, 0.0) AS late_rate
FROM (
  SELECT cu.{column}, {_sum_if('o.order_delivered_customer_date IS NOT NULL')} AS total,
         {_sum_if('o.' + _LATE.replace(' > ', ' > o.'))} AS late
  FROM mk_orders o JOIN mk_customers cu ON o.customer_id = cu.customer_id
  WHERE o.{DELIVERED} GROUP BY 1) x""")


def _late_by_seller(column: str) -> str:
    """An order counts once per group of sellers that its items involve."""
    return with_adapter(f"""
SELECT {column}, CAST(total AS BIGINT) AS n_delivered, CAST(late AS BIGINT) AS n_late,
       COALESCE({rr('late', 'total', 4)}, 0.0) AS late_rate
FROM (
  SELECT {column}, {_sum_if('has_date')} AS total, {_sum_if('late')} AS late
  FROM (SELECT DISTINCT s.{column}, o.order_id,
               o.order_delivered_customer_date IS NOT NULL AS has_date,
               o.{_LATE.replace(' > ', ' > o.')} AS late
        FROM mk_order_items oi JOIN mk_orders o ON oi.order_id = o.order_id
        JOIN mk_sellers s ON oi.seller_id = s.seller_id
        WHERE o.{DELIVERED}) so
  GROUP BY 1) x""")


SQL["late_rate_by_state"] = _late_by_customer("customer_state")
SQL["late_rate_by_customer_city"] = _late_by_customer("customer_city")
SQL["late_rate_by_customer_zip"] = _late_by_customer("customer_zip_code")
SQL["late_rate_by_seller"] = _late_by_seller("seller_id")
SQL["late_rate_by_seller_state"] = _late_by_seller("seller_state")
SQL["late_rate_by_seller_city"] = _late_by_seller("seller_city")
SQL["late_rate_by_seller_zip"] = _late_by_seller("seller_zip_code")

SQL["seller_dispatch_calendar_days"] = with_adapter(f"""
SELECT oi.seller_id, CAST(COUNT(*) AS BIGINT) AS n_items,
       {rr("SUM(date_diff('day', CAST(o.order_approved_at AS DATE), CAST(o.order_delivered_carrier_date AS DATE)))", 'COUNT(*)', 2)}
         AS dispatch_calendar_days
FROM mk_order_items oi JOIN mk_orders o ON oi.order_id = o.order_id
WHERE o.order_approved_at IS NOT NULL AND o.order_delivered_carrier_date IS NOT NULL
GROUP BY 1""")

SQL["late_cliff"] = with_adapter(f"""
SELECT CASE WHEN o.gap > {3 * DAY_US} THEN 'late more than 3 days' ELSE 'other' END AS lateness,
       CAST(COUNT(*) AS BIGINT) AS n_reviews,
       {rr('SUM(r.review_score)', 'COUNT(r.review_score)', 2)} AS avg_score
FROM timed o JOIN mk_order_reviews r ON o.order_id = r.order_id
WHERE o.{DELIVERED} AND o.order_delivered_customer_date IS NOT NULL
  AND o.order_estimated_delivery_date IS NOT NULL AND r.review_score IS NOT NULL
GROUP BY 1""", TIMED)


# ---------------------------------------------------------------- HAVING at the median
# Variants whose thresholds sit at the sf0.01 medians, so that HAVING removes about half
# of the groups and its edge (>= versus >) is exercised.
SQL["seller_dispatch_top_pruned"] = seller_dispatch_sql(True, MEDIAN_ORDERS)
SQL["seller_dispatch_bottom_pruned"] = seller_dispatch_sql(False, MEDIAN_ORDERS)
SQL["seller_satisfaction_pruned"] = seller_satisfaction_sql(MEDIAN_REVIEWS)
SQL["category_satisfaction_pruned"] = category_satisfaction_sql(MEDIAN_ROWS)


# ---------------------------------------------------------------- measures over any dimension
_MONTH = "strftime(o.order_purchase_timestamp, '%Y-%m')"


def _late_rates(by_order: list[str], by_item: list[str], orders: str = "true", items: str | None = None) -> str:
    """Every dimension on its own, at row grain; under an item filter only orders with such an item."""
    facts = f"""
lo AS (
  SELECT o.order_id, {_MONTH} AS month, cu.customer_state, cu.customer_city, cu.customer_zip_code,
         o.order_delivered_customer_date IS NOT NULL AS has_date, o.{_LATE.replace(' > ', ' > o.')} AS late
  FROM mk_orders o JOIN mk_customers cu ON o.customer_id = cu.customer_id
  WHERE o.{DELIVERED} AND {orders}
    AND {f"o.order_id IN (SELECT oi.order_id FROM mk_order_items oi WHERE {items})" if items else "true"}),
li AS (
  SELECT oi.order_id, s.*, cat.category
  FROM mk_order_items oi JOIN mk_sellers s ON oi.seller_id = s.seller_id JOIN cat ON oi.product_id = cat.product_id
  WHERE {items or "true"})"""
    pairs = [f"SELECT '{d}' AS dimension, {d} AS value, order_id, has_date, late FROM lo" for d in by_order]
    pairs += [f"SELECT DISTINCT '{d}' AS dimension, {d} AS value, order_id, has_date, late FROM li JOIN lo USING (order_id)"
              for d in by_item]
    return with_adapter(f"""
SELECT dimension, value, CAST(total AS BIGINT) AS n_delivered, CAST(late AS BIGINT) AS n_late,
       COALESCE({rr('late', 'total', 4)}, 0.0) AS late_rate
FROM (SELECT dimension, value, {_sum_if('has_date')} AS total, {_sum_if('late')} AS late
      FROM ({" UNION ALL ".join(pairs)}) p GROUP BY 1, 2) x""", f"{CAT},{facts}")


_BY_ORDER = ["month", "customer_state", "customer_city", "customer_zip_code"]
_BY_ITEM = ["seller_id", "seller_state", "seller_city", "seller_zip_code", "category"]
SQL["late_rates"] = _late_rates(_BY_ORDER, _BY_ITEM)
SQL["late_rates_of_states"] = _late_rates(
    _BY_ORDER, _BY_ITEM, "cu.customer_state IN ('NATION_7', 'NATION_17') AND o.order_purchase_timestamp >= "
    "TIMESTAMP '1996-02-01' AND o.order_purchase_timestamp < TIMESTAMP '1999-07-01'")
SQL["late_rates_of_sellers"] = _late_rates(["month", "customer_city"], ["seller_id", "category"],
                                           items="oi.seller_id IN ('1', '3', '8')")


def _distinct_persons() -> str:
    grains = [(), ("month",), ("customer_state",), ("category",), ("month", "customer_state"),
              ("customer_state", "category")]
    parts = []
    for grain in grains:
        columns = ", ".join(c if c in grain else f"CAST(NULL AS VARCHAR) AS {c}"
                            for c in ("month", "customer_state", "category"))
        parts.append(f"SELECT '{' x '.join(grain) or 'all'}' AS grain, {columns}, "
                     f"CAST(COUNT(DISTINCT person) AS BIGINT) AS n_persons FROM sold"
                     + (f" GROUP BY {', '.join(grain)}" if grain else ""))
    return with_adapter(" UNION ALL ".join(parts), f"""{CAT},
sold AS (
  SELECT cu.customer_unique_id AS person, {_MONTH} AS month, cu.customer_state, cat.category
  FROM mk_orders o JOIN mk_customers cu ON o.customer_id = cu.customer_id
  JOIN mk_order_items oi ON o.order_id = oi.order_id JOIN cat ON oi.product_id = cat.product_id
  WHERE o.{DELIVERED})""")


SQL["distinct_persons"] = _distinct_persons()


# ---------------------------------------------------------------- load round trip
TEXT = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code", "customer_city", "customer_state"],
    "geolocation": ["geolocation_zip_code", "geolocation_city", "geolocation_state"],
    "order_items": ["order_id", "product_id", "seller_id"],
    "order_payments": ["order_id", "payment_type"],
    "order_reviews": ["review_id", "order_id", "review_comment_title", "review_comment_message"],
    "orders": ["order_id", "customer_id", "order_status"],
    "product_category_translation": ["product_category_name", "product_category_name_english"],
    "products": ["product_id", "product_category_name"],
    "sellers": ["seller_id", "seller_zip_code", "seller_city", "seller_state"],
}
OTHER = {
    "customers": [],
    "geolocation": ["geolocation_lat", "geolocation_lng"],
    "order_items": ["order_item_id", "shipping_limit_date", "price", "freight_value"],
    "order_payments": ["payment_sequential", "payment_installments", "payment_value"],
    "order_reviews": ["review_score", "review_creation_date", "review_answer_timestamp"],
    "orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "product_category_translation": [],
    "products": ["product_name_length", "product_description_length", "product_photos_qty", "product_weight_g",
                 "product_length_cm", "product_height_cm", "product_width_cm"],
    "sellers": [],
}


def _load_round_trip() -> str:
    parts = []
    for table, text in TEXT.items():
        lengths = " + ".join(f"COALESCE(length({c}), 0)" for c in text)
        if table == "order_reviews":  # the message, a comma, quotes, a line break, and the message again
            lengths += " + CASE WHEN review_comment_message IS NULL THEN 0 ELSE length(review_comment_message) + 4 END"
        nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in text + OTHER[table])
        key = PRIMARY_KEYS[table]
        keys = f"COUNT(DISTINCT ({', '.join(key)}))" if key else "NULL"
        parts.append(f"SELECT '{table}' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({keys} AS BIGINT) AS n_keys, "
                     f"CAST(SUM({nulls}) AS BIGINT) AS n_nulls, CAST(SUM({lengths}) AS BIGINT) AS n_characters FROM mk_{table}")
    return with_adapter(" UNION ALL ".join(parts))


SQL["load_round_trip"] = _load_round_trip()
