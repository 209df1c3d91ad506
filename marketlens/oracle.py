"""Independent DuckDB SQL for each SQL-expressible registry query.

Every statement starts from the pre-registered generated tables, rebuilds the
raw binding, the star schema and the prepared fact as CTEs, and computes the
analysis in plain SQL. Column names and types line up with the Spark side;
money is summed in whole cents plus what is left of them, and means are rounded to 6 places on both
sides (SURVEY §7.4).
"""

from __future__ import annotations

from marketlens.registry import CENTRES, COEFFICIENTS, INTERCEPT, MART_MEASURES, ONE_CLASS_DAYS
from marketlens.schemas import BR_STATES, CHURN_FEATURES, SEGMENT_LABELS, STATE_CENTROIDS

_STATES = "[" + ", ".join(f"'{s}'" for s in BR_STATES[:24]) + "]"


def msum(x: str) -> str:
    cents = f"CAST(round({x} * 100.0) AS BIGINT)"
    return f"COALESCE(CAST(sum({cents}) AS DOUBLE) / CAST(100 AS DOUBLE) + sum({x} - CAST({cents} AS DOUBLE) / CAST(100 AS DOUBLE)), 0.0)"


#: One column per period that the small test tables have (78 months after the first, a view needs them named).
_COHORT_PERIODS = ", ".join(
    f"COALESCE(max(CASE WHEN period_number = {p} THEN retention_pct END), 0.0) AS \"{p}\"" for p in range(79))


def mdays() -> str:
    us = "date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date)"
    return f"CAST(sum({us}) AS DOUBLE) / NULLIF(count({us}), 0) / 86400e6"


BASE = f"""
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp,
         o_orderdate + INTERVAL 1 DAY AS order_approved_at,
         o_orderdate + INTERVAL 2 DAY AS order_delivered_carrier_date,
         CASE WHEN o_orderstatus <> 'O'
              THEN o_orderdate + to_days(CAST(2 + o_orderkey % 22 AS INTEGER)) + to_hours(CAST(o_orderkey % 24 AS INTEGER))
         END AS order_delivered_customer_date,
         o_orderdate + INTERVAL 18 DAY AS order_estimated_delivery_date
  FROM orders),
raw_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_extendedprice AS price,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DOUBLE) AS freight_value
  FROM lineitem),
raw_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_custkey AS zip_code_prefix, n_name AS city,
         CASE WHEN c_nationkey < 24 THEN {_STATES}[c_nationkey + 1] END AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
raw_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS product_category_name,
         CAST(length(p_name) AS DOUBLE) AS name_length, CAST(p_size AS DOUBLE) AS weight_g
  FROM part),
raw_sellers AS (
  SELECT s_suppkey AS seller_id, s_suppkey AS zip_code_prefix, n_name AS city,
         CASE WHEN s_nationkey < 24 THEN {_STATES}[s_nationkey + 1] END AS seller_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
raw_reviews AS (
  SELECT o_orderkey AS order_id, CAST(1 + (o_orderkey * 7) % 5 AS DOUBLE) AS review_score FROM orders WHERE o_orderkey % 20 <> 3
  UNION ALL
  SELECT o_orderkey AS order_id, CAST(1 + o_orderkey % 4 AS DOUBLE) AS review_score FROM orders WHERE o_orderkey % 10 = 0),
review_mean AS (
  SELECT order_id, avg(review_score) AS review_score FROM raw_reviews WHERE order_id IS NOT NULL GROUP BY order_id),
fact AS (
  SELECT o.order_id, i.order_item_id, o.customer_id, c.customer_unique_id, i.product_id, i.seller_id, o.order_status,
         c.customer_state, s.seller_state, COALESCE(p.category, 'unknown') AS product_category,
         COALESCE(i.price, 0.0) AS price, COALESCE(i.freight_value, 0.0) AS freight_value,
         COALESCE(i.price, 0.0) + COALESCE(i.freight_value, 0.0) AS revenue,
         r.review_score,
         o.order_purchase_timestamp, o.order_approved_at, o.order_delivered_carrier_date,
         o.order_delivered_customer_date, o.order_estimated_delivery_date,
         date_diff('microsecond', o.order_purchase_timestamp, o.order_delivered_customer_date) / 86400e6 AS delivery_days
  FROM raw_orders o
  LEFT JOIN raw_items i ON o.order_id = i.order_id
  LEFT JOIN review_mean r ON o.order_id = r.order_id
  LEFT JOIN raw_customers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT product_id, COALESCE(product_category_name, 'unknown') AS category FROM raw_products) p
         ON i.product_id = p.product_id
  LEFT JOIN raw_sellers s ON i.seller_id = s.seller_id),
prepared AS (
  SELECT * REPLACE (COALESCE(revenue, 0.0) AS revenue, COALESCE(product_category, 'unknown') AS product_category,
                    COALESCE(customer_state, 'NA') AS customer_state),
         date_trunc('month', order_purchase_timestamp) AS month,
         CAST(order_purchase_timestamp AS DATE) AS order_date
  FROM fact WHERE order_purchase_timestamp IS NOT NULL),
monthly AS (
  SELECT month, {msum('revenue')} AS revenue,
         count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_unique_id) AS customers
  FROM prepared WHERE month IS NOT NULL GROUP BY month),
monthly_kpis AS (
  SELECT month, revenue, total_orders, customers,
         COALESCE(revenue / NULLIF(total_orders, 0), 0.0) AS aov,
         COALESCE(revenue / NULLIF(customers, 0), 0.0) AS clv
  FROM monthly),
rfm_raw AS (
  SELECT customer_unique_id,
         CAST(floor(date_diff('microsecond', max(order_purchase_timestamp),
                              (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY FROM prepared)) / 86400e6) AS BIGINT) AS recency,
         count(DISTINCT order_id) AS frequency, {msum('revenue')} AS monetary,
         avg(review_score) AS ar, {mdays()} AS ad
  FROM prepared WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
rfm AS (SELECT customer_unique_id, recency, frequency, monetary FROM rfm_raw),
features AS (
  SELECT customer_unique_id, recency, frequency, monetary,
         COALESCE(ar, (SELECT median(ar) FROM rfm_raw), 0.0) AS avg_review_score,
         COALESCE(ad, (SELECT median(ad) FROM rfm_raw), 0.0) AS avg_delivery_days,
         CAST(recency > 120 AS INTEGER) AS churned
  FROM rfm_raw),
cm AS (
  SELECT DISTINCT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS m FROM prepared
  WHERE customer_unique_id IS NOT NULL AND order_purchase_timestamp IS NOT NULL),
cc AS (SELECT customer_unique_id, m, min(m) OVER (PARTITION BY customer_unique_id) AS cohort FROM cm),
cnt AS (
  SELECT cohort, (year(m) * 12 + month(m)) - (year(cohort) * 12 + month(cohort)) AS period_number, count(*) AS customers
  FROM cc GROUP BY ALL),
retention AS (
  SELECT strftime(cnt.cohort, '%Y-%m') AS cohort_month, CAST(cnt.period_number AS INTEGER) AS period_number,
         CAST(cnt.customers AS BIGINT) AS customers, CAST(sz.customers AS BIGINT) AS cohort_size,
         round_even(cnt.customers / sz.customers * 100.0, 1) AS retention_pct
  FROM cnt JOIN (SELECT cohort, customers FROM cnt WHERE period_number = 0) sz ON cnt.cohort = sz.cohort),
mrev AS (SELECT month AS ds, {msum('revenue')} AS y FROM prepared WHERE month IS NOT NULL GROUP BY month),
series AS (
  SELECT cal.ds, COALESCE(mrev.y, 0.0) AS y
  FROM (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM mrev) cal
  LEFT JOIN mrev ON cal.ds = mrev.ds)
"""



def _z(column: str, table: str) -> str:
    """Standardised column; constant columns are 0."""
    return (f"({column} - (SELECT avg({column}) FROM {table})) / "
            f"(SELECT CASE WHEN stddev_pop({column}) > 0 THEN stddev_pop({column}) ELSE 1 END FROM {table}) AS {column}_z")


_RFM = ("recency", "frequency", "monetary")
_DISTANCES = ", ".join(" + ".join(f"({c}_z - ({x})) ** 2" for c, x in zip(_RFM, centre)) for centre in CENTRES)
SCALED = f"scaled AS (SELECT customer_unique_id, {', '.join(_z(c, 'rfm') for c in _RFM)} FROM rfm)"
SEGMENTS = f"""
WITH {SCALED},
clustered AS (SELECT customer_unique_id, list_position(d, list_min(d)) - 1 AS cluster FROM (SELECT *, [{_DISTANCES}] AS d FROM scaled)),
rows AS (SELECT r.customer_unique_id, CAST(recency AS DOUBLE) AS recency, CAST(frequency AS DOUBLE) AS frequency, monetary, cluster
         FROM rfm r JOIN clustered USING (customer_unique_id)),
profile AS (SELECT cluster, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM rows GROUP BY cluster),
nth AS (SELECT *, row_number() OVER (ORDER BY m, f, r, cluster) AS i FROM profile),
scored AS (SELECT cluster, i, row_number() OVER (ORDER BY f, i) + row_number() OVER (ORDER BY m, i) - row_number() OVER (ORDER BY r, i) AS score FROM nth),
named AS (SELECT cluster, {SEGMENT_LABELS}[row_number() OVER (ORDER BY score, i)] AS segment FROM scored),
segments AS (SELECT customer_unique_id, recency, frequency, monetary, CAST(cluster AS INTEGER) AS cluster, segment FROM rows JOIN named USING (cluster))"""
_MARGIN = " + ".join([f"({INTERCEPT})", *(f"({w}) * {c}_z" for w, c in zip(COEFFICIENTS, CHURN_FEATURES))])
PROBABILITIES = f"""
fz AS (SELECT customer_unique_id, churned, {', '.join(_z(c, 'features') for c in CHURN_FEATURES)} FROM features),
probs AS (SELECT *, 1 / (1 + exp(-({_MARGIN}))) AS p FROM fz)"""

_LLOYD_STEPS = 5


def _lloyd() -> str:
    """Lloyd steps from CENTRES over the scaled customers, one pair of tables (assignment, centres) a step."""
    z = [f"{c}_z" for c in _RFM]
    values = ", ".join(f"({i}, CAST(0 AS BIGINT), {', '.join(f'{x}::DOUBLE' for x in centre)})" for i, centre in enumerate(CENTRES))
    out = f"WITH {SCALED},\nm0(cluster, customers, {', '.join(z)}) AS (VALUES {values})"
    for i in range(_LLOYD_STEPS):
        gap = " + ".join(f"(s.{c} - m.{c}) ** 2" for c in z)
        out += f""",
        n{i} AS MATERIALIZED (SELECT any_value(s) AS s, arg_min(m.cluster, ({gap}, m.cluster)) AS cluster
                 FROM scaled s, m{i} m GROUP BY s.customer_unique_id),
        m{i + 1} AS MATERIALIZED (SELECT m.cluster, count(n.cluster) AS customers, {', '.join(f'COALESCE(avg(n.s.{c}), any_value(m.{c})) AS {c}' for c in z)}
                 FROM m{i} m LEFT JOIN n{i} n ON m.cluster = n.cluster GROUP BY m.cluster)"""
    return f"{out} SELECT CAST(cluster AS INTEGER) AS cluster, customers, {', '.join(f'round({c}, 9) AS {c}' for c in z)} FROM m{_LLOYD_STEPS}"


#: M-03: quotas of the holdout by class, and the customers with the smallest seeded md5 of each.
SPLIT = """
classes AS (SELECT churned, count(*) AS k FROM features GROUP BY churned),
whole AS (SELECT sum(k) AS n, sum(k) - ceil(sum(k) / 4.0) AS n_train, min(k) AS least FROM classes),
shares AS (SELECT churned, k, n_train, floor(n_train * k / n::DOUBLE) AS t, n_train * k / n::DOUBLE - floor(n_train * k / n::DOUBLE) AS rest FROM classes, whole),
quotas AS (SELECT churned, k - t - CASE WHEN row_number() OVER (ORDER BY rest DESC, churned) <= n_train - sum(t) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
split AS (
  SELECT f.*, CASE WHEN (SELECT least FROM whole) < 2
                   THEN row_number() OVER (ORDER BY md5('42:' || customer_unique_id), customer_unique_id) <= (SELECT n - n_train FROM whole)
                   ELSE row_number() OVER (PARTITION BY churned ORDER BY md5('42:' || customer_unique_id), customer_unique_id) <= quota END AS is_test
  FROM features f JOIN quotas USING (churned))"""
_NEWTON_STEPS = 40


def _newton() -> str:
    """M-04: Newton steps of the balanced ridge logistic regression on the training rows, then ``scored`` with all customers.

    A step sums gradient and Hessian, eliminates row by row and goes back."""
    x = [*(f"{c}_z" for c in CHURN_FEATURES), "1.0::DOUBLE"]
    d = len(x)
    theta = [f"t{i}" for i in range(d)]
    sums = [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {1 if i == j < d - 1 else 0} AS a{i}{j}" for i in range(d) for j in range(d)]
    sums += [f"sum(w * (p - churned) * {x[i]}) + {f't{i}' if i < d - 1 else '0'} AS a{i}{d}" for i in range(d)]
    sql = f"""SELECT step, {', '.join(theta)}, {', '.join(sums)}
              FROM (SELECT newton.*, train.*, 1 / (1 + exp(-({' + '.join(f'{t} * {v}' for t, v in zip(theta, x))}))) AS p FROM newton, train WHERE step < {_NEWTON_STEPS})
              GROUP BY step, {', '.join(theta)}"""
    for k in range(d):  # eliminate column k below row k
        cells = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" if i > k else f"a{i}{j}" for i in range(d) for j in range(d + 1)]
        sql = f"SELECT step, {', '.join(theta)}, {', '.join(cells)} FROM ({sql})"
    for k in reversed(range(d)):
        known = " ".join(f"- a{k}{j} * d{j}" for j in range(k + 1, d))
        sql = f"SELECT *, (a{k}{d} {known}) / a{k}{k} AS d{k} FROM ({sql})"
    scaled = ", ".join(f"(f.{c} - m_{c}) / s_{c} AS {c}_z" for c in CHURN_FEATURES)
    moments = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in CHURN_FEATURES)
    score = " + ".join(f"{t} * {v}" for t, v in zip(theta, x))
    return f"""WITH RECURSIVE {SPLIT.strip()},
moments AS (SELECT {moments} FROM features),
sized AS (SELECT count(*) AS n, sum(churned) AS pos FROM split WHERE NOT is_test),
scaled_split AS MATERIALIZED (SELECT f.*, {scaled} FROM split f, moments),
train AS MATERIALIZED (
  SELECT churned, {', '.join(x[:-1])}, CASE churned WHEN 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END AS w FROM scaled_split, sized WHERE NOT is_test),
newton(step, {', '.join(theta)}) AS (
  SELECT 0, {', '.join(f'0.0::DOUBLE AS {t}' for t in theta)}
  UNION ALL
  SELECT step + 1, {', '.join(f'{t} - d{i}' for i, t in enumerate(theta))} FROM ({sql})),
fitted AS (SELECT * FROM newton WHERE step = {_NEWTON_STEPS}),
scored AS (SELECT scaled_split.*, {', '.join(theta)}, 1 / (1 + exp(-({score}))) AS p FROM scaled_split, fitted)"""


def _f1_and_auc(rows: str) -> str:
    return f"""
        ranked AS (SELECT churned, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS nth FROM {rows}),
        t AS (SELECT count(*) FILTER (p >= 0.5 AND churned = 1) AS tp, count(*) FILTER (p >= 0.5 AND churned = 0) AS fp,
                     count(*) FILTER (p < 0.5 AND churned = 1) AS fn, count(*) FILTER (churned = 1)::DOUBLE AS pos,
                     count(*) FILTER (churned = 0)::DOUBLE AS neg, sum(nth) FILTER (churned = 1) AS ranks FROM ranked)
        SELECT 'F1' AS metric, round(COALESCE(2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0), 0), 9) AS value FROM t
        UNION ALL
        SELECT 'AUC-ROC', round(COALESCE((ranks - pos * (pos + 1) / 2) / NULLIF(pos * neg, 0), 0), 9) FROM t"""


MODEL = _newton()
_CENTROIDS = ", ".join(f"('{s}', {lat}, {lon})" for s, (lat, lon) in STATE_CENTROIDS.items())

_EWMA_BY_CATEGORY = f"""WITH RECURSIVE m AS (
          SELECT product_category, month AS ds, {msum('revenue')} AS y FROM prepared
          WHERE month IS NOT NULL AND product_category IS NOT NULL GROUP BY product_category, month),
        cal AS (SELECT product_category, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds
                FROM m GROUP BY product_category),
        s AS (SELECT cal.product_category, cal.ds, COALESCE(m.y, 0.0) AS y,
                     row_number() OVER (PARTITION BY cal.product_category ORDER BY cal.ds) AS rn
              FROM cal LEFT JOIN m ON cal.product_category = m.product_category AND cal.ds = m.ds),
        ew(product_category, rn, ds, y, yhat) AS (
          SELECT product_category, rn, ds, y, y FROM s WHERE rn = 1
          UNION ALL
          SELECT s.product_category, s.rn, s.ds, s.y, CAST(0.4 AS DOUBLE) * s.y + CAST(0.6 AS DOUBLE) * ew.yhat
          FROM ew JOIN s ON s.product_category = ew.product_category AND s.rn = ew.rn + 1)"""

QUERIES = {
    "star_fact_orders": "SELECT * FROM fact",
    "dim_customers": """SELECT customer_id, customer_unique_id, zip_code_prefix, city, customer_state AS state
                        FROM raw_customers""",
    "dim_products": """SELECT product_id, COALESCE(product_category_name, 'unknown') AS category, name_length,
                              CAST(NULL AS DOUBLE) AS description_length, CAST(NULL AS DOUBLE) AS photos_qty, weight_g,
                              CAST(NULL AS DOUBLE) AS length_cm, CAST(NULL AS DOUBLE) AS height_cm,
                              CAST(NULL AS DOUBLE) AS width_cm
                       FROM raw_products""",
    "dim_sellers": "SELECT seller_id, zip_code_prefix, city, seller_state AS state FROM raw_sellers",
    "fact_prepared": "SELECT * FROM prepared",
    "filtered_fact": """SELECT * FROM prepared
                        WHERE order_date BETWEEN DATE '1997-03-15' AND DATE '1999-10-20'
                          AND product_category = 'Brand#1' AND customer_state = 'AM'""",
    "filter_domains": """
        SELECT 'min_date' AS control, strftime(CAST(min(order_purchase_timestamp) AS DATE), '%Y-%m-%d') AS value FROM prepared
        UNION ALL SELECT 'max_date', strftime(CAST(max(order_purchase_timestamp) AS DATE), '%Y-%m-%d') FROM prepared
        UNION ALL SELECT DISTINCT 'category', product_category FROM prepared WHERE product_category IS NOT NULL
        UNION ALL SELECT DISTINCT 'state', customer_state FROM prepared WHERE customer_state IS NOT NULL""",
    "monthly_kpis": "SELECT * FROM monthly_kpis",
    "monthly_kpis_last24": "SELECT * FROM monthly_kpis ORDER BY month DESC LIMIT 24",
    "kpi_summary": f"""
        WITH totals AS (
          SELECT {msum('revenue')} AS revenue, CAST(count(DISTINCT order_id) AS DOUBLE) AS total_orders,
                 CAST(count(DISTINCT customer_unique_id) AS DOUBLE) AS customers FROM prepared),
        t AS (SELECT revenue, total_orders, COALESCE(revenue / NULLIF(total_orders, 0), 0.0) AS aov,
                     COALESCE(revenue / NULLIF(customers, 0), 0.0) AS clv FROM totals),
        ranked AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS rn FROM monthly_kpis),
        lt AS (SELECT count(*) AS n_months,
                 max(CASE WHEN rn = 1 THEN CAST(revenue AS DOUBLE) END) AS cur_revenue,
                 max(CASE WHEN rn = 2 THEN CAST(revenue AS DOUBLE) END) AS prev_revenue,
                 max(CASE WHEN rn = 1 THEN CAST(total_orders AS DOUBLE) END) AS cur_total_orders,
                 max(CASE WHEN rn = 2 THEN CAST(total_orders AS DOUBLE) END) AS prev_total_orders,
                 max(CASE WHEN rn = 1 THEN aov END) AS cur_aov, max(CASE WHEN rn = 2 THEN aov END) AS prev_aov,
                 max(CASE WHEN rn = 1 THEN clv END) AS cur_clv, max(CASE WHEN rn = 2 THEN clv END) AS prev_clv
               FROM ranked WHERE rn <= 2),
        rows_ AS (
          SELECT 1 AS position, 'Total Revenue' AS metric, t.revenue AS value,
                 CASE WHEN n_months >= 2 AND prev_revenue <> 0 THEN (cur_revenue - prev_revenue) / prev_revenue * 100 ELSE 0.0 END AS delta
          FROM t, lt
          UNION ALL SELECT 2, 'Total Orders', t.total_orders,
                 CASE WHEN n_months >= 2 AND prev_total_orders <> 0 THEN (cur_total_orders - prev_total_orders) / prev_total_orders * 100 ELSE 0.0 END
          FROM t, lt
          UNION ALL SELECT 3, 'Average Order Value', t.aov,
                 CASE WHEN n_months >= 2 AND prev_aov <> 0 THEN (cur_aov - prev_aov) / prev_aov * 100 ELSE 0.0 END
          FROM t, lt
          UNION ALL SELECT 4, 'Customer Lifetime Value', t.clv,
                 CASE WHEN n_months >= 2 AND prev_clv <> 0 THEN (cur_clv - prev_clv) / prev_clv * 100 ELSE 0.0 END
          FROM t, lt)
        SELECT position, metric, value, delta,
               CASE WHEN metric = 'Total Orders' THEN format('{{:,.0f}}', value) ELSE 'R$ ' || format('{{:,.0f}}', value) END AS display_value,
               printf('%+.1f%% MoM', delta) AS display_delta
        FROM rows_""",
    "category_revenue_top10": f"""
        SELECT product_category, {msum('revenue')} AS revenue FROM prepared WHERE product_category IS NOT NULL
        GROUP BY product_category ORDER BY revenue DESC, product_category LIMIT 10""",
    "order_status_funnel": """
        SELECT order_status, count(DISTINCT order_id) AS orders FROM prepared WHERE order_status IS NOT NULL
        GROUP BY order_status""",
    "state_revenue_geo": f"""
        WITH c(customer_state, lat, lon) AS (VALUES {_CENTROIDS})
        SELECT g.customer_state, g.revenue, c.lat, c.lon
        FROM (SELECT customer_state, {msum('revenue')} AS revenue FROM prepared WHERE customer_state IS NOT NULL
              GROUP BY customer_state) g
        JOIN c ON g.customer_state = c.customer_state""",

    "star_row_counts": """
        SELECT 'fact_orders' AS table_name, count(*) AS row_count FROM fact
        UNION ALL SELECT 'dim_customers', count(*) FROM raw_customers
        UNION ALL SELECT 'dim_products', count(*) FROM raw_products
        UNION ALL SELECT 'dim_sellers', count(*) FROM raw_sellers""",
    "product_performance": f"""
        SELECT product_id, product_category, {msum('revenue')} AS revenue, avg(review_score) AS review_score,
               count(DISTINCT order_id) AS orders
        FROM prepared WHERE product_id IS NOT NULL AND product_category IS NOT NULL
        GROUP BY product_id, product_category""",
    "seller_leaderboard": f"""
        SELECT seller_id, {msum('revenue')} AS revenue, avg(review_score) AS avg_rating,
               {mdays()} AS avg_delivery_days, count(DISTINCT order_id) AS orders
        FROM prepared WHERE seller_id IS NOT NULL GROUP BY seller_id
        ORDER BY revenue DESC, seller_id LIMIT 15""",
    "review_sentiment": """
        WITH b AS (
          SELECT CASE WHEN review_score >= 0 AND review_score <= 2 THEN 'negative'
                      WHEN review_score > 2 AND review_score <= 3 THEN 'neutral'
                      WHEN review_score > 3 AND review_score <= 5 THEN 'positive' END AS sentiment, order_id
          FROM prepared),
        c AS (SELECT sentiment, count(DISTINCT order_id) AS orders FROM b WHERE sentiment IS NOT NULL GROUP BY sentiment)
        SELECT d.sentiment, CAST(COALESCE(c.orders, 0) AS BIGINT) AS orders
        FROM (VALUES ('negative'), ('neutral'), ('positive')) d(sentiment) LEFT JOIN c ON d.sentiment = c.sentiment""",
    "delivery_time_by_state": """
        WITH d AS (SELECT customer_state, delivery_days AS dd FROM prepared
                   WHERE delivery_days IS NOT NULL AND customer_state IS NOT NULL),
        s AS (SELECT customer_state, count(*) AS n, min(dd) AS mn, round(quantile_cont(dd, 0.25), 9) AS q1,
                     round(quantile_cont(dd, 0.5), 9) AS med, round(quantile_cont(dd, 0.75), 9) AS q3, max(dd) AS mx
              FROM d GROUP BY customer_state)
        SELECT s.customer_state, CAST(n AS BIGINT) AS count, mn AS min, q1, med AS median, q3, mx AS max,
               min(CASE WHEN d.dd >= q1 - 1.5 * (q3 - q1) THEN d.dd END) AS lower_whisker,
               max(CASE WHEN d.dd <= q3 + 1.5 * (q3 - q1) THEN d.dd END) AS upper_whisker
        FROM s JOIN d ON s.customer_state = d.customer_state
        GROUP BY s.customer_state, n, mn, q1, med, q3, mx""",
    "product_month_orders": """
        SELECT product_id, product_category, month, count(DISTINCT order_id) AS orders FROM prepared
        WHERE product_id IS NOT NULL AND product_category IS NOT NULL AND month IS NOT NULL
        GROUP BY product_id, product_category, month""",
    "slow_movers": """
        WITH pm AS (
          SELECT product_id, product_category, month, count(DISTINCT order_id) AS orders FROM prepared
          WHERE product_id IS NOT NULL AND product_category IS NOT NULL AND month IS NOT NULL
          GROUP BY product_id, product_category, month),
        m AS (SELECT product_id, product_category, avg(orders) AS mean_orders FROM pm GROUP BY product_id, product_category)
        SELECT product_id, product_category, mean_orders AS orders FROM m WHERE mean_orders < 5
        ORDER BY mean_orders, product_id, product_category LIMIT 50""",
    "rfm_base": "SELECT * FROM rfm",
    "top_customers_ltv": """
        SELECT customer_unique_id, recency, frequency, monetary AS lifetime_value_brl FROM rfm
        ORDER BY monetary DESC, customer_unique_id LIMIT 10""",
    "customer_features": "SELECT * FROM features",
    "churn_class_balance": "SELECT churned, count(*) AS customers FROM features GROUP BY churned",
    "rfm_scaled": f"""
        WITH {SCALED} SELECT customer_unique_id, {', '.join(f'round({c}_z, 9) AS {c}_z' for c in _RFM)} FROM scaled""",
    "rfm_segments_given": f"{SEGMENTS} SELECT * FROM segments",
    "segment_profile_given": f"""{SEGMENTS}
        SELECT segment, cluster, count(*) AS customers, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in _RFM)}
        FROM segments GROUP BY segment, cluster""",
    "segment_churn_heuristic_given": f"""{SEGMENTS},
        s AS (SELECT segment, avg(recency) AS r, avg(frequency) AS f FROM segments GROUP BY segment)
        SELECT segment, round(least(greatest((r / NULLIF(max(r) OVER (), 0) * 0.7::DOUBLE
                                              + (1 - f / NULLIF(max(f) OVER (), 0)) * 0.3::DOUBLE) * 100, 0), 100), 6) AS churn_probability
        FROM s""",
    "top_customers_segmented_given": f"""{SEGMENTS}
        SELECT customer_unique_id, segment, recency, frequency, monetary AS lifetime_value_brl FROM segments
        ORDER BY monetary DESC, customer_unique_id LIMIT 10""",
    "churn_scores_given": f"WITH {PROBABILITIES.strip()} SELECT customer_unique_id, round(p, 9) AS churn_probability FROM probs",
    "churn_metrics_given": f"WITH {PROBABILITIES.strip()}, {_f1_and_auc('probs')}",
    "churn_drivers_given": f"WITH {PROBABILITIES.strip()} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs(({w}) * {c}_z)), 9) AS importance, 'mean_abs_shap' AS source FROM probs"
        for w, c in zip(COEFFICIENTS, CHURN_FEATURES)),
    "churn_by_segment_given": f"""{SEGMENTS}, {PROBABILITIES.strip()}
        SELECT segment, round(avg(p) * 100, 6) AS churn_probability FROM probs JOIN segments USING (customer_unique_id) GROUP BY segment""",
    "churn_scores_top100_given": f"""{SEGMENTS}, {PROBABILITIES.strip()}
        SELECT customer_unique_id, segment, round_even(p * 100, 1) AS churn_probability
        FROM probs JOIN segments USING (customer_unique_id) ORDER BY 3 DESC, 1 LIMIT 100""",
    "kmeans_lloyd_steps": _lloyd(),
    "churn_split": f"WITH {SPLIT.strip()} SELECT customer_unique_id, churned, is_test FROM split",
    "churn_metrics": f"{MODEL}, tested AS (SELECT churned, p FROM scored WHERE is_test), {_f1_and_auc('tested')}",
    "churn_drivers": f"{MODEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs(t{i} * {c}_z)), 6) AS importance, 'mean_abs_shap' AS source FROM scored"
        for i, c in enumerate(CHURN_FEATURES)),
    "churn_drivers_coefficient": f"{MODEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(abs(t{i}), 6) AS importance, 'abs_coefficient' AS source FROM fitted" for i, c in enumerate(CHURN_FEATURES)),
    "churn_predictions": f"""{MODEL}
        SELECT customer_unique_id, recency, frequency, monetary, avg_review_score, avg_delivery_days, churned, round(p, 6) AS churn_probability
        FROM scored""",
    "churn_one_class": f"""WITH labels AS (SELECT count(DISTINCT recency > {ONE_CLASS_DAYS}) AS k FROM features)
        SELECT 'metric' AS kind, unnest(['F1', 'AUC-ROC']) AS name, 0.0::DOUBLE AS value FROM labels WHERE k < 2
        UNION ALL SELECT 'driver', unnest({list(CHURN_FEATURES)}), 0.0 FROM labels WHERE k < 2
        UNION ALL SELECT 'prediction', customer_unique_id, 0.0 FROM features, labels WHERE k < 2""",
    "cohort_retention": "SELECT * FROM retention",
    "cohort_matrix": f"SELECT cohort_month, {_COHORT_PERIODS} FROM retention GROUP BY cohort_month",
    "monthly_revenue_series": "SELECT ds, y FROM series",
    "forecast_methods": """
        SELECT product_category, date_diff('month', min(month), max(month)) + 1 AS months,
               CASE WHEN date_diff('month', min(month), max(month)) + 1 >= 3 THEN 'Exponential smoothing fallback' ELSE 'Insufficient history' END AS method
        FROM prepared WHERE month IS NOT NULL AND product_category IS NOT NULL GROUP BY product_category""",
    "forecast_backtest_smoothing": f"""
        {_EWMA_BY_CATEGORY},
        st AS (SELECT product_category, max(rn) AS n FROM ew GROUP BY product_category)
        SELECT e.product_category, e.ds AS origin, 'smoothing' AS method, round(e.yhat, 4) AS yhat, s.y AS actual, round(s.y - e.yhat, 4) AS error
        FROM ew e JOIN st ON e.product_category = st.product_category JOIN s ON s.product_category = e.product_category AND s.rn = e.rn + 1
        WHERE e.rn >= 3 AND e.rn >= n - 12""",
    "forecast_ewma": """
        WITH RECURSIVE s AS (SELECT ds, y, row_number() OVER (ORDER BY ds) AS rn FROM series),
        ew(rn, ds, y, yhat) AS (
          SELECT rn, ds, y, y FROM s WHERE rn = 1
          UNION ALL
          SELECT s.rn, s.ds, s.y, CAST(0.4 AS DOUBLE) * s.y + CAST(0.6 AS DOUBLE) * ew.yhat FROM ew JOIN s ON s.rn = ew.rn + 1),
        st AS (SELECT count(*) AS n, max(rn) AS last_rn,
                      1.96 * CASE WHEN COALESCE(stddev_samp(y - yhat), 0) <> 0 THEN stddev_samp(y - yhat)
                                  WHEN COALESCE(stddev_samp(y), 0) <> 0 THEN stddev_samp(y) ELSE 0.0 END AS band
               FROM ew),
        out AS (
          SELECT ds, y AS actual, yhat, band FROM ew, st WHERE n >= 3 AND rn > last_rn - 24
          UNION ALL
          SELECT CAST(ds + INTERVAL 1 MONTH AS TIMESTAMP), CAST(NULL AS DOUBLE), yhat, band FROM ew, st WHERE n >= 3 AND rn = last_rn)
        SELECT ds, actual, round(yhat, 4) AS yhat, round(yhat - band, 4) AS yhat_lower, round(yhat + band, 4) AS yhat_upper
        FROM out""",
    "forecast_ewma_by_category": f"""
        {_EWMA_BY_CATEGORY},
        st AS (SELECT product_category, count(*) AS n, max(rn) AS last_rn,
                      1.96 * CASE WHEN COALESCE(stddev_samp(y - yhat), 0) <> 0 THEN stddev_samp(y - yhat)
                                  WHEN COALESCE(stddev_samp(y), 0) <> 0 THEN stddev_samp(y) ELSE 0.0 END AS band
               FROM ew GROUP BY product_category),
        out AS (
          SELECT ew.product_category, ds, y AS actual, yhat, band FROM ew JOIN st ON ew.product_category = st.product_category
          WHERE n >= 3 AND rn > last_rn - 24
          UNION ALL
          SELECT ew.product_category, CAST(ds + INTERVAL 1 MONTH AS TIMESTAMP), CAST(NULL AS DOUBLE), yhat, band
          FROM ew JOIN st ON ew.product_category = st.product_category WHERE n >= 3 AND rn = last_rn)
        SELECT product_category, ds, actual, round(yhat, 4) AS yhat, round(yhat - band, 4) AS yhat_lower,
               round(yhat + band, 4) AS yhat_upper
        FROM out""",
}


QUERIES["star_from_text"] = "SELECT * REPLACE (" + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in ("order_id", "customer_id", "product_id", "seller_id")) + ") FROM fact"
QUERIES["ingest_run_log"] = """
    WITH n AS (SELECT (SELECT count(*) FROM fact) AS f, (SELECT count(*) FROM raw_customers) AS c, (SELECT count(*) FROM raw_products) AS p,
                      (SELECT count(*) FROM raw_sellers) AS s)
    SELECT 'success' AS status, format('{} rows written (dim_customers {}, dim_products {}, dim_sellers {}, fact_orders {})', f + c + p + s, c, p, s, f) AS message,
           false AS latest, true AS latest_success FROM n
    UNION ALL SELECT 'failed', 'Missing required CSV', true, false"""

#: Tables of the marts under other names than their queries', and those with a column under another name.
_MART_SOURCES = {"rfm_segments": "rfm_base", "top_customers": "top_customers_ltv"}


def _mart_sql(mart: str) -> str:
    parts = []
    for table, (key, *measures) in MART_MEASURES[mart].items():
        body = QUERIES[_MART_SOURCES.get(table, table)].strip()
        label = f"strftime({key}, '%Y-%m')" if key in ("month", "ds") else f"CAST({key} AS VARCHAR)"
        values = ", ".join(f"{{'measure': '{m}', 'value': round(CAST({m} AS DOUBLE), {digits})}}" for m, digits in measures)
        parts.append(f"SELECT '{table}' AS table_name, {label} AS name, unnest([{values}], recursive := true) FROM ({body})")
    return "\nUNION ALL\n".join(parts)


for _mart in MART_MEASURES:
    QUERIES[f"mart_{_mart}"] = _mart_sql(_mart)
QUERIES["mart_row_counts"] = "\nUNION ALL\n".join(
    [f"SELECT '{mart}/{table}' AS table_name, count(*) AS row_count FROM ({QUERIES[_MART_SOURCES.get(table, table)].strip()})"
     for mart, tables in MART_MEASURES.items() for table in tables]
    + [f"SELECT '{name}' AS table_name, {rows} AS row_count" for name, rows in (
        ("customer/segment_churn_heuristic", len(SEGMENT_LABELS)),
        ("customer/cohort_matrix", "(SELECT count(DISTINCT cohort_month) FROM retention)"),
        ("predictive/forecast_seasonal", "(SELECT least(count(*), 24) + 1 FROM series)"),
        ("predictive/churn_by_segment", len(SEGMENT_LABELS)),
        ("predictive/churn_scores_top100", "(SELECT least(count(*), 100) FROM features)"))])


def statements() -> dict[str, str]:
    out = {}
    for name, sql in QUERIES.items():
        body = sql.strip()
        head = "WITH"
        if body.upper().startswith("WITH RECURSIVE "):
            head, body = "WITH RECURSIVE", body[len("WITH RECURSIVE "):]
            out[name] = f"{head} {BASE.strip()},\n{body}"
        elif body.upper().startswith("WITH "):
            out[name] = f"{head} {BASE.strip()},\n{body[5:]}"
        else:
            out[name] = f"{head} {BASE.strip()}\n{body}"
    return out
