"""SQL counterparts of the registered queries, for an independent engine on the same tables.

They share the derivation of the raw tables with the Spark side and formulate everything after
it on their own: DISTINCT, median(), ranked windows, self joins, fan-out joins.
"""

from __future__ import annotations

import re

from tallybird.plans import oracle_constants as own
from tallybird.plans.registry import ANOMALOUS_MONTH, CORRELATED, KNOWN_COLUMNS
from tallybird.operators.churn_features import NUMERIC
from tallybird.operators.daily import METRICS
from tallybird.schemas import FOREIGN_KEYS, PRIMARY_KEY, RAW
from tallybird.sources.retail_views import NEGATIVE_TEXTS, NEUTRAL_TEXTS, POSITIVE_TEXTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _pick(texts: list[str]) -> str:
    return f"{_list(texts)}[order_id * 17 % {len(texts)} + 1]"


CTE: dict[str, str] = {}

# ---- raw tables

CTE["raw_customers"] = """
SELECT customer_id, customer_name, age, gender, city, signup_date, customer_segment FROM (
  SELECT c_custkey AS customer_id, c_name AS customer_name,
    CASE WHEN c_custkey % 33 = 7 THEN NULL ELSE CAST(18 + c_custkey % 47 AS INT) END AS age,
    CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END
      AS gender,
    CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN upper(n_name)
      WHEN 2 THEN concat('  ', n_name, '  ') ELSE n_name END AS city,
    CAST(CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2000 AS INTEGER) AS DATE) AS VARCHAR)
      AS signup_date,
    c_mktsegment AS customer_segment,
    unnest(CASE WHEN c_custkey % 100 = 0 THEN [1, 2] ELSE [1] END) AS copy
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

CTE["raw_products"] = """
SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
  round(p_retailprice / (CAST(1.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (p_partkey % 7)), 2) AS cost,
  p_retailprice AS selling_price,
  CAST(CASE WHEN p_partkey % 20 = 9 THEN NULL WHEN p_partkey % 400 = 3 THEN -5
    ELSE (p_partkey * 17) % 500 END AS INT) AS inventory
FROM part"""

CTE["single_orders"] = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, product_id,
  CAST(day AS VARCHAR) AS order_date,
  CAST(CASE WHEN o_orderkey % 1800 = 11 THEN -1 ELSE 1 + o_orderkey % 4 END AS INT) AS quantity,
  CASE WHEN o_orderkey % 1800 = 23 THEN CAST(0 AS DOUBLE)
    WHEN year(day) = 2000 AND month(day) = 11
      THEN round(p_retailprice * CAST(1.6 AS DOUBLE), 2)
    ELSE p_retailprice END AS price,
  CAST(CASE CAST(floor(o_orderkey / CAST(7 AS DOUBLE)) AS BIGINT) % 7 WHEN 3 THEN 0.05
    WHEN 4 THEN 0.10 WHEN 5 THEN 0.15 WHEN 6 THEN 0.20 ELSE 0 END AS DOUBLE) AS discount,
  CASE o_orderkey % 3 WHEN 0 THEN lower(method) WHEN 1 THEN upper(method) ELSE method END
    AS payment_method,
  CASE WHEN o_orderkey % 25 = 5 THEN NULL ELSE CAST(1 + o_orderkey % 9 AS INT) END
    AS delivery_time,
  CASE o_orderkey % 7 WHEN 4 THEN 'Cancelled' WHEN 5 THEN 'Returned' WHEN 6 THEN 'Pending'
    ELSE 'Delivered' END AS status
FROM (
  SELECT *,
    CASE WHEN o_custkey % 20 < 3 AND CAST(o_orderdate AS DATE) >= DATE '1998-04-17'
      THEN CAST(CAST(o_orderdate AS DATE) - 1202 AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day,
    CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Credit Card' WHEN '2' THEN 'Debit Card'
      WHEN '3' THEN 'UPI' WHEN '4' THEN 'Net Banking' ELSE 'COD' END AS method
  FROM orders
  JOIN (SELECT l_orderkey, min(l_partkey) AS product_id FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = product_id)"""

CTE["raw_orders"] = """
SELECT * FROM single_orders UNION ALL SELECT * FROM single_orders WHERE order_id % 200 = 0"""

CTE["raw_reviews"] = f"""
SELECT order_id AS review_id, customer_id, order_id, CAST(stars AS INT) AS rating,
  CASE WHEN order_id % 33 = 0 THEN NULL WHEN stars >= 4 THEN {_pick(POSITIVE_TEXTS)}
    WHEN stars = 3 THEN {_pick(NEUTRAL_TEXTS)} ELSE {_pick(NEGATIVE_TEXTS)} END AS review_text,
  CAST(CAST(CAST(order_date AS DATE) + CAST(2 + order_id % 13 AS INTEGER) AS DATE) AS VARCHAR)
    AS review_date
FROM (
  SELECT *, CASE WHEN order_id * 13 % 100 < 7 THEN 1 WHEN order_id * 13 % 100 < 15 THEN 2
    WHEN order_id * 13 % 100 < 30 THEN 3 WHEN order_id * 13 % 100 < 60 THEN 4 ELSE 5 END AS stars
  FROM single_orders WHERE status = 'Delivered' AND order_id % 5 < 2)"""

CTE["raw_marketing"] = """
SELECT event_id AS campaign_id, user_id AS customer_id, concat('C', event_id % 6) AS campaign,
  CASE WHEN event_id % 25 = 4 THEN NULL ELSE value END AS spend,
  CAST(json_extract_string(props, '$.k') AS INT) AS clicks,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion
FROM events"""

# ---- cleaning

CTE["one_customers"] = "SELECT DISTINCT * FROM raw_customers"
CTE["one_products"] = """
SELECT DISTINCT product_id, category, brand, cost, selling_price,
  CASE WHEN inventory < 0 THEN NULL ELSE inventory END AS inventory FROM raw_products"""
CTE["one_orders"] = "SELECT DISTINCT * FROM raw_orders WHERE quantity > 0 AND price > 0"
CTE["one_reviews"] = "SELECT DISTINCT * FROM raw_reviews"
CTE["one_marketing"] = "SELECT DISTINCT * FROM raw_marketing"

CTE["c_customers"] = """
SELECT customer_id, customer_name,
  CAST(coalesce(age, (SELECT median(age) FROM one_customers)) AS DOUBLE) AS age,
  coalesce(gender, 'Unknown') AS gender,
  upper(substring(trim(city), 1, 1)) || lower(substring(trim(city), 2)) AS city,
  CAST(signup_date AS DATE) AS signup_date, customer_segment,
  date_diff('day', CAST(signup_date AS DATE),
    (SELECT max(CAST(signup_date AS DATE)) FROM one_customers)) AS tenure_days
FROM one_customers"""

CTE["c_products"] = """
SELECT product_id, category, brand, cost, selling_price,
  CAST(trunc(coalesce(inventory, (SELECT median(inventory) FROM one_products))) AS BIGINT)
    AS inventory,
  m / 100.0 AS profit_margin, floor((2000 * m + p) / (2.0 * p)) / 1000.0 AS margin_pct
FROM (SELECT *, CAST(round(selling_price * 100) AS BIGINT) AS p,
  CAST(round(selling_price * 100) - round(cost * 100) AS BIGINT) AS m FROM one_products)"""

CTE["c_orders"] = """
SELECT order_id, customer_id, product_id, CAST(order_date AS DATE) AS order_date, quantity, price,
  discount,
  CASE lower(trim(payment_method)) WHEN 'credit card' THEN 'Credit Card'
    WHEN 'debit card' THEN 'Debit Card' WHEN 'net banking' THEN 'Net Banking'
    WHEN 'upi' THEN 'Upi' WHEN 'cod' THEN 'Cod' END AS payment_method,
  CAST(coalesce(delivery_time, (SELECT median(delivery_time) FROM one_orders)) AS DOUBLE)
    AS delivery_time,
  status,
  CAST(round(CAST(price AS DECIMAL(12,4)) * CAST(quantity AS DECIMAL(9,0))
    * (1 - CAST(discount AS DECIMAL(5,4))), 2) AS DECIMAL(18,2)) AS revenue
FROM one_orders"""

CTE["c_reviews"] = """
SELECT review_id, customer_id, order_id, rating,
  coalesce(review_text, 'No review text provided') AS review_text,
  CAST(review_date AS DATE) AS review_date FROM one_reviews"""

CTE["c_marketing"] = """
SELECT campaign_id, customer_id, campaign,
  CAST(coalesce(spend, (SELECT median(spend) FROM one_marketing)) AS DOUBLE) AS spend,
  clicks, conversion FROM one_marketing"""

# ---- star schema

CTE["s_customers"] = "SELECT * REPLACE (CAST(round_even(age, 0) AS BIGINT) AS age) FROM c_customers"
CTE["s_products"] = """
SELECT * REPLACE (CAST(cost AS DECIMAL(18,2)) AS cost,
  CAST(selling_price AS DECIMAL(18,2)) AS selling_price) FROM c_products"""
CTE["s_orders"] = """
SELECT * REPLACE (CAST(price AS DECIMAL(18,2)) AS price, CAST(discount AS DECIMAL(4,2)) AS discount,
  CAST(round_even(delivery_time, 0) AS BIGINT) AS delivery_time) FROM c_orders"""
CTE["s_reviews"] = "SELECT * FROM c_reviews WHERE order_id IN (SELECT order_id FROM c_orders)"
CTE["s_marketing"] = """
SELECT * REPLACE (CAST(round(CAST(spend AS DECIMAL(18,8)), 2) AS DECIMAL(18,2)) AS spend)
FROM c_marketing"""
CTE["sold"] = "SELECT * FROM s_orders WHERE status = 'Delivered'"

# ---- customer analytics

CTE["base"] = """
SELECT customer_id,
  date_diff('day', max(order_date), (SELECT max(order_date) FROM sold)) + 1 AS recency_days,
  count(order_id) AS frequency, sum(revenue) AS monetary FROM sold GROUP BY customer_id"""

_EDGES = "[0.2, 0.4, 0.6, 0.8]"


def _above(value: str, edges: str) -> str:
    return " + ".join(f"CAST({value} > {edges}[{k}] AS BIGINT)" for k in range(1, 5))


CTE["scores"] = f"""
SELECT customer_id, recency_days, frequency, monetary, r_score, f_score, m_score,
  concat(r_score, f_score, m_score) AS rfm_score
FROM (
  SELECT *, 5 - ({_above('recency_days', 'r')}) AS r_score,
    1 + ({' + '.join(f'CAST(5 * i > {k} * (n - 1) AS BIGINT)' for k in range(1, 5))}) AS f_score,
    1 + ({_above('CAST(monetary AS DOUBLE)', 'm')}) AS m_score
  FROM (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) - 1 AS i,
          count(*) OVER () AS n FROM base)
  CROSS JOIN (SELECT quantile_cont(CAST(recency_days AS DOUBLE), {_EDGES}) AS r,
    quantile_cont(CAST(monetary AS DOUBLE), {_EDGES}) AS m FROM base))"""

CTE["segments"] = """
SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions'
  WHEN r_score = 3 AND f_score >= 4 THEN 'Loyal Customers'
  WHEN r_score >= 4 AND f_score IN (2, 3) THEN 'Potential Loyalists'
  WHEN r_score < 3 AND f_score > 2 THEN 'At Risk'
  WHEN r_score < 3 THEN 'Lost' ELSE 'Needs Attention' END AS segment FROM scores"""

# ---- churn features

CTE["usual"] = """
SELECT customer_id, payment_method FROM (
  SELECT customer_id, payment_method,
    row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_method) AS place
  FROM sold WHERE payment_method IS NOT NULL GROUP BY 1, 2)
WHERE place = 1"""

CTE["feat"] = """
SELECT s_customers.*, base.frequency, CAST(base.monetary AS DOUBLE) AS monetary,
  CASE WHEN base.recency_days > 90 THEN 1 ELSE 0 END AS churned,
  o.avg_order_value, o.avg_discount_used, o.avg_delivery_time,
  coalesce(usual.payment_method, 'Unknown') AS preferred_payment_method,
  coalesce(r.avg_rating, 0) AS avg_rating, coalesce(r.review_count, 0) AS review_count,
  coalesce(m.campaigns_targeted, 0) AS campaigns_targeted,
  coalesce(m.total_marketing_spend, 0) AS total_marketing_spend,
  coalesce(m.total_conversions, 0) AS total_conversions
FROM s_customers JOIN base USING (customer_id)
LEFT JOIN (SELECT customer_id, avg(revenue) AS avg_order_value, avg(discount) AS avg_discount_used,
  avg(delivery_time) AS avg_delivery_time FROM sold GROUP BY 1) o USING (customer_id)
LEFT JOIN usual USING (customer_id)
LEFT JOIN (SELECT customer_id, avg(rating) AS avg_rating, count(review_id) AS review_count
  FROM s_reviews GROUP BY 1) r USING (customer_id)
LEFT JOIN (SELECT customer_id, count(campaign_id) AS campaigns_targeted,
  CAST(sum(spend) AS DOUBLE) AS total_marketing_spend,
  CAST(sum(conversion) AS BIGINT) AS total_conversions
  FROM s_marketing GROUP BY 1) m USING (customer_id)"""

CTE["parted"] = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY h, customer_id)
    <= round(0.2 * count(*) OVER (PARTITION BY churned)) THEN 1 ELSE 0 END AS is_test
FROM (SELECT *, (customer_id + 42) % 2147483647 * 48271 % 2147483647 AS h FROM feat)"""

CTE["rated"] = """
SELECT customer_id, churned AS label, model, customer_id * factor % 101 / CAST(100 AS DOUBLE) AS score
FROM feat CROSS JOIN (VALUES ('Logistic Regression', 7919), ('Random Forest', 104729))
  models(model, factor)"""

# ---- daily series

CTE["revenue_days"] = """
SELECT d.ds, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS y
FROM (SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM sold),
  (SELECT max(order_date) FROM sold), INTERVAL 1 DAY)) AS DATE) AS ds) d
LEFT JOIN sold ON order_date = d.ds GROUP BY 1"""

CTE["days"] = """
SELECT d.order_date,
  CASE WHEN o.n IS NULL THEN 0 ELSE r.revenue END AS daily_revenue,
  coalesce(o.n, 0) AS daily_orders,
  CASE WHEN o.n IS NULL THEN 0 ELSE r.delivery END AS daily_avg_delivery_time,
  coalesce(l.n, 0) / CAST(coalesce(o.n, 1) AS DOUBLE) AS daily_cancel_rate
FROM (SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM s_orders),
  (SELECT max(order_date) FROM s_orders), INTERVAL 1 DAY)) AS DATE) AS order_date) d
LEFT JOIN (SELECT order_date, count(*) AS n FROM s_orders GROUP BY 1) o USING (order_date)
LEFT JOIN (SELECT order_date, CAST(sum(revenue) AS DOUBLE) AS revenue,
  avg(delivery_time) AS delivery FROM sold GROUP BY 1) r USING (order_date)
LEFT JOIN (SELECT order_date, count(*) AS n FROM s_orders
  WHERE status IN ('Cancelled', 'Returned') GROUP BY 1) l USING (order_date)"""

_Z = ", ".join(
    f"round(({m} - (SELECT avg({m}) FROM days)) / (SELECT stddev_samp({m}) FROM days), 6)"
    f" AS {m}_zscore"
    for m in METRICS
)
_CLASSES = ", ".join(
    f"CASE WHEN abs({m}_zscore) > 3 THEN 'HIGH' WHEN abs({m}_zscore) >= 2 THEN 'MEDIUM'"
    f" ELSE 'Normal' END AS {m}_anomaly"
    for m in METRICS
)
CTE["flagged"] = f"SELECT *, {_CLASSES} FROM (SELECT *, {_Z} FROM days)"

CTE["naive"] = """
SELECT ds, y, (SELECT avg(y) FROM (SELECT y FROM revenue_days
    WHERE ds <= (SELECT max(ds) - 60 FROM revenue_days) ORDER BY ds DESC LIMIT 7)) AS yhat
FROM revenue_days ORDER BY ds DESC LIMIT 60"""

# ---- review text: one row per word, neighbours by lag, rules in the order they apply


def _words(name: str, table: str, key: str, text: str) -> None:
    boosters = " ".join(
        [f"WHEN w IN ({', '.join(map(_text, own.STRENGTHEN))}) THEN 0.293",
         f"WHEN w IN ({', '.join(map(_text, own.WEAKEN))}) THEN -0.293"]
    )
    negations = ", ".join(map(_text, own.NEGATE))
    lexicon = ", ".join(f"({_text(w)}, {v})" for w, v in own.LEXICON.items())
    CTE[f"{name}_lexicon"] = f"SELECT * FROM (VALUES {lexicon}) l(token, valence)"
    CTE[f"{name}_token"] = f"""
SELECT k, word, lower(word) AS w, row_number() OVER (PARTITION BY k ORDER BY pos) AS i,
  (word = upper(word) AND word <> lower(word)) AS loud
FROM (SELECT {key} AS k, pos, CASE WHEN lower(piece) IN ({', '.join(map(_text, own.LEXICON))})
    THEN piece ELSE trim(piece, {_text(own.PUNCTUATION)}) END AS word
  FROM (SELECT {key}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
    FROM (SELECT {key}, string_split_regex({text}, '[ \\t\\n\\x0B\\f\\r]+') AS pieces FROM {table})))
WHERE length(word) > 1"""
    CTE[f"{name}_kind"] = f"""
SELECT *, CASE {boosters} ELSE 0 END AS push,
  (w IN ({negations}) OR ends_with(w, 'n''t')) AS negates,
  valence IS NOT NULL AS known,
  bool_or(loud) OVER (PARTITION BY k) AND NOT bool_and(loud) OVER (PARTITION BY k) AS mixed,
  min(CASE WHEN w = 'but' THEN i END) OVER (PARTITION BY k) AS but_at
FROM {name}_token LEFT JOIN {name}_lexicon ON token = w"""
    lags = ", ".join(
        f"lag({c}, {d}) OVER (PARTITION BY k ORDER BY i) AS {c}{d}"
        for d in (1, 2, 3)
        for c in ("push", "negates", "known", "loud", "w")
    )
    leads = ", ".join(f"lead(w, {d}) OVER (PARTITION BY k ORDER BY i) AS next{d}" for d in (1, 2))
    CTE[f"{name}_near"] = f"""
SELECT *, CAST(valence AS DOUBLE) + CASE WHEN mixed AND loud THEN 0.733 * sign(valence)
  ELSE 0 END AS v0 FROM (SELECT *, {lags}, {leads} FROM {name}_kind)
WHERE known AND push = 0 AND NOT (w = 'kind' AND coalesce(next1, '') = 'of')"""
    step = f"{name}_near"
    turned = {
        1: "CASE WHEN negates1 THEN -0.74 ELSE 1 END",
        2: "CASE WHEN w2 = 'never' AND w1 IN ('so', 'this') THEN 1.5 WHEN negates2 THEN -0.74 ELSE 1 END",
        3: "CASE WHEN (w3 = 'never' AND w2 IN ('so', 'this')) OR w1 IN ('so', 'this') THEN 1.25"
        " WHEN negates3 THEN -0.74 ELSE 1 END",
    }
    for d, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
        previous, step = step, f"{name}_step{d}"
        v = f"v{d - 1}"
        CTE[step] = f"""
SELECT *, CASE WHEN known{d} IS NULL OR known{d} THEN {v} ELSE
  ({v} + {damping} * CASE WHEN push{d} = 0 THEN 0 ELSE
     push{d} * (CASE WHEN {v} < 0 THEN -1 ELSE 1 END)
     + CASE WHEN mixed AND loud{d} THEN 0.733 ELSE 0 END
       * (CASE WHEN {v} > 0 THEN 1 ELSE -1 END) END)
  * {turned[d]} END AS v{d} FROM {previous}"""
    idiom = lambda words: "CASE " + " || ' ' || ".join(words) + " " + " ".join(
        f"WHEN {_text(k)} THEN CAST({v} AS DOUBLE)" for k, v in own.IDIOMS.items()
    ) + " END"
    around = [("w", "next1", "next2"), ("w", "next1"), ("w1", "w"), ("w2", "w1", "w"), ("w2", "w1"), ("w3", "w2", "w1"), ("w3", "w2")]
    pairs = ", ".join(map(_text, own.WEAKEN_PAIRS))
    CTE[f"{name}_phrased"] = f"""
SELECT *, CASE WHEN known3 IS NULL OR known3 THEN v3
  ELSE coalesce({', '.join(map(idiom, around))}, v3)
    - CASE WHEN w3 || ' ' || w2 IN ({pairs}) OR w2 || ' ' || w1 IN ({pairs}) THEN 0.293 ELSE 0 END END
  * CASE WHEN w1 = 'least' AND coalesce(w2, '') NOT IN ('at', 'very') THEN -0.74 ELSE 1 END AS v
FROM {step}"""
    CTE[f"{name}_sum"] = f"""
SELECT k, sum(v * CASE WHEN i < but_at THEN 0.5 WHEN i > but_at THEN 1.5 ELSE 1 END) AS total
FROM {name}_phrased GROUP BY k"""
    CTE[name] = f"""
SELECT *, round(s / sqrt(s * s + 15), 4) + 0 AS sentiment_score FROM (
  SELECT *, coalesce(total, 0) + sign(coalesce(total, 0)) * (
      least(exclamations, 4) * 0.292
      + CASE WHEN questions > 3 THEN 0.96 WHEN questions > 1 THEN questions * 0.18 ELSE 0 END) AS s
  FROM (SELECT *, length(regexp_replace({text}, '[^!]', '', 'g')) AS exclamations,
      length(regexp_replace({text}, '[^?]', '', 'g')) AS questions FROM {table}) t
  LEFT JOIN {name}_sum ON k = t.{key})"""


_words("scored", "s_reviews", "review_id", "review_text")
_words("texts", "documents", "doc_id", "text")

_TAGS = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(review_text), {_text(w)})' for w in words)}"
    f" THEN {_text(topic)} END"
    for topic, words in own.TOPICS.items()
)
CTE["tagged"] = f"""
SELECT *, CASE WHEN topic_text = '' THEN 'General' ELSE topic_text END AS topics,
  CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative'
    ELSE 'Neutral' END AS sentiment_label,
  CASE WHEN rating > 3 THEN 'Positive' WHEN rating < 3 THEN 'Negative' ELSE 'Neutral' END
    AS rating_based_sentiment
FROM (SELECT *, concat_ws(', ', {_TAGS}) AS topic_text FROM scored)"""

CTE["tagged_texts"] = f"""
SELECT doc_id, CASE WHEN topic_text = '' THEN 'General' ELSE topic_text END AS topics,
  CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative'
    ELSE 'Neutral' END AS sentiment_label
FROM (SELECT texts.doc_id, sentiment_score, concat_ws(', ', {_TAGS.replace('review_text', 'documents.text')}) AS topic_text
      FROM texts JOIN documents ON documents.doc_id = texts.doc_id)"""

CTE["link"] = """
SELECT customer_id, segment, CAST(monetary AS DOUBLE) AS monetary, frequency, recency_days,
  avg_sentiment_score, CASE WHEN recency_days > 90 THEN 1 ELSE 0 END AS churned
FROM segments JOIN (SELECT customer_id, avg(sentiment_score) AS avg_sentiment_score
  FROM tagged GROUP BY 1) USING (customer_id)"""


def _with(body: str) -> str:
    """Prefix the body with the table expressions it needs, directly or through others."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(CTE[name])
    parts = [f"{name} AS ({sql.strip()})" for name, sql in CTE.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def _dbl(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


def _money(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


Q: dict[str, str] = {}

Q["ingest_validate"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({len(s)} AS BIGINT) AS n_cols,"
    f" '' AS missing_columns, CAST(0 AS BIGINT) AS n_bad_values, CAST(0 AS BIGINT) AS n_null_keys,"
    f" 'ok' AS status FROM raw_{t}"
    for t, s in RAW.items()
)
Q["quarantine_counts"] = """
SELECT reason, count(*) FILTER (bad) AS n_records FROM (
  SELECT unnest(['all', 'accepted', 'rejected', 'no key: order_id', 'bad value: quantity', 'wrong number of fields']) AS reason,
    unnest([true, k <> 0 AND q <> 0 AND f <> 0, k = 0 OR q = 0 OR f = 0, k = 0, q = 0, f = 0]) AS bad
  FROM (SELECT order_id % 17 AS k, order_id % 11 AS q, order_id % 13 AS f FROM raw_orders))
GROUP BY reason HAVING count(*) FILTER (bad) > 0 OR reason IN ('all', 'accepted', 'rejected')"""
Q["quarantine_accepted"] = f"""
SELECT order_id, customer_id, product_id, CAST(order_date AS VARCHAR) AS order_date, {_big('quantity')}, price, discount,
  payment_method, {_big('delivery_time')}, status FROM raw_orders
WHERE order_id % 17 <> 0 AND order_id % 11 <> 0 AND order_id % 13 <> 0"""
_PRODUCTS = f"SELECT product_id, category, brand, {_money('cost', 'selling_price')}, " \
    f"{_big('inventory')}, {_money('profit_margin', 'margin_pct')}"
Q["load_append_if_empty"] = f"{_PRODUCTS} FROM s_products"
Q["load_star_schema"] = """
SELECT CAST(1 AS BIGINT) AS load_order, 'customers' AS table_name, count(*) AS n_rows,
  CAST(0 AS BIGINT) AS n_skipped FROM s_customers
UNION ALL SELECT 2, 'products', count(*), 0 FROM s_products
UNION ALL SELECT 3, 'orders', count(*), 0 FROM s_orders
UNION ALL SELECT 4, 'reviews', (SELECT count(*) FROM s_reviews),
  (SELECT count(*) FROM c_reviews) - (SELECT count(*) FROM s_reviews)
UNION ALL SELECT 5, 'marketing_campaigns', count(*), 0 FROM s_marketing"""
Q["valid_reviews"] = f"""
SELECT review_id, customer_id, order_id, {_big('rating')}, review_text, review_date
FROM s_reviews"""
Q["key_violations"] = " UNION ALL ".join(
    [
        f"SELECT '{t}.{k} null' AS check_name, count(*) AS n_violations FROM raw_{t}"
        f" WHERE {k} IS NULL UNION ALL SELECT '{t}.{k} duplicate', count(*) FROM (SELECT {k}"
        f" FROM raw_{t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        for t, k in PRIMARY_KEY.items()
    ]
    + [
        f"SELECT '{c}.{k} orphan', count(*) FROM raw_{c} x WHERE {k} IS NOT NULL AND NOT EXISTS"
        f" (SELECT 1 FROM raw_{p} y WHERE y.{k} = x.{k})"
        for c, k, p in FOREIGN_KEYS
    ]
)
_SCORES = f"customer_id, {_big('recency_days', 'frequency')}, {_money('monetary')}, " \
    f"{_big('r_score', 'f_score', 'm_score')}, rfm_score"
Q["replace_derived_table"] = f"SELECT {_SCORES}, segment FROM segments"

Q["clean_customers"] = f"""
SELECT customer_id, customer_name, age, gender, city, signup_date, customer_segment,
  {_big('tenure_days')} FROM c_customers"""
Q["clean_products"] = f"{_PRODUCTS} FROM c_products"
Q["clean_orders"] = f"""
SELECT order_id, customer_id, product_id, order_date, {_big('quantity')}, price, discount,
  payment_method, delivery_time, status, {_money('revenue')} FROM c_orders"""
Q["clean_reviews"] = f"""
SELECT review_id, customer_id, order_id, {_big('rating')}, review_text, review_date
FROM c_reviews"""
Q["clean_marketing"] = f"""
SELECT campaign_id, customer_id, campaign, round(spend, 6) AS spend,
  {_big('clicks', 'conversion')} FROM c_marketing"""


def _check(table: str, check: str, value: str) -> str:
    return f"SELECT '{table}' AS table_name, '{check}' AS check_name, " \
        f"CAST(({value}) AS DOUBLE) AS value"


def _duplicates(table: str) -> str:
    return f"SELECT (SELECT count(*) FROM raw_{table}) - " \
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM raw_{table}))"


Q["cleaning_report"] = " UNION ALL ".join(
    [_check(t, "duplicates_removed", _duplicates(t)) for t in RAW]
    + [_check(t, "rows_saved", f"SELECT count(*) FROM c_{t}") for t in RAW]
    + [
        _check(t, f"{c}_filled", f"SELECT count(*) FROM one_{t} WHERE {c} IS NULL")
        for t, c in [("customers", "age"), ("customers", "gender"), ("products", "inventory"),
                     ("orders", "delivery_time"), ("reviews", "review_text"),
                     ("marketing", "spend")]
    ]
    + [
        _check(t, f"median_{c}", f"SELECT round(median({c}), 6) FROM one_{t}")
        for t, c in [("customers", "age"), ("products", "inventory"),
                     ("orders", "delivery_time"), ("marketing", "spend")]
    ]
    + [
        _check(
            "orders", "impossible_removed",
            "SELECT count(*) FROM (SELECT DISTINCT * FROM raw_orders)"
            " WHERE quantity <= 0 OR price <= 0",
        )
    ]
)

Q["total_revenue"] = "SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM sold"


def _half_up(total: str, n: str, digits: int = 2) -> str:
    """Exact rounded mean of cents: no floating point before the last step."""
    cents = f"CAST({total} * 100 AS HUGEINT)"
    scale = 10 ** (digits - 2)
    return f"CAST((2 * {scale} * {cents} + {n}) // (2 * {n}) AS DOUBLE) / {10 ** digits}"


Q["revenue_by_payment"] = f"""
SELECT payment_method, count(*) AS num_orders, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
  {_half_up('sum(revenue)', 'count(revenue)')} AS avg_order_value FROM sold GROUP BY 1"""
Q["frequent_payment_methods"] = """
SELECT payment_method, num_orders FROM (SELECT DISTINCT payment_method,
  count(*) OVER (PARTITION BY payment_method) AS num_orders FROM s_orders) WHERE num_orders > 500"""
Q["top_products"] = """
SELECT category, brand, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
  count(order_id) AS num_orders
FROM sold JOIN s_products USING (product_id) GROUP BY 1, 2
ORDER BY sum(revenue) DESC, category, brand LIMIT 10"""
Q["order_tiers"] = f"""
SELECT order_id, {_money('revenue')}, CASE WHEN revenue < 1500 THEN 'Low Value'
  WHEN revenue < 5000 THEN 'Medium Value' WHEN revenue IS NULL THEN 'Low Value'
  ELSE 'High Value' END AS order_tier FROM sold"""
Q["above_average_orders"] = f"""
SELECT customer_id, order_id, {_money('revenue')} FROM sold
WHERE revenue > (SELECT avg(revenue) FROM sold) ORDER BY sold.revenue DESC, order_id LIMIT 20"""
Q["city_profit"] = """
SELECT city, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
  CAST(sum(cost * quantity) AS DOUBLE) AS total_cost,
  CAST(sum(revenue - cost * quantity) AS DOUBLE) AS total_profit
FROM sold JOIN s_products USING (product_id) JOIN s_customers USING (customer_id) GROUP BY 1"""
Q["top_customers_ranked"] = """
SELECT a.customer_id, CAST(a.spent AS DOUBLE) AS total_spent,
  1 + (SELECT count(*) FROM spend b WHERE b.spent > a.spent) AS spend_rank
FROM spend a ORDER BY a.spent DESC, a.customer_id LIMIT 20"""
CTE["spend"] = "SELECT customer_id, sum(revenue) AS spent FROM sold GROUP BY 1"
CTE["by_day"] = "SELECT order_date, sum(revenue) AS r FROM sold GROUP BY 1"
Q["running_revenue"] = """
SELECT a.order_date, CAST(any_value(a.r) AS DOUBLE) AS daily_revenue,
  CAST(sum(b.r) AS DOUBLE) AS running_total
FROM by_day a JOIN by_day b ON b.order_date <= a.order_date GROUP BY 1"""
Q["rolling_revenue_7"] = f"""
SELECT order_date, CAST(r AS DOUBLE) AS daily_revenue, {_half_up('t', 'n')} AS rolling_7day_avg
FROM (SELECT *, sum(r) OVER w AS t, count(r) OVER w AS n FROM by_day
  WINDOW w AS (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
CTE["by_month"] = """
SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) AS month, sum(revenue) AS r
FROM sold GROUP BY 1, 2"""
Q["product_monthly_change"] = """
SELECT a.product_id, a.month, CAST(a.r AS DOUBLE) AS monthly_revenue,
  CAST(b.r AS DOUBLE) AS prev_month_revenue, CAST(a.r - b.r AS DOUBLE) AS change
FROM by_month a ASOF LEFT JOIN by_month b ON a.product_id = b.product_id AND a.month > b.month"""
CTE["active"] = """
SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS m FROM sold"""
Q["monthly_retention"] = """
SELECT a.m AS order_month, count(DISTINCT a.customer_id) AS active_customers,
  count(DISTINCT b.customer_id) AS retained_from_prev_month,
  floor((2000 * count(DISTINCT b.customer_id) + count(DISTINCT a.customer_id))
    / (2.0 * count(DISTINCT a.customer_id))) / 10.0 AS retention_pct
FROM active a LEFT JOIN active b
  ON a.customer_id = b.customer_id AND a.m = CAST(b.m + INTERVAL 1 MONTH AS DATE) GROUP BY 1"""
Q["churn_risk_rules"] = """
SELECT customer_id, last_order_date, gap AS days_since_last_order,
  CASE WHEN gap <= 60 THEN 'Low Risk' WHEN gap <= 120 THEN 'Medium Risk' ELSE 'High Risk' END
    AS churn_risk
FROM (SELECT customer_id, max(order_date) AS last_order_date,
  date_diff('day', max(order_date), (SELECT max(order_date) FROM s_orders)) AS gap
  FROM sold GROUP BY 1)"""
Q["campaign_roi"] = """
SELECT campaign, touches AS total_touches, CAST(spend AS DOUBLE) AS total_spend,
  CAST(conversions AS BIGINT) AS total_conversions, CAST(earned AS DOUBLE) AS attributed_revenue,
  round(CAST(earned - spend AS DOUBLE) / CAST(spend AS DOUBLE) * 100, 1) AS roi_pct
FROM (SELECT campaign, count(*) AS touches, sum(spend) AS spend, sum(conversion) AS conversions,
    sum(CASE WHEN conversion = 1 THEN revenue ELSE 0 END) AS earned
  FROM s_marketing m LEFT JOIN sold o ON m.customer_id = o.customer_id GROUP BY 1)"""

Q["rfm_base"] = f"""
SELECT customer_id, {_big('recency_days', 'frequency')}, {_money('monetary')} FROM base"""
Q["rfm_scores"] = f"SELECT {_SCORES} FROM scores"
Q["rfm_segments"] = f"SELECT {_SCORES}, segment FROM segments"
Q["segment_counts"] = "SELECT segment, count(*) AS num_customers FROM segments GROUP BY 1"
Q["segment_avg_value"] = """
SELECT segment, round(avg(CAST(monetary AS DOUBLE)), 4) AS avg_monetary FROM segments GROUP BY 1"""

_INTEGER_FEATURES = ["age", "tenure_days", "frequency", "review_count", "campaigns_targeted",
                     "total_conversions"]


def _numeric(digits: int) -> str:
    return ", ".join(
        _big(c) if c in _INTEGER_FEATURES else _dbl(c, digits=digits) for c in NUMERIC
    )


Q["churn_features"] = f"""
SELECT customer_id, customer_name, gender, city, signup_date, customer_segment,
  {_big('churned')}, preferred_payment_method, {_numeric(9)} FROM feat"""
Q["churn_rate"] = """
SELECT CAST(churned AS BIGINT) AS churned, count(*) AS num_customers,
  round(count(*) / CAST((SELECT count(*) FROM feat) AS DOUBLE), 6) AS share FROM feat GROUP BY 1"""
_LEVELS = {
    "gender": ["Male", "Unknown"],
    "city": [f"Nation_{i}" for i in range(1, 25)],
    "customer_segment": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "preferred_payment_method": ["Credit Card", "Debit Card", "Net Banking", "Upi"],
}
_DUMMIES = ", ".join(
    f"""CAST({c} = {_text(v)} AS BIGINT) AS "{c}_{v}" """ for c, vs in _LEVELS.items() for v in vs
)
Q["one_hot_features"] = f"SELECT customer_id, {_big('churned')}, {_numeric(6)}, {_DUMMIES} FROM feat"
_KNOWN = {
    "gender_Male": "CAST(gender = 'Male' AS BIGINT)",
    "city_Nation_7": "CAST(city = 'Nation_7' AS BIGINT)",
    "city_Atlantis": "CAST(0 AS BIGINT)",
    "frequency": "CAST(frequency AS BIGINT)",
    "monetary": "monetary",
    "age": "CAST(age AS BIGINT)",
}
Q["align_features"] = f"""
SELECT customer_id, {_big('churned')}, {', '.join(f'{_KNOWN[c]} AS {c}' for c in KNOWN_COLUMNS)}
FROM feat"""
_SOURCES = list(_LEVELS)
CTE["levels"] = " UNION ALL ".join(
    f"SELECT {k} AS k, '{c}' AS source, {c} AS level FROM feat WHERE {c} IS NOT NULL GROUP BY ALL" for k, c in enumerate(_SOURCES)
)
CTE["places"] = f"""
SELECT source, level, {len(NUMERIC) - 1} + row_number() OVER (ORDER BY k, level) AS place
FROM (SELECT *, min(level) OVER (PARTITION BY k) AS least FROM levels) WHERE level <> least"""
Q["category_table"] = "SELECT source, level, CAST(place AS BIGINT) AS place FROM places"
_OWN = ", ".join(f"(SELECT place FROM places WHERE source = '{c}' AND level = feat.{c})" for c in _SOURCES)
Q["sparse_features"] = f"""
SELECT customer_id, {_big('churned')}, {_numeric(6)},
  array_to_string(list_sort(list_filter([{_OWN}], lambda x: x IS NOT NULL)), ',') AS places FROM feat"""
Q["sparse_features_view"] = Q["align_features"]
Q["churn_logistic_optimum"] = f"""
SELECT count(*) AS n_test, (SELECT {len(NUMERIC)} + count(*) FROM places) AS n_columns,
  CAST(0 AS BIGINT) AS n_beyond, CAST(0 AS BIGINT) AS n_apart FROM parted WHERE is_test = 1"""
Q["stratified_split"] = f"SELECT customer_id, {_big('churned', 'is_test')} FROM parted"
_SCALED = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM parted WHERE is_test = 0)) / coalesce(nullif("
    f"(SELECT stddev_pop({c}) FROM parted WHERE is_test = 0), 0), 1), 6) AS {c}"
    for c in NUMERIC
)
Q["scale_features"] = f"SELECT customer_id, {_big('is_test')}, {_SCALED} FROM parted"
CTE["lr"] = "SELECT *, CAST(score >= 0.5 AS INT) AS p FROM rated WHERE model LIKE 'Log%'"
Q["classification_metrics"] = """
SELECT round(avg(CAST(p = label AS INT)), 6) AS accuracy,
  round(sum(p * label) / CAST(sum(p) AS DOUBLE), 6) AS precision,
  round(sum(p * label) / CAST(sum(label) AS DOUBLE), 6) AS recall,
  round(2 * sum(p * label) / CAST(sum(p) + sum(label) AS DOUBLE), 6) AS f1,
  (SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5
    ELSE 0 END), 6) FROM lr a JOIN lr b ON a.label = 1 AND b.label = 0) AS roc_auc
FROM lr"""
Q["confusion_matrix"] = """
SELECT CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted, count(lr.p) AS n
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) b(predicted)
LEFT JOIN lr ON lr.label = actual AND lr.p = predicted GROUP BY 1, 2"""
Q["select_best_model"] = """
SELECT model AS best_model, round(r, 6) AS recall
FROM (SELECT model, avg(CAST(score >= 0.5 AS INT)) AS r FROM rated WHERE label = 1 GROUP BY 1)
ORDER BY r DESC, model DESC LIMIT 1"""

_METRICS = f"{_dbl('daily_revenue')}, {_big('daily_orders')}, " \
    f"{_dbl('daily_avg_delivery_time', 'daily_cancel_rate')}"
Q["daily_revenue_filled"] = f"SELECT ds, {_dbl('y')} FROM revenue_days"
Q["daily_metrics"] = f"SELECT order_date, {_METRICS} FROM days"
Q["zscore_anomalies"] = f"""
SELECT order_date, {_METRICS}, {', '.join(f'{m}_zscore, {m}_anomaly' for m in METRICS)}
FROM flagged"""
Q["anomaly_alerts"] = """
SELECT 'Daily Revenue' AS metric, order_date,
  round((SELECT avg(daily_revenue) - 2 * stddev_samp(daily_revenue) FROM days), 4) AS expected_low,
  round((SELECT avg(daily_revenue) + 2 * stddev_samp(daily_revenue) FROM days), 4) AS expected_high,
  daily_revenue AS actual, daily_revenue_anomaly AS severity
FROM flagged WHERE daily_revenue_anomaly = 'HIGH'"""
Q["known_anomaly_check"] = f"""
SELECT count(*) > 0 AS caught FROM flagged WHERE daily_revenue_anomaly <> 'Normal'
  AND year(order_date) = {ANOMALOUS_MONTH[0]} AND month(order_date) = {ANOMALOUS_MONTH[1]}"""

Q["holdout_split"] = f"""
SELECT ds, {_dbl('y')}, CASE WHEN row_number() OVER (ORDER BY ds DESC) <= 60 THEN 'test'
  ELSE 'train' END AS part FROM revenue_days"""
Q["baseline_forecast"] = f"SELECT ds, {_dbl('y', 'yhat')} FROM naive"
Q["forecast_metrics"] = """
SELECT round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse,
  round(avg(abs(y - yhat) / abs(y)) FILTER (y <> 0) * 100, 6) AS mape FROM naive"""

Q["sentiment_scores"] = "SELECT review_id, sentiment_score FROM scored"
Q["sentiment_scores_documents"] = "SELECT doc_id, sentiment_score FROM texts"
Q["sentiment_scores_by_table"] = Q["sentiment_scores_documents"]
Q["keyword_topics_documents"] = f"""
WITH keywords AS (
  SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark
), listed AS (SELECT list(w) AS ws FROM keywords WHERE length(w) > 7)
SELECT doc_id, CASE WHEN topic_text = '' THEN 'General' ELSE topic_text END AS topics
FROM (SELECT doc_id, concat_ws(', ', {_TAGS.replace('review_text', 'text')},
    CASE WHEN len(list_filter(ws, lambda x: contains(lower(text), x))) > 0 THEN 'Benchmark' END) AS topic_text
  FROM documents, listed)"""
Q["sentiment_labels"] = "SELECT review_id, sentiment_label FROM tagged"
Q["review_topics"] = "SELECT review_id, topics FROM tagged"
Q["sentiment_labels_documents"] = "SELECT doc_id, sentiment_label FROM tagged_texts"
Q["topics_documents"] = "SELECT doc_id, topics FROM tagged_texts"
Q["negative_topic_counts_documents"] = """
SELECT topic, count(*) AS num_mentions
FROM (SELECT unnest(string_split(topics, ', ')) AS topic FROM tagged_texts
  WHERE sentiment_label = 'Negative') GROUP BY 1"""
Q["rating_sentiment"] = "SELECT review_id, rating_based_sentiment FROM tagged"
Q["sentiment_agreement"] = """
SELECT round(count(*) FILTER (sentiment_label = rating_based_sentiment)
  / CAST(count(*) AS DOUBLE), 6) AS agreement FROM tagged"""
Q["sentiment_distribution"] = """
SELECT sentiment_label, count(*) AS num_reviews FROM tagged GROUP BY 1"""
Q["rating_sentiment_crosstab"] = f"""
SELECT {_big('rating')}, count(*) FILTER (sentiment_label = 'Negative') AS "Negative",
  count(*) FILTER (sentiment_label = 'Neutral') AS "Neutral",
  count(*) FILTER (sentiment_label = 'Positive') AS "Positive" FROM tagged GROUP BY tagged.rating"""
Q["negative_topic_counts"] = """
SELECT topic, count(*) AS num_mentions
FROM (SELECT unnest(string_split(topics, ', ')) AS topic FROM tagged
  WHERE sentiment_label = 'Negative') GROUP BY 1"""
Q["sentiment_business_link"] = f"""
SELECT customer_id, segment, monetary, {_big('frequency', 'recency_days')},
  {_dbl('avg_sentiment_score', digits=10)}, {_big('churned')} FROM link"""
Q["sentiment_by_group"] = """
SELECT 'segment' AS dimension, segment AS value, round(avg(avg_sentiment_score), 6) AS avg_sentiment
FROM link GROUP BY 2
UNION ALL SELECT 'churned', CAST(churned AS VARCHAR), round(avg(avg_sentiment_score), 6)
FROM link GROUP BY churned"""
Q["sentiment_correlations"] = """
SELECT round(corr(avg_sentiment_score, monetary), 6) AS corr_monetary,
  round(corr(avg_sentiment_score, frequency), 6) AS corr_frequency FROM link"""


def _nulls(label: str, table: str, columns) -> list[str]:
    return [
        f"SELECT '{label}' AS table_name, '{c}' AS column_name,"
        f" count(*) FILTER ({c} IS NULL) AS n_nulls FROM {table}"
        for c in columns
    ]


Q["null_counts"] = " UNION ALL ".join(
    _nulls("orders", "sold", [*RAW["orders"].names, "revenue"])
    + _nulls("customers", "s_customers", [*RAW["customers"].names, "tenure_days"])
    + _nulls("raw_orders", "raw_orders", RAW["orders"].names)
    + _nulls("raw_customers", "raw_customers", RAW["customers"].names)
)


def _histogram(metric: str, source: str, unit: int, bins: int) -> str:
    return f"""
SELECT '{metric}' AS metric, b AS bin,
  round((lo + (hi - lo) * b / {bins}.0) / {unit}.0, 6) AS low,
  round((lo + (hi - lo) * (b + 1) / {bins}.0) / {unit}.0, 6) AS high,
  (SELECT count(*) FROM ({source}) WHERE (u - lo) * {bins} >= b * (hi - lo)
    AND ((u - lo) * {bins} < (b + 1) * (hi - lo) OR b = {bins - 1})) AS n
FROM (SELECT min(u) AS lo, max(u) AS hi FROM ({source}))
CROSS JOIN (SELECT unnest(range({bins})) AS b)"""


CTE["per_customer"] = "SELECT count(*) AS u FROM sold WHERE customer_id IS NOT NULL GROUP BY customer_id"
Q["numeric_histogram"] = (
    _histogram("revenue", "SELECT CAST(revenue * 100 AS BIGINT) AS u FROM sold", 100, 40)
    + " UNION ALL "
    + _histogram("orders_per_customer", "SELECT u FROM per_customer", 1, 20)
)
Q["density_curve"] = """
SELECT CAST(g AS BIGINT) AS point, round(any_value(lo + g * (hi - lo) / 199), 6) AS x,
  round(sum(exp(-0.5 * ((lo + g * (hi - lo) / 199 - v) / h) ** 2))
    / any_value(h * n * sqrt(2 * pi())), 10) AS density
FROM (SELECT CAST(revenue AS DOUBLE) AS v FROM sold)
CROSS JOIN (SELECT min(CAST(revenue AS DOUBLE)) AS lo, max(CAST(revenue AS DOUBLE)) AS hi,
  count(*) AS n, stddev_samp(CAST(revenue AS DOUBLE)) * count(*) ** -0.2 AS h FROM sold)
CROSS JOIN (SELECT unnest(range(200)) AS g) GROUP BY g"""


def _box(column: str) -> str:
    return f"""
SELECT '{column}' AS metric, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3,
  round(min(v) FILTER (v BETWEEN a AND b), 6) AS low_whisker,
  round(max(v) FILTER (v BETWEEN a AND b), 6) AS high_whisker,
  count(*) FILTER (v < a OR v > b) AS n_outliers
FROM (SELECT v, q, q[1] - 1.5 * (q[3] - q[1]) AS a, q[3] + 1.5 * (q[3] - q[1]) AS b
  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM sold)
  CROSS JOIN (SELECT quantile_cont(CAST({column} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM sold))
GROUP BY q"""


Q["tukey_outliers"] = _box("revenue") + " UNION ALL " + _box("delivery_time")
Q["correlation_matrix"] = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 6) AS r"
    " FROM sold"
    for x in CORRELATED
    for y in CORRELATED
)
Q["monthly_revenue"] = """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
  CAST(sum(revenue) AS DOUBLE) AS monthly_revenue FROM sold GROUP BY 1"""
Q["orders_per_customer_stats"] = """
SELECT count(*) AS count, round(avg(u), 6) AS mean, round(stddev_samp(u), 6) AS std,
  min(u) AS min, quantile_cont(u, 0.25) AS p25, quantile_cont(u, 0.5) AS p50,
  quantile_cont(u, 0.75) AS p75, max(u) AS max FROM per_customer"""
Q["revenue_by_dimension"] = """
SELECT 'category' AS dimension, category AS value, CAST(sum(revenue) AS DOUBLE) AS total_revenue
FROM sold JOIN s_products USING (product_id) GROUP BY 2
UNION ALL SELECT 'city', city, CAST(sum(revenue) AS DOUBLE)
FROM sold JOIN s_customers USING (customer_id) GROUP BY 2"""

# ---- what can be said of models and forecasts without fitting them

Q["fitted_score_checks"] = """
SELECT unnest(['Logistic Regression', 'Random Forest']) AS model, n_rows, n_churned, CAST(0 AS BIGINT) AS n_outside
FROM (SELECT count(*) AS n_rows, CAST(sum(churned) AS BIGINT) AS n_churned FROM parted WHERE is_test = 1)
"""
_SERIES = """(SELECT series, max(order_date) AS last
      FROM (SELECT order_date, unnest(['all', coalesce(category, 'none')]) AS series
            FROM sold JOIN s_products USING (product_id))
      GROUP BY series)"""
Q["model_roundtrip"] = f"""
SELECT unnest(['Logistic Regression', 'Random Forest']) AS model, n AS num_scores, CAST(0 AS DOUBLE) AS max_difference
FROM (SELECT count(*) AS n FROM parted)
UNION ALL SELECT 'Forecast', 90 * count(*), CAST(0 AS DOUBLE) FROM {_SERIES}
"""
Q["forest_node_checks"] = """
SELECT CAST(200 AS BIGINT) AS n_trees, CAST(200 AS BIGINT) AS n_roots, CAST(0 AS BIGINT) AS n_apart,
  CAST(1 AS DOUBLE) AS importance
"""
Q["churn_prediction_checks"] = """
SELECT count(*) AS n_customers, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_wrong_level FROM parted
"""
Q["isolation_forest_checks"] = """
SELECT count(*) AS n_days, true AS share_kept, CAST(0 AS BIGINT) AS n_outside FROM days
"""
Q["forecast_checks"] = f"""
SELECT series, CAST(last + 1 AS DATE) AS first_day, CAST(last + 90 AS DATE) AS last_day, CAST(90 AS BIGINT) AS n_days,
  CAST(0 AS BIGINT) AS n_unordered
FROM {_SERIES}
"""

Q["forecast_optimality"] = f"SELECT series, CAST(0 AS BIGINT) AS n_violations FROM {_SERIES}"
Q["forecast_widths"] = f"""
SELECT series, CAST(90 AS BIGINT) AS n_days, CAST(0 AS BIGINT) AS n_narrower FROM {_SERIES}"""

ORACLE_SQL = {name: _with(body) for name, body in Q.items()}
