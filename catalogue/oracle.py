"""The registered queries as plain SQL over the given tables."""

from retailspark.operators.evaluation import poisson_thresholds

from . import params as P

ORACLE = {}


def with_ctes(*ctes, select):
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


TICKETS = """
t AS (
  SELECT o.o_custkey AS c, o.o_orderkey AS tk, l.l_partkey AS art,
    CAST(o.o_orderdate AS DATE) AS d,
    CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END AS dir,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS gross,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS disc
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""
DAY_LINES = """
SELECT c AS "ID_CLI", tk AS "ID_SCONTRINO", art AS "ID_ARTICOLO", CAST(d AS VARCHAR) AS "TIC_DATE",
  dir AS "DIREZIONE", CAST(gross AS DOUBLE) AS "IMPORTO_LORDO", CAST(disc AS DOUBLE) AS "SCONTO"
FROM t"""
ACTIVE = f"""
act AS (
  SELECT c, max(d) AS last, datediff('day', max(d), DATE '{P.AS_OF}') AS r
  FROM t WHERE dir = 1 AND d > DATE '{P.START}' GROUP BY c
  HAVING datediff('day', max(d), DATE '{P.AS_OF}') <= {P.MAX_DAYS}
)"""
LOYALTY = """
loy AS (
  SELECT o_custkey AS c, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS card
  FROM orders WHERE o_orderdate < DATE '{before}' GROUP BY o_custkey
)"""
MEASURES = f"""
m AS (
  SELECT c, max(CASE WHEN dir = 1 THEN d END) AS last,
    datediff('day', max(CASE WHEN dir = 1 THEN d END), DATE '{P.AS_OF}') AS r,
    count(DISTINCT CASE WHEN dir = 1 THEN tk END) AS f,
    CAST(sum(gross - disc) AS DOUBLE) AS v
  FROM t GROUP BY c HAVING max(CASE WHEN dir = 1 THEN d END) IS NOT NULL
)"""
LONG_MEASURES = """
lm AS (
  SELECT 'RECENCY' AS measure, CAST(r AS DOUBLE) AS x FROM m
  UNION ALL SELECT 'N_TRANSAZIONI', CAST(f AS DOUBLE) FROM m
  UNION ALL SELECT 'MONETARY_VALUE', v FROM m
)"""


def level(x, right=True):
    """Level of ``x`` for the breaks q; where breaks coincide, the highest level that touches them."""
    if right:
        below = " + ".join(f"(q[{i}] < {x})::INT" for i in range(1, 5))
        lowest = " + ".join(f"(q[{i}] <= q[1])::INT" for i in range(1, 5))
        place = f"greatest({below}, {lowest})"
    else:
        place = " + ".join(f"(q[{i}] <= {x})::INT" for i in range(1, 5))
    return f"(['LOW', 'MEDIUM', 'HIGH'])[least({place}, 3)]"


def rfm_ctes(start):
    return f"""
w AS (SELECT * FROM t WHERE d > DATE '{start}'),
rec AS (
  SELECT c, max(d) AS last, datediff('day', max(d), DATE '{P.AS_OF}') AS r FROM w WHERE dir = 1 GROUP BY c
),
a AS (SELECT * FROM rec WHERE r <= {P.MAX_DAYS}),
wa AS (SELECT w.* FROM w WHERE c IN (SELECT c FROM a)),
fr AS (SELECT c, count(DISTINCT tk) AS f FROM wa WHERE dir = 1 GROUP BY c),
mo AS (SELECT c, CAST(sum(gross - disc) AS DOUBLE) AS v FROM wa GROUP BY c HAVING sum(gross - disc) > 0.01),
rq AS (SELECT quantile_cont(CAST(r AS DOUBLE), [0, 0.25, 0.75, 1]) AS q FROM a),
fq AS (SELECT quantile_cont(CAST(f AS DOUBLE), [0, 0.5, 0.75, 1]) AS q FROM fr),
mq AS (SELECT quantile_cont(v, [0, 0.25, 0.75, 1]) AS q FROM mo),
rg AS (SELECT a.*, {level('r')} AS g FROM a, rq),
fg AS (SELECT fr.*, {level('f', right=False)} AS g FROM fr, fq),
mg AS (SELECT mo.*, {level('v')} AS g FROM mo, mq),
rfm AS (
  SELECT rg.c, fg.f, fg.g AS fgrp, mg.v, mg.g AS mgrp, rg.last, rg.r, rg.g AS rgrp
  FROM fg JOIN mg ON fg.c = mg.c JOIN rg ON rg.c = fg.c
),
seg AS (
  SELECT *, CASE
    WHEN rgrp = 'HIGH' AND fgrp = 'HIGH' THEN 'Leaving Top'
    WHEN rgrp = 'HIGH' THEN 'Leaving'
    WHEN fgrp = 'LOW' THEN 'One-Timer'
    WHEN fgrp = 'MEDIUM' THEN 'Engaged'
    ELSE 'Top' END AS rf
  FROM rfm
),
cls AS (
  SELECT *, (['Cheap', 'Tin', 'Copper', 'Bronze', 'Silver', 'Gold', 'Diamond'])[
    CASE rf WHEN 'One-Timer' THEN 1 WHEN 'Leaving' THEN 2 WHEN 'Engaged' THEN 3
      WHEN 'Leaving Top' THEN 4 ELSE 5 END
    + CASE mgrp WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END] AS rfmc
  FROM seg
)"""


RFM = rfm_ctes(P.START)
RFM_COLUMNS = """c AS "ID_CLI", f AS "N_TRANSAZIONI", fgrp AS "FREQUENCY_GROUP", v AS "MONETARY_VALUE",
  mgrp AS "MONETARY_GROUP", CAST(last AS VARCHAR) AS "LAST_PURCHASE", CAST(r AS INTEGER) AS "RECENCY", rgrp AS "RECENCY_GROUP" """

# --- sources ---------------------------------------------------------------------------------

ORACLE["delimited_tickets"] = with_ctes(
    TICKETS,
    select="""
SELECT CAST(c AS VARCHAR) AS "ID_CLI", count(*) AS n, CAST(sum(gross) AS DOUBLE) AS gross,
  CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day,
  CAST(sum(dir) AS BIGINT) AS direction
FROM t GROUP BY c""",
)
ORACLE["delimited_documents"] = """
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '"; ' || text || chr(10) || '"";' || source ELSE text END) AS digest, source
FROM documents"""
ORACLE["delimited_header_orders"] = """
SELECT CAST(c_custkey AS VARCHAR) AS "ID_CLI", CAST(c_nationkey AS VARCHAR) AS "ID_ADDRESS", c_mktsegment AS "TYP_JOB"
FROM customer"""
ORACLE["invalid_values"] = """
SELECT 'o_orderkey' AS "column", 0 AS n
UNION ALL SELECT 'amount', count(*) FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'day', count(*) FROM orders WHERE o_orderkey % 7 = 0"""
ORACLE["null_tokens_in_text"] = """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment NOT IN ('BUILDING', '') THEN c_mktsegment END AS c_mktsegment
FROM customer"""
ORACLE["dataset_tables"] = with_ctes(
    LOYALTY.format(before=P.REF),
    select="""
SELECT 'loyalty' AS name, 2 AS columns, count(*) AS n, CAST(count(c) + count(card) AS BIGINT) AS filled FROM loy
UNION ALL SELECT 'account', 3, count(*), count(c_custkey) + count(c_nationkey) + count(c_mktsegment) FROM customer
UNION ALL SELECT 'address', 2, count(*), count(n_nationkey) + count(r_name)
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'privacy', 2, count(*), count(c_custkey) + count(c_name) FROM customer
UNION ALL SELECT 'campaign', 2, count(*), count(r_regionkey) + count(r_name) FROM region
UNION ALL SELECT 'campaign_event', 3, count(*), count(event_id) + count(user_id) + count(event_type) FROM events
UNION ALL SELECT 'ticket_line', 8, count(*), 8 * count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
TYPE_LINES = """
bl AS (
  SELECT DISTINCT o.o_custkey AS c, o.o_orderdate AS ts, p.p_type AS item
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""
BRAND_LINES = TYPE_LINES.replace("p.p_type", "p.p_brand")
ARTICLE_LINES = """
bl AS (
  SELECT DISTINCT o.o_custkey AS c, o.o_orderdate AS ts, CAST(l.l_partkey AS VARCHAR) AS item
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""
BASKETS = """
b AS (SELECT c, ts, string_agg(item, ',' ORDER BY item) AS items, count(*) AS size FROM bl GROUP BY c, ts)"""
ORACLE["basket_files"] = with_ctes(
    TYPE_LINES, BASKETS, select="SELECT items, count(*) AS n FROM b GROUP BY items"
)

# --- filters and projections ------------------------------------------------------------------

ORACLE["in_window"] = with_ctes(
    TICKETS, select=DAY_LINES + f" WHERE d > DATE '{P.LOOKBACK}' AND d < DATE '{P.REF}'"
)
_ends = {
    "left": f"d >= DATE '{P.REF}' AND d < DATE '{P.HOLDOUT_END}'",
    "right": f"d > DATE '{P.REF}' AND d <= DATE '{P.HOLDOUT_END}'",
    "both": f"d >= DATE '{P.REF}' AND d <= DATE '{P.HOLDOUT_END}'",
    "neither": f"d > DATE '{P.REF}' AND d < DATE '{P.HOLDOUT_END}'",
    "after": f"d > DATE '{P.START}'",
}
ORACLE["window_ends"] = with_ctes(
    "o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders)",
    select=" UNION ALL ".join(
        f"SELECT '{name}' AS closed, count(*) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM o WHERE {test}"
        for name, test in _ends.items()
    ),
)
ORACLE["purchases_only"] = with_ctes(TICKETS, select=DAY_LINES + " WHERE dir = 1")
ORACLE["latest_rows"] = """
SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)"""
ORACLE["active_only"] = with_ctes(
    TICKETS,
    ACTIVE,
    select="""SELECT c AS "ID_CLI", CAST(last AS VARCHAR) AS "LAST_PURCHASE", CAST(r AS INTEGER) AS "RECENCY" FROM act""",
)
ORACLE["min_value"] = with_ctes(
    TICKETS,
    select="""
SELECT c AS "ID_CLI", CAST(sum(gross - disc) AS DOUBLE) AS "MONETARY_VALUE"
FROM t GROUP BY c HAVING sum(gross - disc) > 1000000""",
)
ORACLE["projected_columns"] = """
SELECT o_custkey AS customer_id, o_orderkey,
  CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,1)) AS DOUBLE) AS o_totalprice,
  o_orderpriority AS priority, 'EUR' AS unit
FROM orders"""
_CARDED = """
SELECT c_custkey AS "ID_CLI", c_nationkey AS "ID_ADDRESS", c_mktsegment AS "TYP_JOB", card AS "LAST_COD_FID"
FROM customer LEFT JOIN loy ON c_custkey = c"""
ORACLE["enrich"] = with_ctes(LOYALTY.format(before=P.EARLY), select=_CARDED)
ORACLE["complete_cases"] = with_ctes(LOYALTY.format(before=P.EARLY), select=_CARDED + " WHERE card IS NOT NULL")

# --- joins ------------------------------------------------------------------------------------

ORACLE["restrict_to"] = with_ctes(
    TICKETS, ACTIVE, select=DAY_LINES + f" WHERE d > DATE '{P.START}' AND c IN (SELECT c FROM act)"
)
ORACLE["assemble"] = with_ctes(
    TICKETS,
    MEASURES,
    select="""
SELECT c AS "ID_CLI", CAST(last AS VARCHAR) AS "LAST_PURCHASE", CAST(r AS INTEGER) AS "RECENCY",
  f AS "N_TRANSAZIONI", v AS "MONETARY_VALUE"
FROM m""",
)
ORACLE["flag_members"] = with_ctes(
    TICKETS,
    select=f"""
SELECT c_custkey AS "ID_CLI", CASE WHEN c_custkey IN (
  SELECT c FROM t WHERE dir = 1 AND d >= DATE '{P.REF}' AND d < DATE '{P.HOLDOUT_END}') THEN 0 ELSE 1 END AS "CHURN"
FROM customer""",
)
ORACLE["enrich_via"] = """
SELECT DISTINCT o_custkey AS "ID_CLI", n_name AS "REGION"
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"""

# --- aggregations -----------------------------------------------------------------------------

ORACLE["recency"] = with_ctes(
    TICKETS,
    select=f"""
SELECT c AS "ID_CLI", CAST(max(d) AS VARCHAR) AS "LAST_PURCHASE",
  CAST(datediff('day', max(d), DATE '{P.AS_OF}') AS INTEGER) AS "RECENCY"
FROM t WHERE dir = 1 GROUP BY c""",
)
ORACLE["frequency"] = with_ctes(
    TICKETS,
    select='SELECT c AS "ID_CLI", count(DISTINCT tk) AS "N_TRANSAZIONI" FROM t WHERE dir = 1 GROUP BY c',
)
ORACLE["frequency_approx_bound"] = with_ctes(
    TICKETS, select='SELECT DISTINCT c AS "ID_CLI", 1 AS within FROM t WHERE dir = 1'
)
ORACLE["quantiles_approx_bound"] = "SELECT unnest(range(0, 21)) / 20.0 AS prob, 1 AS within"
ORACLE["monetary"] = with_ctes(
    TICKETS, select='SELECT c AS "ID_CLI", CAST(sum(gross - disc) AS DOUBLE) AS "MONETARY_VALUE" FROM t GROUP BY c'
)
ORACLE["spend"] = with_ctes(
    TICKETS,
    select="""
SELECT c AS "ID_CLI", CAST(sum(gross) AS DOUBLE) AS "IMPORTO_LORDO", CAST(sum(disc) AS DOUBLE) AS "SCONTO",
  CAST(sum(gross) - sum(disc) AS DOUBLE) AS "SPESA"
FROM t WHERE dir = 1 GROUP BY c""",
)
ORACLE["distinct_keys"] = 'SELECT DISTINCT o_custkey AS "ID_CLI" FROM orders JOIN lineitem ON l_orderkey = o_orderkey'
ORACLE["level_counts"] = """
SELECT lv.name AS "TYP_JOB", count(c_custkey) AS n
FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('UNKNOWN')) lv(name)
LEFT JOIN customer ON c_mktsegment = lv.name GROUP BY lv.name"""
ORACLE["cross_counts"] = """
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL"""
ORACLE["cross_counts_wide"] = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_orderpriority"""
_VENTILES = "[" + ", ".join(str(i / 20) for i in range(21)) + "]"
ORACLE["quantiles"] = with_ctes(
    TICKETS,
    f"q AS (SELECT quantile_cont(v, {_VENTILES}) AS q FROM (SELECT CAST(sum(gross - disc) AS DOUBLE) AS v FROM t GROUP BY c))",
    select=f"SELECT unnest({_VENTILES})::DOUBLE AS prob, round(unnest(q), 4) AS value FROM q",
)
ORACLE["quantiles_of_lines"] = f"""
SELECT 'l_extendedprice' AS measure, unnest({_VENTILES})::DOUBLE AS prob, round(unnest(q), 4) AS value
FROM (SELECT quantile_cont(l_extendedprice, {_VENTILES}) AS q FROM lineitem)
UNION ALL SELECT 'l_quantity', unnest([0, 0.25, 0.75, 1])::DOUBLE, round(unnest(q), 4)
FROM (SELECT quantile_cont(l_quantity, [0, 0.25, 0.75, 1]) AS q FROM lineitem)"""
ORACLE["profile"] = with_ctes(
    TICKETS,
    MEASURES,
    LONG_MEASURES,
    select="""
SELECT measure, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1,
  round(quantile_cont(x, 0.5), 4) AS median, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.75), 4) AS q3,
  round(max(x), 4) AS max
FROM lm GROUP BY measure""",
)
ORACLE["distribution"] = with_ctes(
    TICKETS,
    MEASURES,
    LONG_MEASURES,
    "s AS (SELECT measure, min(x) AS lo, (max(x) - min(x)) / 20.0 AS w, count(*) AS total FROM lm GROUP BY measure)",
    "k AS (SELECT lm.measure, CAST(least(floor((x - lo) / w) + 1, 20) AS INTEGER) AS bin, count(*) AS n "
    "FROM lm JOIN s ON lm.measure = s.measure GROUP BY ALL)",
    select="""
SELECT s.measure, b.bin, round(lo + w * (b.bin - 1), 4) AS lo, round(lo + w * (b.bin - 1) + w, 4) AS hi,
  coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * w), 10) AS density
FROM s CROSS JOIN (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS bin) b
  LEFT JOIN k ON k.measure = s.measure AND k.bin = b.bin""",
)
ORACLE["article_sales"] = """
SELECT l_partkey AS "ID_ARTICOLO", count(*) AS "NUM_VENDITE" FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 10"""

# --- windows and sorts ------------------------------------------------------------------------

GAPS = """
dd AS (SELECT DISTINCT c, d FROM t WHERE dir = 1),
g AS (
  SELECT * FROM (SELECT c, d, datediff('day', lag(d) OVER (PARTITION BY c ORDER BY d), d) AS gap FROM dd)
  WHERE gap IS NOT NULL
)"""
ORACLE["repurchase_gaps"] = with_ctes(
    TICKETS,
    GAPS,
    select='SELECT c AS "ID_CLI", CAST(d AS VARCHAR) AS day, CAST(gap AS INTEGER) AS gap FROM g',
)
ORACLE["repurchase_quantiles"] = with_ctes(
    TICKETS,
    GAPS,
    select="""
SELECT unnest([0.8, 0.9])::DOUBLE AS prob, round(unnest(q), 6) AS value
FROM (SELECT quantile_cont(CAST(gap AS DOUBLE), [0.8, 0.9]) AS q FROM g)""",
)
ORACLE["repurchase_curve"] = with_ctes(
    TICKETS,
    GAPS,
    select="""
SELECT CAST(gap AS INTEGER) AS gap, count(*) AS n,
  round(CAST(sum(count(*)) OVER (ORDER BY gap) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share
FROM g GROUP BY gap""",
)
ORACLE["ordered_customers"] = ORACLE["frequency"] + ' ORDER BY "N_TRANSAZIONI" DESC, "ID_CLI"'

# --- scalar expressions -----------------------------------------------------------------------

ORACLE["parsed_days"] = """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS padded_day,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS short_day
FROM orders"""
ORACLE["day_differences"] = """
SELECT o_orderkey, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ORACLE["joined_articles"] = with_ctes(
    TICKETS,
    select="""
SELECT c AS "ID_CLI", CAST(d AS VARCHAR) AS day,
  string_agg(CAST(art AS VARCHAR), ',' ORDER BY CAST(art AS VARCHAR)) AS items
FROM t GROUP BY c, d""",
)
ORACLE["cut_right_closed"] = """
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice >= 1000 AND o_totalprice <= 100000 THEN 'LOW'
  WHEN o_totalprice > 100000 AND o_totalprice <= 300000 THEN 'MEDIUM'
  WHEN o_totalprice > 300000 AND o_totalprice <= 500000 THEN 'HIGH' END AS level
FROM orders"""
ORACLE["cut_left_closed"] = """
SELECT l_orderkey, l_quantity, CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'LOW'
  WHEN l_quantity >= 10 AND l_quantity < 25 THEN 'MEDIUM'
  WHEN l_quantity >= 25 AND l_quantity <= 50 THEN 'HIGH' END AS level
FROM lineitem"""
ORACLE["cut_collapsed"] = with_ctes(
    TICKETS,
    rfm_ctes(P.SHORT_START),
    select='SELECT c AS "ID_CLI", f AS "N_TRANSAZIONI", g AS "FREQUENCY_GROUP" FROM fg',
)

# --- segmentation -----------------------------------------------------------------------------

ORACLE["rfm_table"] = with_ctes(TICKETS, RFM, select=f"SELECT {RFM_COLUMNS} FROM rfm")
ORACLE["rf_segment"] = with_ctes(
    TICKETS,
    RFM,
    select='SELECT c AS "ID_CLI", rgrp AS "RECENCY_GROUP", fgrp AS "FREQUENCY_GROUP", rf AS "RF" FROM seg',
)
ORACLE["rfm_class"] = with_ctes(
    TICKETS,
    RFM,
    select='SELECT c AS "ID_CLI", rf AS "RF", mgrp AS "MONETARY_GROUP", rfmc AS "RFM" FROM cls',
)
ORACLE["rfm_segments"] = with_ctes(
    TICKETS, RFM, select=f'SELECT {RFM_COLUMNS}, rf AS "RF", rfmc AS "RFM" FROM cls'
)


def _score(column, q):
    return "CAST(" + " + ".join(f"CASE WHEN {column} >= {q}[{i}] THEN 1 ELSE 0 END" for i in range(1, 6)) + " AS INTEGER)"


_FIFTHS = "[0, 0.2, 0.4, 0.6, 0.8, 1]"
ORACLE["rfm_scores"] = with_ctes(
    TICKETS,
    RFM,
    f"""
q5 AS (
  SELECT quantile_cont(CAST(r AS DOUBLE), {_FIFTHS}) AS rq5, quantile_cont(CAST(f AS DOUBLE), {_FIFTHS}) AS fq5,
    quantile_cont(v, {_FIFTHS}) AS mq5
  FROM rfm
),
sc AS (SELECT c, 6 - {_score('r', 'rq5')} AS rs, {_score('f', 'fq5')} AS fs, {_score('v', 'mq5')} AS ms FROM rfm, q5)
""",
    select="""
SELECT c AS "ID_CLI", rs AS recency_score, fs AS frequency_score, ms AS monetary_score,
  rs * 100 + fs * 10 + ms AS rfm_score
FROM sc""",
)
ORACLE["rfm_points"] = with_ctes(
    TICKETS,
    RFM,
    select="""
SELECT 'RM' AS plot, c AS "ID_CLI", CAST(r AS DOUBLE) AS x, v AS y FROM rfm
UNION ALL SELECT 'FM', c, CAST(f AS DOUBLE), v FROM rfm
UNION ALL SELECT 'RF', c, CAST(r AS DOUBLE), CAST(f AS DOUBLE) FROM rfm""",
)
ORACLE["rfm_raster"] = with_ctes(
    TICKETS,
    MEASURES,
    "s AS (SELECT min(r) AS x0, max(r) AS x1, min(v) AS y0, max(v) AS y1 FROM m)",
    select="""
SELECT CAST(least(floor((CAST(r AS DOUBLE) - x0) * 25 / (x1 - x0)) + 1, 25) AS INTEGER) AS x_bin,
  CAST(least(floor((v - y0) * 25 / (y1 - y0)) + 1, 25) AS INTEGER) AS y_bin, count(*) AS n
FROM m, s GROUP BY 1, 2""",
)
COUNTS = """
lv AS (SELECT * FROM (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3)) v(category, rank)),
gc AS (
  SELECT 'RECENCY' AS measure, lv.category, lv.rank, count(c) AS n FROM lv LEFT JOIN rg ON g = category GROUP BY ALL
  UNION ALL SELECT 'N_TRANSAZIONI', lv.category, lv.rank, count(c) FROM lv LEFT JOIN fg ON g = category GROUP BY ALL
  UNION ALL SELECT 'MONETARY_VALUE', lv.category, lv.rank, count(c) FROM lv LEFT JOIN mg ON g = category GROUP BY ALL
)"""
ORACLE["share_bands"] = with_ctes(
    TICKETS,
    RFM,
    COUNTS,
    """
sh AS (
  SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY measure) AS DOUBLE) AS fraction,
    CAST(sum(n) OVER (PARTITION BY measure ORDER BY rank) AS DOUBLE)
      / CAST(sum(n) OVER (PARTITION BY measure) AS DOUBLE) AS ymax
  FROM gc
),
sb AS (SELECT *, coalesce(lag(ymax) OVER (PARTITION BY measure ORDER BY rank), 0) AS ymin FROM sh)""",
    select="""
SELECT measure, category, n, round(fraction, 9) AS fraction, round(ymin, 9) AS ymin, round(ymax, 9) AS ymax,
  round((ymin + ymax) / 2.0, 9) AS "labelPosition", category || chr(10) || '  ' || n AS label
FROM sb""",
)
ORACLE["rfm_report"] = with_ctes(
    TICKETS,
    RFM,
    COUNTS,
    select="""
SELECT 'bands' AS section, measure || '/' || category AS name, n FROM gc
UNION ALL SELECT 'rf', rf, count(*) FROM cls GROUP BY rf
UNION ALL SELECT 'rfm', rfmc, count(*) FROM cls GROUP BY rfmc
UNION ALL SELECT 'rf_matrix', rgrp || '/' || fgrp || '/' || rf, count(*) FROM cls GROUP BY rgrp, fgrp, rf
UNION ALL SELECT 'rfm_matrix', rf || '/' || mgrp || '/' || rfmc, count(*) FROM cls GROUP BY rf, mgrp, rfmc""",
)

# --- churn ------------------------------------------------------------------------------------

CHURN = f"""
lb AS (SELECT * FROM t WHERE dir = 1 AND d < DATE '{P.REF}' AND d > DATE '{P.LOOKBACK}'),
ft AS (
  SELECT c, datediff('day', max(d), DATE '{P.REF}') AS r, CAST(sum(gross) - sum(disc) AS DOUBLE) AS s,
    count(DISTINCT tk) AS p
  FROM lb GROUP BY c
),
ho AS (SELECT DISTINCT c FROM t WHERE dir = 1 AND d >= DATE '{P.REF}' AND d < DATE '{P.HOLDOUT_END}'),
lf AS (SELECT ft.*, CASE WHEN c IN (SELECT c FROM ho) THEN 0 ELSE 1 END AS churn FROM ft),
ds AS (
  SELECT lf.*, c_mktsegment AS job, card, r_name AS region
  FROM lf LEFT JOIN customer ON c_custkey = lf.c LEFT JOIN loy ON loy.c = lf.c
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  WHERE c_mktsegment IS NOT NULL AND card IS NOT NULL AND r_name IS NOT NULL
)"""
SPLIT = f"""
hs AS (
  SELECT *, md5('{P.SEED}|' || c) AS h, ceil({P.SPLIT} * count(*) OVER (PARTITION BY churn)) AS want FROM ds
),
sp AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY churn ORDER BY h, CAST(c AS VARCHAR)) <= want
    THEN 1 ELSE 0 END AS is_train
  FROM hs
)"""
CHURN_ALL = (TICKETS, LOYALTY.format(before=P.REF), CHURN)
ORACLE["churn_features"] = with_ctes(
    *CHURN_ALL,
    select='SELECT c AS "ID_CLI", CAST(r AS INTEGER) AS "RECENCY", s AS "SPESA", p AS "TOT_PURCHASE" FROM ft',
)
ORACLE["churn_labels"] = with_ctes(*CHURN_ALL, select='SELECT c AS "ID_CLI", churn AS "CHURN" FROM lf')
ORACLE["churn_dataset"] = with_ctes(
    *CHURN_ALL,
    select="""
SELECT c AS "ID_CLI", CAST(r AS INTEGER) AS "RECENCY", s AS "SPESA", p AS "TOT_PURCHASE", churn AS "CHURN",
  job AS "TYP_JOB_CLEAN", card AS "LAST_COD_FID", region AS "REGION"
FROM ds""",
)
ORACLE["stratified_split"] = with_ctes(
    *CHURN_ALL, SPLIT, select='SELECT c AS "ID_CLI", churn AS "CHURN", is_train FROM sp'
)
ORACLE["hashed_split"] = with_ctes(
    *CHURN_ALL,
    select=f"""
SELECT c AS "ID_CLI", churn AS "CHURN",
  CASE WHEN md5('{P.SEED}|' || c)[1:8] < 'b3333333' THEN 1 ELSE 0 END AS is_train
FROM ds""",
)
_categories = (("REGION", "region"), ("TYP_JOB_CLEAN", "job"), ("LAST_COD_FID", "card"))
ORACLE["encoded_one_level"] = with_ctes(
    *CHURN_ALL,
    select="""
SELECT 3 + count(DISTINCT region) - 1 + count(DISTINCT job) - 1 AS features, count(*) AS n,
  3 + count(DISTINCT region) - 1 + count(DISTINCT job) - 1 AS terms FROM ds""",
)
ORACLE["encoded_categories"] = with_ctes(
    *CHURN_ALL,
    select="""
SELECT 'RECENCY' AS term, count(*) FILTER (r <> 0) AS n FROM ds
UNION ALL SELECT 'SPESA', count(*) FILTER (s <> 0) FROM ds
UNION ALL SELECT 'TOT_PURCHASE', count(*) FILTER (p <> 0) FROM ds"""
    + "".join(
        f" UNION ALL SELECT '{name}' || {col}, count(*) FROM ds WHERE {col} > (SELECT min({col}) FROM ds) GROUP BY {col}"
        for name, col in _categories
    ),
)
TRAIN = "tr AS (SELECT * FROM sp WHERE is_train = 1)"
ORACLE["tree_leaf_shares"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    TRAIN,
    select="""
SELECT count(*) AS n, CAST(sum(churn) AS BIGINT) AS positives, CAST(sum(churn) AS DOUBLE) AS fitted, 0 AS leaves_off
FROM tr""",
)
WEIGHT = " + ".join(f"(u >= {t})::INT" for t in poisson_thresholds())
_numeric = (("RECENCY", "r"), ("SPESA", "s"), ("TOT_PURCHASE", "p"))
ORACLE["split_gains"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    TRAIN,
    "v AS ("
    + " UNION ALL ".join(
        [f"SELECT '{name}' AS predictor, CAST({col} AS DOUBLE) AS x, NULL AS level, churn AS y FROM tr" for name, col in _numeric]
        + [f"SELECT '{name}', NULL, {col}, churn FROM tr" for name, col in _categories]
    )
    + ")",
    "e AS (SELECT predictor, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 256 AS w FROM v GROUP BY predictor)",
    """b AS (
  SELECT predictor, level, lo, w, count(*) AS n, sum(y) AS k,
    CASE WHEN x IS NOT NULL THEN least(255, CAST(floor((x - lo) / w) AS BIGINT)) END AS bin
  FROM v JOIN e USING (predictor) WHERE x IS NULL OR lo < hi GROUP BY ALL)""",
    """c AS (
  SELECT predictor, lo + w * (bin + 1) AS below, row_number() OVER o AS left_bins,
    CAST(sum(n) OVER o AS DOUBLE) AS ln, CAST(sum(k) OVER o AS DOUBLE) AS lk,
    CAST(sum(n) OVER a AS DOUBLE) AS n, CAST(sum(k) OVER a AS DOUBLE) AS k
  FROM b WINDOW a AS (PARTITION BY predictor), o AS (PARTITION BY predictor
    ORDER BY bin, CASE WHEN bin IS NULL THEN CAST(k AS DOUBLE) / n END, level
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    """g AS (
  SELECT *, round(2 * (k / n) * (1 - k / n) - ln / n * (2 * (lk / ln) * (1 - lk / ln))
    - (n - ln) / n * (2 * ((k - lk) / (n - ln)) * (1 - (k - lk) / (n - ln))), 9) AS gain
  FROM c WHERE ln < n)""",
    select="""
SELECT predictor, gain, left_bins, CAST(ln AS BIGINT) AS left_rows, CAST(lk AS BIGINT) AS left_positives,
  round(below, 6) AS below
FROM g QUALIFY row_number() OVER (PARTITION BY predictor ORDER BY gain DESC, left_bins) = 1""",
)
ORACLE["tree_pruning_ends"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    "k AS (SELECT CAST(sum(churn) > count(*) - sum(churn) AS INT) AS class FROM sp WHERE is_train = 1)",
    select="""
SELECT CAST(1 AS INT) AS leaves, count(*) FILTER (is_train = 1 AND churn <> class) AS train_errors,
  count(*) FILTER (is_train = 0 AND churn <> class) AS test_errors, count(*) FILTER (is_train = 1) AS train_rows,
  count(*) FILTER (is_train = 0) AS test_rows, CAST(0 AS BIGINT) AS out_of_order
FROM sp CROSS JOIN k""",
)
ORACLE["forest_bags"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    TRAIN,
    f"dr AS (SELECT tree, churn, ('0x' || substr(md5('{P.SEED}-' || tree || '-' || CAST(c AS VARCHAR)), 1, 8))::BIGINT AS u "
    f"FROM tr, range({P.BAGS}) t(tree))",
    f"w AS (SELECT tree, churn, {WEIGHT} AS w FROM dr)",
    select="""
SELECT CAST(tree AS INT) AS tree, CAST(sum(w) AS BIGINT) AS weight, count(*) FILTER (w = 0) AS left_out,
  count(*) FILTER (w = 0 AND churn = 1) AS left_out_positives
FROM w GROUP BY tree""",
)
ORACLE["logistic_totals"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    TRAIN,
    select="""
SELECT '(Intercept)' AS term, CAST(sum(churn) AS BIGINT) AS observed, CAST(sum(churn) AS DOUBLE) AS fitted FROM tr"""
    + "".join(
        f" UNION ALL SELECT '{name}' || l.{col}, CAST(coalesce(sum(churn), 0) AS BIGINT), "
        f"CAST(coalesce(sum(churn), 0) AS DOUBLE) FROM (SELECT DISTINCT {col} FROM ds) l LEFT JOIN tr ON tr.{col} = l.{col} "
        f"WHERE l.{col} > (SELECT min({col}) FROM ds) GROUP BY l.{col}"
        for name, col in _categories
    ),
)
ORACLE["logistic_null_deviance"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    TRAIN,
    "sh AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(churn) AS DOUBLE) AS k FROM tr)",
    select="""
SELECT round(-2 * (k * ln(k / n) + (n - k) * ln(1 - k / n)), 3) AS null_deviance, CAST(n - 1 AS BIGINT) AS null_df,
  0.0::DOUBLE AS aic_gap FROM sh""",
)
ORACLE["predicted_rows"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    select="""
SELECT model, count(*) AS n, CAST(sum(churn) AS BIGINT) AS positives, 0 AS classes_off
FROM sp CROSS JOIN (SELECT unnest(['logistic_reg', 'random_forest', 'dec_tree']) AS model)
WHERE is_train = 0 GROUP BY model""",
)
BAYES = """
tr AS (SELECT * FROM sp WHERE is_train = 1),
te AS (SELECT * FROM sp WHERE is_train = 0),
k AS (
  SELECT churn AS k, count(*) AS n, avg(r) AS rm, stddev_samp(r) AS rs, avg(s) AS sm, stddev_samp(s) AS ss,
    avg(p) AS pm, stddev_samp(p) AS ps, count(*) / (SELECT count(*) FROM tr) AS prior
  FROM tr GROUP BY churn
),
lt AS (
  SELECT 'REGION' AS f, region AS l, churn AS k FROM tr UNION ALL SELECT 'TYP_JOB_CLEAN', job, churn FROM tr
  UNION ALL SELECT 'LAST_COD_FID', card, churn FROM tr
),
lc AS (SELECT f, l, k, count(*) AS n FROM lt GROUP BY ALL),
ll AS (
  SELECT x.f, x.l, k.k, coalesce(lc.n, 0) / k.n AS share
  FROM (SELECT DISTINCT f, l FROM lt) x CROSS JOIN k LEFT JOIN lc ON lc.f = x.f AND lc.l = x.l AND lc.k = k.k
)"""


def _density(x, mean, sd):
    z = f"(te.{x} - k.{mean}) / greatest(k.{sd}, 1e-300)"
    pdf = f"exp(-0.5 * ({z}) * ({z})) / (k.{sd} * sqrt(2 * pi()))"
    return f"ln(CASE WHEN {pdf} > 0 THEN {pdf} ELSE 0.001 END)"


def _share(alias):
    return f"ln(CASE WHEN {alias}.share > 0 THEN {alias}.share ELSE 0.001 END)"


SCORES = f"""
scr AS (
  SELECT te.c, te.churn, k.k, ln(k.prior) + {_density('r', 'rm', 'rs')} + {_density('s', 'sm', 'ss')}
    + {_density('p', 'pm', 'ps')} + {_share('l1')} + {_share('l2')} + {_share('l3')} AS score
  FROM te CROSS JOIN k
    LEFT JOIN ll l1 ON l1.f = 'REGION' AND l1.l = te.region AND l1.k = k.k
    LEFT JOIN ll l2 ON l2.f = 'TYP_JOB_CLEAN' AND l2.l = te.job AND l2.k = k.k
    LEFT JOIN ll l3 ON l3.f = 'LAST_COD_FID' AND l3.l = te.card AND l3.k = k.k
),
two AS (
  SELECT c, churn, max(score) FILTER (k = 0) AS s0, max(score) FILTER (k = 1) AS s1 FROM scr GROUP BY c, churn
),
pr AS (
  SELECT c, CAST(churn AS VARCHAR) AS label, CASE WHEN s1 > s0 THEN '1' ELSE '0' END AS prediction,
    exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) AS probability
  FROM two
)"""
BAYES_ALL = (*CHURN_ALL, SPLIT, BAYES, SCORES)
_numbers = [("RECENCY", "rm", "rs"), ("SPESA", "sm", "ss"), ("TOT_PURCHASE", "pm", "ps")]
ORACLE["naive_bayes_parameters"] = with_ctes(
    *CHURN_ALL,
    SPLIT,
    BAYES,
    select="""
SELECT CAST(k AS VARCHAR) AS class, '(prior)' AS feature, CAST(NULL AS VARCHAR) AS level, 'share' AS parameter,
  round(prior, 6) AS value FROM k"""
    + "".join(
        f" UNION ALL SELECT CAST(k AS VARCHAR), '{f}', NULL, '{name}', round({col}, 6) FROM k"
        for f, mean, sd in _numbers
        for name, col in (("mean", mean), ("sd", sd))
    )
    + " UNION ALL SELECT CAST(k AS VARCHAR), f, l, 'share', round(share, 6) FROM ll",
)
ORACLE["naive_bayes"] = with_ctes(
    *BAYES_ALL, select='SELECT c AS "ID_CLI", label, prediction, round(probability, 6) AS probability FROM pr'
)
ORACLE["confusion_counts"] = with_ctes(
    *BAYES_ALL, select="SELECT label, prediction, count(*) AS n FROM pr GROUP BY label, prediction"
)
MATRIX = """
cm AS (
  SELECT count(*) FILTER (label = '1' AND prediction = '1') AS tp,
    count(*) FILTER (label = '0' AND prediction = '1') AS fp,
    count(*) FILTER (label = '1' AND prediction = '0') AS fn,
    count(*) FILTER (label = '0' AND prediction = '0') AS tn, CAST(count(*) AS DOUBLE) AS n
  FROM pr
),
ce AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM cm)"""
ORACLE["model_metrics"] = with_ctes(
    *BAYES_ALL,
    MATRIX,
    select="""
SELECT tp, fp, fn, tn, round(po, 9) AS accuracy, round(tp / (tp + fn), 9) AS recall,
  round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS precision,
  round((po - pe) / (1 - pe), 9) AS kappa, round(greatest(tp + fn, fp + tn) / n, 9) AS no_information_rate,
  round(2 * tp / (2 * tp + fp + fn), 9) AS f1
FROM ce""",
)
ORACLE["confusion_report"] = with_ctes(
    *BAYES_ALL,
    MATRIX,
    select="""
SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
  round(tn / (tn + fn), 9) AS negative_predictive_value, round((tp + fn) / n, 9) AS prevalence,
  round(tp / n, 9) AS detection_rate, round((tp + fp) / n, 9) AS detection_prevalence,
  round(CAST((abs(fp - fn) - 1) * (abs(fp - fn) - 1) AS DOUBLE) / (fp + fn), 9) AS mcnemar
FROM cm""",
)
ORACLE["f1_score"] = with_ctes(*BAYES_ALL, MATRIX, select="SELECT round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM ce")

ORACLE["bootstrap_accuracy"] = with_ctes(
    *BAYES_ALL,
    "dr AS (SELECT rep, label = prediction AS ok, "
    "('0x' || substr(md5('0-' || rep || '-' || coalesce(CAST(c AS VARCHAR), '')), 1, 8))::BIGINT AS u "
    "FROM pr, range(25) t(rep))",
    f"w AS (SELECT rep, ok, {WEIGHT} AS w FROM dr)",
    select="""
SELECT CAST(rep AS INT) AS repeat, CAST(sum(w) AS BIGINT) AS n,
  round(CAST(sum(CASE WHEN ok THEN w ELSE 0 END) AS DOUBLE) / sum(w), 9) AS accuracy
FROM w GROUP BY rep""",
)

# --- baskets and rules ------------------------------------------------------------------------

ORACLE["baskets"] = with_ctes(
    TYPE_LINES,
    BASKETS,
    select='SELECT c AS "ID_CLI", CAST(CAST(ts AS DATE) AS VARCHAR) AS day, items FROM b',
)
ORACLE["basket_summary"] = with_ctes(
    TYPE_LINES,
    BASKETS,
    "ic AS (SELECT item, count(*) AS n FROM bl GROUP BY item)",
    "tot AS (SELECT count(*) AS nb, sum(size) AS nl, (SELECT count(*) FROM ic) AS ni, "
    "quantile_cont(CAST(size AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM b)",
    select="""
SELECT 'total' AS section, 'baskets' AS name, CAST(nb AS DOUBLE) AS value FROM tot
UNION ALL SELECT 'total', 'items', CAST(ni AS DOUBLE) FROM tot
UNION ALL SELECT 'total', 'density', round(CAST(nl AS DOUBLE) / (nb * ni), 9) FROM tot
UNION ALL SELECT 'total', 'mean size', round(CAST(nl AS DOUBLE) / nb, 9) FROM tot
UNION ALL SELECT 'size', CAST(size AS VARCHAR), CAST(count(*) AS DOUBLE) FROM b GROUP BY size
UNION ALL SELECT 'size quantile', unnest(['min', 'q1', 'median', 'q3', 'max']), unnest(q) FROM tot
UNION ALL SELECT 'item', item, CAST(n AS DOUBLE) FROM (SELECT * FROM ic ORDER BY n DESC, item LIMIT 5)""",
)
ORACLE["item_frequency"] = with_ctes(
    BRAND_LINES, select="SELECT item, count(*) AS n FROM bl GROUP BY item ORDER BY n DESC, item LIMIT 10"
)
# Every set of article kinds is a bit mask; a mask is contained in a basket when all its bits are.
MASKS = f"""
kd AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM bl)),
bm AS (SELECT c, ts, bit_or(1::BIGINT << i) AS m FROM bl JOIN kd USING (item) GROUP BY c, ts),
mc AS (SELECT m, count(*) AS n FROM bm GROUP BY m),
nb AS (SELECT count(*) AS total FROM bm),
st AS (
  SELECT s.s, sum(n) AS n, bit_count(s.s) AS size
  FROM generate_series(1, (SELECT (1::BIGINT << count(*)) - 1 FROM kd)) s(s) JOIN mc ON (mc.m & s.s) = s.s
  GROUP BY s.s HAVING sum(n) >= {P.TYPE_SUPPORT} * (SELECT total FROM nb)
),
nm AS (
  SELECT st.s, list(item ORDER BY item) AS items FROM st JOIN kd ON (st.s & (1::BIGINT << i)) <> 0 GROUP BY st.s
),
ru AS (
  SELECT u.s AS s, nmx.items AS antecedent, [kd.item] AS consequent, u.n AS n, u.size AS size,
    CAST(u.n AS DOUBLE) / total AS support, CAST(u.n AS DOUBLE) / a.n AS confidence,
    (CAST(u.n AS DOUBLE) / a.n) / (CAST(x.n AS DOUBLE) / total) AS lift
  FROM st u JOIN kd ON (u.s & (1::BIGINT << i)) <> 0
    JOIN st a ON a.s = u.s - (1::BIGINT << i) JOIN st x ON x.s = (1::BIGINT << i)
    JOIN nm nmx ON nmx.s = a.s CROSS JOIN nb
  WHERE u.size >= 2 AND CAST(u.n AS DOUBLE) / a.n >= {P.TYPE_CONFIDENCE}
)"""
PRUNED = """
fl AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY confidence DESC, antecedent, consequent) > 1
      OR EXISTS (SELECT 1 FROM ru o WHERE o.s <> ru.s AND (o.s & ru.s) = o.s) THEN 1 ELSE 0 END AS redundant
  FROM ru
),
pru AS (SELECT * FROM fl WHERE redundant = 0),
best AS (
  SELECT *, '{' || array_to_string(antecedent, ',') || '}' AS lhs, '{' || array_to_string(consequent, ',') || '}' AS rhs
  FROM pru ORDER BY lift DESC, antecedent, consequent LIMIT 10
)"""
RULE_COLUMNS = """array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift"""
RULES_ALL = (TYPE_LINES, MASKS)
PRUNED_ALL = (*RULES_ALL, PRUNED)
ORACLE["frequent_itemsets"] = with_ctes(
    *RULES_ALL,
    select="SELECT array_to_string(items, ',') AS items, CAST(n AS BIGINT) AS freq FROM st JOIN nm USING (s)",
)
ORACLE["association_rules"] = with_ctes(
    *RULES_ALL, select=f"SELECT {RULE_COLUMNS}, CAST(n AS BIGINT) AS count FROM ru"
)
ORACLE["rule_coverage"] = with_ctes(
    *RULES_ALL,
    select="""
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
  round(support / confidence, 9) AS coverage FROM ru""",
)
ORACLE["association_rules_of_sets"] = ORACLE["association_rules"]


def pair_sql(lines, support, confidence):
    return with_ctes(
        lines,
        "nb AS (SELECT count(*) AS total FROM (SELECT DISTINCT c, ts FROM bl))",
        f"ic AS (SELECT item, count(*) AS n FROM bl GROUP BY item HAVING count(*) >= {support} * (SELECT total FROM nb))",
        f"""
pc AS (
  SELECT a.item AS x, b.item AS y, count(*) AS n
  FROM bl a JOIN bl b ON a.c = b.c AND a.ts = b.ts AND a.item <> b.item
  GROUP BY a.item, b.item HAVING count(*) >= {support} * (SELECT total FROM nb)
)""",
        select=f"""
SELECT x AS antecedent, y AS consequent, round(CAST(pc.n AS DOUBLE) / total, 9) AS support,
  round(CAST(pc.n AS DOUBLE) / p.n, 9) AS confidence,
  round((CAST(pc.n AS DOUBLE) / p.n) / (CAST(q.n AS DOUBLE) / total), 9) AS lift, pc.n AS count
FROM pc JOIN ic p ON p.item = x JOIN ic q ON q.item = y CROSS JOIN nb
WHERE CAST(pc.n AS DOUBLE) / p.n >= {confidence}""",
    )


ORACLE["pair_rules"] = pair_sql(BRAND_LINES, P.BRAND_SUPPORT, P.BRAND_CONFIDENCE)
ORACLE["association_rules_two_items"] = ORACLE["pair_rules"]
ORACLE["pair_rules_by_article"] = pair_sql(ARTICLE_LINES, f"{P.ARTICLE_SUPPORT:.4f}", P.ARTICLE_CONFIDENCE)
ORACLE["sorted_rules"] = with_ctes(
    *RULES_ALL, select=f"SELECT {RULE_COLUMNS} FROM ru ORDER BY ru.support DESC, ru.antecedent, ru.consequent"
)
_spread = "".join(
    f" UNION ALL SELECT '{m}', '{name}', round({agg}, 9) FROM ru"
    for m in ("support", "confidence", "lift")
    for name, agg in (
        ("min", f"min({m})"),
        ("q1", f"quantile_cont({m}, 0.25)"),
        ("median", f"quantile_cont({m}, 0.5)"),
        ("q3", f"quantile_cont({m}, 0.75)"),
        ("max", f"max({m})"),
        ("mean", f"avg({m})"),
    )
)
ORACLE["rule_summary"] = with_ctes(
    *RULES_ALL,
    select="""
SELECT 'total' AS section, 'rules' AS name, CAST(count(*) AS DOUBLE) AS value FROM ru
UNION ALL SELECT 'size', CAST(size AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ru GROUP BY size"""
    + _spread,
)
ORACLE["top_rules"] = with_ctes(
    *RULES_ALL, select=f"SELECT {RULE_COLUMNS} FROM ru ORDER BY ru.support DESC, ru.antecedent, ru.consequent LIMIT 10"
)
ORACLE["redundant_rules"] = with_ctes(*PRUNED_ALL, select=f"SELECT {RULE_COLUMNS}, redundant FROM fl")
ORACLE["pruned_rules"] = with_ctes(*PRUNED_ALL, select=f"SELECT {RULE_COLUMNS} FROM pru")
ORACLE["rule_points"] = with_ctes(*PRUNED_ALL, select=f"SELECT {RULE_COLUMNS} FROM best")
ORACLE["rule_grid"] = with_ctes(
    *PRUNED_ALL, select="SELECT lhs, rhs, round(lift, 9) AS lift, round(support, 9) AS support FROM best"
)
ORACLE["rule_nodes"] = with_ctes(
    *PRUNED_ALL,
    select="""
SELECT DISTINCT unnest(list_concat(antecedent, consequent)) AS node, 'item' AS kind, CAST(NULL AS DOUBLE) AS support,
  CAST(NULL AS DOUBLE) AS lift FROM best
UNION ALL SELECT lhs || ' => ' || rhs, 'rule', round(support, 9), round(lift, 9) FROM best""",
)
ORACLE["rule_edges"] = with_ctes(
    *PRUNED_ALL,
    select="""
SELECT unnest(antecedent) AS source, lhs || ' => ' || rhs AS target, round(support, 9) AS support, round(lift, 9) AS lift
FROM best
UNION ALL SELECT lhs || ' => ' || rhs, unnest(consequent), round(support, 9), round(lift, 9) FROM best""",
)
GAP_LINES = """
al AS (
  SELECT o_custkey AS c, o_orderdate AS ts, CASE WHEN o_orderkey % 5 <> 0 THEN p_type END AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
bl AS (SELECT DISTINCT c, ts, item FROM al WHERE item IS NOT NULL)"""
ORACLE["basket_totals_with_gaps"] = with_ctes(
    GAP_LINES,
    select="""
SELECT unnest(['lines', 'sets', 'pairs', 'files']) AS way, count(*) AS baskets FROM (SELECT DISTINCT c, ts FROM al)""",
)
ORACLE["pair_rules_with_gaps"] = pair_sql(GAP_LINES, P.TYPE_SUPPORT, P.BRAND_CONFIDENCE).replace(
    "FROM (SELECT DISTINCT c, ts FROM bl)", "FROM (SELECT DISTINCT c, ts FROM al)"
)
