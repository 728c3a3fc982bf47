"""DuckDB oracle SQL for the registered queries (independent restatement).

Every string runs on DuckDB with the test tables registered as views.
``pyr``/``pyf`` spell Python's ``round``/``f"{x:.nf}"`` in SQL with the same
double arithmetic as ``shelfcast.functions.pynum`` (exact value, ties to
even) so both engines print and round identically.  Arguments of ``pyr``
are always plain column names (staged through CTEs) to keep the text small.
"""

from __future__ import annotations

D = "DOUBLE"


def dbl(v) -> str:
    return f"CAST({v} AS DOUBLE)"


def pyr(x: str, n: int = 2) -> str:
    s = dbl(float(10 ** n))
    a = f"abs({x})"
    c = f"({a} * {dbl(134217729.0)})"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    p = f"({a} * {s})"
    err = f"(({hi} * {s} - {p}) + {lo} * {s})"
    f = f"floor({p})"
    d = f"({p} - {f})"
    k = (f"(CASE WHEN {d} > 0.5 THEN {f} + 1 WHEN {d} < 0.5 THEN {f} "
         f"WHEN {err} > 0 THEN {f} + 1 WHEN {err} < 0 THEN {f} "
         f"WHEN floor({f} / 2) * 2 = {f} THEN {f} ELSE {f} + 1 END)")
    mag = f"({k} / {s})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR {p} >= {dbl(4503599627370496.0)} THEN {x} "
            f"WHEN {x} = 0 THEN {x} WHEN {x} < 0 THEN -{mag} ELSE {mag} END)")


def pyf(x: str, n: int = 2) -> str:
    return f"printf('%.{n}f', {pyr(x, n)})"


SALES_SQL = """
SELECT CAST(l_shipdate AS DATE) AS date,
       printf('P%06d', l_partkey) AS product_id,
       printf('S%04d', l_suppkey) AS store_id,
       p_type AS category,
       r_name AS region,
       CASE WHEN p_size % 10 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(p_size AS DOUBLE) * CAST(10 AS DOUBLE) END AS inventory_level,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN CAST(0 AS DOUBLE)
            ELSE l_quantity END AS units_sold,
       CAST(l_linenumber AS DOUBLE) * CAST(10 AS DOUBLE) AS units_ordered,
       l_extendedprice / l_quantity AS price,
       l_discount AS discount,
       CASE WHEN l_returnflag = 'A' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS promotion,
       p_retailprice AS competitor_pricing,
       CASE WHEN l_linestatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS epidemic,
       l_quantity * (CAST(1 AS DOUBLE) + l_tax) AS demand,
       l_orderkey AS src_order,
       l_linenumber AS src_line
FROM lineitem JOIN part ON l_partkey = p_partkey
              JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey
"""

MESSAGES_SQL = """
SELECT event_id AS message_id,
       printf('P%06d', user_id) AS product_id,
       CASE event_type WHEN 'purchase' THEN 'Do I need to reorder? How much?'
                       WHEN 'error'    THEN 'What is the current risk level and why?'
                       WHEN 'view'     THEN 'What is the forecast for next week?'
                       WHEN 'click'    THEN 'Give me a summary'
                       ELSE 'hello there' END AS query
FROM events
"""

ORD = "date, src_order, src_line"
ORD_DESC = "date DESC, src_order DESC, src_line DESC"
W = f"(PARTITION BY product_id ORDER BY {ORD})"


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    parts = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {parts}\n{body}"


def sales_cte():
    return ("sales", SALES_SQL)


def numbered_cte():
    """sales rows with rd (1 = latest) and n_rows per product."""
    return ("numbered", f"""
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {ORD_DESC}) AS rd,
          count(*) OVER (PARTITION BY product_id) AS n_rows
FROM sales""")


def aligned_serving_cte():
    """Training-style features of the latest row (aligned mode), per product."""
    return ("aligned", f"""
SELECT product_id,
       max(CASE WHEN rd = 1 THEN inventory_level END) AS inventory_level,
       avg(CASE WHEN rd BETWEEN 2 AND 8 THEN units_sold END) AS rolling_mean_7
FROM numbered GROUP BY product_id""")


def plan_ctes(src: str, keep: list[str], kind: str = "scalar"):
    """Inventory plan + alerts over ``src`` (columns: keep…, f1..f7 or fs, inv, lead).

    ``kind='scalar'``: ``fs`` is a constant daily rate (LTD = fs × lead);
    ``kind='list'``: f1..f7 are the first seven values (lead ≤ 7 assumed).
    """
    k = ", ".join(keep)
    if kind == "scalar":
        ltd = "greatest(CAST(0 AS DOUBLE), fs * CAST(lead AS DOUBLE))"
        days_src = ", ".join(["fs"] * 7)
        f7 = "fs + fs + fs + fs + fs + fs + fs"
    else:
        terms = " + ".join(f"CASE WHEN lead >= {i} THEN f{i} ELSE CAST(0 AS DOUBLE) END" for i in range(1, 8))
        ltd = f"greatest(CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) + {terms})"
        days_src = ", ".join(f"f{i}" for i in range(1, 8))
        f7 = "CAST(0 AS DOUBLE) + f1 + f2 + f3 + f4 + f5 + f6 + f7"
    vals = days_src.split(", ")
    # running sums c1..c7 (left to right) — written out as nested sums
    cum_cols, prev = [], "CAST(0 AS DOUBLE)"
    for i, v in enumerate(vals, start=1):
        prev = f"({prev} + {v})"
        cum_cols.append(f"{prev} AS c{i}")
    cums = ", ".join(cum_cols)
    src_vals = "fs" if kind == "scalar" else ", ".join(f"f{i}" for i in range(1, 8))
    days_when = " ".join(f"WHEN c{i} >= inv THEN {i}" for i in range(1, 8))
    return [
        ("p0", f"""
SELECT {k}, {src_vals}, inv, lead, {ltd} AS ltd, {f7} AS forecast_7day,
       {cums}
FROM {src}"""),
        ("p1", f"""
SELECT *, greatest(CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE) * ltd) AS ss,
       CASE WHEN inv <= 0 THEN 0 {days_when} ELSE -1 END AS days
FROM p0"""),
        ("p2", "SELECT *, greatest(CAST(0 AS DOUBLE), ltd + ss) AS rop FROM p1"),
        ("p3", f"""
SELECT *, inv <= rop AS reorder_status,
       CASE WHEN inv <= rop THEN greatest(CAST(0 AS DOUBLE), (rop - inv) + rop * CAST(0.5 AS DOUBLE))
            ELSE CAST(0 AS DOUBLE) END AS qty,
       CASE WHEN inv <= rop THEN CASE WHEN days > 0 AND days <= lead THEN 'high' ELSE 'medium' END
            WHEN inv <= rop * CAST(1.2 AS DOUBLE) THEN 'medium' ELSE 'low' END AS decision_risk
FROM p2"""),
        ("p4", f"""
SELECT *, {pyf('inv', 1)} AS inv_s, {pyf('rop', 1)} AS rop_s, {pyf('qty', 1)} AS qty_s,
       {pyr('ltd')} AS lead_time_demand, {pyr('ss')} AS safety_stock, {pyr('rop')} AS reorder_point,
       CASE WHEN reorder_status THEN {pyr('qty')} ELSE CAST(0 AS DOUBLE) END AS reorder_quantity,
       {pyr('inv')} AS current_inventory
FROM p3"""),
        ("plan", f"""
SELECT *, CASE
  WHEN reorder_status AND decision_risk = 'high' THEN
    'URGENT: Reorder immediately! Current inventory (' || inv_s || ') is below reorder point (' || rop_s || '). '
    || CASE WHEN days > 0 THEN 'Stockout expected in ' || CAST(days AS VARCHAR) || ' days. ' ELSE '' END
    || 'Recommended reorder quantity: ' || qty_s || ' units.'
  WHEN reorder_status AND decision_risk = 'medium' THEN
    'Reorder recommended. Current inventory (' || inv_s || ') is at or below reorder point (' || rop_s || '). '
    || CASE WHEN days > 0 THEN 'Stockout expected in ' || CAST(days AS VARCHAR) || ' days. ' ELSE '' END
    || 'Recommended reorder quantity: ' || qty_s || ' units.'
  WHEN reorder_status THEN
    'Consider reordering. Current inventory (' || inv_s || ') is at reorder point (' || rop_s || '). '
    || 'Recommended reorder quantity: ' || qty_s || ' units.'
  WHEN decision_risk = 'low' THEN
    'Inventory level is healthy. Current inventory (' || inv_s || ') is above reorder point (' || rop_s || '). No action needed.'
  WHEN decision_risk = 'medium' THEN
    'Monitor inventory closely. Current inventory (' || inv_s || ') is above reorder point (' || rop_s || ') but should be watched. '
    || CASE WHEN days > 0 THEN 'Estimated stockout in ' || CAST(days AS VARCHAR) || ' days.' ELSE '' END
  ELSE 'Inventory status: Current inventory (' || inv_s || ') is above reorder point (' || rop_s || ').'
END AS recommendation
FROM p4"""),
        ("a0", f"""
SELECT *, CASE WHEN days = -1 THEN 'LOW' WHEN days <= 2 THEN 'HIGH' WHEN days <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       {pyf('reorder_quantity', 0)} AS q0,
       CASE WHEN forecast_7day > 0 AND forecast_7day / CAST(7 AS DOUBLE) > 0
            THEN current_inventory / (forecast_7day / CAST(7 AS DOUBLE)) ELSE CAST(-1 AS DOUBLE) END AS cov
FROM plan"""),
        ("alerts", f"""
SELECT *, CASE
  WHEN risk_level = 'HIGH' THEN CASE WHEN reorder_status THEN
      CASE WHEN days > 0 THEN 'URGENT: Critical inventory level. Stockout expected in ' || CAST(days AS VARCHAR) || ' day(s). '
           ELSE 'URGENT: Critical inventory level. Immediate action required. ' END
      || 'Recommended reorder: ' || q0 || ' units.'
    ELSE 'WARNING: High risk detected. Stockout expected in ' || CAST(days AS VARCHAR) || ' day(s). Monitor closely.' END
  WHEN risk_level = 'MEDIUM' THEN CASE WHEN reorder_status THEN
      CASE WHEN days > 0 THEN 'ALERT: Reorder recommended. Stockout expected in ' || CAST(days AS VARCHAR) || ' day(s). '
           ELSE 'ALERT: Reorder recommended. ' END
      || 'Recommended quantity: ' || q0 || ' units.'
    ELSE CASE WHEN days > 0 THEN 'NOTICE: Medium risk. Stockout expected in ' || CAST(days AS VARCHAR) || ' day(s). Continue monitoring.'
              ELSE 'NOTICE: Medium risk level. Continue monitoring inventory.' END END
  ELSE CASE WHEN reorder_status THEN 'INFO: Consider reordering. Recommended quantity: ' || q0 || ' units.'
            WHEN days = -1 THEN 'INFO: Inventory levels are healthy. No immediate action required.'
            WHEN days > 0 THEN 'INFO: Low risk. Stockout expected in ' || CAST(days AS VARCHAR) || ' day(s).'
            ELSE 'INFO: Inventory levels are adequate.' END
END AS alert_message,
CASE WHEN forecast_7day <= 0 THEN false ELSE current_inventory > CAST(2.0 AS DOUBLE) * forecast_7day END AS overstock_flag,
CASE WHEN cov > 0 THEN {pyr('cov')} ELSE CAST(-1 AS DOUBLE) END AS inventory_coverage_days,
{pyr('forecast_7day')} AS forecast_7day_total,
CASE WHEN forecast_7day > 0 THEN {pyr('forecast_7day / CAST(7 AS DOUBLE)')} ELSE CAST(0 AS DOUBLE) END AS estimated_daily_demand
FROM a0"""),
    ]


def constant_plan_sql(select: str) -> str:
    ctes = [sales_cte(), numbered_cte(), aligned_serving_cte(),
            ("src", "SELECT product_id, coalesce(rolling_mean_7, CAST(0 AS DOUBLE)) AS fs, "
                    "inventory_level AS inv, 3 AS lead FROM aligned")]
    ctes += plan_ctes("src", ["product_id"], "scalar")
    return with_ctes(*ctes, body=select)


QUERIES: dict[str, str] = {}

QUERIES["inventory_plan"] = constant_plan_sql("""
SELECT product_id, lead AS lead_time_days, lead_time_demand, safety_stock, reorder_point,
       reorder_status, reorder_quantity, days AS days_to_stockout, decision_risk AS risk_level,
       current_inventory, recommendation
FROM plan""")

QUERIES["alerts"] = constant_plan_sql("""
SELECT product_id, risk_level, alert_message, overstock_flag, days AS days_to_stockout,
       reorder_status AS reorder_needed, reorder_quantity, inventory_coverage_days,
       forecast_7day_total, estimated_daily_demand, current_inventory
FROM alerts""")


# ---------------------------------------------------------------------------
# Shared CTEs
# ---------------------------------------------------------------------------
LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 28, 30)
MEANS = (3, 7, 14, 21, 30)
STDS = (7, 14, 30)
KEYS = "product_id, date, src_order, src_line"
PW = f"PARTITION BY product_id ORDER BY {ORD}"
TGT = [f"demand_t{i}" for i in range(1, 8)]
LAG_C = [f"lag_{k}" for k in LAGS]
MEAN_C = [f"rolling_mean_{n}" for n in MEANS]
STD_C = [f"rolling_std_{n}" for n in STDS]
CAL = ("CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(date) AS INTEGER) AS week_of_year, "
       "CAST(month(date) AS INTEGER) AS month, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend")


def feat_cte():
    cols = [f"lag(units_sold, {k}) OVER ({PW}) AS lag_{k}" for k in LAGS]
    cols += [f"avg(units_sold) OVER ({PW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_mean_{n}"
             for n in MEANS]
    cols += [f"stddev_samp(units_sold) OVER ({PW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_std_{n}"
             for n in STDS]
    cols += [f"lead(units_sold, {i}) OVER ({PW}) AS demand_t{i}" for i in range(1, 8)]
    return ("feat", f"SELECT *, {', '.join(cols)}, {CAL} FROM sales")


def tf_cte():
    cond = " AND ".join(f"{t} IS NOT NULL" for t in TGT)
    return ("tf", f"SELECT * FROM feat WHERE {cond}")


def numbered2_cte():
    return ("numbered", f"""
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {ORD_DESC}) AS rd,
          row_number() OVER (PARTITION BY product_id ORDER BY {ORD}) AS ra,
          count(*) OVER (PARTITION BY product_id) AS n_rows
FROM sales""")


def std_replace(cols=STD_C, n=6):
    return "REPLACE (" + ", ".join(f"{pyr(c, n)} AS {c}" for c in cols) + ")"


def info_ctes():
    return [("info", f"""
SELECT product_id AS sku,
       max(CASE WHEN ra = 1 THEN category END) AS category,
       max(CASE WHEN ra = 1 THEN region END) AS region,
       concat_ws(' - ', coalesce(max(CASE WHEN ra = 1 THEN category END), 'Unknown'), product_id) AS product_name,
       max(CASE WHEN ra = 1 THEN store_id END) AS store_id,
       avg(price) AS average_price_raw
FROM numbered GROUP BY product_id"""),
            ("info6", f"SELECT * EXCLUDE (average_price_raw), {pyr('average_price_raw', 6)} AS average_price FROM info")]


def base(*extra):
    return [sales_cte(), ("messages", MESSAGES_SQL), *extra]


def q(*ctes, body):
    return with_ctes(*ctes, body=body)


Q = QUERIES
Q["sales_scan"] = q(sales_cte(), body="SELECT * FROM sales")
Q["sku_filter"] = q(*base(), body="SELECT * FROM sales WHERE product_id IN (SELECT product_id FROM messages)")
Q["sku_membership"] = q(*base(), body="""
SELECT m.message_id, m.product_id, (k.product_id IS NOT NULL) AS known,
       CASE WHEN k.product_id IS NOT NULL THEN m.product_id ELSE (SELECT min(product_id) FROM sales) END AS resolved_sku
FROM messages m LEFT JOIN (SELECT DISTINCT product_id FROM sales) k ON m.product_id = k.product_id""")

Q["zero_profile"] = q(sales_cte(), ("z", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE units_sold = 0) AS zero_rows FROM sales"""), body="""
SELECT total_rows, zero_rows, CAST(zero_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) * 100 AS zero_pct,
       total_rows - zero_rows AS nonzero_rows,
       CAST(100 AS DOUBLE) - CAST(zero_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) * 100 AS nonzero_pct
FROM z""")
Q["zero_by_product"] = q(sales_cte(), body="""
SELECT product_id, count(*) FILTER (WHERE units_sold = 0) AS zero_count FROM sales
WHERE product_id IS NOT NULL GROUP BY product_id""")
_zt = " UNION ALL ".join(
    f"SELECT 'demand_t+{i}' AS target, count(*) FILTER (WHERE demand_t{i} = 0) AS zero_count, "
    f"count(demand_t{i}) AS total_count FROM tf" for i in range(1, 8))
Q["zero_targets"] = q(sales_cte(), feat_cte(), tf_cte(), ("zt", _zt), body="""
SELECT target, zero_count, total_count, CAST(zero_count AS DOUBLE) / CAST(total_count AS DOUBLE) * 100 AS zero_pct
FROM zt WHERE total_count > 0""")
Q["sku_list"] = q(sales_cte(), body="SELECT DISTINCT product_id FROM sales")
Q["product_info"] = q(sales_cte(), numbered2_cte(), *info_ctes(), body="SELECT * FROM info6")
Q["sku_catalog"] = q(sales_cte(), numbered2_cte(), *info_ctes(), ("ranked", """
SELECT *, CAST(row_number() OVER (ORDER BY sku) AS INTEGER) AS position FROM info6"""), body="""
SELECT *, position <= 20 AS displayed, greatest((SELECT count(*) FROM info6) - 20, 0) AS more_products
FROM ranked WHERE position <= 50""")

FEAT = (sales_cte(), feat_cte())
Q["lag_features"] = q(*FEAT, body=f"SELECT {KEYS}, units_sold, {', '.join(LAG_C)} FROM feat")
Q["rolling_mean"] = q(*FEAT, body=f"SELECT {KEYS}, units_sold, {', '.join(MEAN_C)} FROM feat")
Q["rolling_std"] = q(*FEAT, body=f"SELECT {KEYS}, units_sold, {', '.join(pyr(c, 6) + ' AS ' + c for c in STD_C)} FROM feat")
Q["demand_targets"] = q(*FEAT, body=f"SELECT {KEYS}, units_sold, {', '.join(TGT)} FROM feat")
Q["calendar_features"] = q(sales_cte(), body=f"SELECT {KEYS}, {CAL} FROM sales")
Q["date_text"] = q(sales_cte(), body=f"SELECT {KEYS}, strftime(date, '%Y-%m-%d') AS date_text FROM sales")
Q["training_frame"] = q(*FEAT, tf_cte(), body=f"SELECT * {std_replace()} FROM tf")
Q["layout_training_frame"] = Q["training_frame"]
_inc = " OR ".join(f"{t} IS NULL" for t in TGT)
Q["dropped_rows"] = q(*FEAT, body=f"""
SELECT count(*) AS initial_rows, count(*) FILTER (WHERE {_inc}) AS dropped_rows,
       count(*) FILTER (WHERE NOT ({_inc})) AS final_rows FROM feat""")

MANIFEST = ("inventory_level units_sold units_ordered price discount promotion competitor_pricing epidemic "
            "demand").split() + LAG_C + MEAN_C + STD_C + ["is_weekend"]
_mi = ", ".join(f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE)) AS {c}" for c in MANIFEST)
Q["model_input"] = q(*FEAT, tf_cte(), ("mi", f"SELECT {KEYS}, {_mi} FROM tf"),
                     body=f"SELECT * {std_replace()} FROM mi")

_cal_names = [c for c in MANIFEST + ["day_of_week", "week_of_year", "month"] if c not in STD_C]
Q["model_input_calendar"] = q(*FEAT, tf_cte(), body=f"""
SELECT {KEYS}, {', '.join(f'coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE)) AS {c}' for c in _cal_names)} FROM tf""")

PASS = "inventory_level units_ordered price discount promotion competitor_pricing epidemic".split()


def serving_sql(mode: str) -> str:
    aggs = ["max(n_rows) AS n", "max(CASE WHEN rd = 1 THEN date END) AS date",
            "max(CASE WHEN rd = 1 THEN units_sold END) AS lu"]
    aggs += [f"max(CASE WHEN rd = 1 THEN {c} END) AS {c}" for c in PASS + ["demand"]]
    if mode == "reference":
        aggs += [f"max(CASE WHEN rd = least({k}, n_rows) THEN units_sold END) AS l{k}" for k in LAGS]
        aggs += [f"avg(CASE WHEN rd <= least({w}, n_rows - 1) THEN units_sold END) AS m{w}" for w in MEANS]
        aggs += [f"stddev_samp(CASE WHEN rd <= least({w}, n_rows - 1) THEN units_sold END) AS s{w}" for w in STDS]
    else:
        aggs += [f"max(CASE WHEN rd = {k + 1} THEN units_sold END) AS l{k}" for k in LAGS]
        aggs += [f"avg(CASE WHEN rd BETWEEN 2 AND {w + 1} THEN units_sold END) AS m{w}" for w in MEANS]
        aggs += [f"stddev_samp(CASE WHEN rd BETWEEN 2 AND {w + 1} THEN units_sold END) AS s{w}" for w in STDS]
    g = ("g", f"SELECT product_id, {', '.join(aggs)} FROM numbered GROUP BY product_id")
    if mode == "reference":
        cols = [f"CASE WHEN n = 1 THEN lu ELSE l{k} END AS lag_{k}" for k in LAGS]
        cols += [f"CASE WHEN n = 1 THEN lu ELSE m{w} END AS rolling_mean_{w}" for w in MEANS]
        cols += [f"coalesce(s{w}, CAST(0 AS DOUBLE)) AS rolling_std_{w}" for w in STDS]
        cols += [f"coalesce({c}, CAST(0 AS DOUBLE)) AS {c}" for c in PASS]
    else:
        cols = [f"l{k} AS lag_{k}" for k in LAGS] + [f"m{w} AS rolling_mean_{w}" for w in MEANS]
        cols += [f"s{w} AS rolling_std_{w}" for w in STDS] + PASS + ["lu AS units_sold", "demand"]
    sv = ("sv", f"SELECT product_id, date, {', '.join(cols)}, {CAL} FROM g")
    return sales_cte(), numbered2_cte(), g, sv


Q["serving_features"] = q(*serving_sql("reference"), body=f"SELECT * {std_replace()} FROM sv")
Q["serving_features_aligned"] = q(*serving_sql("aligned"), body=f"SELECT * {std_replace()} FROM sv")


def requested_sql(mode: str) -> str:
    lacking = [c for c in PASS if c != "price"]
    req = ("req", """
SELECT event_id AS request_id, printf('P%06d', user_id * 15) AS product_id,
       CASE event_type WHEN 'purchase' THEN DATE '1995-01-02' + CAST(user_id * 17 % 2500 AS INT)
                       WHEN 'view' THEN DATE '1995-01-02' + CAST(user_id * 17 % 2500 AS INT) + 400
                       WHEN 'click' THEN DATE '2001-12-01' WHEN 'error' THEN DATE '1994-01-01' ELSE DATE '1998-06-15' END AS date,
       CAST(floor(value) AS DOUBLE) AS units_sold, CASE WHEN event_id % 2 = 0 THEN value END AS price
FROM events""")
    pt = ("pt", "SELECT DISTINCT product_id, date FROM req")
    over = "(PARTITION BY pt.product_id, pt.date ORDER BY s.date DESC, s.src_order DESC, s.src_line DESC)"
    h = ("h", f"""
SELECT pt.product_id, pt.date, s.units_sold, {', '.join(f's.{c}' for c in lacking)}, row_number() OVER {over} AS rd,
       count(*) OVER (PARTITION BY pt.product_id, pt.date) AS n_rows
FROM pt JOIN sales s ON s.product_id = pt.product_id AND s.date {'<' if mode == 'aligned' else '<='} pt.date""")
    aggs = ["max(n_rows) AS n", *[f"max(CASE WHEN rd = 1 THEN {c} END) AS x_{c}" for c in lacking]]
    top = "{w}" if mode == "aligned" else "least({w}, n_rows - 1)"
    lag = "{k}" if mode == "aligned" else "least({k}, n_rows)"
    aggs += [f"max(CASE WHEN rd = {lag.format(k=k)} THEN units_sold END) AS l{k}" for k in LAGS]
    aggs += [f"avg(CASE WHEN rd <= {top.format(w=w)} THEN units_sold END) AS m{w}" for w in MEANS]
    aggs += [f"stddev_samp(CASE WHEN rd <= {top.format(w=w)} THEN units_sold END) AS s{w}" for w in STDS]
    g = ("g", f"SELECT product_id, date, {', '.join(aggs)} FROM h GROUP BY product_id, date")
    zero = "CAST(0 AS DOUBLE)"
    if mode == "aligned":
        cols = [f"l{k} AS lag_{k}" for k in LAGS] + [f"m{w} AS rolling_mean_{w}" for w in MEANS] + [f"s{w} AS rolling_std_{w}" for w in STDS]
        cols += [("price" if c == "price" else f"x_{c} AS {c}") for c in PASS] + ["units_sold", f"CAST(NULL AS DOUBLE) AS demand"]
    else:
        cols = [f"CASE WHEN n IS NULL THEN units_sold ELSE l{k} END AS lag_{k}" for k in LAGS]
        cols += [f"CASE WHEN n IS NULL OR n = 1 THEN units_sold ELSE m{w} END AS rolling_mean_{w}" for w in MEANS]
        cols += [f"coalesce(s{w}, {zero}) AS rolling_std_{w}" for w in STDS]
        cols += [f"coalesce({'price' if c == 'price' else 'x_' + c}, {zero}) AS {c}" for c in PASS]
    rv = ("rv", f"SELECT request_id, req.product_id, req.date, {', '.join(cols)}, {CAL.replace('date', 'req.date')} "
                "FROM req LEFT JOIN g ON g.product_id = req.product_id AND g.date = req.date")
    return q(sales_cte(), req, pt, h, g, rv, body=f"SELECT * {std_replace()} FROM rv")


Q["requested_features"] = requested_sql("reference")
Q["requested_features_aligned"] = requested_sql("aligned")
_vec_cols = ", ".join((f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE)) AS {c}" if c not in ("units_sold", "demand")
                       else f"CAST(0 AS DOUBLE) AS {c}") for c in MANIFEST)
Q["serving_vector"] = q(*serving_sql("reference"), ("vec", f"SELECT product_id, {_vec_cols} FROM sv"),
                        body=f"SELECT product_id, [{', '.join(pyr(c, 6) for c in MANIFEST)}] AS feature_vector FROM vec")
Q["latest_row"] = q(sales_cte(), numbered2_cte(), body="SELECT * EXCLUDE (rd, ra, n_rows) FROM numbered WHERE rd = 1")
Q["recent_sales"] = q(sales_cte(), numbered2_cte(), body="""
SELECT product_id, list(units_sold ORDER BY rd DESC) AS daily_sales_history
FROM numbered WHERE rd <= 14 GROUP BY product_id""")
_given = ", ".join(f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE)) AS {c}" for c in PASS if c != "price")
Q["partial_row_features"] = q(sales_cte(), numbered2_cte(), body=f"""
SELECT product_id, (SELECT max(price) + 1 FROM sales s WHERE s.product_id = numbered.product_id) AS price, {_given}
FROM numbered WHERE rd = 1""")
Q["append_latest"] = q(sales_cte(), numbered2_cte(), body=f"""
SELECT {KEYS}, units_sold, false AS appended FROM sales
UNION ALL SELECT {KEYS}, units_sold, true AS appended FROM numbered WHERE rd = 1""")
Q["forecast_clamp"] = q(*FEAT, tf_cte(), ("fc", f"""
SELECT {KEYS}, CAST(2.0 AS DOUBLE) * coalesce(lag_1, CAST(0 AS DOUBLE)) - coalesce(rolling_mean_7, CAST(0 AS DOUBLE))
       AS raw_prediction FROM tf"""), body=f"""
SELECT {KEYS}, raw_prediction, greatest(CAST(0 AS DOUBLE), raw_prediction) AS forecast FROM fc""")

SPLIT = (*FEAT, tf_cte(), ("sp", f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY date, product_id, src_order, src_line)
                    <= floor((SELECT count(*) FROM tf) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE)))
               THEN 'train' ELSE 'val' END AS split
FROM tf"""))
Q["time_split"] = q(*SPLIT, body=f"SELECT {KEYS}, split FROM sp")
Q["cv_folds"] = q(*SPLIT, ("tr", """
SELECT *, row_number() OVER (ORDER BY date, product_id, src_order, src_line) AS r,
       count(*) OVER () AS n FROM sp WHERE split = 'train'"""), ("fs", """
SELECT *, n // 3 + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END AS s0,
          n // 3 + CASE WHEN n % 3 > 1 THEN 1 ELSE 0 END AS s1 FROM tr"""), body=f"""
SELECT {KEYS}, CASE WHEN r <= s0 THEN 0 WHEN r <= s0 + s1 THEN 1 ELSE 2 END AS fold FROM fs""")

UNTIED = ("u", """
SELECT CASE WHEN l_orderkey % 97 <> 0 THEN CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) END AS date,
       CASE WHEN l_orderkey % 89 <> 0 THEN printf('P%06d', l_partkey % 10) END AS product_id,
       printf('S%04d', l_suppkey % 3) AS store_id,
       CASE WHEN l_linenumber > 1 THEN CAST(floor(l_quantity / 10) AS DOUBLE) END AS units_sold
FROM lineitem""")
U_ORD = "date NULLS FIRST, product_id NULLS FIRST, store_id NULLS FIRST, units_sold NULLS FIRST"
U_RANK = ("ur", f"SELECT *, row_number() OVER (ORDER BY {U_ORD}) AS r, count(*) OVER () AS n FROM u")
Q["time_split_untied"] = q(UNTIED, U_RANK, body="""
SELECT date, product_id, store_id, units_sold,
       CASE WHEN r <= floor(n * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'val' END AS split FROM ur""")
Q["cv_folds_untied"] = q(UNTIED, U_RANK, body="""
SELECT date, product_id, store_id, units_sold,
       CASE WHEN r <= n // 3 + CAST(n % 3 > 0 AS INT) THEN 0 WHEN r <= 2 * (n // 3) + CAST(least(n % 3, 2) AS INT) THEN 1 ELSE 2 END AS fold
FROM ur""")
_uw = "OVER (PARTITION BY product_id ORDER BY date NULLS FIRST, store_id NULLS FIRST, units_sold NULLS FIRST)"
_um = "(PARTITION BY product_id ORDER BY date NULLS FIRST, store_id NULLS FIRST, units_sold NULLS FIRST ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
Q["untied_features"] = q(UNTIED, body=f"""
SELECT date, product_id, store_id, units_sold, row_number() {_uw} AS pos, count(*) OVER (PARTITION BY product_id) AS n_rows,
       lag(units_sold, 1) {_uw} AS lag_1, lag(units_sold, 30) {_uw} AS lag_30, avg(units_sold) OVER {_um} AS rolling_mean_7,
       lead(units_sold, 1) {_uw} AS demand_t1, lead(units_sold, 7) {_uw} AS demand_t7
FROM u WHERE product_id IS NOT NULL""")

_preds = " UNION ALL ".join(
    f"SELECT {i} AS horizon, split, CAST(demand_t{i} AS DOUBLE) AS y, "
    f"CAST(coalesce(rolling_mean_7, CAST(0 AS DOUBLE)) AS DOUBLE) AS prediction FROM sp" for i in range(1, 8))
PREDS = (*SPLIT, ("preds", _preds))


def metrics_ctes(zero_pairs="skip"):
    den = "((abs(y) + abs(prediction)) / 2.0)"
    term = (f"CASE WHEN {den} = 0 THEN NULL ELSE abs(prediction - y) / {den} END" if zero_pairs == "skip"
            else f"CASE WHEN {den} = 0 THEN CAST('NaN' AS DOUBLE) ELSE abs(prediction - y) / {den} END")
    aggs = []
    for s in ("train", "val"):
        aggs += [f"sqrt(avg(CASE WHEN split = '{s}' THEN pow(y - prediction, 2) END)) AS {s}_rmse",
                 f"avg(CASE WHEN split = '{s}' THEN abs(y - prediction) END) AS {s}_mae",
                 f"avg(CASE WHEN split = '{s}' THEN {term} END) * 100 AS {s}_smape"]
    return (*PREDS, ("m", f"SELECT 'demand_t+' || CAST(horizon AS VARCHAR) AS target, horizon, {', '.join(aggs)} "
                          "FROM preds GROUP BY horizon"))


MCOLS = [f"{s}_{m}" for s in ("train", "val") for m in ("rmse", "mae", "smape")]
Q["metrics_by_horizon"] = q(*metrics_ctes(), body=f"SELECT target, horizon, {', '.join(pyr(c, 6) + ' AS ' + c for c in MCOLS)} FROM m")
Q["eval_smape"] = q(*metrics_ctes("nan"), body=f"SELECT target, {pyr('train_smape', 6)} AS train_smape, {pyr('val_smape', 6)} AS val_smape FROM m")
Q["fit_diagnosis"] = q(*metrics_ctes(), ("d", """
SELECT target, horizon, train_rmse - val_rmse AS rmse_gap, train_mae - val_mae AS mae_gap,
       CASE WHEN val_rmse > train_rmse * 1.2 THEN 'val_worse' WHEN val_rmse < train_rmse THEN 'val_better' ELSE 'ok' END AS fit,
       CASE WHEN val_rmse > train_rmse * 1.2 THEN 'Possible underfitting detected'
            WHEN val_rmse < train_rmse THEN 'Validation RMSE is lower than training RMSE (unusual, may indicate data leakage)'
            ELSE 'Model performance looks reasonable' END AS note,
       CASE WHEN val_rmse > train_rmse * 1.2 THEN (val_rmse / train_rmse - 1) * 100 END AS val_excess_pct
FROM m"""), body=f"""
SELECT target, horizon, {pyr('rmse_gap', 6)} AS rmse_gap, {pyr('mae_gap', 6)} AS mae_gap, fit, note,
       {pyr('val_excess_pct', 6)} AS val_excess_pct FROM d""")
Q["prediction_range"] = q(*PREDS, body="""
SELECT horizon, least(min(y), min(prediction)) AS min_val, greatest(max(y), max(prediction)) AS max_val
FROM preds WHERE split = 'val' GROUP BY horizon""")
_points = " UNION ALL ".join(
    f"SELECT {i} AS horizon, sample_key, CAST(demand_t{i} AS DOUBLE) AS y, "
    f"CAST(coalesce(rolling_mean_7, CAST(0 AS DOUBLE)) AS DOUBLE) AS prediction FROM picked" for i in range(1, 8))
Q["prediction_sample"] = q(*SPLIT, ("picked", f"""
SELECT *, md5(concat_ws('|', {', '.join(f'CAST({k.strip()} AS VARCHAR)' for k in KEYS.split(','))})) AS sample_key
FROM sp WHERE split = 'val' ORDER BY sample_key LIMIT 5000"""), body=_points)
Q["last_validation_row"] = q(*SPLIT, body=f"""
SELECT {KEYS}, units_sold, inventory_level, {', '.join(TGT)} FROM sp WHERE split = 'val'
ORDER BY date DESC, product_id DESC, src_order DESC, src_line DESC LIMIT 1""")

_z = "CAST(0 AS DOUBLE)"
Q["forecast_array"] = q(*FEAT, body=f"""
SELECT {KEYS}, [{', '.join(f'coalesce({t}, {_z})' for t in TGT)}] AS days_from_map,
       [{', '.join(f'coalesce({t}, {_z})' for t in TGT)}] AS days_from_list,
       [{', '.join([f'coalesce(rolling_mean_7, {_z})'] * 7)}] AS days_from_scalar
FROM feat""")

ALIGNED = (sales_cte(), numbered2_cte(), aligned_serving_cte())
_tot = "(((((((CAST(0 AS DOUBLE) + r) + r) + r) + r) + r) + r) + r)"
Q["forecast_summary"] = q(*ALIGNED, ("cf", f"SELECT product_id, coalesce(rolling_mean_7, {_z}) AS r FROM aligned"),
                          ("t", f"SELECT product_id, {_tot} AS total_7day FROM cf"), body="""
SELECT product_id, total_7day, total_7day / CAST(7 AS DOUBLE) AS average_daily,
       total_7day / CAST(7 AS DOUBLE) AS average_per_key FROM t""")

Q["status_labels"] = constant_plan_sql("""
SELECT product_id,
       CASE WHEN reorder_status THEN 'Yes' ELSE 'No' END AS reorder_needed_label,
       CASE WHEN reorder_status THEN 'YES - Reorder Needed' ELSE 'NO - Sufficient Stock' END AS reorder_status_label,
       CASE WHEN days > 0 THEN CAST(days AS VARCHAR) ELSE 'Beyond forecast horizon' END AS stockout_label,
       upper(decision_risk) AS risk_label
FROM plan""")

_keys_l = ["product_id", "date", "src_order", "src_line"]
BT = (*FEAT, tf_cte(), ("bsrc", f"SELECT {KEYS}, {', '.join(f'{t} AS f{i}' for i, t in enumerate(TGT, 1))}, "
                                "inventory_level AS inv, 3 AS lead FROM tf"),
      *plan_ctes("bsrc", _keys_l, "list"))
Q["backtest_decisions"] = q(*BT, body=f"""
SELECT {KEYS}, lead_time_demand, safety_stock, reorder_point, reorder_status, reorder_quantity,
       days AS days_to_stockout, decision_risk, risk_level, overstock_flag, inventory_coverage_days, current_inventory
FROM alerts""")
for _name, _col in [("lead_time_demand", "lead_time_demand"), ("safety_stock", "safety_stock"),
                    ("reorder_point", "reorder_point"), ("reorder_flag", "reorder_status"),
                    ("reorder_quantity", "reorder_quantity"), ("days_to_stockout", "days AS days_to_stockout"),
                    ("decision_risk", "decision_risk"), ("recommendation_text", "recommendation"),
                    ("alert_risk", "risk_level"), ("alert_message", "alert_message"),
                    ("overstock", "overstock_flag"), ("coverage_days", "inventory_coverage_days")]:
    Q[_name] = q(*BT, body=f"SELECT {KEYS}, {_col} FROM alerts")

Q["forecast_7day_estimate"] = q(*BT, ("e0", f"""
SELECT {KEYS}, current_inventory, CASE WHEN days > 0 AND days <= 7 THEN (current_inventory / CAST(days AS DOUBLE)) * CAST(7 AS DOUBLE)
            WHEN lead_time_demand > 0 THEN (lead_time_demand / CAST(3 AS DOUBLE)) * CAST(7 AS DOUBLE)
            ELSE {_z} END AS f7e FROM plan"""), ("e1", f"""
SELECT *, CASE WHEN f7e > 0 AND f7e / CAST(7 AS DOUBLE) > 0 THEN current_inventory / (f7e / CAST(7 AS DOUBLE))
               ELSE CAST(-1 AS DOUBLE) END AS cov FROM e0"""), body=f"""
SELECT {KEYS}, {pyr('f7e')} AS forecast_7day_total,
       CASE WHEN f7e <= 0 THEN false ELSE current_inventory > CAST(2.0 AS DOUBLE) * f7e END AS overstock_flag,
       CASE WHEN cov > 0 THEN {pyr('cov')} ELSE CAST(-1 AS DOUBLE) END AS inventory_coverage_days FROM e1""")

# -- context ----------------------------------------------------------------
CTX = (sales_cte(), ("messages", MESSAGES_SQL), numbered2_cte(), aligned_serving_cte(), *info_ctes(),
       ("csrc", f"SELECT product_id, {', '.join(f'coalesce(rolling_mean_7, {_z}) AS f{i}' for i in range(1, 8))}, "
                "inventory_level AS inv, 3 AS lead FROM aligned"),
       *plan_ctes("csrc", ["product_id"], "list"),
       ("lr", "SELECT product_id, inventory_level AS l_inv, price AS l_price FROM numbered WHERE rd = 1"),
       ("recent", "SELECT product_id, list(units_sold ORDER BY rd DESC) AS daily_sales_history "
                  "FROM numbered WHERE rd <= 14 GROUP BY product_id"),
       ("ctx0", """
SELECT a.product_id AS sku, coalesce(i.product_name, a.product_id) AS product_name,
       coalesce(i.category, 'Unknown') AS category, coalesce(i.region, 'Unknown') AS region,
       l.l_inv AS current_inventory, l.l_price AS price_raw,
       a.f1, a.f2, a.f3, a.f4, a.f5, a.f6, a.f7,
       a.days AS days_to_stockout, a.risk_level, a.reorder_status AS reorder_needed,
       a.reorder_quantity AS recommended_reorder_quantity, coalesce(r.daily_sales_history, []) AS daily_sales_history,
       a.lead AS lead_time_days, a.safety_stock, a.reorder_point, a.lead_time_demand, a.inventory_coverage_days,
       coalesce(i.average_price_raw, l.l_price) AS avg_raw,
       a.overstock_flag, a.alert_message, a.current_inventory AS inv_rounded
FROM alerts a LEFT JOIN info i ON a.product_id = i.sku LEFT JOIN lr l ON a.product_id = l.product_id
LEFT JOIN recent r ON a.product_id = r.product_id"""),
       ("ctx", f"SELECT *, {pyr('price_raw', 6)} AS current_price, {pyr('avg_raw', 6)} AS average_price FROM ctx0"))

Q["sku_snapshot"] = q(sales_cte(), numbered2_cte(), *info_ctes(), body="""
SELECT l.product_id, l.date, l.units_sold, l.inventory_level, l.price, i.category, i.region, i.product_name,
       i.store_id, i.average_price
FROM numbered l JOIN info6 i ON l.product_id = i.sku WHERE l.rd = 1""")
Q["sku_context"] = q(*CTX, body=f"""
SELECT sku, product_name, category, region, current_inventory, current_price,
       {', '.join(f'f{i} AS forecast_t{i}' for i in range(1, 8))},
       days_to_stockout, risk_level, reorder_needed, recommended_reorder_quantity, daily_sales_history,
       lead_time_days, safety_stock, reorder_point, lead_time_demand, inventory_coverage_days, average_price
FROM ctx""")
_fmap = "MAP {" + ", ".join(f"'t+{i}': f{i}" for i in range(1, 8)) + "}"
Q["context_json"] = q(*CTX, body=f"""
SELECT sku, to_json({{'sku': sku, 'product_name': product_name, 'category': category, 'region': region,
  'current_inventory': current_inventory, 'current_price': current_price, 'forecast': {_fmap},
  'days_to_stockout': days_to_stockout, 'risk_level': risk_level, 'reorder_needed': reorder_needed,
  'recommended_reorder_quantity': recommended_reorder_quantity, 'daily_sales_history': daily_sales_history,
  'metadata': {{'lead_time_days': lead_time_days, 'safety_stock': safety_stock, 'reorder_point': reorder_point,
               'lead_time_demand': lead_time_demand, 'inventory_coverage_days': inventory_coverage_days,
               'average_price': average_price}}}}) AS context_json
FROM ctx""")
Q["sales_trend"] = q(*CTX, body="""
SELECT sku, CAST(len(daily_sales_history) AS INTEGER) AS history_days,
       daily_sales_history[greatest(len(daily_sales_history) - 6, 1):greatest(len(daily_sales_history) - 6, 1) + 6] AS last_7_days,
       CASE WHEN len(daily_sales_history) = 0 THEN NULL
            ELSE list_reduce(list_prepend(CAST(0 AS DOUBLE), daily_sales_history), lambda a, x: a + x) / CAST(len(daily_sales_history) AS DOUBLE) END AS average,
       CASE WHEN len(daily_sales_history) = 0 THEN NULL
            WHEN daily_sales_history[-1] > daily_sales_history[1] THEN 'Increasing'
            WHEN daily_sales_history[-1] < daily_sales_history[1] THEN 'Decreasing' ELSE 'Stable' END AS trend
FROM ctx""")

_tot7 = "(((((((CAST(0 AS DOUBLE) + f1) + f2) + f3) + f4) + f5) + f6) + f7)"
EX = (*CTX, ("ex0", f"SELECT *, {_tot7} AS tot FROM ctx"),
      ("ex1", f"SELECT *, tot / 7.0 AS avg7, {pyr('tot')} AS total_7day, {pyr('tot / 7.0')} AS average_daily FROM ex0"))
_dbd = " || ', ' || ".join(f"'t+{i}=' || {pyf(f'f{i}', 1)}" for i in range(1, 8))
Q["explain_forecast"] = q(*EX, body=f"""
SELECT sku, '7-day demand forecast generated. Total expected demand: ' || {pyf('tot', 1)} || ' units (' ||
       {pyf('avg7', 1)} || ' units/day average). Day-by-day: ' || {_dbd} || '.' AS forecast_explanation,
       total_7day, average_daily FROM ex1""")
Q["explain_inventory"] = q(*EX, body=f"""
SELECT sku, CASE WHEN current_inventory IS NULL THEN '{'Cannot generate inventory recommendation without forecast and inventory data.'}' ELSE
  'Inventory status: ' || {pyf('inv_rounded', 0)} || ' units on hand. Reorder point: ' || {pyf('reorder_point', 0)} || ' units. ' ||
  CASE WHEN reorder_needed THEN 'REORDER NEEDED. Recommended quantity: ' || {pyf('recommended_reorder_quantity', 0)} || ' units. '
       ELSE 'No reorder needed at this time. ' END ||
  CASE WHEN days_to_stockout > 0 THEN 'Estimated stockout in ' || CAST(days_to_stockout AS VARCHAR) || ' days.'
       ELSE 'Stockout beyond forecast horizon.' END END AS inventory_explanation FROM ex1""")
Q["explain_risk"] = q(*EX, body="""
SELECT sku, 'Risk Level: ' || risk_level || '. ' || alert_message || ' ' ||
       CASE WHEN overstock_flag THEN 'OVERSTOCK DETECTED: Inventory exceeds 2x forecasted demand.' ELSE '' END AS risk_explanation
FROM ex1""")
Q["explain_summary"] = q(*EX, body=f"""
SELECT sku, 'OPERATIONAL SUMMARY' || chr(10) || 'Forecast: ' || {pyf('total_7day', 0)} || ' units expected over next 7 days (' ||
       {pyf('average_daily', 1)} || ' units/day).' || chr(10) || 'Inventory: ' || {pyf('inv_rounded', 0)} ||
       ' units on hand. Reorder point: ' || {pyf('reorder_point', 0)} || ' units. ' ||
       CASE WHEN reorder_needed THEN 'REORDER NEEDED: ' || {pyf('recommended_reorder_quantity', 0)} || ' units.' || chr(10)
            ELSE 'No reorder needed.' || chr(10) END ||
       'Risk: ' || risk_level || '. Stockout in ' || CAST(days_to_stockout AS VARCHAR) || ' days. ' ||
       CASE WHEN overstock_flag THEN 'OVERSTOCK detected.' ELSE '' END AS summary_explanation
FROM ex1""")

_NL = "chr(10)"


def _pylist(a: str) -> str:
    return ("'[' || array_to_string(list_transform(" + a + ", lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 'nan' "
            "WHEN abs(x) < 1e16 AND x = floor(x) THEN printf('%.1f', x) ELSE CAST(x AS VARCHAR) END), ', ') || ']'")


_fc_lines = f" || {_NL} || ".join(f"'  t+{i}: ' || {pyf(f'f{i}', 2)} || ' units'" for i in range(1, 8))
Q["prompt_context"] = q(*EX, body=f"""
SELECT sku, concat_ws({_NL},
  'Product Name: ' || product_name, 'SKU: ' || sku, 'Category: ' || category, 'Region: ' || region,
  CASE WHEN price_raw <> 0 THEN 'Current Price: $' || {pyf('price_raw', 2)} END,
  {_NL} || 'INVENTORY STATUS:',
  'Current Inventory: ' || coalesce({pyf('current_inventory', 2)} || ' units', 'unknown'),
  'Days to Stockout: ' || CAST(days_to_stockout AS VARCHAR),
  'Risk Level: ' || risk_level,
  'Reorder Needed: ' || CASE WHEN reorder_needed THEN 'Yes' WHEN NOT reorder_needed THEN 'No' END,
  CASE WHEN reorder_needed THEN 'Recommended Reorder Quantity: ' || {pyf('recommended_reorder_quantity', 2)} || ' units' END,
  {_NL} || '7-DAY DEMAND FORECAST:' || {_NL} || {_fc_lines} || {_NL} || '  Total (7-day): ' || {pyf('tot', 2)} || ' units'
      || {_NL} || '  Average daily: ' || {pyf('avg7', 2)} || ' units/day',
  CASE WHEN len(daily_sales_history) > 0 THEN {_NL} || 'RECENT SALES HISTORY (last ' || CAST(len(daily_sales_history) AS VARCHAR)
      || ' days):' || {_NL} || '  ' || {_pylist('daily_sales_history')} END,
  {_NL} || 'ADDITIONAL METRICS:' || {_NL} || concat_ws({_NL}, '  Lead Time: ' || CAST(lead_time_days AS VARCHAR) || ' days',
      '  Safety Stock: ' || {pyf('safety_stock', 2)} || ' units', '  Reorder Point: ' || {pyf('reorder_point', 2)} || ' units',
      '  Lead Time Demand: ' || {pyf('lead_time_demand', 2)} || ' units',
      '  Inventory Coverage: ' || {pyf('inventory_coverage_days', 1)} || ' days')) AS prompt
FROM ex1""")

def _any(words):
    return " OR ".join(f"contains(lower(query), '{w}')" for w in words)


_INTENT = f"""CASE
  WHEN {_any(['forecast', 'demand', 'prediction', 'predict', 'future', 'next week'])} THEN 'forecast'
  WHEN {_any(['risk', 'alert', 'danger', 'critical', 'urgent', 'warning'])} THEN 'risk'
  WHEN {_any(['reorder', 'order', 'purchase', 'buy', 'restock', 'stock'])} THEN 'reorder'
  ELSE 'summary' END"""
Q["detect_intent"] = q(*base(), body=f"SELECT message_id, query, {_INTENT} AS intent FROM messages")


def _body_expr(name: str) -> str:
    """Extract the explanation expression of an explain_* query body."""
    body = Q[name].rsplit("\nSELECT sku, ", 1)[1]
    expr = body.rsplit(f" AS {name.replace('explain_', '')}_explanation", 1)[0]
    return expr


_EXQ = ("exq", f"""
SELECT sku, {_body_expr('explain_forecast')} AS forecast_explanation,
       {_body_expr('explain_inventory')} AS inventory_explanation,
       {_body_expr('explain_risk')} AS risk_explanation,
       {_body_expr('explain_summary')} AS summary_explanation,
       tot, reorder_point, risk_level
FROM ex1""")
Q["respond"] = q(*EX, _EXQ, ("mi", f"SELECT message_id, product_id, {_INTENT} AS intent FROM messages"), body="""
SELECT m.message_id, m.product_id, m.intent,
  CASE m.intent WHEN 'forecast' THEN coalesce(e.forecast_explanation, 'Cannot generate forecast without latest data.')
                WHEN 'reorder' THEN coalesce(e.inventory_explanation, 'Cannot generate inventory recommendation without forecast and inventory data.')
                WHEN 'risk' THEN coalesce(e.risk_explanation, 'Cannot generate inventory recommendation without forecast and inventory data.')
                ELSE coalesce(e.summary_explanation, 'Unable to generate summary without forecast.') END AS response_text,
  CASE WHEN e.sku IS NOT NULL AND m.intent IN ('forecast', 'summary') THEN e.tot END AS forecast_total,
  CASE WHEN e.sku IS NOT NULL AND m.intent IN ('reorder', 'risk', 'summary') THEN e.reorder_point END AS inventory_reorder_point,
  CASE WHEN e.sku IS NOT NULL AND m.intent IN ('risk', 'summary') THEN e.risk_level END AS alerts_risk_level
FROM mi m LEFT JOIN exq e ON m.product_id = e.sku""")

# -- the model path with least squares in the regressor slot -------------------------------------------
_lx = "coalesce(rolling_mean_7, CAST(0 AS DOUBLE))"
_fits = ", ".join(f"regr_slope(demand_t{i}, {_lx}) AS a{i}, regr_intercept(demand_t{i}, {_lx}) AS b{i}" for i in range(1, 8))
LINEAR = (*SPLIT, ("fit", f"SELECT {_fits} FROM sp WHERE split = 'train'"))
_lpreds = " UNION ALL ".join(f"SELECT {i} AS horizon, split, CAST(demand_t{i} AS DOUBLE) AS y, a{i} * {_lx} + b{i} AS prediction FROM sp, fit"
                             for i in range(1, 8))
_lm = metrics_ctes()
Q["linear_metrics"] = q(*LINEAR, ("preds", _lpreds), _lm[-1],
                        body=f"SELECT target, horizon, {', '.join(pyr(c, 6) + ' AS ' + c for c in MCOLS)} FROM m")
_serve = serving_sql("reference")
_lf = ", ".join(f"greatest(CAST(0 AS DOUBLE), a{i} * {_lx} + b{i}) AS p{i}" for i in range(1, 8))
_lt = ", ".join(f"{pyr(f'p{i}', 6)} AS t{i}" for i in range(1, 7))
Q["linear_forecast"] = q(*LINEAR, *[c for c in _serve if c[0] not in {n for n, _ in LINEAR}], ("lf", f"SELECT product_id, {_lf} FROM sv, fit"),
                         body=f"SELECT product_id, {_lt}, CAST(0 AS DOUBLE) AS t7 FROM lf")
Q["linear_sample_forecast"] = q(*LINEAR, ("lv", """
SELECT * FROM sp WHERE split = 'val' ORDER BY date DESC, product_id DESC, src_order DESC, src_line DESC LIMIT 1"""),
                                ("lf", f"SELECT product_id, {_lf} FROM lv, fit"), body=f"SELECT product_id, {_lt}, {pyr('p7', 6)} AS t7 FROM lf")
_foldfit = " UNION ALL ".join(f"""
SELECT {i} AS horizon, {k} AS fold, (SELECT sqrt(avg(pow(demand_t{i} - (a * x + b), 2))) FROM lfold WHERE fold = {k}) AS rmse
FROM (SELECT regr_slope(demand_t{i}, x) AS a, regr_intercept(demand_t{i}, x) AS b FROM lfold WHERE fold <> {k})""" for i in range(1, 8) for k in range(3))
Q["linear_folds"] = q(*SPLIT, ("tr", """
SELECT *, row_number() OVER (ORDER BY date, product_id, src_order, src_line) AS r, count(*) OVER () AS n FROM sp WHERE split = 'train'"""),
                      ("lfold", f"""
SELECT *, {_lx} AS x, CASE WHEN r <= n // 3 + CAST(n % 3 > 0 AS INT) THEN 0 WHEN r <= 2 * (n // 3) + CAST(least(n % 3, 2) AS INT) THEN 1 ELSE 2 END AS fold
FROM tr"""), ("ff", _foldfit), ("fr", "SELECT horizon, avg(rmse) AS rmse FROM ff GROUP BY horizon"),
                      body=f"SELECT horizon, {pyr('rmse', 6)} AS rmse FROM fr")

# -- missing stock, prices and units: a forecast, but neither plan nor alert without stock --------------------
GAPS = ("sales", f"""
SELECT * REPLACE (CASE WHEN src_order % 5 <> 0 THEN inventory_level END AS inventory_level,
                  CASE WHEN src_order % 7 <> 0 THEN price END AS price, CASE WHEN src_order % 3 <> 0 THEN units_sold END AS units_sold)
FROM ({SALES_SQL})""")
_ctes = dict(CTX)
_null = ("reorder_status days risk_level alert_message overstock_flag inventory_coverage_days reorder_quantity recommendation decision_risk "
         "forecast_7day_total").split()
_blank = ", ".join(f"CASE WHEN inv IS NOT NULL THEN {c} END AS {c}" for c in _null)
_ctes["alerts"] = f"SELECT * REPLACE ({_blank}) FROM ({_ctes['alerts']})"
GAPS_CTX = (GAPS, *[(n, s) for n, s in _ctes.items() if n != "sales"])
GAPS_EX = (*GAPS_CTX, *EX[len(CTX):])
_NOINV = "Cannot generate inventory recommendation without forecast and inventory data."
GAPS_TEXTS = ("gt", f"""
SELECT sku, {_body_expr('explain_forecast')} AS forecast_explanation, total_7day, average_daily,
       CASE WHEN current_inventory IS NULL THEN '{_NOINV}' ELSE {_body_expr('explain_inventory')} END AS inventory_explanation,
       CASE WHEN current_inventory IS NULL THEN '{_NOINV}' ELSE {_body_expr('explain_risk')} END AS risk_explanation,
       CASE WHEN current_inventory IS NULL THEN '{_NOINV}' ELSE {_body_expr('explain_summary')} END AS summary_explanation,
       CASE WHEN current_inventory IS NULL THEN 'Missing forecast or current_inventory in data_inputs' END AS error,
       reorder_point, risk_level FROM ex1""")
Q["gaps_plan"] = q(*GAPS_CTX, body="""
SELECT product_id, current_inventory, lead_time_demand, safety_stock, reorder_point, reorder_status, reorder_quantity, days AS days_to_stockout,
       decision_risk, recommendation, risk_level, alert_message, overstock_flag, inventory_coverage_days, forecast_7day_total FROM alerts""")
Q["gaps_context"] = q(*GAPS_CTX, body=Q["sku_context"].rsplit("\n)\n", 1)[1])
Q["gaps_explanations"] = q(*GAPS_EX, GAPS_TEXTS, body="SELECT * EXCLUDE (reorder_point, risk_level) FROM gt")
Q["gaps_prompt"] = q(*GAPS_EX, body="\nSELECT sku, concat_ws(" + Q["prompt_context"].rsplit("\nSELECT sku, concat_ws(", 1)[1])
Q["gaps_respond"] = q(*GAPS_EX, GAPS_TEXTS, ("mi", f"SELECT message_id, product_id, {_INTENT} AS intent FROM messages"), body=f"""
SELECT m.message_id, m.product_id, m.intent,
  CASE m.intent WHEN 'forecast' THEN coalesce(e.forecast_explanation, 'Cannot generate forecast without latest data.')
                WHEN 'reorder' THEN coalesce(e.inventory_explanation, '{_NOINV}') WHEN 'risk' THEN coalesce(e.risk_explanation, '{_NOINV}')
                ELSE coalesce(e.summary_explanation, 'Unable to generate summary without forecast.') END AS response_text,
  CASE WHEN e.sku IS NULL THEN 'Missing data for the product' WHEN m.intent <> 'forecast' THEN e.error END AS error,
  e.sku IS NOT NULL AND m.intent IN ('forecast', 'summary') AS has_forecast,
  CASE WHEN e.error IS NULL AND m.intent IN ('reorder', 'risk', 'summary') THEN e.reorder_point END AS inventory_reorder_point,
  CASE WHEN e.error IS NULL AND m.intent IN ('risk', 'summary') THEN e.risk_level END AS alerts_risk_level
FROM mi m LEFT JOIN gt e ON m.product_id = e.sku""")

Q["eval_metrics"] = q(*metrics_ctes(), body=f"""
SELECT target, {', '.join(pyr(c, 6) + ' AS ' + c for c in ('train_rmse', 'train_mae', 'val_rmse', 'val_mae'))} FROM m""")
_fm = "MAP {" + ", ".join(f"'t+{i}': demand_t{i}" for i in range(1, 8)) + "}"
Q["forecast_map"] = q(*FEAT, tf_cte(), body=f"SELECT {KEYS}, {_fm} AS forecast FROM tf")
