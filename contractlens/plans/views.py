"""Views over the given tables that queries and their SQL twins share: one text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "edges": """SELECT concat('customer:', o_custkey) AS source, concat('order:', o_orderkey) AS target, 'calls' AS kind FROM {orders}
UNION SELECT concat('order:', l_orderkey), concat('supplier:', l_suppkey), 'calls' FROM {lineitem}
UNION SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'calls' FROM {supplier}
UNION SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey), 'calls' FROM {customer}
UNION SELECT concat('region:', n_regionkey), concat('nation:', n_nationkey), 'contains' FROM {nation}""",
    "nodes": """SELECT concat('customer:', c_custkey) AS id, 'customer' AS kind, c_name AS name FROM {customer}
UNION ALL SELECT concat('order:', o_orderkey), 'order', o_orderpriority FROM {orders}
UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', s_name FROM {supplier}
UNION ALL SELECT concat('nation:', n_nationkey), 'nation', n_name FROM {nation}
UNION ALL SELECT concat('region:', r_regionkey), 'region', r_name FROM {region}""",
    "snap_old": "SELECT p_partkey AS k, concat(p_type, '/', p_brand) AS file, p_name AS symbol FROM {part}",
    "snap_new": """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN concat(p_type, '/moved') ELSE concat(p_type, '/', p_brand) END AS file,
CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, ' v2') ELSE p_name END AS symbol FROM {part} WHERE p_partkey % 11 <> 0""",
    "pkg": """SELECT p_brand AS name, concat(p_size, '.', p_partkey % 13, '.', p_partkey % 7) AS version,
CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'file' ELSE 'registry' END AS source, concat('machine', p_partkey % 20) AS provider, p_partkey AS ordinal FROM {part}""",
    "diag": """SELECT concat('p', l_partkey % 50) AS file, l_orderkey AS line, l_linenumber AS col, 1 + (l_linenumber % 2) AS severity, l_returnflag AS rule, l_suppkey, l_extendedprice FROM {lineitem}""",
    "cov": "SELECT p_brand AS file, CAST(MIN(p_size) AS DOUBLE) AS lines, CAST(100 AS DOUBLE) AS functions FROM {part} GROUP BY p_brand",
    "coded": "SELECT p_partkey AS id, concat('status: 1-', p_type, ' 2-', p_name) AS comment FROM {part}",
    "hook": """SELECT event_id, CAST(user_id AS VARCHAR(20)) AS session_id, CAST(CAST(FLOOR(event_id / 700) AS BIGINT) AS VARCHAR(20)) AS turn_id,
CAST(CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS INT) % 4 AS VARCHAR(20)) AS tool_use_id,
CASE event_type WHEN 'view' THEN 'PreToolUse' WHEN 'click' THEN 'PostToolUse' WHEN 'purchase' THEN 'Stop' END AS stage,
concat('f', CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS INT)) AS path, CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR(20)) AS content FROM {events}""",
    "sessions": """SELECT event_id, CAST(user_id AS VARCHAR(20)) AS session_id, CAST(CAST(FLOOR(event_id / 5000) AS BIGINT) AS VARCHAR(20)) AS turn_id, ts AS seen,
CASE WHEN k % 11 < 10 THEN CAST(k % 3 AS VARCHAR(20)) END AS tool_use_id, CASE event_type WHEN 'view' THEN 'PreToolUse' WHEN 'click' THEN 'PostToolUse' WHEN 'purchase' THEN 'Stop' END AS stage,
CASE WHEN k % 13 < 12 THEN concat('f', k % 5) END AS path, CAST(CAST(FLOOR(value) AS BIGINT) % 2 AS VARCHAR(20)) AS content,
CASE event_id % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'warning' WHEN 2 THEN 'none' ELSE 'failed' END AS status, event_id % 8 = 3 AS continued
FROM (SELECT *, CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e""",
    "slots": "SELECT concat('o', o_orderkey) AS slot, concat('c', o_custkey, o_orderstatus) AS method FROM {orders}",
    "args": """SELECT concat('c', o_custkey, was) AS caller, concat('c', o_custkey, o_orderstatus) AS method, concat('o', o_orderkey) AS slot, concat('o', prior) AS from_slot, CAST(NULL AS VARCHAR(20)) AS domain
FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM {orders}) WHERE prior IS NOT NULL
UNION ALL SELECT concat('c', o_custkey, max_by(o_orderstatus, o_orderkey)), concat('c', o_custkey, min_by(o_orderstatus, o_orderkey)), concat('o', min(o_orderkey)), concat('o', max(o_orderkey)), NULL FROM {orders} WHERE o_custkey % 3 = 0 GROUP BY o_custkey
UNION ALL SELECT 'entry', concat('c', o_custkey, o_orderstatus), concat('o', o_orderkey), NULL, CASE WHEN o_orderkey % 32 = 0 THEN NULL ELSE o_orderpriority END FROM {orders} WHERE o_orderkey % 4 = 0""",
    "within": """SELECT 'all' AS root, method AS node FROM (SELECT DISTINCT concat('c', o_custkey, o_orderstatus) AS method FROM {orders}) UNION ALL SELECT 'all', 'entry'
UNION ALL SELECT 'cut', method FROM (SELECT DISTINCT concat('c', o_custkey, o_orderstatus) AS method FROM {orders} WHERE o_orderstatus <> 'P' OR o_custkey % 2 = 0) UNION ALL SELECT 'cut', 'entry'""",
    "writers": """SELECT concat('order:', o_orderkey) AS node, concat('Order', o_orderkey) AS name, concat('o', o_orderkey % 97, '.java') AS file FROM {orders}
UNION ALL SELECT concat('customer:', c_custkey), c_name, 'customer.java' FROM {customer}""",
    "setter_calls": """SELECT DISTINCT concat('order:', l_orderkey) AS caller, concat('set', l_linenumber) AS setter, CAST(l_quantity AS INT) AS line, CAST(l_partkey % 40 AS INT) AS col FROM {lineitem}""",
    "setter_sites": """SELECT DISTINCT concat('order:', l_orderkey) AS caller, concat('set', l_linenumber) AS setter, CAST(CASE WHEN l_suppkey % 25 = 0 THEN l_quantity + 100 ELSE l_quantity END AS INT) AS line,
CAST(l_partkey % 37 AS INT) AS col, l_returnflag AS source, concat('slot', CASE WHEN l_suppkey % 20 = 3 THEN 4 ELSE o_custkey % 6 END) AS slot FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_partkey % 17 <> 0""",
    "setter_refs": "SELECT DISTINCT concat('order:', l_orderkey) AS caller, concat('set', l_linenumber) AS setter, CAST(l_quantity AS INT) AS line, CAST(l_partkey % 40 AS INT) AS col FROM {lineitem} WHERE l_returnflag = 'R' AND l_partkey % 29 = 0",
    "sites": """SELECT concat(p_brand, p_size % 7) AS target, CAST(p_partkey AS INT) AS p, CASE WHEN p_size % 7 IN (0, 1, 2) THEN concat('E', CASE WHEN p_size % 7 = 2 THEN p_partkey % 3 ELSE 0 END) END AS e, NOT (p_size % 7 = 1 AND p_partkey % 5 = 0) AS whole,
CASE WHEN p_size % 7 IN (3, 4) THEN 'rpc' END AS e2, CASE WHEN p_size % 7 IN (4, 5) THEN concat('u', p_partkey % 9) END AS unk, p_size % 7 = 6 AND p_partkey % 2 = 0 AS changed, p_type AS v FROM {part}""",
    "fields": """SELECT concat('nation:', c_nationkey) AS schema, 'customers' AS field, concat('customer:', c_custkey) AS ref, true AS is_list, 'field' AS kind FROM {customer}
UNION ALL SELECT concat('customer:', c_custkey), 'home', concat('nation:', c_nationkey), false, 'field' FROM {customer}
UNION ALL SELECT concat('customer:', o_custkey), 'orders', concat('order:', o_orderkey), false, 'map' FROM {orders}
UNION ALL SELECT DISTINCT concat('order:', l_orderkey), 'from', concat('supplier:', l_suppkey), false, 'page' FROM {lineitem} WHERE l_linenumber = 1""",
    "classes": "SELECT concat('o', o_orderkey) AS class, CASE WHEN n % 3 <> 1 THEN concat('o', prior) END AS parent FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior FROM {orders}) q",
    "members": "SELECT concat('o', l_orderkey) AS class, concat('f', l_linenumber) AS field, CAST(l_linenumber AS INT) AS pos, min(l_returnflag) AS type FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "tree": """SELECT concat('c', o_custkey) AS schema, concat('f', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 5) AS field, concat('o', o_orderkey) AS ref FROM {orders}
UNION ALL SELECT DISTINCT concat('o', l_orderkey), concat('f', l_linenumber), concat('s', l_suppkey) FROM {lineitem}""",
    "written": "SELECT concat('customer:', c_custkey) AS operation, concat('f', n_regionkey) AS field, CASE WHEN n_regionkey > 0 THEN concat('set', n_regionkey) END AS setter FROM {customer} JOIN (SELECT DISTINCT n_regionkey FROM {nation}) r ON n_regionkey < 4",
    "bound": """SELECT concat('customer:', c_custkey) AS operation, slot, domain FROM {customer} JOIN (SELECT 'slot0' AS slot, 'd0' AS domain UNION ALL SELECT 'slot1', 'd1' UNION ALL SELECT 'slot2', 'd2' UNION ALL SELECT 'slot3', 'unknown' UNION ALL SELECT 'slot4', 'd0' UNION ALL SELECT 'slot4', 'd1') b ON true""",
    "url": "SELECT page_id, url, REGEXP_REPLACE(REGEXP_REPLACE(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path, REGEXP_EXTRACT(url, '://([^/]*)', 1) AS host FROM {pages}",
}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("VARCHAR(20)", "STRING")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def as_sql(*names: str) -> str:
    """WITH clause of the views for an SQL engine that has the tables as views."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names) + " "
