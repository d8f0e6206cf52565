"""Change logs derived from the star-schema tables, in the same expressions for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREFIX = "00000000-0000-4000-8000-"
NOW_MS = 1_000_000

#: Log 1, one source: aggregate = user, sequence = event id; an error after another error is a tombstone (null op).
LOG1 = """SELECT event_id, user_id, event_type, value, props, CASE WHEN event_type = 'error' AND prev IS NOT NULL AND prev <> 'error' THEN 'd'
 WHEN event_type = 'error' THEN NULL WHEN prev IS NULL OR prev = 'error' THEN 'c' ELSE 'u' END AS op
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) e"""

#: Work items of log 1 with fixed states: every third is done, every fifth waits for a retry.
ITEMS = f"""SELECT concat('i', CAST(event_id AS VARCHAR(20))) AS item, concat('e', CAST(event_id AS VARCHAR(20))) AS event, concat('u', CAST(user_id AS VARCHAR(20))) AS aggregate,
 CAST(floor(event_id / 1000) AS BIGINT) AS commit_vlf, CAST(floor(event_id / 10) AS BIGINT) % 100 AS commit_off, event_id % 10 AS commit_slot,
 CAST(floor(event_id / 1000) AS BIGINT) AS change_vlf, CAST(floor(event_id / 10) AS BIGINT) % 100 AS change_off, event_id % 10 AS change_slot,
 event_id * 10 AS event_ms, CASE WHEN event_id % 3 = 0 THEN event_id * 20 END AS processed_at, CAST(event_id % 4 AS INT) AS retry_counter,
 CASE WHEN event_id % 5 = 0 THEN {NOW_MS} + (event_id % 7 - 3) * 1000 END AS next_retry FROM log1 WHERE op IS NOT NULL"""

#: Outbox items of log 1.
OUTBOX = f"""SELECT concat('o', CAST(event_id AS VARCHAR(20))) AS item, concat('u', CAST(user_id AS VARCHAR(20))) AS aggregate, event_type AS payload, CAST(floor(event_id / 4) AS BIGINT) AS outbox_ms,
 CASE WHEN event_id % 4 = 0 THEN event_id END AS processed_at, CAST(event_id % 3 AS INT) AS retry_counter, CASE WHEN event_id % 9 = 0 THEN {NOW_MS} + (event_id % 5 - 2) * 1000 END AS next_retry FROM log1 WHERE op IS NOT NULL"""

#: Registry of lock ids and the locks that sessions hold.
REGISTRY = "SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(20))) AS aggregate, CAST(user_id AS BIGINT) AS lock_id FROM events"
LOCKS = "SELECT DISTINCT CAST(user_id AS BIGINT) AS objid, CAST(user_id % 3 AS INT) AS pid FROM events WHERE user_id % 11 = 0"

#: Log 2, two sources: parent = order, child = its first line; the others update the child, all in one order of
#: (order, phase, row). Every fifth order gets its child before its parent; of some the parent is updated; every seventh
#: loses its child and then goes.
LOG2_LINES = """SELECT l_orderkey AS k, l_partkey AS part, CAST(l_quantity AS INT) AS quantity, l_returnflag AS flag,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem"""
LOG2 = """SELECT o_orderkey AS k, 'parent' AS source, 'c' AS op, 1 AS phase, CAST(1 AS BIGINT) AS n, CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS model, CAST(NULL AS BIGINT) AS part, CAST(NULL AS INT) AS quantity, CAST(NULL AS VARCHAR(10)) AS flag FROM orders
 UNION ALL SELECT k, 'child', CASE WHEN n = 1 THEN 'c' ELSE 'u' END, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END, n, NULL, NULL, part, quantity, flag FROM log2_lines
 UNION ALL SELECT o_orderkey, 'parent', 'u', 3, 1, CAST(year(o_orderdate) AS INT) + 1, concat(o_orderpriority, '+'), NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT DISTINCT o_orderkey, 'child', 'x', 4, CAST(1 AS BIGINT), CAST(NULL AS INT), CAST(NULL AS VARCHAR(10)), CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS VARCHAR(10)) FROM orders JOIN (SELECT DISTINCT k FROM log2_lines) l ON l.k = o_orderkey WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_orderkey, 'parent', 'd', 5, 1, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0"""

VIEWS = {"log1": LOG1, "items": ITEMS, "outbox": OUTBOX, "registry": REGISTRY, "locks": LOCKS, "log2_lines": LOG2_LINES, "log2": LOG2}
NEEDS = {"log1": [], "items": ["log1"], "outbox": ["log1"], "registry": [], "locks": [], "log2_lines": [], "log2": ["log2_lines"]}


def with_clause(*names: str) -> str:
    """The derived tables as common table expressions, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables in a folder; only the columns it needs are read."""
    sql = f"{with_clause(name)} SELECT * FROM {name}".replace("VARCHAR(20)", "STRING").replace("VARCHAR(10)", "STRING")
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "lineitem") if f"FROM {t}" in sql}
    for t in views:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **views)
