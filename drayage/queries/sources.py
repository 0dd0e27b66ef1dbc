"""Queries over the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.months import Month
from drayage.operators.verify import manifest
from drayage.queries import query
from drayage.queries.inputs import TABLES, positioned, table
from drayage.session import scratch_dir
from drayage.sources.discovery import missing_tables, narrow_catalog, select_tables
from drayage.sources.messages import (
    configured, discovered_streams, envelope_read, latest_state, records,
)
from drayage.sources.monthly import month_scan, window_start
from drayage.sources.splits import (
    balanced_predicates, key_bounds, partition_plan, split_read, split_sizes,
)
from drayage.sources.tables import parquet_tables
from drayage.operators.conform import conform
from drayage.schemas import tpch_schema, wide_keys
from drayage.sources import tpch
from drayage.sources.tpch import (
    SUPPLIERS_PER_PART, customer_rows, line_rows, order_rows, partsupp_keys,
)


@query("full_read", "SELECT * FROM orders")
def full_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


_SPLITS = 16


@query("partitioned_read", "SELECT * FROM lineitem")
def read_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split of the plan is read by its own predicate; hot orders are cut by line number."""
    lines = table(spark, sf_dir, "lineitem")
    counts = manifest(spark, {"lineitem": lines})
    splits = partition_plan(counts, 1, rows_per_split=10_000, max_workers=_SPLITS).first()["by_rows"]
    predicates = balanced_predicates(lines, "l_orderkey", splits, "l_linenumber")
    return split_read(lambda predicate: lines.filter(predicate), predicates)


@query("split_sizes", f"""
WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem),
w AS (SELECT lo, CAST(ceil((hi - lo + 1) / {_SPLITS}.0) AS BIGINT) AS width FROM b)
SELECT CAST(least({_SPLITS} - 1, (l_orderkey - lo) // width) AS INTEGER) AS split,
  count(*) AS rows, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key
FROM lineitem, w GROUP BY 1""")
def sizes_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lo, hi = key_bounds(lines, "l_orderkey")
    return split_sizes(lines, "l_orderkey", lo, hi, _SPLITS)


_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES)


@query("partition_plan", f"""
SELECT "table", rows, CAST(2 AS INTEGER) AS by_budget,
  CAST(greatest(1, ceil(rows / 2000.0)) AS BIGINT) AS splits,
  CAST(least(greatest(1, ceil(rows / 2000.0)), 32) AS INTEGER) AS by_rows
FROM ({_COUNTS_SQL})""")
def plan_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = manifest(spark, parquet_tables(spark, sf_dir, TABLES))
    return partition_plan(counts, len(TABLES), rows_per_split=2_000)


@query("month_scan", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1999-10-01' AND l_shipdate < TIMESTAMP '2001-10-01'""")
def last_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as monthly files, then only the months of the window."""
    root = scratch_dir(spark, "months")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    # Rebalancing gathers a month's rows into few files and splits a month that is too big.
    table(spark, sf_dir, "lineitem").select(
        month, "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"
    ).hint("rebalance", "month").write.partitionBy("month").parquet(root)
    last = Month(2001, 9)
    return month_scan(spark, root + "/month={month}", "lineitem", window_start(24, last), last)


@query("row_index", "SELECT row_number() OVER () - 1 AS row_index, o_orderkey, o_custkey FROM orders")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir, "orders").select("row_index", "o_orderkey", "o_custkey")


_RECORD = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
_STATE = T.StructType([T.StructField("cursor", T.LongType())])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as message lines of four types, some of them cut short."""
    kind = ("case event_type when 'view' then 'RECORD' when 'click' then 'RECORD' "
            "when 'purchase' then 'STATE' when 'signup' then 'LOG' else 'TRACE' end")
    line = f"""case {kind}
        when 'RECORD' then to_json(named_struct('type', 'RECORD', 'record', named_struct('stream',
            event_type, 'data', named_struct('event_id', event_id, 'user_id', user_id, 'value', value))))
        when 'STATE' then to_json(named_struct('type', 'STATE', 'state', named_struct('cursor', event_id * 2)))
        else to_json(named_struct('type', {kind}, 'log', named_struct('message', props))) end"""
    return table(spark, sf_dir, "events").selectExpr("event_id AS line_no", f"{line} AS line") \
        .selectExpr("line_no", "if(line_no % 50 = 7, left(line, 30), line) AS value")


@query("envelope_read", """
SELECT event_type AS stream, event_id, user_id, value FROM events
WHERE event_type IN ('view', 'click') AND event_id % 50 <> 7""")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(envelope_read(_messages(spark, sf_dir), _RECORD, _STATE))


@query("envelope_state", """
SELECT max(event_id) * 2 AS cursor FROM events
WHERE event_type = 'purchase' AND event_id % 50 <> 7""")
def last_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(envelope_read(_messages(spark, sf_dir), _RECORD, _STATE), "line_no")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every customer is an offered stream, every order asks for one; some are never offered."""
    offered = table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment AS namespace", "concat('customer_', cast(c_custkey as string)) AS stream_name")
    wanted = table(spark, sf_dir, "orders").selectExpr(
        "concat('customer_', cast(o_custkey + 100 as string)) AS stream_name")
    return offered, wanted


_OFFERED = "SELECT c_mktsegment AS namespace, 'customer_' || c_custkey AS stream_name FROM customer"
_WANTED = "SELECT DISTINCT 'customer_' || (o_custkey + 100) AS stream_name FROM orders"


@query("discover_catalog", """
SELECT 'user_' || user_id AS stream_name, arg_max(event_type, event_id) AS namespace,
  'full_refresh' AS sync_mode, 'overwrite' AS destination_sync_mode, CAST(1 AS INTEGER) AS generation_id,
  CAST(1 AS INTEGER) AS minimum_generation_id, CAST(1 AS INTEGER) AS sync_id
FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event that is no error offers its user's stream, under a namespace that changes."""
    lines = table(spark, sf_dir, "events").selectExpr("event_id AS line_no", """
        to_json(named_struct('type', if(event_type = 'error', 'TRACE', 'CATALOG'), 'catalog',
            named_struct('streams', array(named_struct('name', concat('user_', user_id),
                'namespace', event_type))))) AS value""")
    return configured(discovered_streams(lines, "line_no"))


@query("select_tables", f"""
SELECT namespace, stream_name FROM ({_OFFERED})
WHERE stream_name IN (SELECT stream_name FROM ({_WANTED}))""")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_tables(*_catalog(spark, sf_dir))


@query("missing_tables", f"""
SELECT stream_name FROM ({_WANTED})
WHERE stream_name NOT IN (SELECT stream_name FROM ({_OFFERED}))""")
def not_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_tables(*_catalog(spark, sf_dir))


@query("narrow_catalog", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE '' END AS selected,
  CASE WHEN event_type = 'view' THEN 'view,click' ELSE 'view' END AS streams,
  CASE event_type WHEN 'click' THEN 'purchase' WHEN 'view' THEN 'purchase' ELSE 'click,purchase' END AS missing
FROM events""")
def narrowed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event offers its own type, a marker and one or two schemas; three tables are wanted."""
    docs = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """map('public', array(named_struct('stream_name', if(event_type = 'purchase', 'signup', event_type)),
                               named_struct('stream_name', '_seed'))) AS selected_streams""",
        """array(named_struct('stream', named_struct('name', 'view')),
                 named_struct('stream', named_struct('name', if(event_type = 'view', 'click', 'other'))))
           AS streams""",
    )
    narrow = narrow_catalog(docs, ["view", "click", "purchase"])
    names = F.transform(F.flatten(F.map_values("selected_streams")), lambda s: s["stream_name"])
    return narrow.select(
        "event_id", F.concat_ws(",", names).alias("selected"),
        F.concat_ws(",", F.transform("streams", lambda s: s["stream"]["name"])).alias("streams"),
        F.concat_ws(",", "missing").alias("missing"))


@query("seed_partsupp", f"""
WITH s AS (SELECT count(*) AS n, min(s_suppkey) AS s0 FROM supplier),
p AS (SELECT p_partkey, p_partkey - (SELECT min(p_partkey) FROM part) AS p FROM part)
SELECT p_partkey AS ps_partkey,
  CAST((p + i * (n // {SUPPLIERS_PER_PART} + p // n)) % n + s0 AS BIGINT) AS ps_suppkey
FROM p, s, range({SUPPLIERS_PER_PART}) r(i)""")
def missing_partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table the test data lacks, from the parts and suppliers it has."""
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    first_part, _ = key_bounds(parts, "p_partkey")
    bounds = suppliers.agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("s0")).first()
    return partsupp_keys(parts, "p_partkey", first_part, bounds["n"], bounds["s0"])


def _sql_draw(field: str, multipliers: tuple[int, int, int] = tpch.MULTIPLIERS, key: str = "o_orderkey") -> str:
    first, second, third = multipliers
    return (f"((({tpch.field_number(field)} + {key}) % {tpch.PRIME} * {first} % {tpch.PRIME}"
            f" * {second} % {tpch.OTHER_PRIME}) * {third} % {tpch.PRIME})")


def _sql_pick(field: str, words: list[str], divisor: int = 1, key: str = "o_orderkey") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"[{listed}][{_sql_draw(field, key=key)} // {divisor} % {len(words)} + 1]"


_CLERKS = 1_000
_LOW, _HIGH = tpch.ORDER_CENTS


@query("seed_tpch", f"""
SELECT o_orderkey,
  ({_sql_draw("o_custkey.high")} * {tpch.PRIME} + {_sql_draw("o_custkey.low", tpch.LOW_MULTIPLIERS)}) % n + c0 AS o_custkey,
  {_sql_pick("o_codes", tpch.ORDER_STATES)} AS o_orderstatus,
  CAST(CAST({_LOW} + {_sql_draw("o_totalprice")} % {_HIGH - _LOW + 1} AS DECIMAL(15,2)) / 100 AS DECIMAL(15,2)) AS o_totalprice,
  CAST(DATE '{tpch.FIRST_ORDER_DATE}' + CAST({_sql_draw("o_orderdate")} % {tpch.ORDER_DAYS} AS INTEGER) AS DATE) AS o_orderdate,
  {_sql_pick("o_codes", tpch.PRIORITIES, len(tpch.ORDER_STATES))} AS o_orderpriority,
  'Clerk#' || lpad(CAST({_sql_draw("o_clerk")} % {_CLERKS} + 1 AS VARCHAR), 9, '0') AS o_clerk,
  CAST(0 AS INTEGER) AS o_shippriority,
  concat_ws(' ', {", ".join(_sql_pick("comment", tpch.WORDS, 10 ** i) for i in range(4))}) AS o_comment
FROM orders, (SELECT count(*) AS n, min(c_custkey) AS c0 FROM customer)""")
def generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared orders table, generated for the order keys and the customers there are."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    customers = table(spark, sf_dir, "customer").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("c0")).first()
    rows = order_rows(keys, customers["c0"], customers["n"], _CLERKS)
    return conform(rows, wide_keys(tpch_schema("orders")))


def _sql_money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(15,2)) / 100 AS DECIMAL(15,2))"


def _sql_comment(key: str) -> str:
    return f"concat_ws(' ', {', '.join(_sql_pick('comment', tpch.WORDS, 10 ** i, key) for i in range(4))})"


def _sql_within(field: str, lo: int, hi: int, key: str) -> str:
    return f"({lo} + {_sql_draw(field, key=key)} % {hi - lo + 1})"


_NATION = f"({_sql_draw('cnation', key='c_custkey')} % {len(tpch.NATIONS)})"


@query("seed_customer", f"""
SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS c_name,
  substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 20) AS c_address, CAST({_NATION} AS BIGINT) AS c_nationkey,
  concat_ws('-', {_NATION} + 10, {_sql_within("ca", 100, 999, "c_custkey")}, {_sql_within("cb", 100, 999, "c_custkey")},
    {_sql_within("cc", 1000, 9999, "c_custkey")}) AS c_phone,
  {_sql_money(_sql_within("cbal", -99_999, 999_999, "c_custkey"))} AS c_acctbal,
  {_sql_pick("cm", tpch.SEGMENTS, key="c_custkey")} AS c_mktsegment, {_sql_comment("c_custkey")} AS c_comment
FROM customer""")
def generated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared customer table, generated for the customer keys there are."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return conform(customer_rows(keys), wide_keys(tpch_schema("customer")))


def _sql_retail(key: str) -> str:
    return f"(90000 + {key} // 10 % 20001 + 100 * ({key} % 1000))"


_MAKER = f"CAST({_sql_within('pm', 1, 5, 'p_partkey')} AS VARCHAR)"
_SUPPLIER_NATION = f"({_sql_draw('snation', key='s_suppkey')} % {len(tpch.NATIONS)})"


@query("seed_supplier", f"""
SELECT s_suppkey, 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS s_name,
  substr(sha1(CAST(s_suppkey AS VARCHAR)), 1, 20) AS s_address, CAST({_SUPPLIER_NATION} AS BIGINT) AS s_nationkey,
  concat_ws('-', {_SUPPLIER_NATION} + 10, {_sql_within("sa", 100, 999, "s_suppkey")},
    {_sql_within("sb", 100, 999, "s_suppkey")}, {_sql_within("sc", 1000, 9999, "s_suppkey")}) AS s_phone,
  {_sql_money(_sql_within("sbal", -99_999, 999_999, "s_suppkey"))} AS s_acctbal, {_sql_comment("s_suppkey")} AS s_comment
FROM supplier""")
def generated_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared supplier table, generated for the supplier keys there are."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    return conform(tpch.supplier_rows(keys), wide_keys(tpch_schema("supplier")))


@query("seed_part", f"""
SELECT p_partkey,
  concat_ws(' ', {_sql_pick("pn1", tpch.WORDS, key="p_partkey")}, {_sql_pick("pn2", tpch.WORDS, key="p_partkey")}) AS p_name,
  'Manufacturer#' || {_MAKER} AS p_mfgr,
  'Brand#' || {_MAKER} || CAST({_sql_within("pb", 1, 5, "p_partkey")} AS VARCHAR) AS p_brand,
  {_sql_pick("pt", tpch.TYPES, key="p_partkey")} AS p_type,
  CAST({_sql_within("ps", 1, 50, "p_partkey")} AS INTEGER) AS p_size,
  {_sql_pick("pc", tpch.CONTAINERS, key="p_partkey")} AS p_container,
  {_sql_money(_sql_retail("p_partkey"))} AS p_retailprice,
  {_sql_comment("p_partkey")} AS p_comment
FROM part""")
def generated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared part table, generated for the part keys there are."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return conform(tpch.part_rows(keys), wide_keys(tpch_schema("part")))


def _sql_code(draw: str, divisor: int, size: int) -> str:
    return f"({draw} // {divisor} % {size})"


def _sql_word(code: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"[{listed}][{code} + 1]"


@query("seed_lineitem", f"""
WITH o AS (SELECT o_orderkey, CAST(DATE '{tpch.FIRST_ORDER_DATE}'
    + CAST({_sql_draw("o_orderdate")} % {tpch.ORDER_DAYS} AS INTEGER) AS DATE) AS ordered,
    1 + {_sql_draw("lines")} % {tpch.LINES_PER_ORDER[1]} AS n FROM orders),
l AS (SELECT o_orderkey AS l_orderkey, ordered, CAST(i AS INTEGER) AS l_linenumber,
    o_orderkey * {tpch.LINES_PER_ORDER[1] + 1} + i AS line
  FROM o, range(1, {tpch.LINES_PER_ORDER[1] + 1}) r(i) WHERE i <= n),
c AS (SELECT *, {_sql_draw("l_codes", key="line")} AS codes, {_sql_draw("l_dates", key="line")} AS dates,
    ({_sql_draw("l_partkey.high", key="line")} * {tpch.PRIME}
      + {_sql_draw("l_partkey.low", tpch.LOW_MULTIPLIERS, "line")}) % parts + 1 AS l_partkey
  FROM l, (SELECT count(*) AS parts FROM part), (SELECT count(*) AS suppliers FROM supplier))
SELECT l_orderkey, l_partkey, CAST((l_partkey - 1 + {_sql_draw("l_suppkey", key="line")} % {SUPPLIERS_PER_PART}
    * (suppliers // {SUPPLIERS_PER_PART} + (l_partkey - 1) // suppliers)) % suppliers + 1 AS BIGINT) AS l_suppkey, l_linenumber,
  CAST({_sql_code("codes", 1, 50)} + 1 AS DECIMAL(15,2)) AS l_quantity,
  {_sql_money(f"({_sql_code('codes', 1, 50)} + 1) * {_sql_retail('l_partkey')}")} AS l_extendedprice,
  {_sql_money(_sql_code("codes", 50, 11))} AS l_discount, {_sql_money(_sql_code("codes", 550, 9))} AS l_tax,
  {_sql_word(_sql_code("codes", 4_950, 3), ["A", "N", "R"])} AS l_returnflag,
  {_sql_word(_sql_code("codes", 14_850, 2), ["F", "O"])} AS l_linestatus,
  CAST(ordered + CAST({_sql_code("dates", 1, 121)} + 1 AS INTEGER) AS DATE) AS l_shipdate,
  CAST(ordered + CAST({_sql_code("dates", 121, 61)} + 30 AS INTEGER) AS DATE) AS l_commitdate,
  CAST(ordered + CAST({_sql_code("dates", 1, 121)} + {_sql_code("dates", 7_381, 30)} + 2 AS INTEGER) AS DATE) AS l_receiptdate,
  {_sql_word(_sql_code("codes", 29_700, 4), tpch.INSTRUCTIONS)} AS l_shipinstruct,
  {_sql_word(_sql_code("codes", 118_800, 7), tpch.SHIP_MODES)} AS l_shipmode,
  {_sql_comment("line")} AS l_comment
FROM c""")
def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared lineitem table, generated for the order keys, parts and suppliers there are."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey")
    counts = {r["table"]: r["rows"] for r in manifest(
        spark, {n: table(spark, sf_dir, n) for n in ("part", "supplier")}).collect()}
    return conform(line_rows(keys, counts["part"], counts["supplier"]), wide_keys(tpch_schema("lineitem")))
