"""Deterministic TPC-H-shaped tables at a scale factor.

Every value is a function of the row number, so any executor can recompute any partition and two
runs agree. The text is synthetic: cardinalities, keys and types follow the standard tables, the
words do not.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions.casts import money
from drayage.operators.conform import conform
from drayage.schemas import TPCH_DDL, tpch_schema, wide_keys

# Rows at scale factor 1 and words of the standard tables.
ROWS_AT_SF1 = {
    "supplier": 10_000, "customer": 150_000, "part": 200_000, "orders": 1_500_000,
}
SUPPLIERS_PER_PART = 4
CLERKS_AT_SF1 = 1_000
FIRST_ORDER_DATE = "1992-01-01"
ORDER_DAYS = 2_406
ORDER_CENTS = (85_000, 55_528_500)
ORDER_STATES = ["F", "O", "P"]
LINES_PER_ORDER = (1, 7)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4),
    ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2),
    ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0),
    ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4),
    ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHIP_MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
INSTRUCTIONS = ["COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN"]
CONTAINERS = ["JUMBO BOX", "LG CASE", "MED BAG", "SM PKG", "WRAP JAR"]
TYPES = ["ECONOMY ANODIZED STEEL", "LARGE BRUSHED BRASS", "PROMO PLATED TIN",
         "SMALL POLISHED COPPER", "STANDARD BURNISHED NICKEL"]
WORDS = ["carefully", "quick", "deposits", "ironic", "packages", "sleep", "furiously", "even",
         "requests", "bold"]


# Two primes below 2^31 and known good multipliers for them: a product of two remainders fits a
# BIGINT, and each step uses its input once, so expressions stay small.
PRIME, OTHER_PRIME = 2_147_483_647, 2_147_483_629
MULTIPLIERS = (742_938_285, 950_706_376, 1_226_874_159)
LOW_MULTIPLIERS = (62_089_911, 1_343_714_438, 397_204_094)


def field_number(field: str) -> int:
    return zlib.crc32(field.encode()) % PRIME


def _draw(field: str, *keys: str, multipliers: tuple[int, int, int] = MULTIPLIERS) -> Column:
    """A number below 2^31 fixed by the field name and the row's non-negative keys."""
    first, second, third = (F.lit(m).cast("bigint") for m in multipliers)
    x = F.lit(field_number(field)).cast("bigint")
    for key in keys:
        x = (x + F.col(key).cast("bigint")) % F.lit(PRIME) * first % F.lit(PRIME)
        x = x * second % F.lit(OTHER_PRIME)
    return x * third % F.lit(PRIME)


def _wide_draw(field: str, *keys: str) -> Column:
    """A number below 2^62, for references to keys beyond 2^31."""
    low = _draw(field + ".low", *keys, multipliers=LOW_MULTIPLIERS)
    return _draw(field + ".high", *keys) * F.lit(PRIME) + low


def _parts(df: DataFrame, draw: Column, sizes: dict[str, int]) -> DataFrame:
    """Several small independent numbers out of one draw, as columns."""
    whole, out, width = df.withColumn("_draw", draw), {}, 1
    for name, size in sizes.items():
        rest = F.col("_draw") if width == 1 else F.floor(F.col("_draw") / F.lit(width))
        out[name] = rest % F.lit(size)
        width *= size
    return whole.withColumns(out).drop("_draw")


def _between(draw: Column, lo: int, hi: int) -> Column:
    return F.lit(lo) + draw % F.lit(hi - lo + 1)


def _pick(draw: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]),
                        (draw % F.lit(len(words)) + 1).cast("int"))


def _commented(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Add a comment of four words."""
    places = [f"_word{i}" for i in range(4)]
    numbered = _parts(df, _draw("comment", *keys), {c: len(WORDS) for c in places})
    words = [_pick(F.col(c), WORDS) for c in places]
    return numbered.withColumn(name, F.concat_ws(" ", *words)).drop(*places)


def _hundredths(cents: Column) -> Column:
    """Money from cents. By way of a double, which is exact here and generates little code."""
    return money(cents / F.lit(100.0))


def _cents(draw: Column, lo: int, hi: int) -> Column:
    return _hundredths(_between(draw, lo, hi))


def _numbered(label: str, key: str) -> Column:
    return F.concat(F.lit(label + "#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def rows_at(table: str, sf: float) -> int:
    if not (sf > 0 and math.isfinite(sf)):
        raise ValueError(f"scale factor must be finite and positive, got {sf}")
    return max(1, round(ROWS_AT_SF1[table] * sf))


def partsupp_keys(parts: DataFrame, part_key: str, first_part: int, suppliers: int,
                  first_supplier: int) -> DataFrame:
    """The four suppliers of every part, spread evenly over all suppliers.

    The standard's formula, over zero-based numbers so that it fits any key origin.
    """
    part = F.col(part_key).cast("bigint") - F.lit(first_part)
    step = F.lit(suppliers // SUPPLIERS_PER_PART) + F.floor(part / F.lit(suppliers))
    numbered = parts.select(
        F.col(part_key).cast("bigint").alias("ps_partkey"), part.alias("p"), step.alias("step"),
        F.explode(F.array(*[F.lit(i) for i in range(SUPPLIERS_PER_PART)])).alias("i"),
    )
    supplier = F.pmod(F.col("p") + F.col("i") * F.col("step"), F.lit(suppliers))
    return numbered.select("ps_partkey", (supplier + F.lit(first_supplier)).alias("ps_suppkey"))


def _order_date(key: str) -> Column:
    return F.date_add(F.lit(FIRST_ORDER_DATE).cast("date"),
                      _between(_draw("o_orderdate", key), 0, ORDER_DAYS - 1).cast("int"))


def order_rows(keys: DataFrame, first_customer: int, customers: int, clerks: int) -> DataFrame:
    """All columns of the orders table for given order keys."""
    key = "o_orderkey"
    clerk = _between(_draw("o_clerk", key), 1, clerks).cast("string")
    rows = (
        _parts(keys, _draw("o_codes", key), {"_s": len(ORDER_STATES), "_p": len(PRIORITIES)})
        .withColumn("o_custkey", _between(
            _wide_draw("o_custkey", key), first_customer, first_customer + customers - 1))
        .withColumn("o_orderstatus", _pick(F.col("_s"), ORDER_STATES))
        .withColumn("o_totalprice", _cents(_draw("o_totalprice", key), *ORDER_CENTS))
        .withColumn("o_orderdate", _order_date(key))
        .withColumn("o_orderpriority", _pick(F.col("_p"), PRIORITIES))
        .withColumn("o_clerk", F.concat(F.lit("Clerk#"), F.lpad(clerk, 9, "0")))
        .withColumn("o_shippriority", F.lit(0))
    )
    return _commented(rows, "o_comment", key)


def _retail_cents(part_key: str) -> Column:
    """A part's price, the standard's function of its key."""
    key = F.col(part_key)
    return F.lit(90_000) + F.pmod(F.floor(key / 10), F.lit(20_001)) + F.lit(100) * F.pmod(key, F.lit(1_000))


def line_rows(orders: DataFrame, parts: int, suppliers: int) -> DataFrame:
    """All columns of the lineitem table for given order keys (``l_orderkey``).

    The extended price is the quantity times the retail price of the line's part, which is a function of the
    part's key: no join finds it.
    """
    line = "_line"
    lines = _between(_draw("lines", "l_orderkey"), *LINES_PER_ORDER).cast("int")
    numbered = orders.select(
        "l_orderkey", _order_date("l_orderkey").alias("_ordered"),
        F.explode(F.sequence(F.lit(LINES_PER_ORDER[0]), lines)).alias("l_linenumber"),
    ).withColumn(line, F.col("l_orderkey") * (LINES_PER_ORDER[1] + 1) + F.col("l_linenumber"))
    coded = _parts(numbered, _draw("l_codes", line), {
        "_q": 50, "_d": 11, "_t": 9, "_r": 3, "_l": 2,
        "_i": len(INSTRUCTIONS), "_m": len(SHIP_MODES)})
    dated = _parts(coded, _draw("l_dates", line), {"_ship": 121, "_commit": 61, "_receipt": 30})
    keyed = dated.withColumn("l_partkey", _between(_wide_draw("l_partkey", line), 1, parts))
    step = F.lit(suppliers // SUPPLIERS_PER_PART) \
        + F.floor((F.col("l_partkey") - 1) / F.lit(suppliers))
    nth = _between(_draw("l_suppkey", line), 0, SUPPLIERS_PER_PART - 1)
    rows = (
        keyed.withColumn("l_suppkey", (F.col("l_partkey") - 1 + nth * step) % F.lit(suppliers) + 1)
        .withColumn("l_quantity", money(F.col("_q") + 1))
        .withColumn("l_extendedprice", _hundredths((F.col("_q") + 1) * _retail_cents("l_partkey")))
        .withColumn("l_discount", _hundredths(F.col("_d")))
        .withColumn("l_tax", _hundredths(F.col("_t")))
        .withColumn("l_returnflag", _pick(F.col("_r"), ["A", "N", "R"]))
        .withColumn("l_linestatus", _pick(F.col("_l"), ["F", "O"]))
        .withColumn("l_shipdate", F.date_add("_ordered", (F.col("_ship") + 1).cast("int")))
        .withColumn("l_commitdate", F.date_add("_ordered", (F.col("_commit") + 30).cast("int")))
        .withColumn("l_receiptdate", F.date_add(
            "_ordered", (F.col("_ship") + F.col("_receipt") + 2).cast("int")))
        .withColumn("l_shipinstruct", _pick(F.col("_i"), INSTRUCTIONS))
        .withColumn("l_shipmode", _pick(F.col("_m"), SHIP_MODES))
    )
    return _commented(rows, "l_comment", line)


def party_rows(df: DataFrame, p: str, key: str, label: str) -> DataFrame:
    """Name, address, nation, phone, balance and comment of a supplier or customer."""
    nationkey = _between(_draw(p + "nation", key), 0, len(NATIONS) - 1)
    named = (
        df.withColumn(f"{p}_name", _numbered(label, key))
        .withColumn(f"{p}_address", F.substring(F.sha1(F.col(key).cast("string")), 1, 20))
        .withColumn(f"{p}_nationkey", nationkey)
        .withColumn(f"{p}_phone", F.concat_ws(
            "-", (F.col(f"{p}_nationkey") + 10).cast("string"),
            _between(_draw(p + "a", key), 100, 999).cast("string"),
            _between(_draw(p + "b", key), 100, 999).cast("string"),
            _between(_draw(p + "c", key), 1000, 9999).cast("string")))
        .withColumn(f"{p}_acctbal", _cents(_draw(p + "bal", key), -99_999, 999_999))
    )
    return _commented(named, f"{p}_comment", key)


def customer_rows(keys: DataFrame) -> DataFrame:
    """All columns of the customer table for given customer keys."""
    return party_rows(keys, "c", "c_custkey", "Customer").withColumn(
        "c_mktsegment", _pick(_draw("cm", "c_custkey"), SEGMENTS))


def supplier_rows(keys: DataFrame) -> DataFrame:
    """All columns of the supplier table for given supplier keys."""
    return party_rows(keys, "s", "s_suppkey", "Supplier")


def part_rows(keys: DataFrame) -> DataFrame:
    """All columns of the part table for given part keys."""
    key = "p_partkey"
    maker = _between(_draw("pm", key), 1, 5).cast("string")
    rows = (
        keys.withColumn("p_name", F.concat_ws(" ", _pick(_draw("pn1", key), WORDS), _pick(_draw("pn2", key), WORDS)))
        .withColumn("p_mfgr", F.concat(F.lit("Manufacturer#"), maker))
        .withColumn("p_brand", F.concat(F.lit("Brand#"), maker, _between(_draw("pb", key), 1, 5).cast("string")))
        .withColumn("p_type", _pick(_draw("pt", key), TYPES))
        .withColumn("p_size", _between(_draw("ps", key), 1, 50))
        .withColumn("p_container", _pick(_draw("pc", key), CONTAINERS))
        .withColumn("p_retailprice", _hundredths(_retail_cents(key)))
    )
    return _commented(rows, "p_comment", key)


def nation_rows(keys: DataFrame) -> DataFrame:
    """All columns of the nation table for given nation keys; a key that the standard lacks has no name."""
    at = F.col("n_nationkey").cast("int")
    rows = keys.withColumn("n_name", F.get(F.array(*[F.lit(name) for name, _ in NATIONS]), at)).withColumn(
        "n_regionkey", F.get(F.array(*[F.lit(region) for _, region in NATIONS]), at))
    return _commented(rows, "n_comment", "n_nationkey")


def region_rows(keys: DataFrame) -> DataFrame:
    """All columns of the region table for given region keys; a key that the standard lacks has no name."""
    name = F.get(F.array(*[F.lit(r) for r in REGIONS]), F.col("r_regionkey").cast("int"))
    return _commented(keys.withColumn("r_name", name), "r_comment", "r_regionkey")


def seed_tpch(spark: SparkSession, sf: float) -> dict[str, DataFrame]:
    """The eight tables in load order, each a lazy, partitioned scan over its row numbers."""
    n = {table: rows_at(table, sf) for table in ROWS_AT_SF1}

    def numbers(count: int, key: str, first: int = 1) -> DataFrame:
        return spark.range(first, first + count).select(F.col("id").alias(key))

    partsupp = (
        partsupp_keys(numbers(n["part"], "p"), "p", 1, n["supplier"], 1)
        .withColumn("ps_availqty", _between(_draw("pa", "ps_partkey", "ps_suppkey"), 1, 9_999))
        .withColumn("ps_supplycost",
                    _cents(_draw("pcost", "ps_partkey", "ps_suppkey"), 100, 100_000))
    )
    orders = order_rows(numbers(n["orders"], "o_orderkey"), 1, n["customer"],
                        max(1, round(CLERKS_AT_SF1 * sf)))
    lineitem = line_rows(numbers(n["orders"], "l_orderkey"), n["part"], n["supplier"])
    tables = {
        "region": region_rows(numbers(len(REGIONS), "r_regionkey", 0)),
        "nation": nation_rows(numbers(len(NATIONS), "n_nationkey", 0)),
        "supplier": supplier_rows(numbers(n["supplier"], "s_suppkey")),
        "customer": customer_rows(numbers(n["customer"], "c_custkey")),
        "part": part_rows(numbers(n["part"], "p_partkey")),
        "partsupp": _commented(partsupp, "ps_comment", "ps_partkey", "ps_suppkey"),
        "orders": orders, "lineitem": lineitem,
    }
    return {name: conform(tables[name], wide_keys(tpch_schema(name))) for name in TPCH_DDL}
