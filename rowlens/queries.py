"""Named queries over the test tables, one or more for each operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ComparisonError
from .functions import casts, equality, text
from .operators import diff, keys, match, normalize, profile, summary
from .options import CompareOptions, NormalizeOptions
from .plans.compare import compare_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Keys are known to be unique in these tables: no look for duplicates before each query.
PLAIN = CompareOptions(unique_keys="off")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- pairs of tables ----------------------------------------------------------------------------


def orders_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """orders, and orders with rows missing, added and changed by the key's remainders."""
    t1 = table(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 11 == 0, F.concat(F.lower("o_orderstatus"), F.lit(" "))).when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus"))
    price = F.when(k % 13 == 0, F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice"))
    t2 = t1.filter(k % 17 != 0).withColumn("o_orderstatus", status).withColumn("o_totalprice", price)
    return t1, t2.unionByName(t1.filter(k % 23 == 0).withColumn("o_orderkey", k + 10_000_000))


ORDERS2 = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) || ' ' WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0
 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 23 = 0"""
ORDER_FIELDS = (("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "double"), ("o_orderdate", "time"), ("o_orderpriority", "text"))
SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def sql_equal(a: str, b: str, kind: str) -> str:
    return {"int": f"{a} = {b}", "double": f"abs({a} - {b}) <= 1e-8 * abs({b})", "time": f"date_trunc('second', {a}) = date_trunc('second', {b})", "text": f"lower(trim({a}, {SPACES})) = lower(trim({b}, {SPACES}))"}[kind]


def sql_cells(t1: str, t2: str, key: list[str], fields, kinds=("missing", "added", "changed"), key2: list[str] | None = None) -> str:
    """SQL for the differing cells: the key, field_name, difference_type, text1, text2, num1, num2, message.

    ``fields`` are (name in table 1, type) or (name in table 1, type, name in table 2).
    """
    key2 = key2 or key
    on = " AND ".join(f"a.{x} = b.{y}" for x, y in zip(key, key2, strict=True))
    shown = lambda x, kind: (f"CAST({x} AS VARCHAR)", "CAST(NULL AS DOUBLE)") if kind != "double" else ("CAST(NULL AS VARCHAR)", f"round({x}, 4)")
    null = ("CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)")
    some1 = " AND ".join(f"a.{x} IS NOT NULL" for x in key)
    some2 = " AND ".join(f"b.{x} IS NOT NULL" for x in key2)
    parts = []
    for name, kind, *other in fields:
        n2 = other[0] if other else name
        a, b = f"a.{name}", f"b.{n2}"
        (s1, d1), (s2, d2) = shown(a, kind), shown(b, kind)
        own = lambda letter, names: ", ".join(f"{letter}.{y} AS {x}" for x, y in zip(key, names, strict=True))
        row = lambda k, f, what, x, y, m, rest: f"SELECT {k}, '{f}' AS field_name, '{what}' AS difference_type, {x[0]} AS text1, {y[0]} AS text2, {x[1]} AS num1, {y[1]} AS num2, {m} AS message FROM {rest}"
        if "missing" in kinds:
            parts.append(row(own("a", key), name, "missing", (s1, d1), null, "'exists only in table 1'", f"t1 a WHERE {some1} AND NOT EXISTS (SELECT 1 FROM t2 b WHERE {on})"))
        if "added" in kinds:
            parts.append(row(own("b", key2), n2, "added", null, (s2, d2), "'exists only in table 2'", f"t2 b WHERE {some2} AND NOT EXISTS (SELECT 1 FROM t1 a WHERE {on})"))
        if "changed" in kinds:
            parts.append(row(own("a", key), name, "changed", (s1, d1), (s2, d2), f"CASE WHEN ({a} IS NULL) <> ({b} IS NULL) THEN 'one side is null' ELSE 'values differ' END", f"t1 a JOIN t2 b ON {on} WHERE CASE WHEN {a} IS NULL AND {b} IS NULL THEN false WHEN {a} IS NULL OR {b} IS NULL THEN true ELSE NOT ({sql_equal(a, b, kind)}) END"))
    return f"WITH t1 AS ({t1}), t2 AS ({t2}) " + " UNION ALL ".join(parts)


def shown(differences: DataFrame, doubles: tuple[str, ...] = ("o_totalprice",)) -> DataFrame:
    """Values of double columns as numbers rounded to 4 digits, all others as texts."""
    is_double = F.col("field_name").isin(*doubles)
    number = lambda c: F.when(is_double, F.round(F.col(c).try_cast("double"), 4))
    keys_ = differences.columns[: differences.columns.index("field_name")]
    return differences.select(*keys_, "field_name", "difference_type", F.when(~is_double, F.col("table1_value")).alias("text1"), F.when(~is_double, F.col("table2_value")).alias("text2"), number("table1_value").alias("num1"), number("table2_value").alias("num2"), "message")


# ---- differences --------------------------------------------------------------------------------

ALL_ORDERS = sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], ORDER_FIELDS)


@query(ALL_ORDERS)
def diff_full(spark, d):
    return shown(diff.diff(*orders_pair(spark, d), "o_orderkey", None, PLAIN))


@query(sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], ORDER_FIELDS, ("missing",)))
def diff_missing(spark, d):
    return shown(diff.missing(*orders_pair(spark, d), "o_orderkey", None, PLAIN))


@query(sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], ORDER_FIELDS, ("added",)))
def diff_added(spark, d):
    return shown(diff.added(*orders_pair(spark, d), "o_orderkey", None, PLAIN))


@query(sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], ORDER_FIELDS, ("changed",)))
def diff_changed(spark, d):
    return shown(diff.changed(*orders_pair(spark, d), "o_orderkey", None, PLAIN))


@query(ALL_ORDERS)
def diff_chunked_equiv(spark, d):
    """With a chunk size far below the number of rows: the result must be that of diff_full."""
    return shown(diff.diff(*orders_pair(spark, d), "o_orderkey", None, PLAIN.with_changes(chunk_size=100, unique_keys="lazy")))


@query(ALL_ORDERS)
def diff_default_keys(spark, d):
    """With the default options: duplicate keys of both tables are looked for first."""
    return shown(diff.diff(*orders_pair(spark, d), "o_orderkey"))


@query("SELECT 'orders' AS name, count(*) > 0 AS refused FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) x UNION ALL SELECT 'lineitem', count(*) > 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x")
def diff_duplicate_keys_refused(spark, d):
    """Tables compared with themselves: a key that occurs twice is an error, at once or when the job runs."""
    out = []
    for name, key in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])):
        t, refused = table(spark, d, name), []
        for mode in ("eager", "lazy"):
            try:
                diff.diff(t, t, key, None, CompareOptions(unique_keys=mode)).count()
                refused.append(False)
            except ComparisonError:
                refused.append(True)
            except PySparkException as e:
                if "duplicate primary key" not in str(e):
                    raise
                refused.append(True)
        if len(set(refused)) > 1:
            raise AssertionError(f"{name}: {refused}")
        out.append((name, refused[0]))
    return spark.createDataFrame(out, "name string, refused boolean")


@query(f"SELECT row_number() OVER (ORDER BY difference_type, field_name, o_orderkey) - 1 AS position, o_orderkey, field_name, difference_type FROM ({ALL_ORDERS}) x")
def diff_ordered(spark, d):
    """Differences in their order, each with its place in it."""
    found = diff.ordered(orders_differences(spark, d), "o_orderkey")
    return keys.with_positions(found.select("o_orderkey", "field_name", "difference_type")).select("position", "o_orderkey", "field_name", "difference_type")


@query(f"WITH t1 AS (SELECT * FROM orders), t2 AS ({ORDERS2}) SELECT a.o_orderkey, 'o_totalprice' AS field_name FROM t1 a JOIN t2 b USING (o_orderkey) WHERE abs(a.o_totalprice - b.o_totalprice) >= 10000 UNION ALL SELECT a.o_orderkey, 'o_orderstatus' FROM t1 a JOIN t2 b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus")
def diff_own_comparators(spark, d):
    """Equality of two columns given by the caller, of the others by their types."""
    own = {"o_totalprice": lambda a, b: F.abs(a - b) < 10_000, "o_orderstatus": lambda a, b: a == b}
    return diff.changed(*orders_pair(spark, d), "o_orderkey", None, PLAIN.with_changes(comparators=own)).select("o_orderkey", "field_name")


LINES1 = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2"


def lines(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"), F.min("l_returnflag").alias("l_returnflag"))


@query(sql_cells(LINES1, f"SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_extendedprice, CASE WHEN l_linenumber = 3 THEN 'Z' ELSE l_returnflag END AS l_returnflag FROM ({LINES1}) x WHERE (l_orderkey + l_linenumber) % 29 <> 0", ["l_orderkey", "l_linenumber"], (("l_quantity", "double"), ("l_extendedprice", "double"), ("l_returnflag", "text"))))
def diff_composite_key(spark, d):
    t1 = lines(spark, d)
    t2 = t1.filter((F.col("l_orderkey") + F.col("l_linenumber")) % 29 != 0).withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).withColumn("l_returnflag", F.when(F.col("l_linenumber") == 3, "Z").otherwise(F.col("l_returnflag")))
    return shown(diff.diff(t1, t2, ["l_orderkey", "l_linenumber"], None, PLAIN), ("l_quantity", "l_extendedprice"))


CUSTOMER2 = "SELECT c_custkey AS customer_key, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || '!' ELSE c_name END AS full_name, c_acctbal + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS acct_bal, c_nationkey AS nation FROM customer WHERE c_custkey % 31 <> 0"


def customer_pair(spark, d):
    t1 = table(spark, d, "customer")
    k = F.col("c_custkey")
    t2 = t1.filter(k % 31 != 0).select(k.alias("customer_key"), F.when(k % 5 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("full_name"), (F.col("c_acctbal") + F.when(k % 9 == 0, 1).otherwise(0)).alias("acct_bal"), F.col("c_nationkey").alias("nation"))
    return t1, t2


@query(sql_cells("SELECT * FROM customer", CUSTOMER2, ["c_custkey"], (("c_name", "text", "full_name"), ("c_acctbal", "double", "acct_bal"), ("c_nationkey", "int", "nation")), ("added", "changed"), ["customer_key"]) + " UNION ALL SELECT a.c_custkey, f.f, 'missing', CASE f.f WHEN 'c_name' THEN c_name WHEN 'c_nationkey' THEN CAST(c_nationkey AS VARCHAR) WHEN 'c_mktsegment' THEN c_mktsegment END, NULL, CASE WHEN f.f = 'c_acctbal' THEN round(c_acctbal, 4) END, NULL, 'exists only in table 1' FROM t1 a, (VALUES ('c_name'), ('c_acctbal'), ('c_nationkey'), ('c_mktsegment')) f(f) WHERE NOT EXISTS (SELECT 1 FROM t2 b WHERE b.customer_key = a.c_custkey)")
def diff_field_mapping(spark, d):
    """Renamed columns; c_mktsegment has no partner and shows in missing rows only."""
    t1, t2 = customer_pair(spark, d)
    mapping = {"c_custkey": "customer_key", "c_name": "full_name", "c_acctbal": "acct_bal", "c_nationkey": "nation"}
    return shown(diff.diff(t1, t2, "c_custkey", mapping, PLAIN), ("c_acctbal", "acct_bal"))


@query(sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], [f for f in ORDER_FIELDS if f[0] not in ("o_totalprice", "o_orderdate")]))
def diff_ignore_columns(spark, d):
    return shown(diff.diff(*orders_pair(spark, d), "o_orderkey", None, PLAIN.with_changes(ignore_columns=("o_totalprice", "o_orderdate"))))


@query(sql_cells("SELECT * FROM orders", f"SELECT o_orderkey, o_custkey, o_orderstatus AS order_state, o_totalprice, o_orderdate, o_orderpriority FROM ({ORDERS2}) x", ["o_orderkey"], [("o_orderstatus", "text", "order_state"), *(f for f in ORDER_FIELDS if f[0] != "o_orderstatus")]).replace("'order_state' AS field_name", "'o_orderstatus' AS field_name"))
def diff_column_aliases(spark, d):
    t1, t2 = orders_pair(spark, d)
    return shown(diff.diff(t1, t2.withColumnRenamed("o_orderstatus", "order_state"), "o_orderkey", None, PLAIN.with_changes(column_aliases={"order_state": "o_orderstatus"})))


def null_pair(spark, d):
    t1, t2 = orders_pair(spark, d)
    k = F.col("o_orderkey")
    return t1.withColumn("o_orderstatus", F.when(k % 3 != 0, F.col("o_orderstatus"))).withColumn("o_orderkey", F.when(k % 41 != 0, k)), t2.withColumn("o_totalprice", F.when(k % 7 != 0, F.col("o_totalprice"))).withColumn("o_orderkey", F.when(k % 43 != 0, k))


NULLS1 = "SELECT CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
NULLS2 = f"SELECT CASE WHEN o_orderkey % 43 <> 0 THEN o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM ({ORDERS2}) x"


@query(sql_cells(NULLS1, NULLS2, ["o_orderkey"], ORDER_FIELDS))
def diff_null_keys(spark, d):
    """Rows without a key are in no category; a null differs from a value."""
    return shown(diff.diff(*null_pair(spark, d), "o_orderkey", None, PLAIN))


@query("WITH t1 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders) SELECT a.o_orderkey, 'o_orderstatus' AS field_name FROM t1 a JOIN t1 b USING (o_orderkey) WHERE a.s IS NULL AND b.s IS NULL")
def diff_null_equality_off(spark, d):
    """A table against itself: with null_equality off exactly the nulls differ."""
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return diff.diff(t, t, "o_orderkey", None, PLAIN.with_changes(null_equality=False)).select("o_orderkey", "field_name")


@query(f"""WITH t1 AS (SELECT * FROM orders), t2 AS ({ORDERS2}) SELECT a.o_orderkey, 'o_totalprice' AS field_name, round(abs(a.o_totalprice - b.o_totalprice), 4) AS absolute, round(CASE WHEN a.o_totalprice = 0 THEN 'inf'::DOUBLE ELSE abs((b.o_totalprice - a.o_totalprice) / a.o_totalprice) * 100 END, 4) AS percentage, CAST(NULL AS BIGINT) AS distance, 'double' AS type1 FROM t1 a JOIN t2 b USING (o_orderkey) WHERE NOT ({sql_equal('a.o_totalprice', 'b.o_totalprice', 'double')})
 UNION ALL SELECT a.o_orderkey, 'o_orderstatus', NULL, NULL, levenshtein(a.o_orderstatus, b.o_orderstatus), 'string' FROM t1 a JOIN t2 b USING (o_orderkey) WHERE NOT ({sql_equal('a.o_orderstatus', 'b.o_orderstatus', 'text')})""")
def diff_details(spark, d):
    out = diff.changed(*orders_pair(spark, d), "o_orderkey", None, PLAIN)
    return out.select("o_orderkey", "field_name", F.round("absolute_difference", 4).alias("absolute"), F.round("percentage_difference", 4).alias("percentage"), F.col("levenshtein_distance").cast("long").alias("distance"), "type1")


@query(f"""WITH t1 AS (SELECT * FROM orders), t2 AS ({ORDERS2}), r AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'common' END AS row_status,
 CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN 0 ELSE {' + '.join(f"CASE WHEN {sql_equal('a.' + n, 'b.' + n, k)} THEN 0 ELSE 1 END" for n, k in ORDER_FIELDS)} END AS changed_cells FROM t1 a FULL JOIN t2 b ON a.o_orderkey = b.o_orderkey) SELECT o_orderkey, row_status, CAST(changed_cells AS BIGINT) AS changed_cells FROM r""")
def row_differences(spark, d):
    return diff.row_differences(diff.join(*orders_pair(spark, d), "o_orderkey", None, PLAIN))


@query(f"SELECT '{{\"l_orderkey\":\"' || l_orderkey || '\",\"l_linenumber\":\"' || l_linenumber || '\"}}' AS key, count(*) AS n FROM lineitem GROUP BY 1")
def key_json(spark, d):
    return table(spark, d, "lineitem").groupBy(diff.key_json(["l_orderkey", "l_linenumber"]).alias("key")).agg(F.count(F.lit(1)).alias("n"))


# ---- equality -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, abs(l_extendedprice - l_extendedprice * (1 + CASE WHEN l_orderkey % 3 = 0 THEN 1e-7::DOUBLE WHEN l_orderkey % 2 = 0 THEN 1e-9::DOUBLE ELSE 0 END)) <= 1e-8 * abs(l_extendedprice * (1 + CASE WHEN l_orderkey % 3 = 0 THEN 1e-7::DOUBLE WHEN l_orderkey % 2 = 0 THEN 1e-9::DOUBLE ELSE 0 END)) AS equal FROM lineitem")
def eq_numeric_tolerance(spark, d):
    k, p = F.col("l_orderkey"), F.col("l_extendedprice")
    other = p * (F.lit(1.0) + F.when(k % 3 == 0, 1e-7).when(k % 2 == 0, 1e-9).otherwise(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("price"), equality.values_equal(p, other, T.DoubleType(), T.DoubleType()).alias("equal"))


SHIFT = "CASE o_orderkey % 5 WHEN 1 THEN INTERVAL 1 SECOND WHEN 2 THEN INTERVAL 1 MINUTE WHEN 3 THEN INTERVAL 1 HOUR WHEN 4 THEN INTERVAL 1 DAY ELSE INTERVAL 0 SECOND END"


@query("SELECT o_orderkey, " + ", ".join(f"date_trunc('{u}', o_orderdate) = date_trunc('{u}', o_orderdate + {SHIFT}) AS by_{u}" for u in ("year", "month", "day", "hour", "minute", "second")) + " FROM orders")
def eq_datetime_precision(spark, d):
    other = F.expr("o_orderdate + CASE o_orderkey % 5 WHEN 1 THEN INTERVAL 1 SECOND WHEN 2 THEN INTERVAL 1 MINUTE WHEN 3 THEN INTERVAL 1 HOUR WHEN 4 THEN INTERVAL 1 DAY ELSE INTERVAL 0 SECOND END")
    kind = T.TimestampNTZType()
    return table(spark, d, "orders").select("o_orderkey", *[equality.values_equal(F.col("o_orderdate"), other, kind, kind, CompareOptions(date_precision=u)).alias(f"by_{u}") for u in ("year", "month", "day", "hour", "minute", "second")])


@query(f"""WITH v AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN chr(9) || p_name || '  ' WHEN 2 THEN p_name || '.' ELSE replace(p_name, ' ', '  ') END AS b FROM part)
 SELECT p_partkey, {sql_equal('a', 'b', 'text')} AS loose, trim(a, {SPACES}) = trim(b, {SPACES}) AS cased, lower(a) = lower(b) AS spaced, a = b AS exact FROM v""")
def eq_string_ci(spark, d):
    k, a, s = F.col("p_partkey"), F.col("p_name"), T.StringType()
    b = F.when(k % 4 == 0, F.upper(a)).when(k % 4 == 1, F.concat(F.lit("\t"), a, F.lit("  "))).when(k % 4 == 2, F.concat(a, F.lit("."))).otherwise(F.replace(a, F.lit(" "), F.lit("  ")))
    eq = lambda **o: equality.values_equal(a, b, s, s, CompareOptions(**o))
    return table(spark, d, "part").select("p_partkey", eq().alias("loose"), eq(case_sensitive=True).alias("cased"), eq(ignore_whitespace=False).alias("spaced"), eq(exact_match_only=True).alias("exact"))


MATRIX = (
    # name, type, value 1, type, value 2, equal
    ("null null", "double", None, "double", None, True), ("nan null", "double", "NaN", "double", None, True), ("null zero", "double", None, "double", "0", False),
    ("inf inf", "double", "Infinity", "double", "Infinity", True), ("inf minus inf", "double", "Infinity", "double", "-Infinity", False),
    ("near", "double", "1.0", "double", "1.000000001", True), ("not near", "double", "1.0", "double", "1.0000001", False), ("zero", "double", "1e-12", "double", "0", False),
    ("int text", "bigint", "1", "string", "1", True), ("int text with fraction", "bigint", "1", "string", "1.0", False), ("texts", "string", " Abc ", "string", "aBC", True), ("inner space", "string", "a b", "string", "a  b", False),
    ("time within a second", "timestamp_ntz", "2020-01-01 10:11:12.1", "timestamp_ntz", "2020-01-01 10:11:12.9", True), ("midnight", "timestamp_ntz", "2020-01-01 23:59:59", "timestamp_ntz", "2020-01-02 00:00:00", False),
    ("time and text", "timestamp_ntz", "2020-01-01 00:00:00", "string", "2020-01-01", True), ("date and time", "date", "2020-01-01", "timestamp_ntz", "2020-01-01 00:00:00", True), ("booleans", "boolean", "true", "boolean", "false", False), ("big integers", "bigint", "900000000000000001", "bigint", "900000000000000002", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(e).lower()})" for n, *_, e in MATRIX) + ") x(name, equal)")
def values_equal_matrix(spark, d):
    from pyspark.sql.types import _parse_datatype_string as parse

    one = spark.range(1)
    value = lambda v, t: F.lit(v).cast("string").cast(t)
    return reduce(DataFrame.unionAll, [one.select(F.lit(n).alias("name"), equality.values_equal(value(a, ta), value(b, tb), parse(ta), parse(tb)).alias("equal")) for n, ta, a, tb, b, _ in MATRIX])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price, abs(l_quantity - l_quantity * (1 + l_discount * 1e-7::DOUBLE)) <= 1e-8 + 1e-8 * abs(l_quantity * (1 + l_discount * 1e-7::DOUBLE)) AS similar FROM lineitem")
def similar_numbers(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), equality.similar_numbers(q, q * (1 + F.col("l_discount") * 1e-7)).alias("similar"))


@query("SELECT c_custkey, round(CASE WHEN a = b THEN 0 WHEN a = 0 THEN 'inf'::DOUBLE ELSE abs((b - a) / a) * 100 END, 4) AS percentage FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE c_acctbal + 25 END AS b FROM customer) x")
def percentage_difference(spark, d):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    a, b = F.when(k % 10 == 0, 0.0).otherwise(v), F.when(k % 20 == 0, 0.0).otherwise(v + 25)
    return table(spark, d, "customer").select("c_custkey", F.round(equality.percentage_difference(a, b), 4).alias("percentage"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM part")
def levenshtein_details(spark, d):
    info = equality.difference_details(F.col("p_name"), F.col("p_type"), T.StringType(), T.StringType())
    return table(spark, d, "part").select("p_partkey", info["levenshtein_distance"].cast("long").alias("distance"))


@query("SELECT event_id, abs(value - (user_id + 0.0::DOUBLE)) <= 1e-8 * abs(user_id + 0.0::DOUBLE) AS equal, value IS NULL AS null1, round(abs(value - user_id), 6) AS absolute FROM events")
def comparison_info_numeric(spark, d):
    i = equality.comparison_info(F.col("value"), F.col("user_id"), T.DoubleType(), T.LongType())
    return table(spark, d, "events").select("event_id", i["equal"].alias("equal"), i["null1"].alias("null1"), F.round(i["absolute_difference"], 6).alias("absolute"))


@query("SELECT p_partkey, length(p_name) - length(p_type) AS length_difference, lower(p_name) = lower(p_type) AND p_name <> p_type AS case_difference FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_type END AS p_type FROM part) x")
def comparison_info_string(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_type")).alias("p_type"))
    i = equality.comparison_info(F.col("p_name"), F.col("p_type"), T.StringType(), T.StringType())
    return t.select("p_partkey", i["length_difference"].cast("long").alias("length_difference"), i["case_difference"].alias("case_difference"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01 12:00:00') AS DOUBLE) AS seconds FROM orders")
def comparison_info_datetime(spark, d):
    kind = T.TimestampNTZType()
    i = equality.comparison_info(F.col("o_orderdate"), F.expr("TIMESTAMP_NTZ '1995-01-01 12:00:00'"), kind, kind)
    return table(spark, d, "orders").select("o_orderkey", i["time_difference_seconds"].alias("seconds"))


# ---- summaries ----------------------------------------------------------------------------------


def orders_differences(spark, d):
    return diff.diff(*orders_pair(spark, d), "o_orderkey", None, PLAIN)


@query(f"SELECT k.t AS difference_type, count(c.field_name) AS n FROM (VALUES ('missing'), ('added'), ('changed')) k(t) LEFT JOIN ({ALL_ORDERS}) c ON c.difference_type = k.t GROUP BY 1")
def summary_by_type(spark, d):
    return summary.by_type(orders_differences(spark, d))


@query(f"SELECT field_name, count(*) AS n FROM ({ALL_ORDERS}) c GROUP BY 1")
def summary_by_field(spark, d):
    return summary.by_field(orders_differences(spark, d))


@query(f"SELECT difference_type, field_name, count(*) AS n FROM ({ALL_ORDERS}) c GROUP BY 1, 2")
def summary_by_type_field(spark, d):
    return summary.by_type_and_field(orders_differences(spark, d))


@query(f"SELECT r.n AS total_rows, c.n AS total_differences, c.n / r.n * 100 AS difference_rate FROM (SELECT count(*) AS n FROM orders) r, (SELECT count(*) AS n FROM ({ALL_ORDERS}) x) c")
def difference_rate(spark, d):
    return summary.rate(orders_differences(spark, d), table(spark, d, "orders"))


@query("SELECT count(*) FILTER (row_status = 'missing') AS missing_rows, count(*) FILTER (row_status = 'added') AS added_rows, count(*) FILTER (row_status = 'common' AND changed_cells > 0) AS changed_rows, count(*) FILTER (row_status = 'common' AND changed_cells = 0) AS equal_rows FROM (" + ORACLE_SQL["row_differences"] + ") x")
def summary_rows(spark, d):
    return summary.rows_with_differences(row_differences(spark, d))


# ---- keys ---------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM ({ORDERS2}) x")
def keys_except(spark, d):
    return keys.only_in_first(*orders_pair(spark, d), "o_orderkey")


@query(f"SELECT o_orderkey FROM orders INTERSECT SELECT o_orderkey FROM ({ORDERS2}) x")
def keys_intersect(spark, d):
    return keys.in_both(*orders_pair(spark, d), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return diff.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH g AS (SELECT l_orderkey, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS ln, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (ln IS NULL), 0) AS BIGINT) AS null_keys, count(*) FILTER (ln IS NOT NULL) AS distinct_keys, CAST(coalesce(sum(n - 1) FILTER (ln IS NOT NULL), 0) AS BIGINT) AS duplicate_rows, false AS is_valid FROM g")
def validate_primary_key(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).alias("ln"))
    return keys.validate_primary_key(t, ["l_orderkey", "ln"])


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders")
def chunk_assignment(spark, d):
    return keys.chunk_assignment(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT chunk, count(*) AS n_rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) x GROUP BY 1")
def chunk_key_ranges(spark, d):
    return keys.chunk_key_ranges(table(spark, d, "orders"), "o_orderkey", 1000)


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_custkey BETWEEN 10 AND 900")
def key_box_filter(spark, d):
    return keys.between(table(spark, d, "orders"), {"o_orderkey": (100, 900), "o_custkey": (10, 900)})


# ---- profiles and normalising -------------------------------------------------------------------

CUSTOMER_COLUMNS = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c if c != 'c_name' else "nullif(c_mktsegment, 'BUILDING')"}) AS n_nulls FROM customer" for c, t in CUSTOMER_COLUMNS))
def profile_nulls(spark, d):
    t = table(spark, d, "customer").withColumn("c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return profile.null_counts(t)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count(*) AS distinct_ratio, count(DISTINCT {c}) / count(*) < 0.5 AS low_cardinality FROM customer" for c, _ in CUSTOMER_COLUMNS))
def cardinality_ratio(spark, d):
    return profile.cardinality(table(spark, d, "customer"))


EVENT_TEXTS = "SELECT CAST(CAST(value AS DECIMAL(20, 4)) AS VARCHAR) AS as_text, strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(NULL AS VARCHAR) AS nothing FROM events"
IS_DAY = " OR ".join(f"try_strptime({{0}}, '{f}') IS NOT NULL" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y"))


@query("SELECT 'event_id' AS column_name, 'numeric' AS kind UNION ALL SELECT 'ts', 'date'" + "".join(f" UNION ALL SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'empty' WHEN bool_and({c} IS NULL OR {IS_DAY.format(c)}) THEN 'date' WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'text' END FROM ({EVENT_TEXTS}) x" for c in ("as_text", "day", "event_type", "nothing")))
def detect_column_types(spark, d):
    t = table(spark, d, "events").select("event_id", "ts", F.col("value").cast("decimal(20,4)").cast("string").alias("as_text"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.lit(None).cast("string").alias("nothing"))
    return profile.column_kinds(t)


SPECIAL = r"[^\p{L}\p{N}_\s]"


def sql_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPECIAL}', ' ', 'g'), '\\s+', ' ', 'g')"


@query(f"SELECT p_partkey, lower(trim({sql_clean('x')}, {SPACES})) AS lowered, upper(trim(x, {SPACES})) AS uppered FROM (SELECT p_partkey, '  ' || p_name || ' #' || p_brand || chr(9) AS x FROM part) t")
def normalize_text(spark, d):
    x = F.concat(F.lit("  "), F.col("p_name"), F.lit(" #"), F.col("p_brand"), F.lit("\t"))
    return table(spark, d, "part").select("p_partkey", text.normalize_text(x).alias("lowered"), text.normalize_text(x, "upper", True, False).alias("uppered"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'ERROR' WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def normalize_dates(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.when(k % 4 == 0, F.date_format(t, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(t, "yyyy-MM-dd")).when(k % 4 == 3, "not a day")
    return table(spark, d, "orders").select("o_orderkey", casts.normalize_date(x, NormalizeOptions().date_formats).alias("day"))


@query("SELECT o_orderkey, round(o_totalprice / 7, 3) AS price FROM orders")
def normalize_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", casts.normalize_number(F.col("o_totalprice") / 7, 3).alias("price"))


@query(f"SELECT p_partkey, lower(trim({sql_clean('p_name')}, {SPACES})) AS p_name, round(p_retailprice, 2) AS p_retailprice, '1996-05-04' AS made FROM part")
def normalize_table(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", F.lit("04/05/1996").alias("made"))
    return normalize.normalize_table(t, ["made"], ["p_retailprice"], ["p_name"], NormalizeOptions(numeric_precision=2))


@query("SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part")
def null_replacement(spark, d):
    return table(spark, d, "part").select("p_partkey", casts.replace_null(F.nullif(F.col("p_brand"), F.lit("Brand#11")), "none").alias("brand"))


# ---- texts, names and casts ---------------------------------------------------------------------


@query(f"SELECT doc_id, lower(trim({sql_clean('text')}, {SPACES})) AS cleaned FROM documents")
def clean_string(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_string(F.col("text")).alias("cleaned"))


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '--' || p_type), '{SPECIAL}', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM part")
def normalize_column_name(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_column_name(F.concat("p_name", F.lit("--"), "p_type")).alias("name"))


@query("WITH v AS (SELECT p_partkey, list_distinct(string_split(lower(replace(p_name, ' ', '_')), '_')) AS a, list_distinct(string_split(lower(replace(p_type, ' ', '_')), '_')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM v")
def overlap_score(spark, d):
    u = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    return table(spark, d, "part").select("p_partkey", text.overlap_score(u("p_name"), u("p_type")).alias("score"))


@query(r"SELECT o_orderkey, regexp_matches(x, '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4})$') AS is_date FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE CAST(o_orderdate AS VARCHAR) END AS x FROM orders) t")
def is_date_string(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.when(k % 3 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(t, "dd/MM/yyyy")).otherwise(t.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", casts.is_date_string(x).alias("is_date"))


@query(r"SELECT o_orderkey, true AS as_time, regexp_matches(x, '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4})$') AS as_text FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE o_orderpriority END AS x FROM orders) t")
def is_date_like(spark, d):
    """Values of a time type, and texts with a date's shape."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.when(k % 3 == 0, F.date_format(t, "yyyy/MM/dd")).when(k % 3 == 1, F.date_format(t, "dd-MM-yyyy")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", casts.is_date_like(t, "timestamp_ntz").alias("as_time"), casts.is_date_like(x, "string").alias("as_text"))


AS_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN o_orderpriority WHEN 2 THEN o_custkey || 'd' ELSE '-1.5e3' END"


def as_text_column():
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return F.when(k % 4 == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(k % 4 == 1, F.col("o_orderpriority")).when(k % 4 == 2, F.concat(c, F.lit("d"))).otherwise("-1.5e3")


@query(f"SELECT o_orderkey, regexp_matches(lower({AS_TEXT}), '^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity|nan)\\s*$') AS is_number FROM orders")
def is_numeric_like(spark, d):
    return table(spark, d, "orders").select("o_orderkey", casts.is_numeric_like(as_text_column()).alias("is_number"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 3 THEN -1500.0::DOUBLE ELSE -1.0::DOUBLE END AS number FROM orders")
def coerce_numeric(spark, d):
    return table(spark, d, "orders").select("o_orderkey", casts.coerce_numeric(as_text_column(), -1.0).alias("number"))


@query(f"SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN trim({AS_TEXT}) WHEN o_orderkey % 4 = 3 THEN NULL ELSE {AS_TEXT} END AS BIGINT) AS whole FROM orders")
def safe_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", casts.safe_cast(as_text_column(), "bigint").alias("whole"))


# ---- matching names -----------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('o_custkey', 'c_custkey', 0.875::DOUBLE), ('first_name', 'firstName', 1.0::DOUBLE), ('customer_id', 'id_customer', 0.8::DOUBLE), ('total_price', 'price', 0.6667::DOUBLE)) x(field1, field2, confidence)")
def match_fields_view(spark, d):
    out = match.match_fields(["o_custkey", "first_name", "customer_id", "total_price", "email"], ["firstName", "c_custkey", "price", "email_address", "id_customer"])
    return out.to_frame(spark).withColumn("confidence", F.round("confidence", 4))


def sql_squashed(name: str) -> str:
    return f"regexp_replace(regexp_replace(lower({name}), '_id$', 'id'), '[-_\\s]', '', 'g')"


ODD_NAMES = ("firstName", "Order-ID", "customer_id", "unit price", "A_B-c  d", "x_ID", "_id")


@query(f"SELECT name, {sql_squashed('name')} AS squashed FROM (SELECT DISTINCT column_name AS name FROM duckdb_columns() WHERE table_name IN {TABLES} UNION SELECT unnest({list(ODD_NAMES)})) x")
def normalize_field_name(spark, d):
    """All column names of the tables, and some odd ones."""
    found = sorted({c for t in TABLES for c in table(spark, d, t).columns} | set(ODD_NAMES))  # metadata only
    names = spark.createDataFrame([(n,) for n in found], "name string")
    return names.select("name", text.normalize_field_name(F.col("name")).alias("squashed"))


#: Twice the length of the matching blocks by that of both names: the longest common stretch (the first of equals), then the same on either side of it.
SIMILARITY = f"""WITH RECURSIVE c AS (SELECT DISTINCT table_name AS t, column_name AS f, list_position({list(TABLES)}, table_name) AS n FROM duckdb_columns() WHERE table_name IN {TABLES}),
 p AS (SELECT a.t AS table1, a.f AS field1, b.t AS table2, b.f AS field2, {sql_squashed('a.f')} AS x, {sql_squashed('b.f')} AS y FROM c a JOIN c b ON a.n < b.n),
 r AS (SELECT DISTINCT x, y, x AS a, y AS b, CAST(0 AS BIGINT) AS got FROM p UNION ALL
  SELECT x, y, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)]), unnest([k, 0]) FROM (
   SELECT x, y, a, b, e // 1000000 AS k, 999 - (e // 1000) % 1000 AS i, 999 - e % 1000 AS j FROM (
    SELECT x, y, a, b, list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: flatten(list_transform(range(1, len(b) + 1), lambda j: list_transform(range(1, least(len(a) - i, len(b) - j) + 2), lambda k: CASE WHEN substr(a, i, k) = substr(b, j, k) THEN k * 1000000 + (999 - i) * 1000 + 999 - j ELSE 0 END)))))) AS e
    FROM r WHERE a <> '' AND b <> '') q WHERE e > 0) q),
 m AS (SELECT x, y, sum(got) AS got FROM r GROUP BY x, y)
 SELECT table1, field1, table2, field2, round(CASE WHEN x = y THEN 1 ELSE 2 * got / (len(x) + len(y)) END, 4) AS score FROM p JOIN m USING (x, y)"""


@query(SIMILARITY)
def field_similarity_pairs(spark, d):
    """Scores of all column names of each table against those of each other."""
    columns = {t: table(spark, d, t).columns for t in TABLES}  # metadata only
    rows = [(t, x, u, y, round(match.similarity(x, y), 4)) for t, u in combinations(TABLES, 2) for x in columns[t] for y in columns[u]]
    return spark.createDataFrame(rows, "table1 string, field1 string, table2 string, field2 string, score double")


CAMEL = "SELECT c_custkey AS custKey, c_name AS Name, c_nationkey AS nationKey, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS acctBal, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE '  ' || lower(c_mktsegment) || '!' END AS mktSegment FROM customer WHERE c_custkey % 37 <> 0"
MATCHED = (("custkey", "custKey", "int"), ("name", "Name", "text"), ("nationkey", "nationKey", "int"), ("acctbal", "acctBal", "double"), ("mktsegment", "mktSegment", "text"))


@query(f"WITH t1 AS (SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer), t2 AS ({CAMEL}) SELECT custkey, 'missing' AS difference_type, f AS field_name FROM t1, (VALUES ('name'), ('nationkey'), ('acctbal'), ('mktsegment')) v(f) WHERE custkey % 37 = 0 UNION ALL SELECT custkey, 'changed', 'acctbal' FROM t1 WHERE custkey % 37 <> 0 AND custkey % 6 = 0 UNION ALL SELECT custkey, 'changed', 'mktsegment' FROM t1 WHERE custkey % 37 <> 0 AND custkey % 4 = 0")
def compare_tables_auto(spark, d):
    """Columns matched by name, texts normalised first: only real changes remain."""
    t1 = table(spark, d, "customer").toDF("custkey", "name", "nationkey", "acctbal", "mktsegment")
    k = F.col("custkey")
    t2 = t1.filter(k % 37 != 0).select(k.alias("custKey"), F.col("name").alias("Name"), F.col("nationkey").alias("nationKey"), F.when(k % 6 == 0, F.col("acctbal") + 10).otherwise(F.col("acctbal")).alias("acctBal"), F.when(k % 4 == 0, "none").otherwise(F.concat(F.lit("  "), F.lower("mktsegment"), F.lit("!"))).alias("mktSegment"))
    return compare_tables(t1, t2, "custkey").differences.select("custkey", "difference_type", "field_name")


from . import file_queries  # noqa: E402, F401  adds its own
