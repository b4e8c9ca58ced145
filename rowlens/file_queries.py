"""Named queries over files, reports and streams: tables are written out in some form and come back through the readers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import FileError, RowlensError
from .operators import diff
from .options import ReadOptions
from .plans.compare import compare_tables
from .queries import ALL_ORDERS, ORDER_FIELDS, ORDERS2, PLAIN, orders_differences, orders_pair, query, shown, sql_cells, table
from .session import new_folder
from .sources import encoding, files, sinks, validate
from .streaming.batches import compare_batches


def _csv(spark, d, name: str, charset: str = "UTF-8") -> str:
    """A table as one CSV file in a folder of the shared one."""
    path = new_folder(spark, name)
    table(spark, d, name).coalesce(1).write.option("header", True).option("encoding", charset).csv(path)
    return path


def _file(spark, d, name: str, charset: str = "UTF-8") -> str:
    """The same as the path of the file itself, if the shared folder is one that paths reach."""
    found = spark.read.format("binaryFile").load(_csv(spark, d, name, charset)).select("path").first()[0]
    return found.removeprefix("file://").removeprefix("file:")


def _local(spark, name: str) -> str:
    """A new local path in the shared folder."""
    path = new_folder(spark, "files").removeprefix("file://")
    os.makedirs(path)
    return os.path.join(path, name)


@contextmanager
def _put(content: dict[str, bytes]) -> Iterator[str]:
    """A folder of the driver with some files in it."""
    with tempfile.TemporaryDirectory() as folder:
        for name, data in content.items():
            with open(os.path.join(folder, name), "wb") as f:
                f.write(data)
        yield folder


# ---- CSV ----------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    return files.read_csv(spark, _csv(spark, d, "nation"))


@query("SELECT e.encoding, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region, (VALUES ('utf-8'), ('utf-16'), ('utf-32'), ('iso-8859-1')) e(encoding)")
def csv_encodings(spark, d):
    read = lambda e: files.read_csv(spark, _csv(spark, d, "region", e.upper()), ReadOptions(encoding=e))
    return reduce(DataFrame.unionAll, [read(e).select(F.lit(e).alias("encoding"), "r_regionkey", "r_name") for e in ("utf-8", "utf-16", "utf-32", "iso-8859-1")])


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def read_file_csv(spark, d):
    """The facade picks the reader by the suffix, finds the encoding, and takes a token of the caller's as null."""
    return files.read_file(spark, _file(spark, d, "orders"), ReadOptions(na_values=("P",), parse_dates=("o_orderdate",)))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def convert_encoding(spark, d):
    """A file in UTF-16 converted to UTF-8, which is then split and read in parallel."""
    return files.read_file(spark, encoding.convert_encoding(_file(spark, d, "customer", "UTF-16"), "utf-8"))


@query("SELECT unnest(range(0, (n + 999) // 1000)) AS block, least(1000, n - 1000 * unnest(range(0, (n + 999) // 1000))) AS n FROM (SELECT count(*) AS n FROM orders) x")
def read_chunks(spark, d):
    blocks = files.read_chunks(spark, _file(spark, d, "orders"), 1000)
    return spark.createDataFrame([(i, len(x)) for i, x in enumerate(blocks)], "block long, n long")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS kind, count(*) - count({c}) AS n_nulls, count(*) AS total_rows, 5 AS total_columns FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "bigint"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def profile_file(spark, d):
    """Rows, columns, types and nulls of a file."""
    p = files.parse_file(spark, _file(spark, d, "customer"))
    return spark.createDataFrame([(c, t, p.null_counts[c], p.total_rows, p.total_columns) for c, t in p.column_types.items()], "column_name string, kind string, n_nulls long, total_rows long, total_columns int")


# ---- workbooks ----------------------------------------------------------------------------------


def _workbook(spark, d) -> str:
    from .sources import xlsx

    path = _local(spark, "tables.xlsx")
    sheets = {name.title(): [(t := table(spark, d, name)).columns, *map(list, t.collect())] for name in ("nation", "supplier")}  # the small tables
    xlsx.write_xlsx(path, sheets)
    return path


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def xlsx_read(spark, d):
    """The first sheet of a workbook, by the data source."""
    return files.read_file(spark, _workbook(spark, d))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, nullif(s_name, 'Supplier#1') AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def xlsx_sheet(spark, d):
    """A sheet by its name, with a token of the caller's as null."""
    return files.read_file(spark, _workbook(spark, d), ReadOptions(sheet_name="Supplier", na_values=("Supplier#1",)))


@query("SELECT * FROM (VALUES (0, 'Nation'), (1, 'Supplier')) x(position, sheet)")
def xlsx_sheets(spark, d):
    return spark.createDataFrame(list(enumerate(files.sheet_names(_workbook(spark, d)))), "position int, sheet string")


# ---- encodings and checks -----------------------------------------------------------------------

CODECS = ("utf-8", "utf-8-sig", "utf-16", "utf-32")


@query(f"SELECT n_nationkey, e AS written, e AS detected, e <> 'utf-8' AS has_mark FROM nation, (VALUES {', '.join(f'({c!r})' for c in CODECS)}) x(e)")
def detect_encodings(spark, d):
    """Files with the nations' names in several encodings, told apart by their marks and bytes."""
    names = {r.n_nationkey: f"name\n{r.n_name} – État\n" for r in table(spark, d, "nation").collect()}  # 25 rows
    rows = []
    with _put({f"{k}.{c}": t.encode(c) for k, t in names.items() for c in CODECS}) as folder:
        for k in names:
            for c in CODECS:
                path = os.path.join(folder, f"{k}.{c}")
                rows.append((k, c, encoding.detect_encoding(path).encoding, encoding.file_bom(path) is not None))
    return spark.createDataFrame(rows, "n_nationkey int, written string, detected string, has_mark boolean")


def _outcome(f, *args) -> str:
    """The error's code (its name, if it has none), or ok."""
    try:
        f(*args)
    except FileError as e:
        return e.code
    except (RowlensError, LookupError, TypeError, ValueError) as e:
        return type(e).__name__
    return "ok"


@query("SELECT a AS written, b AS expected, CASE WHEN b = 'no-such' THEN 'ENC-003' WHEN replace(a, '-sig', '') = replace(b, '-sig', '') THEN 'ok' ELSE 'ENC-002' END AS outcome FROM (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16'), ('utf-32')) x(a), (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16'), ('utf-32'), ('no-such')) y(b)")
def validate_encodings(spark, d):
    with _put({c: "name\nÉtat\n".encode(c) for c in CODECS}) as folder:
        rows = [(a, b, _outcome(encoding.validate_encoding, os.path.join(folder, a), b)) for a in CODECS for b in (*CODECS, "no-such")]
    return spark.createDataFrame(rows, "written string, expected string, outcome string")


@query("SELECT * FROM (VALUES ('good.csv', 'ok'), ('lost.csv', 'FA-001'), ('other.txt', 'FMT-001'), ('large.csv', 'FMT-001'), ('empty.csv', 'FMT-003'), ('short.csv', 'FMT-003'), ('broken.xlsx', 'FMT-003'), ('unknown.csv', 'ENC-001')) x(file, outcome)")
def validate_files(spark, d):
    """The code of the first check that a file fails: presence, type, size, encoding, header."""
    good = b"id,name,value\n1,a,2\n"
    content = {"good.csv": good, "other.txt": good, "large.csv": good + b"2,b,3\n" * 100, "empty.csv": b"", "short.csv": b"id,name\n1,a\n", "broken.xlsx": b"no archive", "unknown.csv": b"\xff\xfe\xff\xfe"}
    with _put(content) as folder:
        rows = [(n, _outcome(lambda p: validate.validate_file(p, max_bytes=500, strict=True), os.path.join(folder, n))) for n in (*content, "lost.csv")]
    return spark.createDataFrame(rows, "file string, outcome string")


@query("SELECT * FROM (VALUES ('good', 'ok'), ('no key', 'ValueError'), ('key not in table 1', 'ComparisonError'), ('key not in table 2', 'ComparisonError'), ('empty table', 'ComparisonError'), ('mapped column lost', 'ComparisonError'), ('mapped twice', 'ComparisonError'), ('no table', 'TypeError')) x(input, outcome)")
def input_checks(spark, d):
    """What a comparison refuses."""
    t = table(spark, d, "nation")
    cases = {
        "good": (t, t, "n_nationkey"),
        "no key": (t, t, None),
        "key not in table 1": (t, t, "no_such_key"),
        "key not in table 2": (t, t.drop("n_nationkey").withColumnRenamed("n_name", "zzz"), "n_nationkey"),
        "empty table": (t, t.limit(0), "n_nationkey"),
        "mapped column lost": (t, t, "n_nationkey", {"n_nationkey": "n_nationkey", "n_name": "lost"}),
        "mapped twice": (t, t, "n_nationkey", {"n_nationkey": "n_nationkey", "n_name": "n_name", "n_regionkey": "n_name"}),
        "no table": (t, None, "n_nationkey"),
    }
    return spark.createDataFrame([(name, _outcome(compare_tables, *args)) for name, args in cases.items()], "input string, outcome string")


# ---- sinks and streams --------------------------------------------------------------------------


@query(f"SELECT f AS format, difference_type, field_name, count(*) AS n FROM ({ALL_ORDERS}) x, (VALUES ('parquet'), ('csv'), ('json')) y(f) GROUP BY 1, 2, 3")
def written_differences(spark, d):
    """Differences written in each format and read again."""
    found, parts = orders_differences(spark, d), []
    for kind in ("parquet", "csv", "json"):
        path = new_folder(spark, f"differences-{kind}")
        sinks.write_differences(found, path, kind)
        parts.append(spark.read.format(kind).option("header", True).load(path).select(F.lit(kind).alias("format"), "difference_type", "field_name"))
    return reduce(DataFrame.unionAll, parts).groupBy("format", "difference_type", "field_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'n_name' AS field_name, n_name AS table1_value, n_name || ' x' AS table2_value FROM nation WHERE n_nationkey % 3 = 0")
def report_workbook(spark, d):
    """The sheet of differences of a report, read back from the workbook."""
    t = table(spark, d, "nation")
    other = t.withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" x"))).otherwise(F.col("n_name")))
    path = _local(spark, "report.xlsx")
    sinks.generate_report(diff.diff(t, other, "n_nationkey"), path)
    out = files.read_file(spark, path, ReadOptions(sheet_name="Differences"))
    return out.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "field_name", "table1_value", "table2_value")


@query(sql_cells("SELECT * FROM orders", ORDERS2, ["o_orderkey"], ORDER_FIELDS, ("added", "changed")))
def stream_differences(spark, d):
    """The changed table as a stream, batch by batch against the other: what is new and what has changed."""
    t1, t2 = orders_pair(spark, d)
    source, out, state = (new_folder(spark, f"stream-{x}") for x in ("source", "out", "state"))
    t2.repartition(3, "o_orderkey").write.parquet(source)
    stream = spark.readStream.schema(t2.schema).option("maxFilesPerTrigger", 1).parquet(source)
    compare_batches(stream, t1, "o_orderkey", out, state, PLAIN).awaitTermination()
    return shown(spark.read.parquet(out).drop("batch"))
