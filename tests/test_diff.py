import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowlens.errors import ComparisonError
from rowlens.operators import diff, keys, normalize, profile, summary
from rowlens.options import CompareOptions, MatchOptions, NormalizeOptions
from rowlens.plans.compare import DataProcessor, compare_tables

OFF = CompareOptions(unique_keys="off")


def two(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", float("nan")), (None, "z", 9.0)], "id int, s string, x double")
    b = spark.createDataFrame([(1, " A ", 1.0 + 1e-9), (2, "x", 3.0), (4, "d", 4.0), (None, "y", 9.0)], "id int, s string, x double")
    return a, b


def facts(df):
    return sorted((r.id, r.field_name, r.difference_type) for r in df.collect())


def test_all_kinds(spark):
    a, b = two(spark)
    out = diff.diff(a, b, "id")
    assert facts(out) == [(2, "s", "changed"), (2, "x", "changed"), (3, "s", "missing"), (3, "x", "missing"), (4, "s", "added"), (4, "x", "added")]
    r = out.filter("field_name = 'x' AND difference_type = 'changed'").first()
    assert (r.absolute_difference, r.percentage_difference, r.message) == (1.0, 50.0, "values differ")
    assert out.filter("field_name = 's' AND difference_type = 'changed'").first().levenshtein_distance == 1
    parts = diff.missing(a, b, "id").unionByName(diff.added(a, b, "id")).unionByName(diff.changed(a, b, "id"))
    assert facts(parts) == facts(out)


def test_with_itself_and_mirrored(spark):
    a, b = two(spark)
    assert diff.diff(a, a, "id").count() == 0
    swap = {"missing": "added", "added": "missing", "changed": "changed"}
    assert facts(diff.diff(b, a, "id")) == sorted((i, f, swap[t]) for i, f, t in facts(diff.diff(a, b, "id")))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 9), st.text("ab ", max_size=2), max_size=6), st.dictionaries(st.integers(0, 9), st.text("ab ", max_size=2), max_size=6))
def test_against_dictionaries(spark, x, y):
    a, b = (spark.createDataFrame(sorted(d.items()), "id int, s string") for d in (x, y))
    want = [(k, "s", "missing") for k in x.keys() - y.keys()] + [(k, "s", "added") for k in y.keys() - x.keys()] + [(k, "s", "changed") for k in x.keys() & y.keys() if x[k].strip() != y[k].strip()]
    assert facts(diff.diff(a, b, "id", None, OFF)) == sorted(want)


def test_duplicate_keys(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "id int, s string")
    with pytest.raises(ComparisonError, match="not unique"):
        diff.diff(a, a, "id")
    with pytest.raises(Exception, match="duplicate primary key"):
        diff.diff(a, a, "id", None, CompareOptions(unique_keys="lazy")).collect()
    assert [tuple(r) for r in diff.duplicate_keys(a, "id").collect()] == [(1, 2)]
    assert keys.validate_primary_key(a, "id").first().asDict() == {"n_rows": 5, "null_keys": 2, "distinct_keys": 2, "duplicate_rows": 1, "is_valid": False}


def test_faulty_input(spark):
    a, b = two(spark)
    with pytest.raises(ValueError):
        diff.diff(a, b, None)
    with pytest.raises(ComparisonError, match="nothing"):
        diff.diff(a, b, "nothing")
    with pytest.raises(ComparisonError):
        diff.diff(a, b, "id", {"s": "lost"})
    with pytest.raises(ComparisonError, match="empty"):
        compare_tables(a.limit(0), b, "id")
    with pytest.raises(ValueError):
        CompareOptions(date_precision="week")
    with pytest.raises(ValueError):
        MatchOptions(similarity_threshold=2)
    with pytest.raises(ValueError):
        NormalizeOptions(numeric_precision=-1)


def test_own_comparator_and_nested_values(spark):
    a = spark.createDataFrame([(1, "x1", [1, 2]), (2, "x2", [3])], "id int, s string, v array<int>")
    b = spark.createDataFrame([(1, "y1", [1, 2]), (2, "y3", [4])], "id int, s string, v array<int>")
    o = CompareOptions(comparators={"s": lambda p, q: F.right(p, F.lit(1)) == F.right(q, F.lit(1))})
    assert facts(diff.diff(a, b, "id", None, o)) == [(2, "s", "changed"), (2, "v", "changed")]


def test_key_only_tables_have_row_status(spark):
    a, b = spark.range(3), spark.range(1, 4)
    j = diff.join(a, b, "id", None, OFF)
    assert diff.cells(j).count() == 0
    assert sorted((r.id, r.row_status) for r in diff.row_differences(j).collect()) == [(0, "missing"), (1, "common"), (2, "common"), (3, "added")]


def test_one_join_and_no_python(spark):
    a, b = two(spark)
    plan = diff.diff(a, b, "id", None, OFF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and "Python" not in plan


def test_compare_tables(spark):
    a, b = two(spark)
    out = compare_tables(a, b.withColumnsRenamed({"s": "S", "x": "X_"}), "id")
    assert out.mapping == {"id": "id", "s": "S", "x": "X_"}
    s = out.summary
    assert s["by_type"] == {"missing": 2, "added": 2, "changed": 2} and s["total_differences"] == 6
    assert s["total_rows"] == 4 and s["difference_rate"] == 150.0 and s["rows_with_differences"] == 3
    assert [r.difference_type for r in out.ordered().collect()] == ["added"] * 2 + ["changed"] * 2 + ["missing"] * 2
    p = DataProcessor()
    assert p.compare_tables(a, b, "id", ignore_columns=("x",)).summary["total_differences"] == 3
    assert p.match_fields(["a_id"], ["aId"]).matched == {"a_id": "aId"}
    assert p.normalize_table(a, text_columns=["s"], case="upper").select("s").first().s == "A"


def test_summary_zero_fill_and_rates(spark):
    a, _ = two(spark)
    none = diff.diff(a, a, "id")
    assert {r.difference_type: r.n for r in summary.by_type(none).collect()} == {"missing": 0, "added": 0, "changed": 0}
    assert summary.rate(none, a.limit(0)).first().difference_rate == 0.0
    assert summary.processing_rate(10, 0) == 0.0 and summary.estimated_bytes(a) > 0


def test_normalize_and_kinds(spark):
    t = spark.createDataFrame([("2020", "1,5", "2020-01-31", None), ("7", " B-c ", "31/01/2020", None)], "n string, t string, d string, e string")
    assert profile.detect_column_types(t) == {"date": ["d"], "numeric": ["n"], "text": ["t"]}
    assert [tuple(r) for r in normalize.normalize_table(t).collect()] == [(2020.0, "1 5", "2020-01-31", None), (7.0, "b c", "2020-01-31", None)]
    with pytest.raises(Exception, match="lost"):
        normalize.normalize_table(t, ["lost"])
    assert profile.check_schema(spark.range(1).toDF("a b"), strict=True) == ["invalid column name 'a b'"]


def test_formats_are_tried_only_on_their_shapes(spark):
    """The shapes let through all that the formats read."""
    from pyspark.sql import functions as F

    from rowlens.functions.casts import parse_date, shape_of_format
    from rowlens.options import NormalizeOptions

    formats = (*NormalizeOptions().date_formats, "M/d/yy", "yyyyMMdd", "H:mm", "dd.MM.yyyy HH:mm:ss.SSS", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm")
    assert [shape_of_format(f) is None for f in formats] == [False] * (len(formats) - 2) + [True] * 2
    texts = ["2020-01-02", "2020-01-02 03:04:05", "02/01/2020", "2020/01/02", "02-01-2020", "1/2/20", "20200102", "7:05", "02.01.2020 03:04:05.123", "02.01.2020 03:04:05.1", "Jan 2, 2020", "2020-01-02T03:04", "", " 2020-01-02", "+12020-01-02", "12020-01-02", "2020-13-01", "x", "2020-1-2", "-2020-01-02"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in formats:
        rows = df.select("t", parse_date(F.col("t"), (f,)).cast("string").alias("a"), F.try_to_timestamp(F.col("t"), F.lit(f)).cast("timestamp_ntz").cast("string").alias("b")).collect()
        assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows], f
