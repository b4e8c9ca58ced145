import pytest

from rowlens import settings
from rowlens.options import ValidationOptions
from rowlens.plans.compare import check_tables


def test_saved_settings_are_read_back(tmp_path):
    s = settings.Settings()
    s.update("compare", float_tolerance=0.5, ignore_columns=["a", "b"])
    s.update("match", prefixes=["x"])
    s.save(tmp_path / "s.json")
    back = settings.load(tmp_path / "s.json", {})
    assert back.as_dict() == s.as_dict()
    assert back.compare.ignore_columns == ("a", "b") and back.match.prefixes == frozenset(["x"])
    back.reset()
    assert back.as_dict() == settings.Settings().as_dict()


def test_environment_and_session_come_on_top(tmp_path, spark):
    (tmp_path / "s.json").write_text('{"compare": {"float_tolerance": 0.5, "chunk_size": 7}}')
    (tmp_path / "s.prod.json").write_text('{"compare": {"chunk_size": 8, "date_precision": "day"}}')
    assert settings.load(tmp_path / "s.json", {}).compare.chunk_size == 7
    variables = {"ROWLENS_ENV": "prod", "ROWLENS_COMPARE_DATE_PRECISION": "hour", "ROWLENS_READ_NA_VALUES": '["-"]'}
    spark.conf.set("spark.rowlens.compare.case_sensitive", "true")
    try:
        got = settings.load(tmp_path / "s.json", variables, spark)
    finally:
        spark.conf.unset("spark.rowlens.compare.case_sensitive")
    c = got.compare
    assert (c.float_tolerance, c.chunk_size, c.date_precision, c.case_sensitive, got.read.na_values) == (0.5, 8, "hour", True, ("-",))


@pytest.mark.parametrize("bad", [{"x": {}}, {"compare": 1}, {"compare": {"x": 1}}, {"compare": {"float_tolerance": -1}}, {"compare": {"case_sensitive": 1}}, {"compare": {"chunk_size": "1"}}, {"compare": {"comparators": {}}}, {"match": {"prefixes": "x"}}])
def test_bad_settings(bad):
    assert len(settings.problems(bad)) == 1
    with pytest.raises((ValueError, TypeError)):
        settings.Settings(bad)
    assert settings.problems({"compare": {"float_tolerance": 0}, "read": {"encoding": "utf-8"}}) == []


def test_check_tables(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id long, name string, v double")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, name string, v long")
    assert check_tables(a, a, "id") == []
    assert check_tables(a, b, "id") == ["column v is double in table 1 and bigint in table 2", "keys of table 2 are not unique"]
    assert check_tables(a, b, "id", options=ValidationOptions(require_unique_keys=False, strict_schema_check=False)) == []
    few = a.select("id", "name")
    loose = ValidationOptions(allow_missing_columns=True)
    assert check_tables(a, few, "id") == ["table 1 alone has column v", "67% of the columns match, 80% are needed"]
    assert check_tables(a, few, "id", options=loose.with_changes(schema_match_threshold=0.5)) == []
    assert check_tables(a, a.select("name", "v"), "id", options=loose)[0] == "key column id is not in both tables"
    assert check_tables(a.limit(0), b.limit(0), "id", options=ValidationOptions(strict_schema_check=False)) == []
