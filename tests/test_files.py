import os

import pytest

from rowlens import errors
from rowlens.options import ReadOptions
from rowlens.sources import encoding, files, sinks, validate, xlsx

TEXT = "id,name,value\n1,Tést,100\n2,Example,200\n"


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_encodings(tmp_path):
    assert encoding.detect_encoding(put(tmp_path, "a.csv", TEXT)).encoding == "utf-8"
    assert encoding.detect_encoding(put(tmp_path, "b.csv", TEXT.encode("utf-16"))).encoding == "utf-16"
    assert encoding.file_bom(put(tmp_path, "c.csv", TEXT.encode("utf-32"))) == (b"\xff\xfe\x00\x00", "utf-32")
    assert encoding.detect_encoding(put(tmp_path, "d.csv", TEXT.encode("utf-8-sig"))).encoding == "utf-8-sig"
    cut = ("x" * (encoding.SAMPLE_BYTES - 1) + "é").encode()
    assert encoding.detect_encoding(put(tmp_path, "e.csv", cut)).encoding == "utf-8"
    with pytest.raises(errors.UnknownEncoding) as e:
        encoding.detect_encoding(put(tmp_path, "f.csv", b"\xff\xfe\xff\xfe"))
    assert e.value.code == "ENC-001" and errors.error_response(e.value)["code"] == "ENC-001"
    assert encoding.validate_encoding(str(tmp_path / "a.csv"), "UTF8")
    with pytest.raises(errors.EncodingMismatch):
        encoding.validate_encoding(str(tmp_path / "a.csv"), "utf-16")
    with pytest.raises(LookupError):
        encoding.convert_encoding(str(tmp_path / "a.csv"), "no-such")
    out = encoding.convert_encoding(str(tmp_path / "b.csv"), "utf-8")
    assert os.path.basename(out) == "b_utf-8.csv" and open(out, encoding="utf-8").read() == TEXT


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "utf-32", "iso-8859-1", "windows-1252"])
def test_csv(spark, tmp_path, name):
    options = ReadOptions(encoding=name) if name in ("iso-8859-1", "windows-1252") else None
    out = files.parse_file(spark, put(tmp_path, "t.csv", TEXT.encode(name)), options)
    assert [tuple(r) for r in out.data.collect()] == [(1, "Tést", 100), (2, "Example", 200)]
    assert out.total_rows == 2 and out.column_types == {"id": "bigint", "name": "string", "value": "bigint"}


def test_csv_options_and_faults(spark, tmp_path):
    p = put(tmp_path, "o.csv", "id,day,x\n1,2020-01-02,NA\n2,bad,-\n3,,1.5\n")
    out = files.read_csv(spark, p, ReadOptions(na_values=("-",), parse_dates=("day",), date_format="yyyy-MM-dd"))
    assert [(r.id, str(r.day), r.x) for r in out.collect()] == [(1, "2020-01-02 00:00:00", None), (2, "None", None), (3, "None", 1.5)]
    with pytest.raises(errors.InvalidStructure):
        files.read_csv(spark, put(tmp_path, "empty.csv", ""))
    with pytest.raises(errors.InvalidStructure, match="twice"):
        files.read_csv(spark, put(tmp_path, "twice.csv", "a,a\n1,2\n"))
    with pytest.raises(errors.FileMissing):
        files.read_file(spark, str(tmp_path / "lost.csv"))
    with pytest.raises(errors.InvalidFormat):
        files.read_file(spark, put(tmp_path, "x.txt", "a"))
    assert [len(c) for c in files.read_chunks(spark, p, 2)] == [2, 1]


def test_xlsx(spark, tmp_path):
    p = str(tmp_path / "w.xlsx")
    xlsx.write_xlsx(p, {"One": [["id", "name", "value"], [1, "a", 1.5], [2, None, True]], "Two": [["id"], [7]]})
    assert files.sheet_names(p) == ["One", "Two"]
    out = files.parse_file(spark, p)
    assert out.sheet_name == "One" and [tuple(r) for r in out.data.collect()] == [(1, "a", "1.5"), (2, None, "True")]
    assert [tuple(r) for r in files.read_file(spark, p, ReadOptions(sheet_name="Two")).collect()] == [(7,)]
    with pytest.raises(errors.InvalidStructure):
        files.sheet_names(put(tmp_path, "bad.xlsx", "no zip"))
    with pytest.raises(errors.InvalidFormat):
        files.sheet_names(put(tmp_path, "x.csv", "a"))


def test_validation(tmp_path):
    assert validate.validate_file(put(tmp_path, "v.csv", TEXT)).is_valid
    for name, data, code in (("v.txt", TEXT, "FMT-001"), ("w.csv", "id,name\n", "FMT-003"), ("e.csv", "", "FMT-003")):
        out = validate.validate_file(put(tmp_path, name, data))
        assert not out.is_valid and out.error.code == code
    assert validate.validate_file(put(tmp_path, "w.csv", "id,name\n")).error.details["missing_columns"] == ["value"]
    assert validate.validate_file(put(tmp_path, "big.csv", TEXT), max_bytes=3).error.code == "FMT-001"
    with pytest.raises(errors.FileMissing):
        validate.validate_file(str(tmp_path / "lost.csv"), strict=True)


def test_sinks(spark, tmp_path):
    import logging

    from rowlens.operators.diff import diff

    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    b = spark.createDataFrame([(1, "x"), (3, "c")], "id int, s string")
    d = diff(a, b, "id")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_differences(d, f"file://{tmp_path}/{fmt}", fmt)
        assert spark.read.format(fmt).option("header", True).load(f"file://{tmp_path}/{fmt}").count() == 3
    total = sinks.generate_report(d, str(tmp_path / "r.xlsx"))
    assert total["total_differences"] == 3 and xlsx.sheet_names(str(tmp_path / "r.xlsx")) == ["Summary", "Differences"]
    assert len(list(xlsx.rows(str(tmp_path / "r.xlsx"), "Differences"))) == 4
    assert sinks.create_summary(d).count() == 3 and sinks.json_lines(d).count() == 3
    log = logging.getLogger("t")
    h = sinks.JsonLog(str(tmp_path / "log"))
    log.addHandler(h)
    log.warning("done", extra={"context": {"n": 1}})
    h.close()
    assert '"context": {"n": 1}' in (tmp_path / "log").read_text()


def test_stream_batches(spark, tmp_path):
    from rowlens.streaming.batches import compare_batches

    snap = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    spark.createDataFrame([(1, "x"), (2, "b"), (5, "n")], "id int, s string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(snap.schema).parquet(f"file://{tmp_path}/in")
    q = compare_batches(stream, snap, "id", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.id, r.difference_type) for r in out.collect()) == [(1, "changed"), (5, "added")]
