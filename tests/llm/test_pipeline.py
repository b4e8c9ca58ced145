"""The pipeline against a brute-force version, and stage by stage over odd documents."""

import brute
import numpy as np
import pytest
from samples import DOCS, document, prose

import corpus_pipeline
from rowlens import session
from rowlens.llm import bpe, common, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    passage, item = prose(1, 70), prose(2, 30)
    rows = []
    for i in range(240):
        text = prose(1000 + i, 60)
        if i % 4 == 0:
            text += " vileword. "
        elif i % 9 == 1:
            text = prose(50, 80) + (" end" if i % 2 else "")
        elif i % 10 == 2:
            text += ". " + passage
        elif i % 10 == 3:
            text = item + " " + text[:60]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, [(1, item)]


def exists(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_whole_pipeline(spark, folder):
    d, rows, items = folder
    docs = [(i, t) for i, t, *_ in rows if "vileword" not in (t or "")]
    components = brute.near(docs)
    docs = [(i, t) for i, t in docs if components[i][1] == i]
    kept = brute.repeats(docs)
    docs = [(i, kept[i][3].decode("utf-8", "ignore")) for i, _ in docs]
    docs = [(i, t) for i, t in docs if not brute.contamination(t, items)[-1]]
    want = {}
    for i, t in docs:
        ids = bpe.encoder().encode(t)
        want[i] = (len(ids) // 4, brute.sha(ids), brute.sha(t.encode()))
    before = set(session.folders)
    out = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, d).collect()}
    left = [x for x in set(session.folders) - before if exists(spark, x)]
    assert len(left) == 1  # the result
    assert out == want
    assert 1000 in out and 1001 in out and 0 < len(out) < 200


def test_stages_keep_columns_and_rows(spark, folder):
    d, _, _ = folder
    rows = [document(1, prose(1, 50)), document(1, prose(1, 50)), document(2, None), document(None, None), document(None, prose(3, 9)), document(3, ""), document(4, "é" * 200), document(5, "x" + "é" * 200)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert out.count() == len(rows) - (name == "near_dedup"), name
        assert stage(spark, docs.limit(0), d).count() == 0, name
    cut = corpus_pipeline.without_repeated_passages(spark, docs, d).filter("doc_id = 5").first()
    assert cut.text == "x" and cut.n_chars == 1
    assert np.all([c in corpus_pipeline.token_ids(spark, docs, d).columns for c in ("doc_id", "n_tokens")])


def test_whole_pipeline_of_odd_rows(spark, tmp_path):
    """A very long text and copies of it, rows without an id, and empty tables beside them."""
    d = f"file://{tmp_path}"
    long = prose(7, 60_000)
    rows = [(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, prose(8, 9), "en", "s", 0), *[(None, f"{prose(9, 40)} own{i} {prose(100 + i, 40)}", None, None, None) for i in range(60)], (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id) == [(False, 1), (False, 3)]
    assert sum(r.doc_id is None for r in out) == 61
    assert next(r for r in out if r.doc_id == 1).decoded_sha256 == brute.sha(long.encode())


@pytest.fixture
def no_broadcasts(spark):
    """As with tables too large to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def shuffled(spark):
    """Bytes of all shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    nothing = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(sc._jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_copies_leave_without_a_shuffle_of_other_texts(spark, no_broadcasts, tmp_path):
    texts = [prose(i, 800) for i in range(100)]
    spark.createDataFrame([document(i, texts[i % 95]) for i in range(100)], DOCS).repartition(3).write.parquet(f"file://{tmp_path}/d")
    folders = set(session.folders)
    out = corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"file://{tmp_path}/d"), "")
    assert len([x for x in set(session.folders) - folders if exists(spark, x)]) == 1  # the ids; the search gave back the rest
    before = shuffled(spark)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == list(enumerate(texts[:95]))
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_joins_by_id_with_a_full_filter_and_a_sparse_one(spark, monkeypatch, no_broadcasts, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = [document(i, f"t{i}") for i in [*range(300), 7, 8, None, None]]
    docs, ids = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in range(0, 600, 3)], "doc_id long")
    gone = {i for i in range(0, 600, 3)}
    order = lambda x: sorted(map(tuple, x), key=str)
    assert order(common.by_id(docs, ids, "left_anti").collect()) == order(r for r in rows if r[0] not in gone)
    assert order(common.by_id(docs, ids, "left_semi").collect()) == order(r for r in rows if r[0] in gone)
    assert order(common.by_id(docs, ids.limit(0), "left_anti").collect()) == order(rows)


def test_near_copies_of_rows_with_one_id(spark):
    """One row of each id stays, and none of an id one of whose texts is a copy."""
    rows = [document(1, prose(1, 50)), document(2, prose(2, 50)), document(2, prose(3, 50)), document(3, prose(1, 50)), document(3, None), document(4, None), document(4, None), document(None, prose(1, 50)), document(None, None)]
    out = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 2, 4]
    assert sum(r.doc_id is None for r in out) == 2


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
