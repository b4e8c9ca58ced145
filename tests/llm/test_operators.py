"""Operators over odd documents: against brute force, empty tables, nulls, repeated rows, clashing names."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from samples import CLASHING, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowlens.llm import audio, bpe, common, decontaminate, html_text, labelled_pages, licenses, near_dedup, suffix_dedup, token_counts, toxicity, warc


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- WARC ----

PAGES = f"page_id long, url string, html string, {CLASHING}"


def archived(spark, rows, **options):
    path = common.new_folder(spark, "test-warc")
    extra = ("r", None, "d", "w", "5", "0", "x", "y", "z", "f", "g", 3)
    warc.write_archives(warc.plan_records(spark.createDataFrame([(*r, *extra) for r in rows], PAGES)), path, **options)
    return warc.read_archives(spark, path)


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\n", "same"), (3, None, "same"), (9, "u", "same"), (7, "u", None), (8, "u", ""), (1, "u", prose(1, 50_000)), (None, "u", "same"), (None, None, "only"), (2, "é", "é\u0000x"), *[(i, "u", f"<p>{prose(i, 40)}</p>") for i in range(100, 200)]]
    out = archived(spark, rows, sample_bytes=20_000, archive_bytes=200_000).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out if r.page_id is not None}
    for i, _, page in rows:
        if i is not None:
            data = (page or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            if got[i].record_type == "response":
                assert bytes(got[i].payload) == data
    assert {i: (got[i].record_type, got[i].refers_to) for i in (3, 5, 9, 7, 8)} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 7: ("response", None), 8: ("revisit", 7)}
    assert sorted((r.record_type, r.refers_to or 0) for r in out if r.page_id is None) == [("response", 0), ("revisit", 3)]


def test_warc_repeated_rows_and_empty_table(spark):
    out = archived(spark, [(1, "u", "x"), (1, "u", "x"), (2, "u", "x")]).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (1, "response"), (2, "revisit")]
    assert archived(spark, []).count() == 0


@pytest.mark.parametrize(("per_archive", "row_bytes", "sample_bytes"), [(10_000, 1, 1 << 14), (3, 2_000, 1 << 14), (1, 1, 1), (2, 1 << 20, 1 << 10)])
def test_warc_dictionary_is_embedded_and_frames_stand_alone(per_archive, row_bytes, sample_bytes):
    records = [f"WARC/1.1 {i} {prose(i, 30)}".encode() for i in range(200)]
    rows = list(warc.archive_rows(iter(records), per_archive, row_bytes, sample_bytes, 1 << 12, 3))
    archives = [warc.SEPARATOR.encode().join(rows[k : k + per_archive]) for k in range(0, len(rows), per_archive)]
    assert [r for a in archives for r in warc.parse_archive(a)] == records
    for a in archives:
        assert a[:4] == b"\x5d\x2a\x4d\x18" and a.count(b"\x5d\x2a\x4d\x18") == 1
    if row_bytes == 1 and per_archive > 1:  # a record each: the last alone with the dictionary
        size = 8 + int.from_bytes(rows[0][4:8], "little")
        assert list(warc.parse_archive(rows[0][:size] + rows[-1])) == records[-1:]
    assert list(warc.archive_rows(iter([]), 2, 1, 1, 1 << 12, 3)) == []


def test_warc_files_are_rolled(spark):
    path = common.new_folder(spark, "test-warc")
    rows = [(i, "u", prose(i, 200)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(pages).coalesce(1), path, archive_bytes=40_000, row_bytes=10_000, sample_bytes=20_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) > 3 and all(len(f) < 80_000 and f[:4] == b"\x5d\x2a\x4d\x18" for f in files)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()} == {i: t for i, _, t in rows}


# ---- audio ----


def stored_features(docs):
    return common.written(audio.features(audio.store(docs)), "test-features")


def test_audio_payloads(odd_texts, odd_docs, no_docs):
    out = by_id(audio.digests(stored_features(odd_docs)))
    for i, t in odd_texts:
        data = brute.utf8(t)
        data += b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(brute.utf8(t)), len(data), brute.sha(data), zlib.crc32(data[len(data) - 32 :]))
        assert r.media_bytes == len(data) + 44
    assert out[10].feature == out[11].feature and out[14].feature == out[15].feature
    assert audio.digests(stored_features(no_docs)).count() == 0


def test_audio_of_repeated_rows(repeated_docs):
    out = audio.digests(stored_features(repeated_docs)).collect()
    assert len(out) == repeated_docs.count()
    assert sum(r.doc_id is None for r in out) == 2
    by_payload = {}
    for r in out:
        assert by_payload.setdefault(r.payload_sha256, r.feature) == r.feature


def test_audio_features_by_plain_formulas(odd_texts, odd_docs):
    """Frames, patches and segments of stored tensors against a direct computation in double precision."""
    for r in stored_features(odd_docs).collect():
        data = brute.utf8(dict(odd_texts)[r.doc_id])
        data += b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        mel, spans = brute.audio(data)
        table = audio.patch_table(bytes(r.patches))
        assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float16(), [audio.PATCH, audio.MELS], dim_names=["frame", "mel"])
        got = table.column("mel").combine_chunks().to_numpy_ndarray()
        assert r.n_frames == len(mel) and got.shape == (max(1, -(-len(mel) // 32)), 32, 40)
        flat = got.reshape(-1, 40).astype(float)
        assert np.abs(flat[: len(mel)] - mel).max() < 1 / 16
        assert (flat[len(mel) :] <= flat[(len(got) - 1) * 32 : len(mel)].min()).all()
        assert table.column("start_s").to_pylist() == [k * 0.32 for k in range(len(got))]
        assert [(round(s.start_s, 4), round(s.end_s, 4)) for s in r.segments] == spans, r.doc_id


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    x = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    for target in (8_000, 12_000, 24_000):
        y = audio.resample(x, 16_000, target)
        want = np.sin(2 * np.pi * 500 * np.arange(len(y)) / target)
        assert len(y) == target and np.abs(y - want)[200:-200].max() < 0.01
    e = np.zeros(50)
    e[20:30], e[30:] = 10, -1
    assert audio.segments(e).tolist() == [[20, 30]]


# ---- tokens ----


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(odd_texts, odd_docs, no_docs, tokenizer):
    out = by_id(token_counts.token_counts(odd_docs, chunk=1000, overlap=16))
    for i, t in odd_texts:
        assert (out[i].n_bytes, out[i].n_tokens) == (len(brute.utf8(t)), len(tokenizer.encode(t or "", add_special_tokens=False)))
    assert token_counts.token_counts(no_docs).count() == 0


def test_tokens_of_repeated_rows(repeated_docs, tokenizer):
    """Row by row: repeated rows, and rows without an id, each have their own count and ids."""
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in repeated_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(repeated_docs).collect()) == want
    want = Counter((r.doc_id, brute.sha(brute.utf8(r.text))) for r in repeated_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in bpe.round_trip(repeated_docs).collect()) == want


@settings(max_examples=80, deadline=None)
@given(st.text("ab '\n é1.<|endoftext>", max_size=120), st.integers(2, 30), st.integers(1, 8))
def test_splices_are_those_of_the_whole_text(tokenizer, text, chunk, overlap):
    text += "<|endoftext|> don't  stop"
    whole = tokenizer.encode(text, add_special_tokens=False)
    assert [x[0] for x in token_counts.resynchronised(tokenizer, text, chunk, overlap)] == whole.ids


@pytest.fixture(scope="module")
def peer():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(odd_texts, odd_docs, no_docs, peer):
    out = by_id(bpe.round_trip(odd_docs))
    coded = bpe.encode_documents(odd_docs)
    ids, back = by_id(coded), by_id(bpe.decode_documents(coded))
    for i, t in odd_texts:
        want = np.array(peer.encode_ordinary(t or ""), "<u4")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(want), brute.sha(want.tobytes()), brute.sha(brute.utf8(t)))
        assert ids[i].ids == want.tolist() and bytes(back[i].decoded) == brute.utf8(t)
    assert bpe.round_trip(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinst ", max_size=200)))
def test_bpe_like_the_library(peer, text):
    own = bpe.encoder()
    assert np.frombuffer(own.encode(text), "<u4").tolist() == peer.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


# ---- HTML ----


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>Some <b>bo</b>ld  text.<br>More</p><div class=ad>Buy this now today</div><p>End</article><footer>&copy; us all</footer>", "A & B Some bold text. More End"),
        ("<body><p>Just one&#33;</p><script>var t='</p>'</script><form>Your name</form>", "Just one!"),
        ("<article><p>Text</p><section id='comments'><p>First comment here by me</p></section></article><p>stray words out here</p>", "Text"),
        ("<main><p>a<!-- <p>b</p> -->c</p><textarea>no</textarea></main>", "ac"),
        ("<p>cut off <b", "cut off"),
        ("<body class='has-sidebar'><article><h1>A b</h1><p>Owls hunt by ear in the dark.</p></article><div class='sidebar'>Most read of all</div></body>", "A b Owls hunt by ear in the dark."),
        ("<body class='no-comments'><main><p>Bread needs flour, water, salt and time.</p></main></body>", "Bread needs flour, water, salt and time."),
        ("<article><h1>Law</h1><p>Something long enough to read.</p><section class='legal'><p>The legal side of it is this.</p></section></article>", "Law Something long enough to read. The legal side of it is this."),
        ("<body hidden><form id='aspnetForm'><div class='page-with-sidebar'><h1>T</h1><p>The text of the page is here for all to read.</p></div><div class='sidebar'><a href=x>One</a></div></form>", "T The text of the page is here for all to read."),
        # no article or main, and names that no page of the fit has
        ("<body><div class='q7'><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div>Buy two pairs of shoes and get the third for nothing today</div><div id='zz'><h2>Bridge reopened</h2><p>After two years of work the <b>old bridge</b> carries traffic again.</p><p>The mayor cut the ribbon <a href=/m>on Monday</a> in heavy rain.</p></div><div><a href=/1>Imprint</a> <a href=/2>Contact</a></div></body>", "Bridge reopened After two years of work the old bridge carries traffic again. The mayor cut the ribbon on Monday in heavy rain."),
        ("<div><h1>Bridge reopened</h1><p>After two years of work the old bridge carries traffic again.</p><div class='ad'>Buy now</div><p>End of story.</p></div><div class='reader-comments'><p>Great text, thanks for it, I loved each word of it so very much.</p></div>", "Bridge reopened After two years of work the old bridge carries traffic again. End of story."),
        ("<table><tr><td>Some old page with its text in a cell, long enough to be the text of that page, as it was done then.</td></tr></table>", "Some old page with its text in a cell, long enough to be the text of that page, as it was done then."),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_html_table(spark):
    deep = "<article>" + "<div><b>" * 5_000 + "word " * 20_000 + "</article>"
    rows = [(1, None, None, *"abcdefghijk", 1), (1, "u", "<p>x</p>", *"abcdefghijk", 1), (None, "u", deep, *"abcdefghijk", 1)]
    out = html_text.extract(spark.createDataFrame(rows, PAGES))
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 99_999), (1, 0), (1, 1)]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0
    assert all(v < 0 for k, v in html_text.weights().items() if k.startswith("tag"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4).map(float), max_size=12))
def test_best_stretch_by_brute_force(scores):
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    lo, hi = html_text.best_stretch(scores)
    assert sum(scores[lo:hi]) == max([0.0, *sums.values()])
    assert (lo, hi) == (0, 0) or (scores[lo] > 0 and scores[hi - 1] > 0)


def test_main_text_of_labelled_pages_not_in_the_fit():
    """Words found and words that belong, over pages from other seeds than those of the fit."""
    right = found = wanted = 0
    for page in labelled_pages.pages(200, 50_000):
        want = Counter(x for inside, markup in page if inside for x in re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", markup)).split())
        got = Counter(html_text.main_text("".join(markup for _, markup in page)).split())
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
    assert right / found >= 0.97 and right / wanted >= 0.96


def test_main_text_of_test_pages(spark):
    """The test pages hold their text in an article, cut out here by other means."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        own = re.sub(r"<(?!/?b>)[^>]*>", " ", own)
        assert out[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", own)).split())


# ---- near duplicates ----


def test_near_groups(odd_texts, odd_docs):
    out = by_id(near_dedup.groups(odd_docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in out.items()} == {i: (n, c, c == i) for i, (n, c) in brute.near(odd_texts).items()}


def test_near_groups_that_need_several_rounds(spark, monkeypatch):
    """Near copies of one text, of which few are near its smallest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    texts = []
    for i in range(40):
        w = prose(1, 200).split()
        for k in range(6):
            w[(37 * i + 31 * k) % 200] = f"new{i}{k}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(near_dedup.groups(docs)).items()} == {i: c for i, (_, c) in brute.near(texts).items()}


def test_near_groups_repeated_and_empty(repeated_docs, no_docs):
    out = near_dedup.groups(repeated_docs).collect()
    assert len(out) == repeated_docs.count()
    assert {r.component_id for r in out if r.doc_id in (10, 11, 12, 13)} == {10}
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2
    assert near_dedup.groups(no_docs).count() == 0


def test_chains_are_followed(spark):
    """Each text is near the next but not the one after it: the buckets' smallest members do not see them all."""
    w, texts = prose(1, 300).split(), []
    for i in range(12):
        texts.append((100 - i, " ".join(w)))
        w[i * 20 : i * 20 + 4] = [f"new{i}a", f"new{i}b", f"new{i}c", f"new{i}d"]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(near_dedup.groups(docs)).items()} == {i: c for i, (_, c) in brute.near(texts).items()}


def test_near_dedup_at_a_lower_threshold(spark):
    assert (near_dedup.band_rows(75), near_dedup.least_equal(75)) == (4, 74)
    rows = []
    for i in range(150):  # 60 shingles each, 40 of them shared: similarity 40 / 80
        words = [f"w{i}x{k}" for k in range(64)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:44], *(f"v{i}x{k}" for k in range(20))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs, 50).collect()} == {i: i // 2 * 2 for i in range(300)}
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs, 51).collect()} == {i: i for i in range(300)}
    with pytest.raises(ValueError, match="percent"):
        near_dedup.groups(docs, 5)


def test_sketch_estimates_and_fills():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 4000, dtype=np.uint64))
    a, b = x[:3000], x[1000:]
    same = np.mean([(near_dedup.sketch(a + np.uint64(k)) == near_dedup.sketch(b + np.uint64(k))).mean() for k in range(20)])
    assert abs(same - 0.5) < 0.05
    for n in (1, 2, 5, 40):
        assert len(near_dedup.sketch(x[:n])) == near_dedup.T
        assert (near_dedup.sketch(x[:n]) == near_dedup.sketch(x[:n])).all()


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = []
    for i in range(60):
        s = np.arange(100, dtype=np.uint64) + np.uint64(1000 * (i % 30))
        bits = near_dedup.sketch(s).astype(np.uint16).tobytes()
        rows.append((1, 60, 48_000, i, i, 100, bytearray(bits), bytearray(s.tobytes())))
    df = spark.createDataFrame([*rows, (1, 60, 48_000, 99, 99, 100, bytearray(bytes(2 * near_dedup.T)), bytearray(np.arange(100, dtype=np.uint64).tobytes()))], "key long, members long, weight long, node long, label long, n_shingles long, sketch binary, set binary")
    assert sorted(r.node for r in near_dedup.suspects(df).collect()) == list(range(60))
    assert sorted((r.a, r.b) for r in near_dedup.links_in_blocks(df).collect()) == [(i + 30, i) for i in range(30)]


# ---- decontamination, licenses ----


@pytest.fixture(scope="module")
def benchmark(spark, odd_texts):
    texts = dict(odd_texts)
    items = [(1, texts[20]), (2, " ".join(texts[20].split()[10:40])), (3, "one two three"), (4, None), (5, "..."), (6, texts[10]), (6, "one"), (None, "gnu general"), (7, "a a a a a a a a a a a a a a a a"), (2, " ".join(texts[20].split()[10:40]))]
    return items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")


def test_contamination(odd_texts, odd_docs, benchmark):
    items, df = benchmark
    out = {r.row.doc_id: r for r in decontaminate.contamination(odd_docs, df, ("doc_id", "source")).collect()}
    for i, t in odd_texts:
        assert tuple(out[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute.contamination(t, items), i
    assert out[10].row.source == "s"


def test_contamination_repeated_and_empty(spark, repeated_docs, no_docs, benchmark):
    items, df = benchmark
    out = decontaminate.contamination(repeated_docs, df, ("doc_id", "text")).collect()
    assert len(out) == repeated_docs.count()
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items) == brute.contamination(r.row.text, items)[:3]
    assert decontaminate.contamination(no_docs, df).count() == 0
    assert decontaminate.contamination(repeated_docs, df.limit(0)).filter("contaminated").count() == 0
    left = decontaminate.clean(repeated_docs, df)
    assert left.columns == repeated_docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((r.row.doc_id or 0, r.row.text or "") for r in out if not r.contaminated)


def test_contamination_of_many_rows_without_id(spark):
    """Rows without an id, each with a seed, are not gathered under one key: no row of a plan's output meets all others."""
    items = spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    docs = [(None, f"{prose(1, 40)} own{i}") for i in range(3_000)]
    out = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), items)
    sizes = out.groupBy("k1", "k2").count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert tuple(sizes) == (3_000, 1)
    assert out.filter("n_hit = 40 AND n_words = 41 AND items = array('1')").count() == 3_000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("ab"), max_size=20), min_size=1, max_size=4))
def test_contamination_of_few_words(spark, texts, items):
    """Words so few that hashes, seeds and windows repeat everywhere."""
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.row.doc_id: tuple(r)[1:] for r in out} == {i: brute.contamination(t, items) for i, t in docs}


def test_licenses(odd_texts, odd_docs, repeated_docs, no_docs):
    out = {r.row.doc_id: r for r in licenses.scan(odd_docs, ("doc_id", "source")).collect()}
    for i, t in odd_texts:
        assert tuple(out[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute.licenses(t), i
        assert out[i].row.source == "s"
    notice = next(i for i, t in odd_texts if t and t.startswith("Permission"))
    assert out[notice].labels == "mit" and len(out[notice].spans) == 2 and out[10].labels == "" and out[10].score == 0.0
    again = licenses.scan(repeated_docs, ("text",)).collect()
    assert len(again) == repeated_docs.count()
    assert all((r.n_words, r.n_base) == brute.licenses(r.row.text)[:2] for r in again)
    assert licenses.scan(no_docs).count() == 0


def test_license_labels_of_repeated_ids_and_turned_words(spark):
    """Rows of one id, or without one, are judged by their own words, and those in their order."""
    notice = next(t for label, base, t in licenses.TEMPLATES if label == "bsd")
    turned = " ".join(reversed(notice.split()))
    halves = notice.split()
    halves = " ".join(halves[12:] + halves[:12])
    rows = [(i, t) for i in (1, None) for t in (notice, turned, halves, "plain words", notice, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id", "text")).collect()
    assert sorted((r.row.doc_id or 0, r.row.text or "", r.labels, r.score) for r in out) == sorted((i or 0, t or "", "bsd" if t == notice else "", float(t == notice)) for i, t in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), max_size=12), st.integers(-2, 3), st.integers(0, 3))
def test_alignment(spark, template, w, first, more):
    n = end = 0
    for p, x in enumerate(template):
        at = next((q for q in range(max(p + first, end), p + first + more + 1) if q < len(w) and w[q] == x), None)
        if at is not None:
            n, end = n + 1, at + 1
    array = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(licenses.aligned(array(w), array(template), F.lit(first), F.lit(first + more))).first()[0] == n


def test_licenses_by_brute_force(spark):
    """Labels and scores of documents made of templates with changes, against a direct search."""
    r, rows = random.Random(4), []
    for i in range(120):
        parts = prose(i, 30).split()
        for _ in range(r.randint(0, 2)):
            t = [x for x in r.choice(licenses.TEMPLATES)[2].split()]
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(["", "other words", "x"])
            at = r.randrange(len(parts))
            parts[at:at] = t
        rows.append((i, " ".join(parts)))
    out = {r.row.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert out[i] == brute.license_labels(t, licenses.TEMPLATES), i


def test_license_with_changes_is_found_on_near_diagonals(spark):
    notice = next(t for label, base, t in licenses.TEMPLATES if label == "bsd").split()
    notice[6:6] = ["very", "much"]
    del notice[14]
    df = spark.createDataFrame([(1, "x y z " + " ".join(notice) + " more"), (2, " ".join(notice[:6]))], "doc_id long, text string")
    out = {r.row.doc_id: r for r in licenses.scan(df).collect()}
    assert out[1].labels == "bsd" and 0.75 <= out[1].score <= 1 and out[1].n_base == 0
    assert out[2].labels == ""


def test_native_plans(odd_docs, benchmark):
    """Neither the last plan nor those of what is written on the way run Python."""
    plans = []
    with pytest.MonkeyPatch.context() as m:
        for module in (decontaminate, licenses):
            m.setattr(module, "written", lambda df, name: plans.append(df) or common.written(df, name))
        plans += [decontaminate.contamination(odd_docs, benchmark[1]), decontaminate.clean(odd_docs, benchmark[1]), licenses.scan(odd_docs)]
    assert len(plans) == 16
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---- suffix arrays ----


def test_repeats(odd_texts, odd_docs):
    out = by_id(suffix_dedup.remove(odd_docs), "id")
    for i, want in brute.repeats(odd_texts).items():
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i
        assert r.kept_sha256 == brute.sha(want[3]) and r.row.source == "s"


def test_repeats_over_several_groups(spark, monkeypatch):
    """A passage in more documents than a group holds, in ever new surroundings."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2_000)
    passage = prose(1, 40)
    docs = [(i, prose(100 + i, 9 + i % 5) + passage + prose(200 + i, 9)) for i in range(40)]
    out = by_id(suffix_dedup.remove(spark.createDataFrame(docs, "doc_id long, text string")), "id")
    for i, want in brute.repeats(docs).items():
        assert (out[i].n_removed, out[i].n_spans, bytes(out[i].kept)) == want[1:], i


def test_repeats_of_rows_and_empty_table(repeated_docs, no_docs):
    out = suffix_dedup.remove(repeated_docs).collect()
    assert len(out) == repeated_docs.count()
    assert all(r.n_removed == 0 for r in out if r.id in (None, 10))
    assert suffix_dedup.remove(no_docs).count() == 0


def test_long_documents_in_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    data = (prose(1, 200) + "a" * 300).encode()
    _, at, n = suffix_dedup.triggers(data)
    assert at[0] == 0 and (at[1:] == (at + n)[:-1]).all() and at[-1] + n[-1] == len(data) - suffix_dedup.LENGTH + 1


def test_rolling_hash_depends_on_its_bytes_only():
    a = np.frombuffer(bytes(range(256)) * 3 + b"ab" * 200, np.uint8)
    h = suffix_dedup.gram_hashes(a)
    assert len(h) == len(a) - suffix_dedup.GRAM + 1
    grams = {}
    for i, x in enumerate(h.tolist()):
        assert grams.setdefault(a[i : i + suffix_dedup.GRAM].tobytes(), x) == x
        assert suffix_dedup.gram_hashes(a[i : i + suffix_dedup.GRAM])[0] == h[i]
    assert len(set(grams.values())) == len(grams)


def test_suffix_array_order():
    r = np.random.default_rng(2)
    buf = r.integers(97, 99, 800, dtype=np.uint8)
    order, rank = suffix_dedup.suffix_classes(buf)
    cut = lambda k: (buf.tobytes() + b"\0" * 100)[k : k + 100]
    assert [cut(k) for k in order] == sorted(map(cut, range(800)))
    assert all((rank[a] == rank[b]) == (cut(a) == cut(b)) for a in range(0, 800, 7) for b in range(0, 800, 11))


# ---- toxicity ----


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        sentences = [prose(i * 10 + k, 8) for k in range(5)]
        if toxic:
            sentences[i % 5] += (" foulword", " nasty", " vile")[i % 3]
        rows.append((i, ". ".join(sentences), "x"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (9_999, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    bad = toxicity.offending(docs.filter("doc_id = 4"), model).collect()
    text = docs.filter("doc_id = 4").first().text
    assert len(bad) == 1 and "nasty" in text[bad[0].start : bad[0].end]
    odd = by_id(toxicity.score(odd_docs, model))
    assert odd[14].score == odd[15].score == 0.0 and odd[10].score == odd[11].score
    assert toxicity.score(no_docs, model).count() == 0
    again = toxicity.fit(docs, labels)
    assert again.weights == model.weights


def test_toxicity_of_long_documents(spark):
    rows, labels = [], []
    for i in range(80):
        sentences = [prose(i * 10 + k, 8) for k in range(20)] * 60
        rows.append((i, ". ".join([*sentences, prose(i, 6) + " foulword" if i % 2 else prose(i, 7)])))
        labels.append((i, 1, i % 2))
    assert all(len(t) > 50_000 and t.find("foulword", 0, 50_000) < 0 for _, t in rows)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(docs, model).collect())
    assert [(r.doc_id, "foulword" in rows[1][1][r.start : r.end]) for r in toxicity.offending(docs.filter("doc_id = 1"), model).collect()] == [(1, True)]


def test_toxicity_bags_merge_equal_sentences(spark):
    texts = spark.createDataFrame([("Bad day. good day! Bad day? Nothing\n", 1, 0), ("", 0, 1), ("... bad", 0, 2)], "text string, toxic int, fold int").coalesce(1)
    out = toxicity.bags(texts, ["bad", "day", "good"]).collect()
    assert [(r.toxic, r.rows, r.times, r.bare) for r in out] == [(1, [[0, 1], [1, 2]], [2, 1], 1), (0, [], [], 0), (0, [[0]], [1], 0)]


def test_toxicity_by_plain_formulas(labelled, odd_texts, odd_docs):
    """Scores against noisy-or computed sentence by sentence, and repeated rows and null ids."""
    model = toxicity.fit(*labelled)
    foul = odd_docs.withColumn("text", F.concat_ws(". A foulword here! ", "text", "text"))
    out = by_id(toxicity.score(foul, model))
    for i, t in odd_texts:
        whole = "" if t is None else f"{t}. A foulword here! {t}"
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", whole.lower()):
            words = set(re.findall(r"[^\W_]+", sentence))
            if words:
                own = [f for w in words for f in (w, *(f"{w[:n]}*" for n in (3, 4, 5, 6) if len(w) >= n))]
                clean *= 1 / (1 + np.exp(model.bias + sum(model.weights.get(f, 0.0) for f in own)))
        want = 0.0 if clean == 1 else 1.0 if clean == 0 else 1 / (1 + np.exp(model.cut) * clean / (1 - clean))
        assert abs(out[i].score - want) < 1e-6 and out[i].predicted == int(want >= 0.5), i


def test_toxicity_of_repeated_rows(labelled, repeated_docs):
    model = toxicity.fit(*labelled)
    out = toxicity.score(repeated_docs, model).collect()
    assert len(out) == repeated_docs.count()
    assert [r.held_out for r in out if r.doc_id is None] == [False] * 2
    twice = {}
    for r in out:
        twice.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(x) == 1 for i, x in twice.items() if i not in (None, 11))


def test_toxicity_threshold_with_few_labels(spark):
    """A third of the toxic words are in no labelled document but one: the threshold does not rest on flattered scores."""
    r = random.Random(3)
    rows, labels = [], []
    foul = [f"foul{x}" for x in "abcdefgh"]
    for i in range(300):
        sentences = [prose(i * 10 + k, 8) for k in range(6)]
        if i % 6 == 0:
            sentences[2] += " " + r.choice(foul)
        rows.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [x for x in toxicity.score(docs, model).collect() if x.held_out]
    toxic = [x for x in held if x.doc_id % 6 == 0]
    assert sum(x.predicted for x in toxic) >= 0.8 * len(toxic)
    assert sum(x.predicted for x in held if x.doc_id % 6) <= 0.05 * len(held)


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    for own in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.score(docs, toxicity.fit(docs, own)).agg(F.max("score")).first()[0] < 0.5
