"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is its set of distinct 5-word shingles. The sketch has T coordinates.
In round i every shingle is hashed to a coordinate and a value; a coordinate
keeps the smallest value of the first round that reached it. Rounds go on until
all are filled, and from round T on every shingle goes to coordinate i - T, so
none can stay empty. The share of equal coordinates is concentrated around the
Jaccard similarity as it is for T independent permutations.

Classes of equal sets come first; from then on only distinct sets are handled.
Bands of ROWS coordinates give buckets. In a bucket every member is checked
against the smallest one on full sets, which joins nearly all that belong
together; a bucket whose members are still in several components is then dealt
into blocks (few and large ones, as sketches are small) that are compared pair by pair. Members that agree with
one of another component meet there once more with their full sets, and are
checked until no two that agree are in different components. No bucket is cut
off, and pairs of members are compared inside a task, never written out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, utf8, written
from .components import components

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates of a sketch, and of a band at most.
T, ROWS = 128, 4
#: The chance that a pair on the threshold shares no band, and that its sketches agree in too few coordinates, stays below this.
MISSED = 1e-5
#: Rows of a block; members checked against one copy of a set.
BLOCK, STAR = 512, 128
#: A bucket of sketches is dealt into blocks of BLOCK rows, but no more than SPREAD of them, until they hold LARGE rows:
#: a sketch is small, and each row is copied once for every block of its bucket.
SPREAD, LARGE = 8, 8192
#: Bytes of the full sets in a block.
BLOCK_BYTES = 4 << 20


@functools.cache
def band_rows(percent: int) -> int:
    """Coordinates of a band, so that a pair at ``percent`` similarity shares one of the bands."""
    rows = ROWS
    while rows and (1 - (percent / 100) ** rows) ** (T // rows) >= MISSED:
        rows //= 2
    if not rows or percent > 100:
        raise ValueError(f"{percent} percent: {T} coordinates find pairs from 9 to 100 percent")
    return rows


@functools.cache
def least_equal(percent: int) -> int:
    """Sketches that agree in fewer coordinates than this are not compared further."""
    p, below = percent / 100, 0.0
    for k in range(T + 1):
        below += math.comb(T, k) * p**k * (1 - p) ** (T - k)
        if below >= MISSED:
            return k
    return T


_U = np.uint64
SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | _U(1)
_ROUNDS = mix(np.arange(2 * T, dtype=np.uint64) + _U(0x1234567))
_BAND = mix(np.arange(T, dtype=np.uint64) + _U(77))
_PLACES = _U(64 - (T.bit_length() - 1))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_words = _WordHashes()


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text in UTF-8.

    ``lower`` and ``split`` of bytes touch only A-Z and the six ASCII white
    spaces. Fewer than five words are one shingle; no words give none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, _U(min(len(h), SHINGLE)))
    for k in range(min(len(h), SHINGLE)):
        out += h[k : k + n] * _FACTORS[k]
    return np.unique(mix(out))


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set: round in the top bits, then the value in that round."""
    out = np.full(T, ~_U(0))
    at, step = 0, max(1, 4096 // len(s))
    while at < 2 * T:
        rounds = np.arange(at, min(at + step, 2 * T))
        x = mix(s[None, :] ^ _ROUNDS[rounds, None])
        place = np.where(rounds[:, None] < T, (x >> _PLACES).astype(np.int64), rounds[:, None] - T)
        value = (rounds[:, None].astype(np.uint64) << _U(55)) | (mix(x) >> _U(9))
        np.minimum.at(out, place.ravel(), value.ravel())
        at += step
        if out.max() < _U(at) << _U(55):  # all coordinates are filled by rounds before `at`
            break
    return mix(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity; sizes alone often rule it out."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row of SKETCH_SCHEMA for every document; an empty set has no bands."""
    rows = band_rows(percent)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, key, bands, coordinates = [], [], [], []
        for x in b.column("data"):
            s = shingles(x.as_py())
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                c = sketch(s)
                own = _BAND[: T // rows].copy()
                for k in range(rows):
                    own = mix(own * _U(31) + c[k::rows])
                bands.append(own.astype(np.int64))
                coordinates.append(c.astype(np.uint16).tobytes())
            else:
                bands.append([])
                coordinates.append(None)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(coordinates, pa.binary())], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data")), run, SKETCH_SCHEMA)


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity.

    Texts are dealt by (b, salt) (and joined by a shuffle at every size), so that a set with very many partners is copied
    to one group for every STAR of them instead of meeting them all in one task.
    An id with several texts is near another if one of its texts is.
    """
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / STAR).cast("int")).select("b", "salts")
    counts = written(counts, "partners")
    members = pairs.join(counts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("a").alias("doc_id"))
    hubs = counts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("b").alias("doc_id"))
    rows = members.unionAll(hubs).join(texts.hint("merge"), "doc_id").select("b", "salt", "member", F.col("doc_id").alias("a"), "data")
    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, []
        for batch in batches:
            found = set()
            keys = zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "member", "a")), strict=True)
            for (b, salt, member, a), x in zip(keys, batch.column("data"), strict=True):
                if at != (b, salt):
                    at, hub = (b, salt), []
                s = shingles(x.as_py())
                if not member:
                    hub.append(s)
                elif any(similar(s, h, percent) for h in hub):
                    found.add((a, b))
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        _words.clear()
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, blocks: Column, columns: list[str]) -> DataFrame:
    """Rows (key, node, ...) dealt so that each two of a bucket meet: once for each pair of its ``blocks``.

    Adds i and j, the pair of blocks, and own, the row's block.
    """
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(blocks).cast("int"))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *columns)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")


def by_group(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((key, i, j), rows) of neighbouring rows from ``in_blocks``; the rows hold ``columns``."""
    at, held = None, []
    for batch in batches:
        names = ["key", "i", "j", *columns]
        for key, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if at != (key, i, j):
                if held:
                    yield at, held
                at, held = (key, i, j), []
            held.append(rest)
    if held:
        yield at, held
    give_back()


def partners(x: int, i: int, j: int, own, label, n, bits, percent: int) -> np.ndarray:
    """Which rows of a group may be near row ``x``, lie in the other block and in another component."""
    rest = np.flatnonzero((own == i + j - own[x]) & (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
    return rest[(bits[rest] == bits[x]).sum(1) >= least_equal(percent)] if len(rest) else rest


def suspects(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key and node of those in a bucket whose sketch agrees enough with one of another component.

    ``rows``: key, members, node, label, n_shingles, sketch.
    """
    blocks = F.greatest(F.least(F.col("members") / BLOCK, F.lit(SPREAD)), F.col("members") / LARGE)
    dealt = in_blocks(rows, blocks, ["label", F.col("n_shingles").alias("n"), "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), held in by_group(batches, ["own", "node", "label", "n", "sketch"]):
            if len(held) < 2:
                continue
            own, node, label, n, bits = zip(*held, strict=True)
            own, label, n = (np.array(x) for x in (own, label, n))
            bits = np.frombuffer(b"".join(bits), np.uint16).reshape(len(held), T)
            found = [node[x] for x in range(len(held)) if len(partners(x, i, j, own, label, n, bits, percent))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "node"])

    return dealt.mapInArrow(run, "key long, node long").distinct()


def full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its full set (sorted 64-bit hashes) for the ids in ``nodes``."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), utf8().alias("data")).join(nodes.hint("merge"), "node", "left_semi")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(x.as_py()).tobytes() for x in b.column("data")], pa.binary())], ["node", "set"])

    return map_arrow(texts, run, "node long, set binary")


def links_in_blocks(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join the components of a bucket's members as far as full sets allow.

    ``rows``: key, weight (bytes of the bucket's sets), members, node, label,
    sketch, set. Within a group every two members of different components whose
    sketches agree are checked on their sets, until they are joined; so no more
    links than members leave a group, and a link is lost only to the sketches.
    """
    dealt = in_blocks(rows, F.greatest(F.col("members") / BLOCK, F.col("weight") / BLOCK_BYTES), ["label", "sketch", "set"])

    def check(held: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
        own, node, label, bits, sets = zip(*held, strict=True)
        own, label = np.array(own), np.array(label)
        bits = np.frombuffer(b"".join(bits), np.uint16).reshape(len(held), T)
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        n = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        mine = [flat[e - k : e] for e, k in zip(ends, n, strict=True)]
        mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
        out = []
        for x in range(len(held)):
            near = partners(x, i, j, own, label, n, bits, percent)
            if i == j:
                near = near[near > x]
            elif own[x] != i:
                continue
            mark[mine[x]] = True
            for y in near:
                if label[x] != label[y]:
                    both = int(mark[mine[y]].sum())
                    if 100 * both >= percent * (n[x] + n[y] - both):
                        out.append((max(node[x], node[y]), min(node[x], node[y])))
                        label[label == label[y]] = label[x]
            mark[mine[x]] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in by_group(batches, ["own", "node", "label", "sketch", "set"]):
            pairs = sorted(set(check(held, i, j))) if len(held) > 1 else []
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Nodes are doc_ids; rows that share one are one node. A null text, or one
    without words, has an empty set and is linked with nothing; so is a row
    without a doc_id, whose component is null and which is kept.
    """
    rows = written(sketches(docs, percent), "sketches")
    classes = rows.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("x"), F.min("doc_id").alias("node"))
    classes = written(classes.select("set_hash", "node", "x.*"), "classes")
    members = classes.select("node", F.explode("bands").alias("key")).distinct()
    hubs = written(members.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    buckets = written(members.join(hubs, "key"), "members")
    tried = written(buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    several = rows.filter("set_hash IS NOT NULL").withColumn("h", F.xxhash64("set_hash")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("doc_id")
    same_id = rows.join(several, "doc_id", "left_semi").join(classes.select("set_hash", "node"), "set_hash").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    links = written(verified(tried, docs, percent).unionAll(same_id), "links")
    labels = components(links)

    known = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_keys = written(known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi").select("key", "members"), "open")
    sketched = classes.select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    left = known.join(open_keys, "key").join(sketched, "node")
    found = written(suspects(left, percent), "suspects")
    sets = written(full_sets(found.select("node").distinct(), docs), "sets")
    slim = written(found.join(known, ["key", "node"]).join(sketched, "node"), "suspects")
    # written, so that the join reads two plain sides: of these adaptive execution splits a hot key
    weights = written(slim.groupBy("key").agg((8 * F.sum("n_shingles")).alias("weight"), F.count(F.lit(1)).alias("members")), "weights")
    left = slim.join(weights, "key").join(sets, "node")  # the sets last: they are dealt once
    links = links.unionAll(written(links_in_blocks(left, percent), "links"))
    labels = components(links)

    named = classes.join(labels, "node", "left").select("set_hash", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
