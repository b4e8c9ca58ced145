"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Every LENGTH-byte window has a trigger: the place inside it whose GRAM-byte
rolling hash is smallest (the leftmost of equals). That depends on nothing but
the window, so equal windows have equal triggers at equal places. The windows of
a trigger are neighbours; runs of triggers make phrases, cut where a trigger's
hash says so. A phrase is the bytes of all its windows.

* The dictionary is the distinct phrases, the parse their places in the corpus.
  All windows of a phrase that occurred before are repeats.
* Of the first occurrences, a window whose trigger hash occurs once in the whole
  dictionary is unique. The stretches around the other triggers are dealt by
  trigger hash, and each task builds the suffix array of its distinct stretches,
  to the depth of LENGTH bytes. Neighbours in it that agree so far are one string; in
  corpus order (doc_id, start) all but its first place are repeats.
* A trigger hash with very many places is dealt over several groups; the strings
  that are first in their group meet once more by their hash.

So copies cost a phrase each, unique text a trigger each, and only stretches
that may hold repeats are moved as bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, give_back, map_arrow, utf8, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: A phrase ends after one trigger in CUT, or after MOST_TRIGGERS of them.
CUT, MOST_TRIGGERS = 12, 64
#: Window starts handled at once; bytes of a suffix array; places of a trigger in one group.
CHUNK, BLOCK, GROUP = 1 << 18, 2 << 20, 512

_U = np.uint64
_LOW = _U((1 << 20) - 1)
_TRIGGER = np.dtype([("h", "<i8"), ("at", "<u4"), ("n", "<u2")])
#: Before every id: the place of documents without one.
NO_ID = -(1 << 63)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, the powers of an odd base modulo 2^64, and those of its inverse."""
    base = 0x9E3779B97F4A7C15
    numbers = np.random.Generator(np.random.PCG64(5)).integers(1 << 64, size=256, dtype=np.uint64)
    each = [np.cumprod(np.append(_U(1), np.full(n - 1, _U(b)))) for b in (base, pow(base, -1, 1 << 64))]
    return numbers, *each


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of the GRAM bytes at every place of a byte array, of at most CHUNK + LENGTH bytes.

    One place on, the byte that leaves is subtracted, the rest divided by the base
    and the byte that enters added with the highest power: done for all places
    at once, by differences of running sums.
    """
    numbers, power, inverse = _powers(CHUNK + LENGTH)
    n = len(a) - GRAM + 1
    sums = numbers[a]
    sums *= power[: len(a)]
    np.cumsum(sums, out=sums)
    h = sums[GRAM - 1 :].copy()
    h[1:] -= sums[: n - 1]
    h *= inverse[:n]
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def triggers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window start and number of windows of the triggers of a text, in order."""
    windows = len(data) - LENGTH + 1
    a = np.frombuffer(data, np.uint8)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, max(0, windows), CHUNK):
        n = min(CHUNK, windows - at)
        h = gram_hashes(a[at : at + n + LENGTH - 1])
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= SPAN:
            v = np.minimum(v[:-reach], v[reach:])
            reach *= 2
        if reach < SPAN:
            v = np.minimum(v[: reach - SPAN], v[SPAN - reach :])
        place = (v & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out[0].append(h[place[first]])
        out[1].append(first + at)
        out[2].append(np.diff(np.append(first, n)))
    if not out[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in out)


def phrases(h: np.ndarray) -> np.ndarray:
    """Where phrases of a row of triggers begin, and its end."""
    ends = np.flatnonzero((h >> _U(20)) % _U(CUT) == 0) + 1
    ends = np.unique(np.concatenate([[0], ends, [len(h)]]))
    long = np.flatnonzero(np.diff(ends) > MOST_TRIGGERS)
    more = [np.arange(ends[i], ends[i + 1], MOST_TRIGGERS) for i in long]
    return np.unique(np.concatenate([ends, *more])) if more else ends


PHRASE_SCHEMA = "phrase binary, doc_id long, rid long, start long, n long, triggers binary"


def parse(rows: DataFrame) -> DataFrame:
    """A row of PHRASE_SCHEMA for every phrase of every document (doc_id, rid, data)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, rid, x in zip(b.column("doc_id").to_pylist(), b.column("rid").to_pylist(), b.column("data"), strict=True):
            data = x.as_py()
            if len(data) < LENGTH:
                continue
            h, at, n = triggers(data)
            t = np.empty(len(h), _TRIGGER)
            t["h"], t["n"] = h.view(np.int64), n
            cut = phrases(h)
            starts = at[cut[:-1]]
            t["at"] = at - np.repeat(starts, np.diff(cut))
            ends = np.append(starts[1:], len(data) - LENGTH + 1)
            view, packed = memoryview(data), t.tobytes()
            size = _TRIGGER.itemsize
            for s, e, i, j in zip(starts.tolist(), ends.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for o, v in zip(out, (xxhash.xxh3_128_digest(view[s : e + LENGTH - 1]), doc_id, rid, s, e - s, packed[i * size : j * size]), strict=True):
                    o.append(v)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], ["phrase", "doc_id", "rid", "start", "n", "triggers"])

    return map_arrow(rows.select("doc_id", "rid", "data"), run, PHRASE_SCHEMA)


def explode_triggers(dictionary: DataFrame) -> DataFrame:
    """h, pid and place (offset in the phrase * 128 + number of windows) of every trigger of the dictionary."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        each = [len(x) // _TRIGGER.itemsize for x in b.column("triggers").to_pylist()]
        t = np.frombuffer(b"".join(b.column("triggers").to_pylist()), _TRIGGER)
        place = t["at"].astype(np.int64) * 128 + t["n"]
        return pa.RecordBatch.from_arrays([pa.array(t["h"]), pa.array(np.repeat(b.column("pid").to_numpy(), each)), pa.array(place)], ["h", "pid", "place"])

    return map_arrow(dictionary.select("pid", "triggers"), run, "h long, pid long, place long")


def suffix_classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``buf`` to the depth of LENGTH bytes, and each place's class of equal strings.

    Ranks of 8 bytes are doubled to 64 and then combined to LENGTH. Places within
    LENGTH of the end are padded with zeros.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(LENGTH, np.uint8)])
    key = np.ndarray((n,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)

    def rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        k = key[order]
        r = np.empty(n, np.uint64)
        r[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        return order, r

    order, r = rank(key)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        after = np.zeros(n, np.uint64)
        after[: max(0, n - step)] = r[step:]
        order, r = rank((r << _U(32)) | after)
        depth += step
    return order, r


STRETCH_SCHEMA = "h long, salt int, salted boolean, doc_id long, rid long, start long, data binary"
FOUND_SCHEMA = "doc_id long, rid long, start long, n long, string binary"


def stretches(rows: DataFrame) -> DataFrame:
    """The bytes around suspect triggers: rows (doc_id, rid, data, suspects: array of start, n, h, salt, salted)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, rid, x, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "data", "suspects")), strict=True):
            out += [(y["h"], y["salt"], y["salted"], doc_id, rid, y["start"], x[y["start"] : y["start"] + y["n"] + LENGTH - 1]) for y in s]
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in STRETCH_SCHEMA.split(", ")])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                yield run(b.slice(k, 500))
        give_back()

    return rows.mapInArrow(batches, STRETCH_SCHEMA)


def repeats(dealt: DataFrame) -> DataFrame:
    """Rows of FOUND_SCHEMA from stretches that lie together by (h, salt).

    With a null string: ``n`` window starts from ``start`` on are repeats. With
    one (the 128-bit hash of a window): the first place of that window in a group
    of a trigger that has several groups.
    """

    def block(rows: list[tuple]) -> list[tuple]:
        _, _, salted, doc, rid, start, data = zip(*rows, strict=True)
        sizes = np.array([len(x) for x in data])
        buf = np.frombuffer(b"".join(data), np.uint8)
        order, rank = suffix_classes(buf)
        own = np.repeat(np.arange(len(rows)), sizes)
        first = np.cumsum(sizes) - sizes
        inside = np.arange(len(buf)) - first[own]
        is_window = inside <= sizes[own] - LENGTH
        p = order[is_window[order]]  # windows in suffix order
        # corpus order in one number: the document's place among those here, then the place in it
        by_doc = np.lexsort((np.array(rid), np.array(doc)))
        changed = [False, *((doc[x], rid[x]) != (doc[y], rid[y]) for x, y in zip(by_doc[1:].tolist(), by_doc[:-1].tolist(), strict=True))]
        base = np.empty(len(rows), np.int64)
        base[by_doc] = np.cumsum(changed) << 40
        base += np.array(start)
        place = base[own[p]] + inside[p]
        new = np.concatenate([[True], rank[p[1:]] != rank[p[:-1]]])
        group = np.cumsum(new) - 1
        again = place != np.minimum.reduceat(place, np.flatnonzero(new))[group]
        flag = np.zeros(len(buf), bool)
        flag[p[again]] = True
        out = []
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2).tolist():
            while a < b:  # a run may go on in the next stretch
                i = own[a]
                e = min(b, first[i] + sizes[i])
                out.append((doc[i], rid[i], start[i] + int(a - first[i]), int(e - a), None))
                a = e
        if any(salted):
            held = memoryview(buf)
            known = np.flatnonzero(~again)  # one place, which may lie in several stretches, for each string
            known = known[np.concatenate([[True], group[known[1:]] != group[known[:-1]]])]
            for x in p[known[np.array(salted)[own[p[known]]]]].tolist():
                i = own[x]
                out.append((doc[i], rid[i], start[i] + int(x - first[i]), 1, xxhash.xxh3_128_digest(held[x : x + LENGTH])))
        return out

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(found), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*found[k : k + 20_000], strict=True), types, strict=True)], [c.split()[0] for c in FOUND_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # distinct stretches, for the suffix array
        size = 0
        key: tuple = ()
        first: dict[bytes, tuple] = {}  # of one key: a stretch's first place
        whole: list[tuple] = []  # equal stretches elsewhere: all their windows are repeats

        def close() -> None:
            nonlocal size
            if len(first) > 1 or first and key[2]:  # a stretch that is alone under its trigger shares no window
                held.extend((*key, *place, data) for data, place in first.items())
                size += sum(map(len, first))
            first.clear()

        for b in batches:
            for h, salt, salted, doc, rid, start, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if key[:2] != (h, salt):
                    close()
                    key = (h, salt, salted)
                    if size >= BLOCK:
                        yield from emit(block(held))
                        held, size = [], 0
                    if len(whole) >= 20_000:
                        yield from emit(whole)
                        whole = []
                place = (doc, rid, start)
                known = first.setdefault(data, place)
                if place != known:
                    least, later = min(place, known), max(place, known)
                    first[data] = least
                    whole.append((*later, len(data) - LENGTH + 1, None))
        close()
        if held:
            yield from emit(block(held))
        yield from emit(whole)
        give_back()

    return dealt.mapInArrow(run, FOUND_SCHEMA)


def row_key(data: Column) -> Column:
    """Tells rows with one doc_id apart by their texts."""
    return F.xxhash64(data)


def repeated_starts(rows: DataFrame) -> DataFrame:
    """doc_id, rid, start, n: all window starts that repeat an earlier window, as runs (rows: doc_id, rid, data)."""
    parsed = written(parse(rows), "parse")
    place = F.struct("doc_id", "rid", "start")
    dictionary = parsed.groupBy("phrase").agg(F.min_by(F.struct("doc_id", "rid", "start", "triggers"), place).alias("x")).select("phrase", "x.*", F.monotonically_increasing_id().alias("pid"))
    dictionary = written(dictionary, "dictionary")
    firsts = dictionary.select("phrase", F.struct("doc_id", "rid", "start").alias("first"))
    whole = written(parsed.select("phrase", "doc_id", "rid", "start", "n").join(firsts, "phrase").filter(place != F.col("first")).select("doc_id", "rid", "start", "n"), "repeated-phrases")
    drop_written(parsed)

    places = explode_triggers(dictionary)
    shared = written(places.groupBy("h").agg(F.count(F.lit(1)).alias("places")).filter("places > 1"), "shared-triggers")
    suspects = places.join(shared, "h").join(dictionary.select("pid", "doc_id", "rid", F.col("start").alias("from")), "pid")
    salts = F.ceil(F.col("places") / GROUP).cast("int")
    start = F.col("from") + F.shiftright("place", 7)
    suspects = written(suspects.select("doc_id", "rid", start.alias("start"), F.col("place").bitwiseAND(F.lit(127)).alias("n"), "h", F.pmod(F.xxhash64("pid", "place"), salts).cast("int").alias("salt"), (F.col("places") > GROUP).alias("salted")), "suspects")
    drop_written(dictionary)

    by_row = suspects.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n", "h", "salt", "salted")).alias("suspects"))
    dealt = stretches(rows.join(by_row, ["doc_id", "rid"])).repartition("h", "salt").sortWithinPartitions("h", "salt")
    found = written(repeats(dealt), "repeats")
    some = found.filter("string IS NOT NULL").select("string", "doc_id", "rid", "start")
    least = written(some.groupBy("string").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1").select("string", "first"), "strings")
    later = some.join(least, "string").filter(place != F.col("first")).select("doc_id", "rid", "start", F.lit(1).cast("long").alias("n"))
    return whole.unionAll(found.filter("string IS NULL").select("doc_id", "rid", "start", "n")).unionAll(later)


def remove(docs: DataFrame) -> DataFrame:
    """row (all columns of the document), id, n_bytes, n_removed, n_spans, kept_sha256, kept and kept_text of every row.

    ``kept`` are the remaining bytes; ``kept_text`` is what they spell without the
    rests of characters that a cut fell into, and null where nothing was removed.

    A null text is empty; texts under LENGTH bytes lose nothing. Rows that share a
    doc_id are taken in the order of a hash of their texts, and equal rows are one
    document: neither is earlier than the other. Rows without a doc_id come before
    all others. Strings never cross documents.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8().alias("data")).withColumn("rid", row_key(F.col("data")))
    starts = repeated_starts(rows.select("doc_id", "rid", "data"))
    by_row = starts.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(by_row, ["doc_id", "rid"], "left").select("row", "id", "data", "runs")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, runs in zip(b.column("data"), b.column("runs").to_pylist(), strict=True):
            data = x.as_py()
            if not runs:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data, None))
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            s, n = (np.array([r[k] for r in runs]) for k in ("start", "n"))
            np.add.at(edge, s, 1)
            np.add.at(edge, s + n + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True))
        names, types = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["row", "id", *names])

    kind = joined.schema["row"].dataType.simpleString()
    return map_arrow(joined, run, f"row {kind}, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string")

