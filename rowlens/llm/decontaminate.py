"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of every 8 consecutive hashes of 6-word runs the smallest is kept (the last of
equals). Any 13 words in common then have a kept hash in common, at the same
place in both, so joining the kept hashes of documents and benchmark items finds
a seed in every shared window. Around each seed the document's windows are
spelled out and joined with those of the items, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .native_words import grams, row_key, words

WINDOW, GRAM = 13, 6
#: A gram's hash (32 bits) and place (31 bits, counted down so that the minimum is the last of equals) in one number.
PLACE = (1 << 31) - 1
#: Columns that tell rows apart by id and text.
KEY = ["k1", "k2"]



def _least_two(name: str, step: int) -> Column:
    """The smaller of each number and the one ``step`` places on."""
    g = F.col(name)
    pairs = F.transform(F.sequence(F.lit(0), F.size(g) - step - 1), lambda i: F.least(g[i], g[i + step]))
    return F.when(F.size(g) > step, pairs).otherwise(F.array().cast("array<bigint>"))


def _kept(df: DataFrame) -> DataFrame:
    """Adds ``kept``: the winnowed numbers of ``w``. The span of WINDOW - GRAM + 1 = 8 is reached by doubling."""
    span = WINDOW - GRAM + 1
    df = df.withColumn("g", grams("w", GRAM))
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(PLACE).cast("bigint") - i)
    df = df.withColumn("g", F.transform("g", pack))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        df = df.withColumn("g", _least_two("g", step))
        reach += step
    return df.withColumn("kept", F.array_distinct("g")).drop("g")


def _seeds(df: DataFrame, lengths: list[int]) -> DataFrame:
    """n, key and at of the seeds of ``w``, beside the other columns: kept hashes (n is WINDOW), and all runs of each of ``lengths`` words."""
    kept = F.transform("kept", lambda x: F.struct(F.lit(WINDOW).alias("n"), F.shiftright(x, 31).alias("key"), (F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE))).cast("int").alias("at")))
    every = lambda n: F.transform(grams("w", n), lambda h, i: F.struct(F.lit(n).alias("n"), h.alias("key"), i.alias("at")))
    runs = [every(n) for n in lengths]
    rest = [c for c in df.columns if c != "w"]
    return _kept(df).select(*rest, F.explode_outer(F.concat(kept, *runs)).alias("s")).select(*rest, "s.*")


def _windows(n: Column, first: Column, last: Column) -> Column:
    """a, n and x (the words) of the windows of ``n`` words of ``w`` that start from ``first`` to ``last``."""
    starts = F.when(first <= last, F.sequence(first, last))
    return F.transform(starts, lambda a: F.struct(a.alias("a"), n.alias("n"), F.array_join(F.slice("w", a + 1, n), " ").alias("x")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item and x, the distinct windows of each item: WINDOW words, or all of a shorter item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(WINDOW), F.size("w"))
    return items.select("item", F.explode_outer(_windows(n, F.lit(0), F.size("w") - n)).alias("s")).select("item", "s.x").distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """KEY, n_words, n_hit and items of the rows that hold a window of an item; one for equal rows (id and text).

    The documents' texts are read where they are; what is shuffled are seeds of
    the benchmark that were found, and the texts of the rows that hold some. Those
    rows are picked by their keys alone (8 bytes each): while Spark measures that
    these can be broadcast, no other text moves.
    """
    items = benchmark.select(words(F.col("text")).alias("w"))
    lengths = sorted(r[0] for r in items.select(F.size("w").alias("n")).filter(f"n BETWEEN 1 AND {WINDOW - 1}").distinct().collect())
    long = _seeds(items.filter(F.size("w") >= WINDOW), []).select("n", "key")
    short = _seeds(items.filter(F.size("w") < WINDOW).withColumn("size", F.size("w")), lengths).filter(F.col("n") == F.col("size")).select("n", "key")
    known = written(long.unionAll(short).filter("key IS NOT NULL").distinct(), "benchmark-seeds")
    spelled = written(item_windows(benchmark), "benchmark-windows")

    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text"))
    seeds = _seeds(rows.select(*KEY, words(F.col("text")).alias("w")), lengths)
    found = written(seeds.join(known, ["n", "key"], "left_semi").select(*KEY, "n", "at").distinct(), "seeds")
    some = written(found.select("k1").distinct(), "seeded-rows")
    affected = rows.join(some, "k1", "left_semi").dropDuplicates(KEY).select(*KEY, words(F.col("text")).alias("w"))
    places = found.groupBy(*KEY).agg(F.collect_set(F.struct("n", "at")).alias("seeds"))
    around = lambda s: _windows(s["n"], F.when(s["n"] < WINDOW, s["at"]).otherwise(F.greatest(F.lit(0), s["at"] - (WINDOW - GRAM))), F.least(s["at"], F.size("w") - s["n"]))
    near = affected.join(places, KEY).select(*KEY, F.size("w").cast("long").alias("n_words"), F.explode_outer(F.array_distinct(F.flatten(F.transform("seeds", around)))).alias("s"))
    near = written(near.select(*KEY, "n_words", "s.*"), "document-windows")

    spans = near.join(spelled.select("x").distinct(), "x", "left_semi").groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("a", (F.col("a") + F.col("n")).alias("e")))).alias("spans"))
    named = near.select(*KEY, "x").distinct().join(spelled, "x").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["e"]).alias("end"))
    return spans.select(*KEY, "n_words", F.aggregate("spans", start, step, lambda acc: acc["n"]).cast("long").alias("n_hit")).join(named, KEY)


#: The contamination rule.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (the carried columns), n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    A word inside any occurrence of a window of any item is hit. A null text has
    no words and is clean; an item without words has no window; items with one
    id count once, and an item without id hits words but is in no count of items.
    Rows that share a doc_id (or lack one) are each judged by their own words:
    rows are told apart by a hash of id and text, and equal ones are equal.

    Only the distinct lengths of short items (12 numbers at most) reach the
    driver. Whether the benchmark's seeds and windows are broadcast is left to
    Spark, which goes by their measured size; beyond it both sides are shuffled.
    """
    found = written(hits(docs, benchmark).select(*KEY, "n_hit", "items"), "contamination")
    rows = docs.select(F.struct(*carry).alias("row"), *row_key(F.col("doc_id"), F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.join(found, KEY, "left").select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), items.alias("items"))
    return out.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, in all their columns.

    An anti join on the keys of the contaminated rows: no text moves while these can be broadcast.
    """
    bad = written(hits(docs, benchmark).filter(CONTAMINATED).select(*KEY), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    return rows.join(bad, KEY, "left_anti").select("row.*")
