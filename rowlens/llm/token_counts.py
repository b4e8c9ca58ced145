"""Token counts of whole texts, huge ones in overlapping chunks.

A text over ``chunk`` characters is encoded in chunks that overlap. Two
neighbours are spliced at a boundary that both have and that provably holds in
the whole text: a token start at a space or line feed after a character that is
no white space. No match of the byte-level pattern, and no added token, holds
white space after another character, and matching never looks back, so what
follows such a place is encoded alike wherever the chunk began. If the overlap
has no such place it is widened, at last to the whole rest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

CHUNK, OVERLAP = 32_768, 256
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@functools.cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace() and ord(text[at - 1]) > 32


def resynchronised(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(id, start, end) of the tokens of a whole text, encoded chunk by chunk."""

    def encode(lo: int, hi: int) -> list[tuple[int, int, int]]:
        e = tok.encode(text[lo:hi], add_special_tokens=False)
        return [(i, lo + a, lo + b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    out: list[tuple[int, int, int]] = []
    lo, hi, since = 0, min(len(text), chunk), 0
    left = encode(lo, hi)
    while hi < len(text):
        width = overlap
        while True:
            start = max(since, hi - width)
            if start <= since and width > hi - since:  # no common boundary in all of this chunk: a longer one
                hi = min(len(text), hi + 2 * (hi - since))
                left = encode(since, hi)
                break
            end = min(len(text), start + max(chunk, 2 * width))
            right = encode(start, end)
            common = {s for _, s, _ in right if start < s < hi and stable(text, s)} & {s for _, s, _ in left}
            if common:
                at = max(common)
                out += [t for t in left if since <= t[1] < at]
                left, lo, hi, since = right, start, end, at
                break
            width *= 2
    return out + [t for t in left if t[1] >= since]


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; a null text has none of either.

    Nothing is shuffled; repeated rows give repeated rows. ``path`` is the
    tokenizer's file on every executor (byte_bpe_50k.json where it is None).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            tok = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            tok = tokenizer(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for k in range(0, len(short), 64):
                own = short[k : k + 64]
                for i, e in zip(own, tok.encode_batch_fast([texts[i] for i in own], add_special_tokens=False), strict=True):
                    n[i] = len(e)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = len(resynchronised(tok, t, chunk, overlap))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, SCHEMA)
