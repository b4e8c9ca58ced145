import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import DOCS, document, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text) with distinct ids: copies, near copies, shared passages, empty, null and very long texts."""
    base, passage, long = prose(1, 120), prose(2, 60), prose(3, 12_000)
    changed = base.split()
    changed[50] = "other"
    texts = [base, base, " ".join(changed), base.upper(), None, "", " \n\t", "one", "one two three", "one two three", passage, prose(4, 40) + " " + passage + " " + prose(5, 40), prose(6, 30) + "\n" + passage, long, long + " end", "a" * 5_000, "é" * 300, "x" * 99, "y" * 100, "y" * 101, "MIT License and the GNU General Public License, or Apache License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, mit\nlicense", "<|endoftext|> a <|endoftext|>b  c d 🙂🙂 e", "ÀÉ İK K k ſ"]
    return list(enumerate(texts, 10))


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """odd_texts as documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([document(i, t) for i, t in odd_texts], DOCS).repartition(3)


@pytest.fixture(scope="session")
def repeated_docs(spark, odd_texts):
    """The same with every row twice, rows without an id, and one id with two texts."""
    rows = [document(i, t) for i, t in odd_texts] * 2 + [document(None, "no id " + prose(9, 50)), document(None, None), document(11, prose(8, 50))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
