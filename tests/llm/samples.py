"""Texts and rows for tests."""

import random

CLASHING = "row string, id string, data string, w string, rid string, start string, score string, seeds string, hits string, found string, g string, n int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def document(i, text):
    return (i, text, None, "s", None if text is None else len(text), "r", None, "d", "w", "5", "0", "x", "y", "z", "f", "g", 3)
