import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import SMALL  # noqa: E402

CLASHING = ["id", "tk", "n_tokens", "ids", "score", "held_out", "pool", "slot", "part", "h", "k", "share", "keep", "n_lines", "text_", "spans", "label", "x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids,
    and further columns named like the operators' own."""
    long = "word%d more text, with some lines\nand a very repetitive line that is longer than forty characters\n"
    rows = [
        (None, "a null id, and a text with five words and more", "en", "s1"), (1, None, "en", None), (2, "", None, "s1"), (3, " \t\n \n", "en", "s2"),
        (4, "".join(long % i for i in range(3000)), "en", "s1"), (5, "the same row twice over here", "en", "s3"), (5, "the same row twice over here", "en", "s3"),
        (6, "one id", "en", "s1"), (6, "with two texts", "en", "s1"), (7, "x" * 50_000, None, "s9"), (8, "9" * 30_000 + " a.b" * 20_000, "de", "s1"),
        (9, "mail a.b@c-d.example.org or 10.0.0.1 or +1 (555) 010-9999, <|endoftext|> é ß 你好 Σ \x1c \x85 \x00", "en", "s1"), (None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHING) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
