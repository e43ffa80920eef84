import re

import pytest

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONBLANK = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(FOLD))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, one very long text, and columns with names that operators use."""
    prose = " ".join(f"word{i % 97} of{i % 13}" for i in range(60))
    rows = [(None, None, None), (None, prose, "x"), (1, "", "x"), (2, prose, "x"), (2, prose, "x"), (3, prose + " more", None), (4, "one two", "y"),
            (5, "tok " * 300_000, "y"), (6, "é😀 API_KEY = 'abcdefghijkl'", "z")]
    return spark.createDataFrame([(i, t, s, 0, "k", 0.5) for i, t, s in rows], "doc_id long, text string, source string, size int, law string, toxicity double")
