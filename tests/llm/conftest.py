import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (3, "Alpha beta, gamma delta epsilon zeta eta theta.", "x"),
    (1, None, "x"),
    (None, "A text without an id, of more than five words.", None),
    (5, "", "y"),
    (8, LONG, "y"),
    (9, "Alpha beta, gamma delta epsilon zeta eta theta.", "y"),
    (9, "Alpha beta, gamma delta epsilon zeta eta theta.", "y"),
    (12, "  two\n\n words ", "z"),
    (13, "ÉCOLE Ünïcode 字 İ <|endoftext|>", "z"),
]
CLASHES = ["row", "rid", "token", "digest", "label", "score", "word", "n", "c", "at", "guest", "term", "payload", "key", "signature", "component_id", "kept"]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty, very long and repeated rows, and columns with names that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.selectExpr("*", *[f"'clash' AS {c}" for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
