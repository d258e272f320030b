import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, shard string"
LONG = "word " * 3 + " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LINE = "This very line stands in rather many documents of the set."


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"t{i}" for i in range(80))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One TWO"), (6, base), (7, base.replace("t40", "x")), (8, base.upper()), (9, LONG), (10, LONG + " end"),
        (11, PASSAGE + " a b c"), (12, "q r s " + PASSAGE), (13, PASSAGE), (13, PASSAGE), (None, PASSAGE), (None, None), (14, "über straße 漢字 🙂 a@b.example.org"),
        *[(20 + i, f"first line number {i}\n  {LINE if i % 2 else LINE.upper()}\t\nlast {i}") for i in range(6)],
    ]
    return spark.createDataFrame([(d, t, "en", "s" if d else None, None, "clash", None) for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
