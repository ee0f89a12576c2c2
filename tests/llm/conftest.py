import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def base(spark):
    """A small table of the driver's, as rows."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(base):
    """Rows with nulls, empty, blank and very long texts, copies and an edited copy, under ids of their own."""
    long = " ".join(t for _, t, *_ in base[:40] if t) * 3
    text = base[1][1]
    words = text.split()
    edited = " ".join([*words[:20], "changed", *words[21:]])
    texts = [None, "", "   ", "a", "one two", "ONE two", long, long + " end", text, text, edited, "x" * 300, "x" * 300, "a@b.c +1 (555) 123-4567", "é" * 201, "\n\n", "x  y   z", "<|endoftext|> a<|endoftext|>"]
    return [(10_000 + i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "srcz", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, base, odd):
    """Documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(base + odd, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(7) for c in ("size", "fp", "node", "score", "bucket", "h", "take", "key", "windows", "held_out", "n_bytes", "target")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(base, odd):
    return base + odd
