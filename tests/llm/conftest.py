import pytest


@pytest.fixture(autouse=True)
def prepared(spark):
    from tessera.llm.shared import prepare

    prepare(spark)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, copies, clashing column names."""
    from itertools import chain

    long = " ".join(f"w{k % 700}x{k % 13}" for k in range(30_000))
    base = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, None, None, None), (2, "", "en", "src0"), (3, " \t\n ", "en", "src0"), (4, long, "en", "src1"), (5, base, "de", "src2"), (5, base, "de", "src2"), (6, base, "fr", None),
        (7, base + " tail", "es", "src3"), (7, "another text for the same id", "es", "src3"), (None, base + " null id", "xx", "src4"), (None, None, None, "src4"), (8, "one", "en", "src5"), (9, "one", "en", "src5"),
        (10, "a\x00b \x1cc\x85d é f  g", "en", "src0"), (11, "x " * 60, "en", "src0"),
    ]
    extra = [f"own{k}" for k in range(len(rows))]
    names = "doc_id long, text string, lang string, source string, n_words string, kept string, topic string, k1 string, fp string, _hits string"
    return spark.createDataFrame([tuple(chain(r, [e] * 6)) for r, e in zip(rows, extra)], names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
