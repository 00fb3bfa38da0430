import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside must not trip over columns of the input.
CLASH = ("key id n size kept seed block copies target source_size rate word body doc words full head group_size "
         "component gap best left right pos low held_out ids text_sha256 __gone __key __copies __turn ___gone").split()


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASH})


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    import random
    rng = random.Random(5)
    words = ["w%d" % i for i in range(4000)]
    long = sentence(rng, 60_000, words)
    copy = sentence(rng, 120, words)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "no id", "en", "b", 5),
        (4, "one", "en", "b", 3), (5, long, "en", "a", 1), (6, copy, "en", "b", 2), (7, copy, "de", None, 2),
        (7, copy, "de", None, 2), (8, copy + " more", "de", "c", 2), (9, "日本語 \U0001F600 é\x00x", "ja", "c", 3),
        (10, "x" * 50_000, "en", "c", 9), (11, "| " * 20_000, "en", "c", 9), (12, "!! " * 20_000, "en", None, 9),
        (None, None, None, None, None)]
    return with_clashes(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], DOCS))


@pytest.fixture(autouse=True, scope="session")
def settings(spark):
    from roompulse.llm.queries import prepared
    prepared(spark)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
