import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, rep string, node int, w int, x string, size int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty, blank, short, very long and repeated texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 613}." for i in range(30_000))
    texts = [None, "", " \n\t", "one", "Some words of a line here.", "some  words of a LINE here.", "Some words of a line here.", long, long + " end", "mail a@b.cd or +44 20 7946 0958 now", "ein kurzer Text mit ö und ß", "　中文 \U0001f600 é", "| a | b |\n| a | b |\n| a | b |"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", None, "s1"][i % 3], None if t is None or i % 5 == 0 else len(t)) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3), (None, "Some words of a line here.", "en", "s0", 26), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 7, "k", "r", 1, 2, "x", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
