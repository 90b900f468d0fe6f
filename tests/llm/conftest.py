import pytest

DIR = "/root/testdata/sf0.001"

#: Rows that every text operator must bear: null and empty texts, a null id,
#: a repeated row, one id with two texts, long and odd texts, clashing columns.
EDGES = [(100001, None), (100002, ""), (100003, "\n\n\n"), (None, "a text without an id that is ten words long or more"),
         (100004, "same row"), (100004, "same row"), (100005, "one id two texts first"), (100005, "one id two texts second"),
         (100006, "word " * 30_000), (100007, "x" * 50_000), (100008, "\u0085   \x1f\x1c odd\tspaces\x0b\x0cİΣς \U0001F600"),
         (-5, "negative id")]
CLASH = ("score string, predicted string, kept string, n_lines string, n_dropped string, host string, path string, "
         "rule string, verdict string, sequence_id string, component_id string, key string, start string, length string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def edges(spark):
    """EDGES with further columns whose names operators use themselves."""
    extra = [("e",) * len(CLASH.split(", "))] * len(EDGES)
    return spark.createDataFrame([(*r, *x) for r, x in zip(EDGES, extra)], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
