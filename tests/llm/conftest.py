import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents of (id, text[, source]); with extra columns whose names operators use."""
    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        if not clash:
            return spark.createDataFrame(full, DOCS)
        extra = "score double, shard int, size long, print binary, item_id long, slot string"
        return spark.createDataFrame([(*r, 0.5, 7, 9, b"x", 3, "y") for r in full],
                                     f"{DOCS}, {extra}")
    return make


@pytest.fixture
def sample(spark):
    def read(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")
    return read


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30_000
ODD = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (5, LONG),
       (6, "Ünïcödé — 漢字 😀 text"), (7, "\x00 control \x1f"), (8, "a b c d e f g")]
