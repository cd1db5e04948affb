import duckdb
import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = " ".join(f"word{i % 997} and{i}" for i in range(60_000))

# Nulls in every column, empty and blank texts, a very long one, repeated rows, ids that repeat.
ODD_ROWS = [
    (None, None, None, None, None),
    (None, "A text without an id, which is long enough to hold some words.", None, "src1", None),
    (1, None, "en", None, 0),
    (2, "", "en", "src1", 0),
    (3, " \t\n\r\x0b\x0c ", "de", "", 7),
    (4, LONG, "en", "src0", len(LONG)),
    (5, "the same row twice over\nand once more", "en", "src0", 37),
    (5, "the same row twice over\nand once more", "en", "src0", 37),
    (6, "... !!! ###\n\n\n***", "fr", "src2", 16),
    (7, "Ünïcödé ßtraße — “quoted”  and\u00a0spaces\u3000here 漢字 🙂 end", "de", "src2", 50),
    (8, "one", "es", "src3", 3),
    (9, "THE SAME ROW TWICE OVER\nAND ONCE MORE", "en", "src3", 37),
]

CLASHING = (
    "host path rule verdict score predicted held_out fingerprint component_id kept n_words base_failed bound fp row "
    "start n_tokens ids_crc32 part lang_pred item_id digest key id h words w draw probability c0 section value lines line n"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns of names that operators use."""
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "documents pages labels benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (6, None, None), (None, 1, 1), (9, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
