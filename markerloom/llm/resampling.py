"""Importance resampling towards a target distribution, with hashed n-gram features.

Words are runs of digits, letters and non-ASCII characters; features are all runs of one to three words, hashed into buckets.
Every bucket has a gain, the log ratio of its smoothed shares in the target and in the corpus, as an array that each task
holds (its size is the number of buckets, whatever the corpus). A document's weight is the sum of its features' gains and its
score adds Gumbel noise keyed by the document, so that the highest scores are a draw without replacement in proportion to the
exponentials of the weights.

The draw sorts nothing but what is drawn. Scores are stored once; their cutoff is found by repeated exact counts over that
table, each cutting the range of numbers that is left into SECTIONS parts, and a second search of the same kind decides among the
documents that have just the cutoff score. The selected rows are range-partitioned by score, and a rank is a row's place in its
partition plus the sizes of the partitions before it.

Defined results: a null text has no words, weight 0, and is never drawn as it has less than MIN_WORDS words. A null key counts as an empty
text in the noise and comes last among equal scores. Repeated rows are rows of their own: equal scores and keys are drawn in the
order of their place in the stored table. An empty table gives an empty one; an empty target has the same smoothed share
everywhere. Extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm.common import appended, fresh, slices, stored, utf8

WIDTH, BUCKETS, SCALE, SEED = 3, 10_000, 1000, 42
MIN_WORDS = 20
SHARE = (5, 100)
# Parts that one count cuts the range of possible cutoffs into.
SECTIONS = 16
# Words of a text that are turned into features at a time.
WORDS = 1 << 16

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_GAP = crc32(b" ")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _byte_tables(length: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """(4, 256): what each byte of a checksum becomes when `length` more bytes follow.

    The checksum of two texts one after the other is that of the first, moved on by the length of the second, xor that of the
    second; moving on is linear in the bits. Tables of longer words are not kept.
    """
    if length in known:
        return known[length]
    zeros, plain = bytes(length), crc32(bytes(length))
    # crc32(zeros, x) is x moved on, xor the checksum of the zeros alone.
    bits = np.array([crc32(zeros, 1 << i) ^ plain for i in range(32)], np.uint64)
    table = np.zeros((4, 256), np.uint64)
    for byte in range(4):
        for i in range(8):
            table[byte] ^= np.where(np.arange(256) >> i & 1, bits[8 * byte + i], np.uint64(0))
    if length <= 64:
        known[length] = table
    return table


def _moved(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each checksum after as many more bytes as its length says."""
    distinct, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([_byte_tables(int(n)) for n in distinct])
    out = np.zeros(len(sums), np.uint64)
    for byte in range(4):
        out ^= tables[which, byte, (sums >> np.uint64(8 * byte)).astype(np.int64) & 255]
    return out


def feature_buckets(words: list[bytes], width: int = WIDTH, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to `width` words joined by one space, in bounded pieces: crc32 of the run modulo `buckets`."""
    for at in range(0, len(words), WORDS):
        # A piece owns the runs that start in it.
        part = words[at : at + WORDS + width - 1]
        own = min(WORDS, len(words) - at)
        first = np.fromiter(map(crc32, part), np.uint64, len(part))
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        later = _moved(np.full(len(part), _GAP, np.uint64), lengths) ^ first
        run = first
        yield (run[:own] % np.uint64(buckets)).astype(np.int64)
        for k in range(1, width):
            if len(part) <= k:
                break
            run = _moved(run[:-1], lengths[k:] + 1) ^ later[k:]
            yield (run[:own] % np.uint64(buckets)).astype(np.int64)


def feature_counts(texts: DataFrame, text: str, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row per bucket."""
    body = fresh("text", [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for t in utf8(part.column(0)):
                for run in feature_buckets(words_of(t), width, buckets):
                    found += np.bincount(run, minlength=buckets)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text).alias(body)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.toLocalIterator():  # `buckets` rows at most
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole-numbered log ratios of the add-one shares, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def noise(key: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Whole-numbered Gumbel noise of the first 32 bits of sha256 of `seed:key`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: np.ndarray, key: str, text: str, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(part: pa.RecordBatch) -> list[pa.Array]:
        table, out = shared.value, []
        for t in utf8(part.column("text")):
            words, weight = words_of(t), 0
            for run in feature_buckets(words, width, len(table)):
                weight += int(table[run].sum())
            n = len(words)
            out.append((n, sum(max(0, n - k) for k in range(width)), weight))
        return [pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    rows = appended(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), fields, weigh).drop("text")
    return rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def cutoff(rows: DataFrame, value: Column, wanted: int) -> tuple[int, int] | None:
    """The largest whole number that at least `wanted` rows reach, and how many rows lie above it.

    Every count is one job over `rows`, which should be a stored table; None if there are fewer rows.
    """
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).first()
    if wanted <= 0 or ends.n < wanted:
        return None
    low, high, above = ends.low, ends.high, 0
    # `low` is reached by enough rows, high + 1 by `above`, which are too few.
    while low < high:
        marks = sorted({low + (high - low + 1) * i // SECTIONS for i in range(1, SECTIONS)} - {low})
        got = rows.agg(*(F.count_if(value >= F.lit(m)).alias(f"n{i}") for i, m in enumerate(marks))).first()
        for m, n in zip(marks, got):
            if n >= wanted:
                low = m
            else:
                high, above = m - 1, n
                break
    return low, above


def drawn(rows: DataFrame, wanted: int) -> DataFrame:
    """`rank` 1, 2, 3, ... of the `wanted` rows with the highest `score`, ties to the smaller `id`, then to the smaller `row`."""
    found = cutoff(rows, F.col("score"), wanted)
    if found is None:
        return rows.limit(0).withColumn("rank", F.lit(None).cast("long"))
    score, above = found
    chosen = F.col("score") > score
    tied = F.col("score") == score
    # Among equal scores the smallest keys: the largest of their negatives. Keys come as whole numbers; others would go by `row` alone.
    if rows.where(tied).count() == wanted - above:
        chosen = chosen | tied
    else:
        same = rows.where(tied & F.col("id").isNotNull())
        found = cutoff(same, -F.col("id"), wanted - above)
        if found is None:
            chosen = chosen | (tied & F.col("id").isNotNull())
            above += same.count()
            rest = tied & F.col("id").isNull()
        else:
            chosen = chosen | (tied & (-F.col("id") > found[0]))
            above += found[1]
            rest = tied & (-F.col("id") == found[0])
        found = cutoff(rows.where(rest), -F.col("row"), wanted - above)
        if found is not None:
            chosen = chosen | (rest & (-F.col("row") >= found[0]))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    ordered = rows.where(F.coalesce(chosen, F.lit(False))).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number holds the partition and the place in it; partitions are in the order of the range.
    ordered = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "resampling-drawn")
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:  # one for each partition
        starts.append((p, before))
        before += n
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    return ordered.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("before") + place + 1).select(*rows.columns, "rank")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's key (a whole number), n_features, weight, score, and the rank of those that are drawn.

    Of the documents with at least `min_words` words a share of share[0] / share[1], rounded down, is drawn.
    """
    gains = bucket_gains(feature_counts(docs, text), feature_counts(target, target_text))
    rows = stored(scored(docs, gains, key, text, seed=seed).withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    able = rows.where(F.col("n_words") >= min_words)
    wanted = share[0] * able.count() // share[1]
    ranks = stored(drawn(able, wanted), "resampling-ranks")
    rest = rows.join(ranks.select("row"), "row", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents, with all their columns. Keys should be unique: rows of one key go together."""
    ids = importance_resample(docs, target, key, text, **options).where("rank IS NOT NULL").select(F.col(key)).distinct()
    return docs.join(ids, key, "left_semi")
