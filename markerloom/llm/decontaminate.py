"""Benchmark decontamination by spaced seeds.

Texts become words (lower case, punctuation removed), words become numbers. A seed is a window of words of which a fixed
mask ignores some positions; its hash survives a substitution at an ignored position. The hashes of all
benchmark seeds go into a Bloom filter of fixed size; one scan of the documents keeps the windows that pass, with a
stretch of words around them. These hits are joined to the benchmark's seeds by hash. Every (stretch, item,
diagonal) found is verified word by word: the best run along the diagonal, +1 for an equal word and a penalty for
another, must hold enough equal words.

Defined results: null or empty texts have no words and are clean. Items with fewer than MIN_ITEM words are ignored,
items shorter than a mask are sought as a whole. Repeated rows are all found. With no benchmark nothing is found. Extra
columns are never read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import fresh, slices, stored, strings

# Masks of a seed: 1 counts, 0 is ignored.
MASKS = ("1111011", "11011011", "110110011", "1010111001", "11001010101")
# Words that an item must have; equal words that a run must hold, or this share of a shorter item; share of equal
# words in a run.
MIN_ITEM, MIN_EQUAL, ITEM_SHARE, RUN_SHARE = 5, 13, 0.8, 0.7
# Words kept on either side of a hit.
PAD = 32
# Bits of the filter as a power of two: 8 MB on the driver and in each task, whatever the benchmark's size.
FILTER_BITS = 26

_BREAKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def word_codes(text: str) -> np.ndarray:
    words = text.lower().encode().translate(_BREAKS).split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the seed at every place, as unsigned numbers."""
    n = len(codes) - len(mask) + 1
    if n < 1:
        return np.zeros(0, _U)
    wide = codes.astype(_U)
    out = np.full(n, _U(crc32(mask.encode())))
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ wide[i : i + n]) * _ODD
            out ^= out >> _U(29)
    return out


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> _U(64 - FILTER_BITS), (hashes * _ODD) >> _U(64 - FILTER_BITS)


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Equal words and length of the best run where doc[i + diagonal] faces item[i]."""
    start, end = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if end <= start:
        return 0, 0
    same = doc[start + diagonal : end + diagonal] == item[start:end]
    equal = np.r_[0, np.cumsum(same)]
    total = equal - RUN_SHARE * np.arange(len(equal))
    # From each start, the last end that the share still holds at; nothing longer has more equal words.
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    last = np.searchsorted(-ahead, -total + 1e-9, "right") - 1
    first = int(np.argmax(equal[last] - equal))
    return int(equal[last[first]] - equal[first]), int(last[first] - first)


def needed(words: int) -> int:
    return min(MIN_EQUAL, int(np.ceil(ITEM_SHARE * words)))


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words array<long>) of every item long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            codes = [word_codes(t) for t in strings(rows.column("text"))]
            kept = [i for i, c in enumerate(codes) if len(c) >= MIN_ITEM]
            words = pa.array([codes[i].astype(np.int64) for i in kept], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(kept, pa.int64())), words], names=["item", "words"])

    plain = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text"))
    kind = plain.schema["item"].dataType.simpleString()
    return stored(plain.mapInArrow(run, f"item {kind}, words array<long>"), "benchmark-items")


def _seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(hash, item, at): every seed of every item; whole-item masks only for items of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            for i, words in enumerate(rows.column("words").to_pylist()):
                codes = np.array(words, np.uint32)
                for mask in masks:
                    if mask in MASKS or len(mask) == len(codes):
                        found = seed_hashes(codes, mask)
                        if len(found):
                            item = rows.column("item").take(pa.array(np.full(len(found), i)))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(found.view(np.int64)), item, pa.array(np.arange(len(found), dtype=np.int32))],
                                names=["hash", "item", "at"],
                            )

    kind = items.schema["item"].dataType.simpleString()
    return stored(items.mapInArrow(run, f"hash long, item {kind}, at int"), "benchmark-seeds")


def _filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter of the hashes as bytes; combined in Spark, at most 2**(FILTER_BITS - 3) come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1 << 16):
            hashes = rows.column("hash").to_numpy().view(_U)
            places = np.unique(np.concatenate(_bits(hashes))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    words = (
        seeds.select("hash")
        .mapInArrow(run, "place long")
        .groupBy(F.shiftright("place", 3).alias("byte"))
        .agg(F.expr("bit_or(shiftleft(1, CAST(place & 7 AS int)))").alias("bits"))
    )
    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in words.toLocalIterator():
        filled[row.byte] = row.bits
    return filled


def _stretches(docs: DataFrame, masks: list[str], filled: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, digest, words, hits): stretches of documents around windows that pass the filter; hits have the hash and
    its place in the stretch. One row per stretch."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def passes(hashes: np.ndarray) -> np.ndarray:
        one, two = _bits(hashes)
        table = shared.value
        first = np.flatnonzero(table[(one >> _U(3)).view(np.int64)] >> (one & _U(7)).astype(np.uint8) & 1)
        two = two[first]
        return first[(table[(two >> _U(3)).view(np.int64)] >> (two & _U(7)).astype(np.uint8) & 1) > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            source, words, hashes, places = [], [], [], []
            for i, body in enumerate(strings(rows.column("text"))):
                codes = word_codes(body)
                at, seeds, widths = [], [], []
                for mask in masks:
                    found = seed_hashes(codes, mask)
                    hit = passes(found)
                    at.append(hit)
                    seeds.append(found[hit])
                    widths.append(np.full(len(hit), len(mask)))
                where = np.concatenate(at)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, seed, width = where[order], np.concatenate(seeds)[order], np.concatenate(widths)[order]
                # Windows whose stretches touch share one.
                reach = np.maximum.accumulate(where + width + PAD)
                groups = np.r_[0, np.flatnonzero(where[1:] - PAD > reach[:-1]) + 1, len(where)]
                for a, b in zip(groups[:-1], groups[1:]):
                    begin = max(0, int(where[a]) - PAD)
                    source.append(i)
                    words.append(codes[begin : int(reach[b - 1])].astype(np.int64))
                    hashes.append(seed[a:b].view(np.int64))
                    places.append((where[a:b] - begin).astype(np.int64))
            columns = [rows.column(c).take(pa.array(source, pa.int64())) for c in ("key", "digest")]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (words, hashes, places)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=["key", "digest", "words", "hashes", "places"])

    plain = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, digest long, words array<long>, hashes array<long>, places array<long>"
    found = plain.mapInArrow(run, schema).withColumn("stretch", F.monotonically_increasing_id())
    return stored(found, "contamination-stretches")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, digest, item, n_equal, n_run): documents and the items they hold, with the best run; digest is xxhash64 of
    the text, which tells rows without a key apart."""
    items = _items(benchmark, item, item_text)
    longest = max(map(len, MASKS))
    short = items.select(F.size("words").alias("n")).where(F.col("n") < longest).distinct().collect()
    masks = [*MASKS, *sorted("1" * r.n for r in short)]
    seeds = _seeds(items, masks)
    stretches = _stretches(docs, masks, _filter(seeds), key, text)
    hits = stretches.select("stretch", F.explode(F.arrays_zip("hashes", "places")).alias("hit"))
    hits = hits.select("stretch", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("place"))
    lines = hits.join(seeds, "hash").select("stretch", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    facing = lines.join(items.withColumnRenamed("words", "item_words"), "item").join(stretches.drop("hashes", "places"), "stretch")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            equal, length, wanted = [], [], []
            for doc, other, diagonal in zip(
                rows.column("words").to_pylist(), rows.column("item_words").to_pylist(), rows.column("diagonal").to_pylist()
            ):
                e, n = best_run(np.array(doc), np.array(other), diagonal)
                equal.append(e)
                length.append(n)
                wanted.append(e >= needed(len(other)))
            out = pa.RecordBatch.from_arrays(
                [rows.column("key"), rows.column("digest"), rows.column("item"), pa.array(equal, pa.int64()), pa.array(length, pa.int64())],
                names=["key", "digest", "item", "n_equal", "n_run"],
            )
            yield out.filter(pa.array(wanted, pa.bool_()))

    kinds = [facing.schema[c].dataType.simpleString() for c in ("key", "item")]
    verified = facing.select("key", "digest", "item", "words", "item_words", "diagonal").mapInArrow(
        verify, f"key {kinds[0]}, digest long, item {kinds[1]}, n_equal long, n_run long"
    )
    best = F.max(F.struct("n_equal", "n_run")).alias("best")
    return (
        verified.groupBy("key", "digest", "item").agg(best).select("key", "digest", "item", "best.n_equal", "best.n_run")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each contaminated document and item: key, item_id, n_equal, n_run, contaminated (true)."""
    found = find_contamination(docs, benchmark, key, text)
    return found.select(
        F.col("key").alias(key), F.col("item").alias("item_id"), "n_equal", "n_run", F.lit(True).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    digest = fresh("digest", docs.columns)
    its_key, its_digest = fresh("found_key", docs.columns), fresh("found_digest", docs.columns)
    found = find_contamination(docs, benchmark, key, text).select(
        F.col("key").alias(its_key), F.col("digest").alias(its_digest)
    )
    whole = docs.withColumn(digest, F.xxhash64(F.col(text)))
    same = F.col(key).eqNullSafe(F.col(its_key)) & (F.col(digest) == F.col(its_digest))
    return whole.join(found.distinct(), same, "left_anti").drop(digest)
