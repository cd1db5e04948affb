"""Token ids in files: a Parquet table of segments, each a run of whole documents whose ids are coded in blocks.

Documents are dealt by ranges of their ids and sorted, so part p holds smaller ids than part p + 1. A task encodes its documents,
gathers them to segments of about SEGMENT ids, cuts each segment into blocks and codes these side by side (see
range_coder). A row has

    part, segment       place in the order of all documents
    before              ids of the same part in earlier segments
    doc_ids, lengths    the documents and their ids, the end id counted
    sizes, checksums    ids of each block, and their crc32 as little-endian unsigned 32-bit integers
    payloads            the coded blocks

Every block starts from nothing, so blocks can be decoded alone; a wrong checksum raises.

Defined results: a null text is empty and has the end id only. Documents without an id come first. Documents with the same
id follow each other by a hash of the text, then by the text. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.llm.common import slices, strings
from markerloom.llm.range_coder import BLOCK, checksum, cut, decode_blocks, encode_blocks
from markerloom.llm.tokens import TokenizerFile
from markerloom.session import new_path

# Ids of a segment; a longer document makes a longer segment.
SEGMENT = 1 << 22
END = 0

SCHEMA = (
    "part int, segment int, before long, doc_ids array<long>, lengths array<long>, sizes array<int>, "
    "checksums array<long>, payloads array<binary>"
)
DOC_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _segment(part: int, segment: int, before: int, keys: list[int | None], docs: list[np.ndarray]) -> pa.RecordBatch:
    blocks = cut(np.concatenate(docs), BLOCK)
    payloads = encode_blocks(blocks)
    row = {
        "part": part,
        "segment": segment,
        "before": before,
        "doc_ids": keys,
        "lengths": [len(d) for d in docs],
        "sizes": [len(b) for b in blocks],
        "checksums": [checksum(b) for b in blocks],
        "payloads": payloads,
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    kinds += [pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: TokenizerFile, key: str = "doc_id", text: str = "text", end: int = END
) -> None:
    """Write the ids of every document, `end` appended, in ascending order of the key."""
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tied = plain.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    last = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokenizer.encoder(), TaskContext.get().partitionId()
        keys: list[int | None] = []
        gathered: list[np.ndarray] = []
        segment = before = held = 0
        for rows in slices(batches):
            for k, ids in zip(rows.column("key").to_pylist(), encoder.ids(strings(rows.column("text")))):
                keys.append(k)
                gathered.append(np.concatenate([ids, last]))
                held += len(ids) + 1
                if held >= SEGMENT:
                    yield _segment(part, segment, before, keys, gathered)
                    segment, before, held, keys, gathered = segment + 1, before + held, 0, [], []
        if keys:
            yield _segment(part, segment, before, keys, gathered)

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def decoded(row: dict) -> np.ndarray:
    """All ids of a segment, checked block by block."""
    blocks = decode_blocks(row["payloads"], row["sizes"])
    for i, (block, expected) in enumerate(zip(blocks, row["checksums"])):
        if checksum(block) != expected:
            raise ValueError(f"part {row['part']}, segment {row['segment']}, block {i}: wrong checksum")
    return np.concatenate(blocks)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    # One row per part comes to the driver; there are as many as tasks wrote.
    parts = (
        segments.groupBy("part")
        .agg(
            F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"),
            F.min(F.array_min("doc_ids")).alias("low"),
            F.max(F.array_max("doc_ids")).alias("high"),
        )
        .orderBy("part")
        .collect()
    )
    starts, total, reached = [], 0, None
    for p in parts:
        if reached is not None and p.low is not None and p.low < reached:
            raise ValueError("the parts are not in ascending order")
        reached = p.high if p.high is not None else reached
        starts.append((p.part, total))
        total += p.n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, part_start long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            row = one.to_pylist()[0]
            ids, lengths = decoded(row), np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            sums = [checksum(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), row["part"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["before"] + ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )

    found = segments.mapInArrow(run, DOC_SCHEMA).join(offsets, "part")
    return found.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below the shared folder and return what they hold."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, TokenizerFile(tokenizer_path), key, text)
    return read_token_files(docs.sparkSession, path).withColumnRenamed("doc_id", key)
