"""Token counts of sections: a document is encoded once, whole, and its tokens' character spans are joined to the
sections' spans.

Sections tile the text: each ends behind a match of a pattern (a line end by default) or at the end of the text. A token within
one section counts for that. A token over several goes by an explicit rule:

    largest   to the section with most of its characters, the first of equals
    first     to the section of its first character
    last      to the section of its last character
    share     to each, by its share of the token's characters

so the counts of a document's sections always add up to its tokens.

Defined results: a null or empty text has one empty section with 0 tokens. Repeated rows give repeated results. An
empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import slices, strings
from markerloom.llm.tokens import TokenizerFile

RULES = ("largest", "first", "last", "share")
SCHEMA = "key {key}, section int, start_char long, end_char long, n_tokens double, n_crossing long"


def section_starts(text: str, pattern: re.Pattern) -> np.ndarray:
    starts = [0, *(m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text))]
    return np.unique(np.array(starts, np.int64))


def attribute(spans: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that cross into or out of it touch it."""
    n = len(starts)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(spans):
        return counts, crossing
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1
    inside = first == last
    counts += np.bincount(first[inside], minlength=n)
    ends = np.r_[starts[1:], length]
    for t in np.flatnonzero(~inside):
        sections = np.arange(first[t], last[t] + 1)
        chars = np.minimum(spans[t, 1], ends[sections]) - np.maximum(spans[t, 0], starts[sections])
        crossing[sections] += 1
        if rule == "share":
            counts[sections] += chars / chars.sum()
        else:
            counts[{"first": first[t], "last": last[t], "largest": sections[np.argmax(chars)]}[rule]] += 1
    return counts, crossing


def section_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    rule: str = "largest",
    pattern: str = r"\n+",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per section: the key, `section` (from 0), its character span, `n_tokens`, and `n_crossing`, the tokens that it
    shares with other sections."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tokenizer, ends = TokenizerFile(tokenizer_path), re.compile(pattern)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for rows in slices(batches):
            texts = strings(rows.column("text"))
            tiles = [section_starts(t, ends) for t in texts]
            found = [attribute(s, tile, len(t), rule) for s, tile, t in zip(encoder.spans(texts), tiles, texts)]
            sizes = [len(tile) for tile in tiles]
            columns = [
                rows.column("key").take(pa.array(np.repeat(np.arange(len(texts)), sizes))),
                pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)),
                pa.array(np.concatenate(tiles)),
                pa.array(np.concatenate([np.r_[tile[1:], len(t)] for tile, t in zip(tiles, texts)]).astype(np.int64)),
                pa.array(np.concatenate([c for c, _ in found])),
                pa.array(np.concatenate([x for _, x in found])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = plain.schema["key"].dataType.simpleString()
    found = plain.mapInArrow(run, SCHEMA.format(key=kind)).withColumnRenamed("key", key)
    return found if rule == "share" else found.withColumn("n_tokens", F.col("n_tokens").cast("long"))
