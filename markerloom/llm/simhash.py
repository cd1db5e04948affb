"""SimHash near-duplicates: fingerprints of word shingles, candidates from shared pigeonhole blocks, verified by
Hamming distance, and the connected components of the verified links.

Only distinct fingerprints are compared, so a group of exact copies is one node however large it is. Two
fingerprints of 64 bits that differ in at most 2 of them agree on at least two of their four 16-bit blocks;
the fingerprints are joined on each of the six pairs of blocks. A pair of blocks that very many fingerprints share
is not expanded into pairs: inside it two fingerprints differ in at most two of the remaining 32 bits exactly
if they become equal when some two of these bits are cleared. Grouping by the cleared fingerprint gives groups of at
most four, whose members are linked to the smallest.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Repeated rows have equal
fingerprints. A row without an id takes part; the id of a component is the smallest id that is not null, and null if
there is none. Extra columns are never read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from markerloom.llm.common import LOWER, UPPER, appended, fresh, stored, utf8
from markerloom.llm.components import connected_components

SEED = 42
BITS, BLOCKS, DISTANCE = 64, 4, 2
SHINGLE = 3
# Fingerprints that share a key and are still compared pair by pair; larger groups are linked by cleared bits.
PAIRWISE = 256
# Hashes summed at a time.
CHUNK = 255

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of the text's shingles as a signed 64-bit number."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(_hash, shingles), np.uint64, max(1, len(words) - width + 1))
    return int(majority(hashes.reshape(-1, 1)).view(">i8")[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows of a (rows, words) array of 64-bit hashes have, as big-endian bytes."""
    ones = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8)
        # A chunk has fewer rows than a byte can count.
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes))


def with_fingerprints(docs: DataFrame, text: str, name: str, width: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint of the text as a signed long."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([fingerprint(t, width) for t in utf8(part.column(text))], pa.int64())]

    return appended(docs, [T.StructField(name, T.LongType())], run)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the block combinations of which one at least is untouched by `distance` flipped bits."""
    size = BITS // blocks
    one = [((1 << size) - 1) << (i * size) for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _masked(column: str, mask: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(signed(mask)))


def fingerprint_links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) at DISTANCE bits or fewer.

    Every close pair is linked, in groups larger than `pairwise` through the smallest fingerprint of a
    cleared-bits group, so that connectivity is that of all close pairs.
    """
    masks = block_masks()
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), _masked("fp", m).alias("v")) for i, m in enumerate(masks))))
    keyed = prints.select("fp", keys.alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(sizes, ["k", "v"]), "simhash-members")
    few = members.where(F.col("n") <= pairwise)
    left, right = few.select("k", "v", F.col("fp").alias("a")), few.select("k", "v", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, ["k", "v"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    many = members.where(F.col("n") > pairwise)
    cleared = None
    for i, mask in enumerate(masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        wild = [signed(~((1 << x) | (1 << y)) % (1 << BITS)) for x, y in combinations(free, DISTANCE)]
        part = many.where(F.col("k") == i).select(
            "fp",
            F.posexplode(F.transform(F.array(*map(F.lit, wild)), lambda w: F.col("fp").bitwiseAND(w))).alias("w", "c"),
            F.lit(i).alias("k"),
        )
        cleared = part if cleared is None else cleared.unionByName(part)
    # Equal but for two cleared bits: four members at most.
    groups = cleared.groupBy("k", "w", "c").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """Per row: the key, `fingerprint` in hex, and `component_id`, the smallest key among all rows that a chain of
    links reaches."""
    body, fp = fresh("text", [key]), fresh("fp", [key])
    plain = docs.select(F.col(key), F.col(text).alias(body))
    rows = stored(with_fingerprints(plain, body, fp, width).select(F.col(key).alias("id"), F.col(fp).alias("fp")), "simhash-rows")
    classes = component_ids(rows.groupBy("fp").agg(F.min("id").alias("least")))
    return rows.join(classes, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def component_ids(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of distinct fingerprints with `least`, the smallest id of each."""
    prints = stored(prints, "simhash-prints")
    roots = connected_components(fingerprint_links(prints.select("fp")))
    placed = stored(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "simhash-placed",
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(placed.join(least, "root").select("fp", "component_id"), "simhash-classes")
