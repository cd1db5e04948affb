"""Near-copies by SimHash, and by longer fingerprints for those that 64 bits at a small distance cannot tell.

Texts that simhash puts in one component (64-bit fingerprints, joined on pairs of blocks that no link can miss, at its distance) are
compared, and so are those that share a block of a longer fingerprint. That has two parts, both of the set of five-word shingles. The first has BLOCKS blocks of 32 bits, each a hash of
PER_BLOCK MinHash values: two texts of Jaccard similarity s share a block with chance 1 - (1 - s**PER_BLOCK)**BLOCKS,
whatever the edits are, which is over 0.99999 from 0.8 on. The component of simhash counts as one more block. The second estimates their similarity: at a cosine c of the
shingle sets a bit differs with probability acos(c) / pi. Texts that share a block are sieved by the Hamming distance of
their second parts, which passes a pair of just 0.8 with chance 0.9998, and what is left is a copy exactly if the
Jaccard similarity of the shingle sets is 0.8 or more.

Only texts of distinct fingerprints are compared. First each with the smallest of its blocks, then those that are still apart
within the task that holds the block; only links that join what was apart leave it. A block that more than GROUP texts
share is dealt to pieces in which its largest component meets the texts outside it, and those each other: no link is lost, no task
holds more than two parts of a block, and the rows that are dealt grow with the block as long as few are outside.
Shingle sets are made anew for the texts that the sieve leaves, not kept for all.

Defined results: texts without words are equal to each other. Of repeated rows one stays. A row without an id takes part
and stays only if its group has no id. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm.common import appended, fresh, slices, stored, utf8
from markerloom.llm.components import connected_components
from markerloom.llm.dealing import deal
from markerloom.llm.simhash import _ASCII_LOWER, fingerprint, fingerprint_links

SHINGLE = 5
# 64-bit words of the two parts; a block is half a word of the first and holds PER_BLOCK minima.
FIRST, SECOND = 20, 6
BLOCKS, BLOCK_BYTES = 2 * FIRST, 4
PER_BLOCK = 6
# Copies have a similarity of OF_WHOLE / PART at least. A pair of just that differs in 58 bits and a standard deviation of 7;
# MAX_DISTANCE is three and a half more.
OF_WHOLE, PART = 4, 5
MAX_DISTANCE = 83
# Fingerprints of a block that are compared in one piece, and their shingles together.
GROUP, GROUP_SHINGLES = 1024, 2_000_000

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def _salts(n: int, start: int) -> np.ndarray:
    """Odd 64-bit numbers, by Weyl steps and a mix."""
    x = (np.arange(start, start + n, dtype=_U) + _U(1)) * _MIX
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(27))) | _U(1)


_SECOND_SALTS = _salts(SECOND, 32)
_FLIPS, _FACTORS, _MORE = ((_salts(BLOCKS * PER_BLOCK, n) >> _U(31)).astype(np.uint32) | np.uint32(n > 1000) for n in (1000, 2000, 3000))


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    width = min(width, len(codes))
    out = np.zeros(len(codes) - width + 1, _U)
    for i in range(width):
        out = (out + codes[i : len(codes) - width + 1 + i] + _U(1)) * _MIX
        out ^= out >> _U(32)
    return out


def _spread(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(rows, words): each hash under each salt."""
    x = (hashes[:, None] ^ (hashes[:, None] >> _U(29))) * salts[None, :]
    x ^= x >> _U(32)
    x *= _MIX
    return x ^ (x >> _U(29))


def _block_keys(shingles: np.ndarray) -> np.ndarray:
    """Per block a hash of its PER_BLOCK smallest hashes of the shingles."""
    low = np.full(BLOCKS * PER_BLOCK, 2**32 - 1, np.uint32)
    short = (shingles >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        x = (short[at : at + 256, None] ^ _FLIPS) * _FACTORS
        x ^= x >> np.uint32(15)
        x *= _MORE
        np.minimum(low, x.min(axis=0), out=low)
    keys = np.zeros(BLOCKS, _U)
    for x in low.reshape(BLOCKS, PER_BLOCK).T:
        keys = (keys + x + _U(1)) * _MIX
        keys ^= keys >> _U(32)
    return (keys >> _U(32)).astype("<u4")


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, sorted; a shorter text is one shingle."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return np.zeros(0, _U)
    return np.unique(_windows(np.fromiter(map(crc32, words), _U, len(words)), SHINGLE))


def long_fingerprint(text: bytes) -> bytes:
    return fingerprint_of(shingle_set(text))


def fingerprint_of(shingles: np.ndarray) -> bytes:
    if not len(shingles):
        return bytes(8 * (FIRST + SECOND))
    ones = np.zeros(64 * SECOND, np.int64)
    for at in range(0, len(shingles), 255):
        rows = _spread(shingles[at : at + 255], _SECOND_SALTS).view(np.uint8)
        ones += np.add.reduce(np.unpackbits(rows, axis=1), axis=0, dtype=np.uint8)
    return _block_keys(shingles).tobytes() + np.packbits(2 * ones > len(shingles)).tobytes()


def _first_of(values: np.ndarray) -> np.ndarray:
    """The first row that has the value of each row."""
    _, first, inverse = np.unique(values, axis=0, return_index=True, return_inverse=True)
    return first[inverse.ravel()]


def _may_be(prints: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs may have the similarity, by their Hamming distance and the sizes of their sets."""
    near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= MAX_DISTANCE
    return near & (PART * np.minimum(sizes[i], sizes[j]) >= OF_WHOLE * np.maximum(sizes[i], sizes[j]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets (sorted, distinct) have a Jaccard similarity of OF_WHOLE / PART at least."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return PART * common >= OF_WHOLE * (len(a) + len(b) - common)


def _steps(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group that are to be compared, by their distance in the group."""
    sizes = ends - starts
    end_of = np.repeat(ends, sizes)
    mixed = np.repeat(np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts), sizes)
    at = np.arange(len(side))
    for step in range(1, int(sizes.max())):
        at = at[at + step < end_of[at]]
        wanted = ~mixed[at] | (side[at] != side[at + step])
        yield at[wanted], at[wanted] + step


def forest(
    prints: np.ndarray,
    starts: np.ndarray,
    ends: np.ndarray,
    side: np.ndarray,
    sizes: np.ndarray | None = None,
    known: np.ndarray | None = None,
    confirm: Callable[[int, int], bool] = lambda i, j: True,
) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between rows of the same group [start, end) at MAX_DISTANCE or less, and confirmed, that join what was
    apart. Rows of one group and side 0 or 1 are compared with all others; where a group has both sides only across. Rows of
    a group with the same `known` component are joined already."""
    if not len(prints):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.ones(len(prints), np.int64) if sizes is None else sizes
    root = np.arange(len(prints))
    if known is not None:
        root = _first_of(np.c_[np.repeat(starts, ends - starts), known])
    left: list[int] = []
    right: list[int] = []
    for i, j in _steps(starts, ends, side):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        near = _may_be(prints, sizes, i, j)
        before = len(left)
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            a, b = x, y
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and confirm(x, y):
                root[max(a, b)] = min(a, b)
                left.append(x)
                right.append(y)
        while len(left) > before and not np.array_equal(up := root[root], root):
            root = up
    return np.array(left, np.int64), np.array(right, np.int64)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A binary column of prints as (rows, SECOND) words, any other as it is."""
    c = table.column(name)
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), _U).reshape(-1, SECOND)
    return c.to_numpy()


def _plausible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.r_[_column(batch, "second_a"), _column(batch, "second_b")]
        sizes = np.r_[_column(batch, "size_a"), _column(batch, "size_b")]
        i = np.arange(batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(_may_be(prints, sizes, i, i + batch.num_rows)))


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = zip(part.column("set_a"), part.column("set_b"))
        kept = [similar(*(np.frombuffer(x.as_buffer(), _U) for x in both)) for both in sets]
        yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _groupwise(fn: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn of runs of whole groups, of rows that come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in slices(batches):
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            changes = _changes(pa.Table.from_batches([*last, part])) - len(last)
            if len(changes):
                yield from fn(pa.Table.from_batches([*held, part.slice(0, changes[-1])])).to_batches()
                held, part = [], part.slice(changes[-1])
            if part.num_rows:
                held.append(part)
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return run


def near_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between classes (cls, fp, size) that share a block and are similar, enough to connect all that are.
    `more` are blocks (cls, v) besides those of the fingerprint.

    `sets_of` gives (cls, shingles) of a table of cls. First every class is compared with the smallest of each of its
    blocks, one pair however many blocks are shared; then all that are still apart within a block with each other.
    """
    blocks = F.array(*(F.substring("fp", 1 + BLOCK_BYTES * i, BLOCK_BYTES) for i in range(BLOCKS)))
    keyed = classes.select("cls", F.posexplode(blocks).alias("k", "v"))
    if more is not None:
        keyed = keyed.unionByName(more.select("cls", F.lit(BLOCKS).alias("k"), "v"))
    shared = keyed.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1")
    members = stored(keyed.join(shared, ["k", "v"]), "near-members")
    info = classes.select("cls", F.substring("fp", 1 + 8 * FIRST, 8 * SECOND).alias("second"), "size")

    def ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        for end in ("b", "a"):
            pairs = pairs.join(facts.withColumnsRenamed({c: end if c == "cls" else f"{c}_{end}" for c in facts.columns}), end)
        return pairs

    stars = members.where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    stars = stored(ends(stars, info).mapInArrow(_plausible_pairs, "a long, b long"), "near-stars")
    ones = stars.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = stored(sets_of(ones), "near-sets").withColumnRenamed("shingles", "set")
    links = stored(ends(stars, sets).mapInArrow(_similar_pairs, "a long, b long"), "near-links")

    # Blocks of two classes are settled.
    roots = connected_components(links).withColumnsRenamed({"node": "cls"})
    rest = members.where("n > 2").drop("n", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rest = stored(rest.join(info.select("cls", "size"), "cls"), "near-rest")
    dealt = deal(rest, ["k", "v"], "size", GROUP, GROUP_SHINGLES)
    names = ["k", "v", "lo", "hi"]

    def by_group(rows: DataFrame) -> DataFrame:
        return rows.repartition(*names).sortWithinPartitions(*names, "cls")

    # Only rows that may be similar to one of another component take their shingles along.
    plausible = by_group(dealt.join(info.select("cls", "second"), "cls"))
    plausible = stored(plausible.mapInArrow(_groupwise(_with_partners), plausible.schema), "near-open")
    sets = stored(sets_of(plausible.select("cls").distinct()), "near-open-sets")
    compared = by_group(plausible.join(sets, "cls")).mapInArrow(_groupwise(_compared), "a long, b long")
    return links.unionByName(compared).distinct()


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's group differs from the row before."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    value = np.frombuffer(b"".join(table.column("v").to_pylist()), "<u4")
    out |= value[1:] != value[:-1]
    for name in ("k", "lo", "hi"):
        c = table.column(name).to_numpy()
        out |= c[1:] != c[:-1]
    return np.flatnonzero(out) + 1


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    changes = _changes(table)
    return np.r_[0, changes], np.r_[changes, table.num_rows]


def _with_partners(table: pa.Table) -> pa.Table:
    """The rows that may be similar to a row of another component."""
    prints, sizes, root = (_column(table, name) for name in ("second", "size", "root"))
    found = np.zeros(table.num_rows, bool)
    for i, j in _steps(*_bounds(table), _column(table, "side")):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        near = _may_be(prints, sizes, i, j)
        found[i[near]] = found[j[near]] = True
    return table.filter(pa.array(found))


def _compared(table: pa.Table) -> pa.Table:
    sets = table.column("shingles")
    cls = _column(table, "cls")

    def confirm(i: int, j: int) -> bool:
        return similar(*(np.frombuffer(sets[x].as_buffer(), _U) for x in (i, j)))

    facts = (_column(table, name) for name in ("side", "size", "root"))
    a, b = forest(_column(table, "second"), *_bounds(table), *facts, confirm)
    a, b = (cls[x] if len(x) else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def simhash_blocks(classes: DataFrame) -> DataFrame:
    """(cls, v): of classes (cls, print) the component that simhash puts each in, where it holds several, as the 4 bytes of a block."""
    prints = stored(classes.groupBy("print").agg(F.count("*").alias("n")), "near-prints")
    roots = connected_components(fingerprint_links(prints.select(F.col("print").alias("fp")))).withColumnRenamed("node", "print")
    several = prints.join(roots, "print", "left").where("n > 1 OR root IS NOT NULL").select("print", F.coalesce("root", "print").alias("root"))
    v = F.unhex(F.lpad(F.hex(F.crc32(F.col("root").cast("string").cast("binary"))), 8, "0"))
    return classes.join(several, "print").select("cls", v.alias("v"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their near-copies: of each group the row with the smallest key stays, one row even
    if the key is repeated; all columns as they came."""
    fp, size, short, row = (fresh(name, docs.columns) for name in ("fp", "n_shingles", "print", "row"))

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        texts = utf8(part.column(text))
        sets = [shingle_set(t) for t in texts]
        prints = pa.array([fingerprint(t) for t in texts], pa.int64())
        return [pa.array([fingerprint_of(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), prints]

    fields = [T.StructField(fp, T.BinaryType()), T.StructField(size, T.LongType()), T.StructField(short, T.LongType())]
    printed = appended(docs, fields, run)
    whole = stored(printed.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row"))
    firsts = whole.select(F.col(fp).alias("fp"), F.col(short).alias("print"), F.col(size).alias("size"), order.alias("first"))
    firsts = firsts.groupBy("fp", "print").agg(F.min("first").alias("first"), F.min_by("size", "first").alias("size"))
    classes = stored(firsts.withColumn("cls", F.col("first.row")), "near-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = whole.select(F.col(row).alias("cls"), F.col(text).alias("text")).join(wanted, "cls", "left_semi")

        def made(part: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([shingle_set(t).tobytes() for t in utf8(part.column("text"))], pa.binary())]

        return appended(texts, [T.StructField("shingles", T.BinaryType())], made).drop("text")

    more = stored(simhash_blocks(classes.select("cls", "print")), "near-simhash")
    roots = connected_components(near_links(classes.select("cls", "fp", "size"), sets_of, more)).withColumnRenamed("node", "cls")
    placed = classes.select("cls", "first").join(roots, "cls", "left")
    grouped = placed.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first.row").alias(row))
    return whole.join(kept, row, "left_semi").drop(fp, size, short, row)
