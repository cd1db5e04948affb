"""Jaccard self-join of word n-gram sets over count-vector R-trees.

A text's set is that of its five-word shingles, as 64-bit hashes. The hashes fall into GROUPS groups, and the counts per group are a point.
Two sets share at most the sum of the smaller coordinates, and a box shares with anything at most what its upper corner does;
a pair of similarity 4/5 shares 4/9 of both sizes together. So two boxes of a packed R-tree, and in the end two points, are
dropped as soon as the sum of the coordinate minima is below that, and what is left is decided by the sets themselves.

Boxes around unrelated texts cover each other, so one tree over all texts would compare nearly every two leaves. The root is therefore
dealt out: a tree holds the sets that have one of their rare shingles in common. A set enters the trees of its
n - ceil(4n/5) + 1 rarest shingles, in an order that is the same for all (occurrences in a table of fixed size, then
the hash). Of two sets with the similarity, one of those of each is the same, so that no pair is lost; a wrong count only
changes the order.

Equal sets are one class, however many texts have it. A class is first compared with its star, the smallest class of most of its
trees; trees that hold one component then are done. In the others the largest component is not compared with itself: what lies outside meets it, and
the rest of its own, in pieces of at most PIECE rows, so the rows that are dealt grow with the tree and not with its square unless many
texts are outside.

Defined results: texts without words have an empty set and are linked with nothing, not with each other. Repeated rows have equal sets.
A row without an id takes part; the id of a component is the smallest id that is not null. Extra columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from markerloom.llm.common import LOWER, UPPER, slices, stored, utf8
from markerloom.llm.components import connected_components
from markerloom.llm.dealing import PIECE, PIECE_SIZE, deal
from markerloom.session import stored_small

SHINGLE = 5
# A link has OF_WHOLE / PART of the union in common, and so OVERLAP / BOTH of both sizes together.
OF_WHOLE, PART = 4, 5
OVERLAP, BOTH = OF_WHOLE, OF_WHOLE + PART
GROUPS = 512
# Entries of the table of occurrences, which every task holds, and of its pieces.
TABLE, TABLE_PIECE = 1 << 18, 1 << 12
# Children of a node; trees of no more rows are a leaf.
FANOUT = 16
# Partners of a class that meet its set in one place.
STAR = 64
# Possible pairs of a piece for each of its rows that are still sent as pairs, which are much smaller than sets.
FEW = 64
# Pairs of points whose coordinates are compared at a time.
AT_ONCE = 1 << 14

# Key hashes go by their first bits; the next 32 tell them apart. Two hashes that agree in both are one tree, which only adds pairs to compare.
BUCKET_BITS, PRINT_BITS = 12, 32
# Keys that a task deals to buckets at a time.
DEALT = 1 << 19

_U = np.uint64
_MIX, _STEP = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_COUNT, _FULL = np.dtype("u1"), 255


def ngram_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; a text of fewer words is one shingle."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return np.zeros(0, _U)
    codes = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, _U)
    for i in range(width):
        out = (out ^ (out >> _U(29))) * _STEP + codes[i : i + len(out)] * _MIX + _U(1)
    out = (out ^ (out >> _U(32))) * _MIX
    return np.unique(out ^ (out >> _U(29)))


def group_counts(hashes: np.ndarray) -> bytes:
    """The point of a set. A count that does not fit is the largest number, which stands for any."""
    counts = np.bincount((hashes >> _U(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, _FULL).astype(_COUNT).tobytes()


def rarest(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The shingles that a similar set has one of: the first n - ceil(4n/5) + 1 in the common order."""
    n = len(hashes)
    order = np.lexsort((hashes, table[hashes.astype(np.int64) & (TABLE - 1)]))
    return hashes[order[: n - -(-OF_WHOLE * n // PART) + 1]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return PART * common >= OF_WHOLE * (len(a) + len(b) - common)


def may_be(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether two points, or anything in two boxes of such upper corners and smallest sizes, may be similar."""
    least = np.minimum(a, b)
    bound = least.sum(axis=1, dtype=np.int64)
    if (full := least == _FULL).any():
        bound += full.sum(axis=1) << 40
    return BOTH * bound >= OVERLAP * (size_a + size_b)


def fitting(n: np.ndarray, m: np.ndarray, at_n: np.ndarray, at_m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be similar if their first common shingle is at these places of their order: what is left
    from there on has to be enough."""
    return BOTH * np.minimum(n - at_n, m - at_m) >= OVERLAP * (n + m)


class CountTree:
    """A packed R-tree over points with sizes: leaves of FANOUT neighbours in an order of size and coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # The coordinates that differ most decide among equal sizes.
        spread = np.argsort(points.astype(np.int64).var(axis=0))[-4:] if len(points) else []
        keys = [points[:, c] for c in spread]
        self.order = np.lexsort([*keys, (np.log2(np.maximum(sizes, 1)) * 8).astype(np.int64)]) if len(points) else np.zeros(0, np.int64)
        # Per level the upper corners, the smallest and the largest sizes; the first level is the points.
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def pairs(self, other: CountTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (row here, row there) that may be similar; without another tree the pairs within this one, once."""
        there = other or self
        if not len(self.order) or not len(there.order):
            return
        depth = max(len(self.levels), len(there.levels))
        stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > AT_ONCE:
                stack += [(level, i[at : at + AT_ONCE], j[at : at + AT_ONCE]) for at in range(0, len(i), AT_ONCE)]
                continue
            (a, low_a, high_a), (b, low_b, high_b) = self._level(level), there._level(level)
            fits = (PART * high_a[i] >= OF_WHOLE * low_b[j]) & (PART * high_b[j] >= OF_WHOLE * low_a[i])
            if other is None and level == 0:
                fits &= i != j
            i, j = i[fits], j[fits]
            close = may_be(a[i], b[j], low_a[i], low_b[j])
            i, j = i[close], j[close]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], there.order[j]
                continue
            below_a, below_b = (len(t._level(level - 1)[1]) for t in (self, there))
            step_a, step_b = (FANOUT if level < len(t.levels) else 1 for t in (self, there))
            x, y = np.meshgrid(np.arange(step_a), np.arange(step_b), indexing="ij")
            i, j = (i[:, None] * step_a + x.ravel()).ravel(), (j[:, None] * step_b + y.ravel()).ravel()
            inside = (i < below_a) & (j < below_b)
            if other is None:
                inside &= i <= j
            stack.append((level - 1, i[inside], j[inside]))

    def _level(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[min(level, len(self.levels) - 1)]


def _packed(point: bytes) -> bytes:
    """Counts by their frequencies alone, in about half the bytes that a shuffle's own compression needs."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(point) + coder.flush()


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(p, -15, GROUPS) for p in column.to_pylist()), _COUNT).reshape(-1, GROUPS)


def _sets_and_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, text) with the size and digest of the set; after all rows, the pieces of the table of occurrences."""
    found = np.zeros(TABLE, np.int64)
    schema = pa.schema(
        [("row", pa.int64()), ("id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("digest", pa.binary()),
         ("piece", pa.int32()), ("counts", pa.binary())]
    )
    for part in slices(batches):
        sizes, digests = [], []
        for text in utf8(part.column("text")):
            hashes = ngram_set(text)
            found += np.bincount(hashes.astype(np.int64) & (TABLE - 1), minlength=TABLE) if len(hashes) > TABLE // 8 else 0
            if len(hashes) <= TABLE // 8:
                np.add.at(found, hashes.astype(np.int64) & (TABLE - 1), 1)
            sizes.append(len(hashes))
            digests.append(blake2b(hashes.tobytes(), digest_size=16).digest())
        none = [pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *none], schema=schema)
    pieces = [p for p in range(TABLE // TABLE_PIECE) if found[p * TABLE_PIECE : (p + 1) * TABLE_PIECE].any()]
    if pieces:
        counts = [found[p * TABLE_PIECE : (p + 1) * TABLE_PIECE].tobytes() for p in pieces]
        none = [pa.nulls(len(pieces), f.type) for f in list(schema)[:5]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(pieces, pa.int32()), pa.array(counts, pa.binary())], schema=schema)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of equal number that a task has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            sums[piece] = sums.get(piece, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    if sums:
        values = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(values, names=["piece", "counts"])


def _occurrences(rows: DataFrame) -> np.ndarray:
    """The table of occurrences of all texts: TABLE / TABLE_PIECE rows reach the driver."""
    pieces = rows.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(_added, "piece int, counts binary")
    table = np.zeros(TABLE, np.int64)
    for row in pieces.toLocalIterator():
        table[row.piece * TABLE_PIECE : (row.piece + 1) * TABLE_PIECE] = np.frombuffer(row.counts, np.int64)
    return table


def _with_ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    for end in ("b", "a"):
        pairs = pairs.join(facts.withColumnsRenamed({c: end if c == "cls" else f"{c}_{end}" for c in facts.columns}), end)
    return pairs


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, AT_ONCE):
        if part.num_rows:
            a, b = (_points(part.column(f"point_{x}")) for x in "ab")
            n, m = (part.column(f"n_{x}").to_numpy() for x in "ab")
            fits = (PART * n >= OF_WHOLE * m) & (PART * m >= OF_WHOLE * n)
            yield part.select(["a", "b"]).filter(pa.array(fits & may_be(a, b, n, m)))


def _like_their_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (a, part, other, cls, hashes) to the star of their part, which comes before them."""
    star: np.ndarray | None = None
    for part in slices(batches, 64):
        left, right = [], []
        rows = zip(part.column("a").to_pylist(), part.column("other").to_pylist(), part.column("cls").to_pylist(), part.column("hashes"))
        for a, other, cls, hashes in rows:
            mine = np.frombuffer(hashes.as_buffer(), _U)
            if not other:
                star = mine
            elif similar(star, mine):
                left.append(a)
                right.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _linked_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar pairs that join what was apart, of rows (group, cls, partners, hashes) that come sorted by group."""
    group, sets, partners = None, {}, {}
    for part in slices(batches, 64):
        rows = zip(part.column("group").to_pylist(), part.column("cls").to_pylist(), part.column("partners").to_pylist(), part.column("hashes"))
        for now, cls, others, hashes in rows:
            if now != group:
                yield _forest(sets, partners)
                group, sets, partners = now, {}, {}
            sets[cls], partners[cls] = np.frombuffer(hashes.as_buffer(), _U), others or []
    yield _forest(sets, partners)


def _forest(sets: dict[int, np.ndarray], partners: dict[int, list[int]]) -> pa.RecordBatch:
    up = {cls: cls for cls in sets}
    left, right = [], []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, others in partners.items():
        for b in sorted(others):
            x, y = top(a), top(b)
            if x != y and similar(sets[a], sets[b]):
                up[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones: the high bytes of small numbers are runs of zeros, which shuffles compress."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def _of_planes(data: memoryview, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, "u1", n * size).reshape(size, n).T).view(kind)[:, 0]


def _to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of rows (cls, n, keys) by buckets: a row has the keys of many classes with class, size and place, column by column."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("keys")).to_numpy()
        at = 0
        while at < batch.num_rows:
            rows = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), DEALT, side="right")))
            part, counts = batch.slice(at, rows), lengths[at : at + rows].astype(np.int64)
            at += rows
            keys = part.column("keys").flatten().to_numpy().view(_U)
            owner = np.repeat(np.arange(rows), counts)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            buckets = (keys >> _U(64 - BUCKET_BITS)).astype(np.uint16)
            order = np.argsort(buckets, kind="stable")
            prints = (keys >> _U(64 - BUCKET_BITS - PRINT_BITS)).astype("<u4")[order]
            cls, n = (part.column(c).to_numpy()[owner[order]] for c in ("cls", "n"))
            pos, n, buckets = pos[order].astype("<u4"), n.astype("<u4"), buckets[order]
            ends = np.r_[np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, len(keys)] if len(keys) else []
            data, start = [], 0
            for end in map(int, ends):
                here = slice(start, end)
                steps = np.diff(cls[here], prepend=0).astype("<i8")
                data.append(prints[here].tobytes() + _planes(steps) + _planes(n[here]) + _planes(pos[here]))
                start = end
            first = np.array(ends, np.int64) - 1
            yield pa.RecordBatch.from_arrays([pa.array(buckets[first].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "keys"])


def _in_common(bucket: int, rows: list[pa.Scalar]) -> pa.RecordBatch:
    """Members (cls, n, pos, key, least) of the keys of a bucket that several classes have, one of them among its first ninth."""
    columns = []
    for row in rows:
        data = memoryview(row.as_buffer())
        n = len(data) // 20
        steps = _of_planes(data[4 * n : 12 * n], "<i8", n)
        columns.append((np.frombuffer(data, "<u4", n), np.cumsum(steps), _of_planes(data[12 * n : 16 * n], "<u4", n), _of_planes(data[16 * n :], "<u4", n)))
    prints, cls, n, pos = (np.concatenate(c).astype(np.int64) for c in zip(*columns))
    order = np.argsort(prints, kind="stable")
    prints, cls, n, pos = (x[order] for x in (prints, cls, n, pos))
    starts = np.r_[0, np.flatnonzero(prints[1:] != prints[:-1]) + 1]
    counts = np.diff(starts, append=len(prints))
    # The smaller set of a pair has its first common shingle in the first ninth, see `fitting`.
    early = np.logical_or.reduceat(BOTH * (n - pos) >= 2 * OVERLAP * n, starts)
    kept = np.repeat((counts > 1) & early, counts)
    least = np.repeat(np.minimum.reduceat(cls, starts), counts)[kept]
    keys = (bucket << PRINT_BITS) | prints[kept]
    return pa.RecordBatch.from_arrays(
        [pa.array(cls[kept]), pa.array(n[kept]), pa.array(pos[kept].astype(np.int32)), pa.array(keys), pa.array(least)],
        names=["cls", "n", "pos", "key", "least"],
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the keys in common, of rows (bucket, keys) that come sorted by bucket."""
    bucket, held = None, []
    for part in slices(batches):
        for now, keys in zip(part.column("bucket").to_pylist(), part.column("keys")):
            if now != bucket and held:
                yield _in_common(bucket, held)
                held = []
            bucket = now
            held.append(keys)
    if held:
        yield _in_common(bucket, held)


_PLACE = ("key", "lo", "hi")


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row is of another piece than the row before."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in _PLACE:
        c = table.column(name).to_numpy()
        out |= c[1:] != c[:-1]
    return np.flatnonzero(out) + 1


def _by_pieces(fn: Callable[[pa.Table], pa.Table], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn of runs of whole pieces of trees, of rows that come sorted by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in slices(batches, rows):
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            ends = _changes(pa.Table.from_batches([*last, part])) - len(last)
            if len(ends):
                yield from fn(pa.Table.from_batches([*held, part.slice(0, ends[-1])])).to_batches()
                held, part = [], part.slice(ends[-1])
            if part.num_rows:
                held.append(part)
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return run


def _candidates(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same piece that the bounds leave: of different components, and across the sides of a piece that has two.

    Pieces of one leaf are compared by their points, many pieces at a time; each larger one gets its tree.
    """
    points, sizes, place = _points(table.column("point")), table.column("n").to_numpy(), table.column("pos").to_numpy()
    side, root = table.column("side").to_numpy(), table.column("root").to_numpy()
    changes = _changes(table)
    starts, ends = np.r_[0, changes], np.r_[changes, table.num_rows]

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (root[i] != root[j]) & fitting(sizes[i], sizes[j], place[i], place[j])

    lengths = ends - starts
    two = np.repeat(np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts), lengths)
    end_of = np.repeat(np.where(lengths <= FANOUT, ends, 0), lengths)
    at = np.arange(table.num_rows)
    for step in range(1, FANOUT):
        at = at[at + step < end_of[at]]
        i, j = at, at + step
        keep = wanted(i, j) & (~two[i] | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        for k in range(0, len(i), AT_ONCE):
            a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            close = may_be(points[a], points[b], sizes[a], sizes[b])
            yield a[close], b[close]
    for start, end in zip(starts[lengths > FANOUT].tolist(), ends[lengths > FANOUT].tolist()):
        rows = np.arange(start, end)
        if len(np.unique(root[rows])) == 1:
            continue
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        if len(left) and len(right):
            found = CountTree(points[left], sizes[left]).pairs(CountTree(points[right], sizes[right]))
            found = ((left[i], right[j]) for i, j in found)
        else:
            found = ((rows[i], rows[j]) for i, j in CountTree(points[rows], sizes[rows]).pairs())
        for i, j in found:
            keep = wanted(i, j)
            yield i[keep], j[keep]


def _with_partner(table: pa.Table) -> pa.Table:
    """Rows that have a row of their piece to be compared with by sizes and places alone, without points; all rows of large pieces."""
    sizes, place = table.column("n").to_numpy(), table.column("pos").to_numpy()
    side, root = table.column("side").to_numpy(), table.column("root").to_numpy()
    changes = _changes(table)
    starts, ends = np.r_[0, changes], np.r_[changes, table.num_rows]
    lengths = ends - starts
    two = np.repeat(np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts), lengths)
    small = np.repeat(lengths <= FEW, lengths)
    end_of = np.where(small, np.repeat(ends, lengths), 0)
    kept, at = ~small, np.arange(table.num_rows)
    for step in range(1, FEW):
        i = at = at[at + step < end_of[at]]
        j = i + step
        fits = (root[i] != root[j]) & fitting(sizes[i], sizes[j], place[i], place[j]) & (~two[i] | (side[i] != side[j]))
        kept[i[fits]] = kept[j[fits]] = True
    return table.filter(pa.array(kept))


def _open_pairs(table: pa.Table) -> pa.Table:
    """Of each piece the pairs that the bounds leave, as rows with `partner`; of a piece that has more than FEW for each row
    the rows that are in any, without one."""
    cls, none = table.column("cls").to_numpy(), np.zeros(0, np.int64)
    changes = _changes(table)
    lengths = np.r_[changes, table.num_rows] - np.r_[0, changes]
    piece = np.repeat(np.arange(len(lengths)), lengths)
    found = list(_candidates(table))
    i, j = (np.concatenate([none, *side]) for side in (zip(*found) if found else ((), ())))
    many = np.bincount(piece[i], minlength=len(lengths)) > FEW * lengths
    few = ~many[piece[i]]
    pairs = np.unique(np.sort(np.c_[cls[i[few]], cls[j[few]]], axis=1), axis=0)
    dense = np.zeros(table.num_rows, bool)
    dense[i[~few]] = dense[j[~few]] = True
    rows = table.filter(pa.array(dense))
    rows = rows.append_column("partner", pa.nulls(rows.num_rows, pa.int64()))
    made = {"cls": pa.array(pairs[:, 0]), "partner": pa.array(pairs[:, 1])}
    columns = [made.get(f.name, pa.nulls(len(pairs), f.type)) for f in rows.schema]
    return pa.concat_tables([rows, pa.table(columns, schema=rows.schema)])


def _links_within(table: pa.Table) -> pa.Table:
    """Verified pairs that join what was apart."""
    sets, cls = table.column("hashes"), table.column("cls").to_numpy()
    _, first, which = np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
    up = first[which].tolist()

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for i, j in _candidates(table):
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = top(x), top(y)
            if a != b and similar(*(np.frombuffer(sets[z].as_buffer(), _U) for z in (x, y))):
                up[max(a, b)] = min(a, b)
                links.append((x, y))
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": cls[ends[:, 0]], "b": cls[ends[:, 1]]})


def ngram_links(points: DataFrame, sets_of: Callable[[DataFrame], DataFrame], piece: int = PIECE) -> DataFrame:
    """Links (a, b) between classes (cls, n, point, keys) of the similarity, enough to connect all that have it.

    `sets_of` adds the hashes to a table with cls.
    """
    keyed = points.select("cls", "n", "keys").mapInArrow(_to_buckets, "bucket int, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    members = stored(keyed.mapInArrow(_shared, "cls long, n long, pos int, key long, least long"), "ngram-members")
    info = points.select("cls", "n", "point")

    # The star of a class is the smallest class of most of its trees; a star of many is dealt to parts.
    common = members.where("cls <> least").groupBy("cls", "least").agg(F.count("*").alias("trees"))
    stars = common.groupBy(F.col("cls").alias("b")).agg(F.max_by("least", F.struct("trees", -F.col("least"))).alias("a"))
    stars = stored(_with_ends(stars, info).mapInArrow(_plausible, "a long, b long"), "ngram-stars")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar: each b goes where the set of its a is, and an a of many is dealt to parts."""
        parts = F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts")
        dealt = pairs.join(pairs.groupBy("a").agg(parts), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        others = dealt.select("a", "part", F.lit(True).alias("other"), F.col("b").alias("cls"))
        heads = dealt.select("a", "part", F.lit(False).alias("other"), F.col("a").alias("cls")).distinct()
        sets = sets_of(heads.unionByName(others)).repartition("a", "part").sortWithinPartitions("a", "part", "other", "cls")
        return stored(sets.mapInArrow(_like_their_star, "a long, b long"), "ngram-links")

    links = verified(stars)
    roots = connected_components(links).withColumnRenamed("node", "cls")
    rest = members.drop("least").join(roots, "cls", "left")
    rest = stored(rest.withColumn("root", F.coalesce("root", "cls")), "ngram-rest")

    def by_piece(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "cls")

    # Few pairs are sent to each other, once however many trees they share; where there are many, rows meet in their piece.
    # Points are many times larger than the other columns, so only rows that sizes and places leave a partner get theirs.
    dealt = by_piece(deal(rest, ["key"], "n", piece))
    dealt = stored(dealt.mapInArrow(_by_pieces(_with_partner, AT_ONCE), dealt.schema), "ngram-dealt")
    left = by_piece(dealt.join(info.drop("n"), "cls"))
    schema = T.StructType([*left.schema.fields, T.StructField("partner", T.LongType())])
    left = stored(left.mapInArrow(_by_pieces(_open_pairs, AT_ONCE), schema), "ngram-open")
    pairs = left.where("partner IS NOT NULL").select(F.col("cls").alias("a"), F.col("partner").alias("b")).distinct()
    pairs = stored(pairs, "ngram-pairs")

    # Pairs that hang together meet in one place, each set once; where more hang together than fit, each b goes to its a.
    groups = connected_components(pairs).withColumnsRenamed({"node": "cls", "root": "group"}).join(info.drop("point"), "cls")
    sizes = groups.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    fits = (F.col("c") <= PIECE) & (F.col("s") <= PIECE_SIZE)
    placed = stored(groups.drop("n").join(sizes.select("group", fits.alias("fits")), "group"), "ngram-groups")
    partners = pairs.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("partners"))
    together = placed.where("fits").drop("fits").join(partners, "cls", "left")
    together = sets_of(together).repartition("group").sortWithinPartitions("group", "cls")
    links = links.unionByName(stored(together.mapInArrow(_linked_groups, "a long, b long"), "ngram-grouped"))
    wide = placed.where("NOT fits").select(F.col("cls").alias("a"))
    if not wide.isEmpty():
        links = links.unionByName(verified(pairs.join(wide, "a", "left_semi")))
    dense = left.where("partner IS NULL").drop("partner")
    if not dense.isEmpty():
        more = by_piece(sets_of(dense)).mapInArrow(_by_pieces(_links_within, 256), "a long, b long")
        links = links.unionByName(more)
    return links.distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Per row: the key (a whole number), `n_shingles`, and `component_id`, the smallest key that a chain of links reaches."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "row long, id long, text string, n long, digest binary, piece int, counts binary"
    whole = stored(plain.mapInArrow(_sets_and_occurrences, schema), "ngram-rows")
    table = docs.sparkSession.sparkContext.broadcast(_occurrences(whole))
    rows = whole.where("piece IS NULL").drop("piece", "counts")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("cls"), F.min("id").alias("least"))
    classes = stored(classes, "ngram-classes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return rows.select(F.col("row").alias("cls"), "text").join(stored_small(wanted), "cls")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [ngram_set(t) for t in utf8(part.column("text"))]
            columns = [
                part.column("cls"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_packed(group_counts(x)) for x in sets], pa.binary()),
                pa.array([rarest(x, table.value).view(np.int64) for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "point", "keys"])

    points = texts_of(classes.select("cls")).mapInArrow(located, "cls long, n long, point binary, keys array<long>")
    points = stored(points, "ngram-points")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The table with the hashes of each row's class; a text is read once, however many rows it has."""
        own = wanted.groupBy("cls").agg(F.collect_list(F.struct(*wanted.columns)).alias("rows"))
        texts = texts_of(own)
        schema = f"cls long, hashes binary, rows {dict(own.dtypes)['rows']}"

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 64):
                sets = pa.array([ngram_set(t).tobytes() for t in utf8(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cls"), sets, part.column("rows")], names=["cls", "hashes", "rows"])

        found = texts.select("cls", "text", "rows").mapInArrow(made, schema)
        return found.select("hashes", F.explode("rows").alias("r")).select("r.*", "hashes")

    links = ngram_links(points, sets_of, piece)
    roots = connected_components(links).withColumnRenamed("node", "cls")
    placed = stored(classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "ngram-placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(least, "root").select("digest", "component_id", F.lit(True).alias("linked"))
    out = rows.select("id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
