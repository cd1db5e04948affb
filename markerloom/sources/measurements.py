"""Flow Cytometry Standard files (FCS 2.0 to 3.1 list mode) as cell tables.

Folders are listed, headers parsed and events read by tasks. The table of files has a row per file, the table of splits a
row per range of SPLIT_BYTES of events, dealt out anew, so a large file is read by many tasks and no task, nor the driver, holds a file or
the list of all. A task reads its split in slices, of which numpy makes columns. The header and text segments decide
the layout first, so unreadable files drop out before any data is touched.

Tasks open files through Arrow's file systems. For stores that only Spark can reach, scan_contents gives files as
rows, which all functions take as well; there a file has to fit in a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.functions.scalars import COFACTOR, basename, label_from_name
from markerloom.operators.cleaning import asinh_transform, clean_values
from markerloom.operators.markers import resolved_name
from markerloom.operators.summaries import summarize
from markerloom.session import checkpointed

# What is decoded at a time, and what one row of the table of splits stands for.
SLICE_BYTES = 256 * 1024
SPLIT_BYTES = 32 * 1024 * 1024
# Rows that tasks send on together, of however many files or folders.
BATCH_ROWS = 10_000

_LAYOUT = (
    "error string, n_events bigint, data_begin bigint, event_bytes int, "
    "formats array<string>, masks array<bigint>, names array<string>, picks array<int>"
)


# Largest file that can be a row of scan_contents.
LARGEST_FILE = 2_000_000_000
_NAMES = re.compile(r"[.]fcs$", re.IGNORECASE)
HEADER = 58


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are small but stand for much work, over all shuffle partitions: a stated number is not coalesced by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder: (path, length, folder)."""
    found: tuple[list, list, list] = ([], [], [])

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.int64(), pa.bool_()))], ["path", "length", "folder"])

    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, inner = _opened(path)
            for f in files.get_file_info(fs.FileSelector(inner)):
                folder = f.type == fs.FileType.Directory
                if folder or _NAMES.search(f.base_name):
                    for column, value in zip(found, (f"{path.rstrip('/')}/{f.base_name}", f.size, folder)):
                        column.append(value)
                if len(found[0]) >= BATCH_ROWS:
                    yield rows()
                    found = ([], [], [])
    yield rows()


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all .fcs files below a folder, in any case, of any size. Each level of folders is listed by one
    job, a folder by one task."""
    files, inner = _opened(folder)
    if files.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(folder)
    level = spark.createDataFrame([(folder, 0, True)], "path string, length bigint, folder boolean")
    levels = []
    while not level.isEmpty():
        level = checkpointed(_dealt(level, "path").mapInArrow(_listed, level.schema))
        levels.append(level.where("NOT folder").select("path", "length"))
        level = level.where("folder")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def scan_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all .fcs files below a folder, through Spark's own reader. Whole files are rows; larger ones
    than LARGEST_FILE have no content, and those without bytes are left out."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[fF][cC][sS]")
        .load(folder)
    )
    none = F.lit(None).cast("binary").alias("content")
    fits = found.where(F.col("length") <= LARGEST_FILE).select("path", "length", "content")
    large = found.select("path", "length").where(F.col("length") > LARGEST_FILE).select("path", "length", none)
    return fits.unionByName(large)


def _text_fields(text: bytes) -> dict[str, str]:
    """Keywords of a text segment; a doubled delimiter stands for itself."""
    body = text.decode("latin-1")
    sep, body = body[0], body[1:]
    parts = body.replace(sep * 2, "\0").split(sep)
    parts = [p.replace("\0", sep) for p in parts]
    return {k.strip().upper(): v.strip() for k, v in zip(parts[0::2], parts[1::2])}


def _layout(head: bytes, text: bytes, length: int, markers: Sequence[str] | None) -> dict:
    """Where and how the events of one file are stored."""
    if length == 0:
        raise ValueError("no bytes")
    if head is None and length > LARGEST_FILE:
        raise ValueError(f"{length} bytes are too many for one row")
    if head is None or not head.startswith(b"FCS") or not text:
        raise ValueError("not an FCS file")
    kw = _text_fields(text)
    kind = kw["$DATATYPE"].upper()
    if kw.get("$MODE", "L").upper() != "L" or kind not in "FDI":
        raise ValueError("not list-mode numbers")
    order = "<" if kw["$BYTEORD"].startswith("1") else ">"
    n_par, n_events = int(kw["$PAR"]), int(kw["$TOT"])
    names, formats, masks = [], [], []
    for i in range(1, n_par + 1):
        names.append(kw.get(f"$P{i}S") or kw[f"$P{i}N"])
        if kind == "I":
            bits, top = int(kw[f"$P{i}B"]), int(float(kw.get(f"$P{i}R", "0")))
            if bits not in (8, 16, 32, 64):
                raise ValueError(f"{bits}-bit integers")
            formats.append(f"{order}u{bits // 8}")
            masks.append((1 << (top - 1).bit_length()) - 1 if 0 < top < (1 << min(bits, 62)) else -1)
        else:
            formats.append(order + ("f4" if kind == "F" else "f8"))
            masks.append(-1)
    begin = int(head[26:34].strip() or 0) or int(kw["$BEGINDATA"])
    event_bytes = sum(np.dtype(f).itemsize for f in formats)
    if begin + n_events * event_bytes > length:
        raise ValueError("truncated data")
    picks = list(range(n_par))
    if markers is not None:
        found = [resolved_name(names, m) for m in markers]
        if not any(f is not None for f in found):
            raise ValueError(f"none of the markers {list(markers)}")
        picks = [-1 if f is None else names.index(f) for f in found]
    return {
        "error": None,
        "n_events": n_events,
        "data_begin": begin,
        "event_bytes": event_bytes,
        "formats": formats,
        "masks": masks,
        "names": names,
        "picks": picks,
    }


_NO_LAYOUT = dict.fromkeys(("n_events", "data_begin", "event_bytes", "formats", "masks", "names", "picks"))


def _layout_row(head: bytes, text: bytes, length: int, markers: Sequence[str] | None) -> dict:
    try:
        return _layout(head, text, length, markers)
    except Exception as e:  # an unreadable file is reported, not fatal
        return {"error": f"{type(e).__name__}: {e}", **_NO_LAYOUT}


def _read_layout(path: str, length: int, markers: Sequence[str] | None) -> dict:
    """The layout of a file of which only the header and the text segment are read."""
    try:
        files, inner = _opened(path)
        with files.open_input_file(inner) as file:
            head = file.read_at(min(HEADER, length), 0)
            first, last = (int(x) if x.strip().isdigit() else 0 for x in (head[10:18], head[18:26]))
            text = file.read_at(last - first + 1, first) if 0 < first < last < length else b""
    except OSError as e:
        return {"error": f"{type(e).__name__}: {e}", **_NO_LAYOUT}
    return _layout_row(head, text, length, markers)


_LAYOUT_ARROW = pa.schema(
    [("error", pa.string()), ("n_events", pa.int64()), ("data_begin", pa.int64()), ("event_bytes", pa.int32()),
     ("formats", pa.list_(pa.string())), ("masks", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("picks", pa.list_(pa.int32()))]
)


def with_layout(files: DataFrame, markers: Sequence[str] | None = None) -> DataFrame:
    """Adds filename, error and the data layout to (path, length) or (path, length, content)."""
    wanted = None if markers is None else list(markers)
    named = files.withColumn("filename", basename(F.col("path")))
    if "content" not in files.columns:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())
                rows = pa.RecordBatch.from_pylist([_read_layout(path, n, wanted) for path, n in found], _LAYOUT_ARROW)
                yield pa.RecordBatch.from_arrays([*batch.columns, *rows.columns], names=[*batch.schema.names, *rows.schema.names])

        kept = _dealt(named.select("path", "filename", "length"), "path")
        return kept.mapInArrow(read, f"path string, filename string, length bigint, {_LAYOUT}").drop("length")

    @F.pandas_udf(_LAYOUT)
    def layout(head: pd.Series, text: pd.Series, length: pd.Series) -> pd.DataFrame:
        rows = [_layout_row(h, t, n, wanted) for h, t, n in zip(head, text, length)]
        return pd.DataFrame(rows, columns=["error", *_NO_LAYOUT])

    head = F.substring("content", 1, HEADER)

    def offset(at: int):
        return F.trim(F.decode(F.substring("content", at, 8), "US-ASCII")).try_cast("int")

    first, last = offset(11), offset(19)
    text = F.when(
        (first > 0) & (last > first), F.substring(F.col("content"), first + 1, last - first + 1)
    )
    return named.withColumn("layout", layout(head, text, F.col("length"))).select("path", "filename", "content", "layout.*")


def scan_manifest(files: DataFrame, markers: Sequence[str] | None = None) -> DataFrame:
    """(path, filename, n_events, error), one row per file."""
    return with_layout(files, markers).select("path", "filename", "n_events", "error")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    bad = F.col("error").isNotNull()
    return manifest.agg(F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("failed"))


class Slice(NamedTuple):
    """Neighbouring events of a file, as they are stored."""

    path: str
    filename: str
    formats: list[str]
    masks: list[int]
    names: list[str]
    picks: list[int]
    first_event: int
    data: bytes


def _content_slices(ready: DataFrame, slice_bytes: int) -> DataFrame:
    """Slices of files that are rows, cut inside the JVM; a file without events has one empty slice."""
    per = F.greatest(F.lit(1), F.floor(F.lit(slice_bytes) / F.col("event_bytes"))).cast("bigint")
    count = F.ceil(F.col("n_events") / per)

    def cut(i):
        first = i * per
        rows = F.least(per, F.col("n_events") - first)
        at = (F.col("data_begin") + first * F.col("event_bytes") + 1).cast("int")
        return F.struct(
            first.alias("first_event"),
            F.substring(F.col("content"), at, (rows * F.col("event_bytes")).cast("int")).alias("data"),
        )

    last = F.greatest(count - 1, F.lit(0).cast("bigint"))
    parts = F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), last), cut))
    return ready.select("path", "filename", "formats", "masks", "names", "picks", parts)


def splits(ready: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ranges of events (first_event, events) of files with a layout; a file without events has one empty range."""
    per = F.greatest(F.lit(1), F.floor(F.lit(split_bytes) / F.col("event_bytes"))).cast("bigint")
    last = F.greatest(F.ceil(F.col("n_events") / per) - 1, F.lit(0).cast("bigint"))
    cut = ready.withColumn("first_event", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cut = cut.withColumn("first_event", F.col("first_event") * per)
    return cut.withColumn("events", F.least(per, F.col("n_events") - F.col("first_event")))


def _read_slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[Slice]:
    """The slices of each split, read one after the other."""
    for batch in batches:
        for row in batch.to_pylist():
            per = max(1, slice_bytes // row["event_bytes"])
            facts = [row[c] for c in ("path", "filename", "formats", "masks", "names", "picks")]
            first, end = row["first_event"], row["first_event"] + row["events"]
            if first == end:
                yield Slice(*facts, first, b"")
                continue
            files, inner = _opened(row["path"])
            with files.open_input_file(inner) as file:
                for at in range(first, end, per):
                    n = min(per, end - at) * row["event_bytes"]
                    yield Slice(*facts, at, file.read_at(n, row["data_begin"] + at * row["event_bytes"]))


def _over_slices(
    ready: DataFrame,
    fn: Callable[[Iterator[Slice]], Iterator[pa.RecordBatch]],
    schema: str,
    slice_bytes: int,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """fn of the slices that a task has of files with a layout; those of a split follow each other."""
    if "content" in ready.columns:
        rows = _content_slices(ready, slice_bytes)
        return rows.mapInArrow(lambda batches: fn(Slice(*r) for b in batches for r in b.to_pandas().itertuples(index=False)), schema)
    # Splits are dealt out one by one, those of one file to many tasks.
    rows = _dealt(splits(ready, split_bytes), "path", "first_event")
    return rows.mapInArrow(lambda batches: fn(_read_slices(batches, slice_bytes)), schema)


def _readable(files: DataFrame, markers: Sequence[str] | None) -> DataFrame:
    return with_layout(files, markers).where(F.col("error").isNull()).drop("error")


def _columns(row, picks: Sequence[int]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Event numbers and one double array for each picked parameter of a slice, None for a pick below 0."""
    kind = np.dtype([(f"f{i}", f) for i, f in enumerate(row.formats)])
    data = np.frombuffer(row.data, dtype=kind) if row.data else np.zeros(0, dtype=kind)
    values: list[np.ndarray | None] = []
    for i in picks:
        if i < 0:
            values.append(None)
            continue
        x, mask = data[f"f{i}"], row.masks[i]
        values.append((x if mask < 0 else x & x.dtype.type(mask)).astype("float64"))
    return row.first_event + np.arange(len(data)), values


def decode_measurements(
    files: DataFrame, markers: Sequence[str], slice_bytes: int = SLICE_BYTES, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(path, filename, event, <marker>...): raw values under the logical marker
    names, null where a file lacks a marker. Unreadable files have no rows."""
    markers = list(markers)
    return _cells(_readable(files, markers), markers, slice_bytes, split_bytes)


def _cells(ready: DataFrame, markers: list[str], slice_bytes: int, split_bytes: int) -> DataFrame:
    names = ["path", "filename", "event", *markers]

    def joined(held: list[tuple[Slice, np.ndarray, list[np.ndarray | None]]]) -> pa.RecordBatch:
        sizes = [len(event) for _, event, _ in held]
        whose = pa.array(np.repeat(np.arange(len(held)), sizes))
        same = [pa.array([getattr(row, c) for row, _, _ in held], pa.string()).take(whose) for c in ("path", "filename")]
        event = pa.array(np.concatenate([event for _, event, _ in held]))
        # NaN is a value of the file, null a marker it does not have.
        picked = []
        for i in range(len(markers)):
            parts = [values[i] for _, _, values in held]
            if all(x is not None for x in parts):
                picked.append(pa.array(np.concatenate(parts), from_pandas=False))
            else:
                picked.append(pa.concat_arrays([pa.nulls(n, pa.float64()) if x is None else pa.array(x, from_pandas=False) for x, n in zip(parts, sizes)]))
        return pa.RecordBatch.from_arrays([*same, event, *picked], names)

    def decode(found: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count = 0
        for row in found:
            event, values = _columns(row, row.picks)
            held.append((row._replace(data=b""), event, values))
            count += len(event)
            if count >= BATCH_ROWS or len(held) >= BATCH_ROWS:
                yield joined(held)
                held, count = [], 0
        if held:
            yield joined(held)

    schema = "path string, filename string, event bigint, " + ", ".join(f"`{m}` double" for m in markers)
    return _over_slices(ready, decode, schema, slice_bytes, split_bytes)


def decode_long(files: DataFrame, slice_bytes: int = SLICE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, filename, event, channel, value) of all channels, whatever each file has."""

    def decode(found: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
        for row in found:
            event, values = _columns(row, range(len(row.formats)))
            for name, x in zip(row.names, values):
                same = {c: pa.array([v] * len(event), pa.string()) for c, v in (("path", row.path), ("filename", row.filename), ("channel", name))}
                columns = [same["path"], same["filename"], pa.array(event), same["channel"], pa.array(x, from_pandas=False)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "filename", "event", "channel", "value"])

    schema = "path string, filename string, event bigint, channel string, value double"
    return _over_slices(_readable(files, None), decode, schema, slice_bytes, split_bytes)


def channels(files: DataFrame) -> DataFrame:
    """(file, pos, channel) of the readable files, keyed by path."""
    ok = with_layout(files).where(F.col("error").isNull())
    return ok.select(F.col("path").alias("file"), F.posexplode("names").alias("pos", "channel"))


def load_batch(
    files: DataFrame,
    markers: Sequence[str],
    method: str = "median",
    transform: bool = True,
    slice_bytes: int = SLICE_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(path, filename, <marker>..., label): scan, transform, clean and summarize.

    A file of one split is summarized where it is read and no cell of it is shuffled. Files of several splits are read by
    several tasks and their cells summarized like those of any table, with exact medians from counts.
    A file without events has a row of NaN. With "all" the cells are returned.
    """
    markers = list(markers)
    if method == "all":
        cells = decode_measurements(files, markers, slice_bytes, split_bytes)
        cells = asinh_transform(cells, markers) if transform else cells
        return clean_values(cells, ["path"], markers).drop("event")
    if method not in ("median", "mean"):
        raise ValueError(f"unknown aggregation: {method}")

    def summary(parts: list[list[np.ndarray | None]]) -> dict:
        row: dict = {}
        for m, arrays in zip(markers, zip(*parts)):
            if arrays[0] is None:
                row[m] = None
                continue
            x = np.concatenate(arrays)
            x = np.arcsinh(x / COFACTOR) if transform else x
            good = x[np.isfinite(x)]
            if not len(x):
                row[m] = float("nan")
                continue
            middle = float(np.median(good)) if len(good) else 0.0
            filled = (good.sum() + (len(x) - len(good)) * middle) / len(x)
            row[m] = middle if method == "median" else filled
        return row

    kind = pa.schema([("path", pa.string()), ("filename", pa.string()), *((m, pa.float64()) for m in markers)])

    def reduce(found: Iterator[Slice]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        parts: list = []
        done: list[dict] = []

        def one() -> dict:
            return {"path": current[0], "filename": current[1], **summary(parts)}

        for row in found:
            if (row.path, row.filename) != current:
                if parts:
                    done.append(one())
                if len(done) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(done, kind)
                    done = []
                current, parts = (row.path, row.filename), []
            parts.append(_columns(row, row.picks)[1])
        if parts:
            done.append(one())
        yield pa.RecordBatch.from_pylist(done, kind)

    schema = "path string, filename string, " + ", ".join(f"`{m}` double" for m in markers)
    ready = _readable(files, markers)
    label = label_from_name(F.col("filename"))
    if "content" in files.columns:
        return _over_slices(ready, reduce, schema, slice_bytes).withColumn("label", label)
    # One row per file.
    ready = checkpointed(ready)
    several = F.col("n_events") > F.greatest(F.lit(1), F.floor(F.lit(split_bytes) / F.col("event_bytes")))
    out = _over_slices(ready.where(~several), reduce, schema, slice_bytes, split_bytes).withColumn("label", label)
    if ready.where(several).isEmpty():
        return out
    cells = _cells(ready.where(several), markers, slice_bytes, split_bytes)
    cells = asinh_transform(cells, markers) if transform else cells
    return out.unionByName(summarize(cells, ["path"], markers, method, "filename"))
