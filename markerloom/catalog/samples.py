"""Scans, cleaning, summaries, bins and states."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from markerloom.catalog import fixtures as X
from markerloom.catalog.base import big, query, r6, rounded, table
from markerloom.functions.scalars import NAN, finite, label_from_name
from markerloom.functions.scalars import clip_index as clipped
from markerloom.operators import binning as B
from markerloom.operators import cleaning as CL
from markerloom.operators import markers as MK
from markerloom.operators import summaries as S
from markerloom.session import new_path
from markerloom.sources import measurements as FCS
from markerloom.sources import tables as T
from markerloom.sources.fcs_bytes import encode_fcs

M, FEATS = X.MARKERS, X.FEATURES
ROW = ["sample_id", "ord", "line"]


def finite_sql(names=M, digits=True) -> str:
    f = "round({c}, 6) + 0.0" if digits else "{c}"
    return ", ".join(f"CASE WHEN isfinite({c}) THEN {f.format(c=c)} END AS {c}" for c in names)


def shown(df, keep, names=M):
    """Rows with the finite values rounded, others null."""
    return df.select(*keep, *[r6(finite(F.col(c))).alias(c) for c in names])


# ---- sources -------------------------------------------------------------------


def _files(spark, sf):
    """(path, length) of a folder: the cells of a supplier as files of 100,000 orders each, every tenth file cut short."""
    folder = new_path(spark, "measurements")

    def put(batches):
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        files.create_dir(f"{root}/cells", recursive=True)
        count = 0
        for path, content in _contents(batches):
            files.create_dir(root + path.rsplit("/", 1)[0], recursive=False)
            with files.open_output_stream(root + path) as out:
                out.write(content)
            count += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    _file_cells(spark, sf).mapInArrow(put, "n bigint").agg(F.sum("n")).first()
    return FCS.scan_files(spark, folder)


def _place(df):
    """The path from the folder on."""
    return df.withColumn("path", F.regexp_extract("path", "/cells/.*$", 0))


def _file_cells(spark, sf):
    """(h, sample_id, part, ord, line, <marker>...): the cells of a file are together in a partition, by a hash of the file. No job has
    a cost of its own for each of many files, and one number is sorted faster than the order of all cells."""
    part = F.floor(F.col("ord") / 100_000).cast("bigint")
    cells = X.cells(spark, sf).select("sample_id", "ord", "line", *M).repartition("sample_id", part)
    return cells.select(F.xxhash64("sample_id", part).alias("h"), "sample_id", part.alias("part"), "ord", "line", *M).sortWithinPartitions("h")


def _numbers(columns):
    """(values, whether they are there) of integer columns; null is 0."""
    return [(c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)) for c in columns]


def _files_of(batches):
    """(sample, part, values) of each file of the cells of a task, its cells by ord, line and tnfa; None stands for null."""

    def ordered(held):
        keys = [np.concatenate([x[i] for x in held]) for i in range(len(held[0]))]
        sample, here, part, dated, ord_, known, line, numbered, values = keys
        # The last key counts most: null is behind all others, as is NaN.
        order = np.lexsort((values[:, M.index("tnfa")], line, ~numbered, ord_, ~known, part, ~dated, sample, ~here))
        sample, here, part, dated, values = (x[order] for x in (sample, here, part, dated, values))
        # Files of one hash, hardly ever more than one.
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in (sample, here, part, dated)])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sample)]):
            yield int(sample[a]) if here[a] else None, int(part[a]) if dated[a] else None, values[a:b]

    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        columns = [x for pair in _numbers(batch.column(c) for c in ("sample_id", "part", "ord", "line")) for x in pair]
        columns.append(np.column_stack([batch.column(m).to_numpy(zero_copy_only=False) for m in M]))
        cuts = (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(h)]):
            if h[a] != current and held:
                yield from ordered(held)
                held = []
            current = h[a]
            held.append([x[a:b] for x in columns])
    if held:
        yield from ordered(held)


def _contents(batches):
    """(path from the folder on, bytes) of each file."""
    for sample, part, values in _files_of(batches):
        content = encode_fcs(["IFNa-PE", "IL6", "cd14 APC", "tnfa"], values)
        if sample is not None and part is not None and (sample + part) % 10 == 0:
            content = content[:-8]
        yield f"/cells/{'nan' if sample is None else sample}/{'nan' if part is None else part}.fcs", content


table(
    "filed",
    """SELECT *, '/cells/' || sample_id || '/' || (ord // 100000) || '.fcs' AS path,
  (sample_id + ord // 100000) % 10 = 0 AS bad,
  row_number() OVER (PARTITION BY sample_id, ord // 100000 ORDER BY ord, line, tnfa) - 1 AS event FROM cells""",
    ("cells",),
)


def _f32(names=M) -> str:
    return ", ".join(
        f"CASE WHEN isfinite({c}) THEN CAST(CAST({c} AS FLOAT) AS DOUBLE) + 0.0 END AS {c}" for c in names
    )


@query(f"SELECT path, event, {_f32()} FROM filed WHERE NOT bad", ("filed",))
def scan_measurements(spark, sf):
    cells = _place(FCS.decode_measurements(_files(spark, sf), M))
    return cells.select("path", "event", *[(finite(F.col(c)) + 0.0).alias(c) for c in M])


@query(
    """SELECT path, CASE WHEN NOT bad THEN count(*) END AS n_events, CAST(bad AS BIGINT) AS failed
FROM filed GROUP BY path, bad""",
    ("filed",),
)
def scan_manifest(spark, sf):
    files = _place(FCS.scan_manifest(_files(spark, sf), M))
    return files.select("path", "n_events", big(F.col("error").isNotNull()).alias("failed"))


@query(
    "SELECT count(DISTINCT path) FILTER (NOT bad) AS loaded, count(DISTINCT path) FILTER (bad) AS failed FROM filed",
    ("filed",),
)
def scan_counts(spark, sf):
    return FCS.manifest_counts(FCS.scan_manifest(_files(spark, sf), M))


@query(
    f"""SELECT path, {", ".join(f"round(coalesce(median(CASE WHEN isfinite({c}) THEN asinh(CAST(CAST({c} AS FLOAT) AS DOUBLE) / 150) END), 0.0), 6) + 0.0 AS {c}" for c in M)}
FROM filed WHERE NOT bad GROUP BY path""",
    ("filed",),
)
def load_batch(spark, sf):
    return shown(_place(FCS.load_batch(_files(spark, sf), M)), ["path"])


@query("SELECT * FROM labn", ("labn",))
def scan_labels(spark, sf):
    path = new_path(spark, "labels")
    rows = X.label_rows(spark, sf).selectExpr("id AS FCSFileName", "label AS Label", "'x' AS Note")
    rows.write.option("header", True).csv(path)
    return T.scan_labels(spark, path)


@query("SELECT filename, id, label FROM labn WHERE filename NOT IN (SELECT filename FROM docf)", ("labn", "docf"))
def missing_files(spark, sf):
    return CL.missing_files(CL.normalize_label_rows(X.label_rows(spark, sf)), X.document_files(spark, sf))


@query(
    """SELECT 'vec' || vec_id || '.fcs' AS filename, label AS encoded_state, label + 2 AS selected_cluster_count,
  vec_id % (label + 2) AS assigned_cluster,
  CASE WHEN vec_id % (label + 2) = 0 THEN 'positive' ELSE 'negative' END AS predicted_hiv_status FROM vec""",
    ("vec",),
)
def write_predictions(spark, sf):
    k = F.col("label") + 2
    rows = X.vectors(spark, sf).select(
        F.concat(F.lit("vec"), "vec_id", F.lit(".fcs")).alias("filename"),
        F.col("label").alias("encoded_state"),
        k.alias("selected_cluster_count"),
        (F.col("vec_id") % k).alias("assigned_cluster"),
        F.when(F.col("vec_id") % k == 0, "positive").otherwise("negative").alias("predicted_hiv_status"),
    )
    path = new_path(spark, "predictions")
    T.write_predictions(rows, path)
    return T.read_predictions(spark, path)


EXPLODED = "SELECT feature, i - 1 AS pos, round(edges[i], 6) + 0.0 AS edge FROM qbins, range(1, 7) t(i)"


def _edge_rows(bins):
    return bins.select("feature", F.posexplode("edges").alias("pos", "edge")).select(
        "feature", big("pos").alias("pos"), r6("edge").alias("edge")
    )


def _event_bins(spark, sf):
    return B.quantile_bins(X.marker_values(spark, sf))


@query(EXPLODED, ("qbins",))
def quantile_bins(spark, sf):
    return _edge_rows(_event_bins(spark, sf))


@query(
    """SELECT g AS feature, i - 1 AS pos, round(e[i], 6) + 0.0 AS edge FROM (
SELECT g, list_reduce([[x] FOR x IN q], lambda a, x: list_append(a, CASE WHEN x[1] <= a[-1] THEN a[-1] + 1e-6 ELSE x[1] END)) AS e
FROM (SELECT l_linestatus || l_linenumber AS g, quantile_cont(CAST(l_linenumber % 3 AS DOUBLE) + floor(l_tax * 20), [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q
FROM lineitem GROUP BY 1)), range(1, 7) t(i)""",
)
def quantile_bins_ties(spark, sf):
    """Values with few distinct ones: repeated edges are moved apart, and the ranks
    are found by counting passes."""
    values = T.parquet(spark, sf, "lineitem").select(
        F.concat("l_linestatus", "l_linenumber").alias("marker"),
        ((F.col("l_linenumber") % 3).cast("double") + F.floor(F.col("l_tax") * 20)).alias("value"),
    )
    return _edge_rows(B.quantile_bins(values, direct_limit=100))


@query(EXPLODED, ("qbins",))
def save_bins(spark, sf):
    path = new_path(spark, "bins")
    T.save_tables({"bins": _event_bins(spark, sf)}, path)
    return _edge_rows(T.load_table(spark, path, "bins"))


# ---- markers -------------------------------------------------------------------

ASKED = ["view", "Click", "sign", "PURCHASE", "missing9"]


def _channels(spark, sf):
    """The event types of a user as that file's channels, named in four ways."""
    ev = T.parquet(spark, sf, "events").groupBy(F.col("user_id").alias("file"))
    rows = ev.agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    rows = rows.select("file", F.posexplode("types").alias("pos", "t"))
    way = (F.col("file") + F.col("pos")) % 4
    name = (
        F.when(way == 0, F.col("t"))
        .when(way == 1, F.upper("t"))
        .when(way == 2, F.concat("t", F.lit("-PE")))
        .otherwise(F.concat(F.lit("FSC view "), "t"))
    )
    return rows.select("file", big("pos").alias("pos"), name.alias("channel"))


table(
    "chan",
    """SELECT file, pos, CASE (file + pos) % 4 WHEN 0 THEN t WHEN 1 THEN upper(t) WHEN 2 THEN t || '-PE'
  ELSE 'FSC view ' || t END AS channel
FROM (SELECT user_id AS file, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS pos
  FROM (SELECT DISTINCT user_id, event_type FROM events))""",
)
ASKED_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in ASKED) + ") a(marker)"


@query(
    f"""SELECT file, marker, channel FROM (SELECT *, CASE WHEN channel = marker THEN 0
  WHEN lower(channel) = lower(marker) THEN 1 WHEN contains(lower(channel), lower(marker)) THEN 2 END AS r
FROM chan, {ASKED_SQL}) WHERE r IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file, marker ORDER BY r, pos) = 1""",
    ("chan",),
)
def resolve_markers(spark, sf):
    return MK.resolve_markers(_channels(spark, sf), ASKED)


@query(
    f"""SELECT file, marker, coalesce(arg_min(channel, pos) FILTER (contains(lower(channel), lower(marker))), marker) AS channel
FROM chan, {ASKED_SQL} GROUP BY 1, 2""",
    ("chan",),
)
def locate_marker(spark, sf):
    return MK.locate_marker(_channels(spark, sf), ASKED)


@query(f"SELECT sample_id, ord, line, {finite_sql(['ifna', 'il6', 'cd14'])} FROM cells", ("cells",))
def select_markers(spark, sf):
    physical = X.cells(spark, sf).withColumnsRenamed({"ifna": "IFNa-PE", "il6": "IL6", "cd14": "CD14 APC"})
    return shown(MK.select_markers(physical, ["ifna", "il6", "cd14", "cd99"], ROW), ROW, ["ifna", "il6", "cd14"])


# ---- cleaning ------------------------------------------------------------------


@query(f"SELECT sample_id, ord, line, {finite_sql()} FROM trans", ("trans",))
def asinh_transform(spark, sf):
    return shown(CL.asinh_transform(X.cells(spark, sf), M), ROW)


@query(f"SELECT sample_id, ord, line, {finite_sql()} FROM clean", ("clean",))
def clean_values(spark, sf):
    raw = CL.asinh_transform(X.cells(spark, sf), M)
    return shown(CL.clean_values(raw, ["sample_id"], M), ROW)


TYPES = ["click", "error", "purchase", "signup", "view"]
table(
    "users",
    "SELECT user_id, "
    + ", ".join(
        f"median(CASE WHEN event_type = '{t}' AND user_id % 10 <> {i} THEN value END) AS f_{t}" for i, t in enumerate(TYPES)
    )
    + " FROM events GROUP BY 1",
)


def _users(spark, sf):
    u = F.col("user_id")
    return (
        T.parquet(spark, sf, "events")
        .groupBy("user_id")
        .agg(
            *[
                F.median(F.when((F.col("event_type") == t) & (u % 10 != i), F.col("value"))).alias(f"f_{t}")
                for i, t in enumerate(TYPES)
            ]
        )
        .withColumn("empty", F.lit(NAN))
    )


@query(
    "SELECT user_id, i - 1 AS dim, round([" + ", ".join(f"f_{t}" for t in TYPES) + "][i], 6) + 0.0 AS x FROM (SELECT user_id, "
    + ", ".join(f"coalesce(f_{t}, (SELECT median(f_{t}) FROM users)) AS f_{t}" for t in TYPES)
    + " FROM users), range(1, 6) t(i)",
    ("users",),
)
def feature_matrix(spark, sf):
    points, _ = CL.feature_matrix(_users(spark, sf), "user_id")
    return points.select("user_id", F.posexplode("features").alias("dim", "x")).select(
        "user_id", big("dim").alias("dim"), r6("x").alias("x")
    )


DIRTY = "CASE WHEN p_partkey % 7 = 0 THEN 'n/a' WHEN p_partkey % 11 = 0 THEN 'inf' WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST({c} AS {t}) END"
table(
    "dirty",
    "SELECT p_partkey, "
    + ", ".join(f"try_cast({DIRTY.format(c=c, t='VARCHAR')} AS DOUBLE) AS {c}" for c in ("p_size", "p_retailprice"))
    + " FROM part",
)


@query(
    "SELECT p_partkey, "
    + ", ".join(
        f"round(CASE WHEN isfinite({c}) THEN {c} ELSE (SELECT median({c}) FROM dirty WHERE isfinite({c})) END, 6) + 0.0 AS {c}"
        for c in ("p_size", "p_retailprice")
    )
    + " FROM dirty",
    ("dirty",),
)
def numeric_coerce(spark, sf):
    cols = ["p_size", "p_retailprice"]
    raw = T.parquet(spark, sf, "part").select(
        "p_partkey", *[F.expr(DIRTY.format(c=c, t="STRING")).alias(c) for c in cols]
    )
    return rounded(CL.numeric_coerce(raw, cols), *cols)


NAMES_SQL = "SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '_Positive' WHEN 1 THEN '_Neg' WHEN 2 THEN '_POS_negative' ELSE '' END || '.fcs' AS filename FROM customer"
table("named", f"SELECT *, {X.LABEL_SQL} AS label FROM ({NAMES_SQL})")


def _named(spark, sf):
    way = F.col("c_custkey") % 4
    suffix = F.when(way == 0, "_Positive").when(way == 1, "_Neg").when(way == 2, "_POS_negative").otherwise("")
    return T.parquet(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", suffix, F.lit(".fcs")).alias("filename")
    )


@query("SELECT * FROM named", ("named",))
def label_from_filename(spark, sf):
    return _named(spark, sf).withColumn("label", label_from_name(F.col("filename")))


@query("SELECT * FROM named WHERE label IS NOT NULL", ("named",))
def labeled_only(spark, sf):
    return CL.labeled_only(_named(spark, sf).withColumn("label", label_from_name(F.col("filename"))))


@query(
    """SELECT doc_id, 'text' AS kind, CAST(contains(lower(CASE WHEN doc_id % 5 = 0 THEN 'heu' WHEN quality = 1 THEN 'HEU' ELSE 'UE' END), 'heu') AS BIGINT) AS y FROM labels
UNION ALL SELECT doc_id, 'number', CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 0 ELSE CAST(quality > 0 AS BIGINT) END FROM labels""",
)
def label_to_binary(spark, sf):
    rows = T.parquet(spark, sf, "labels")
    d = F.col("doc_id")
    text = F.when(d % 5 == 0, "heu").when(F.col("quality") == 1, "HEU").otherwise("UE")
    number = F.when(d % 4 == 0, "x").when(d % 4 == 1, "-1").otherwise(F.col("quality").cast("string"))
    parts = [
        CL.label_to_binary(rows.select("doc_id", F.lit(kind).alias("kind"), c.alias("label")))
        for kind, c in (("text", text), ("number", number))
    ]
    return parts[0].unionByName(parts[1]).select("doc_id", "kind", "y")


@query(
    """SELECT event_id, greatest(0, least(24, event_id % 40 - 5)) AS state, greatest(0, least(8, user_id % 14 - 2)) AS action FROM events""",
)
def clip_index(spark, sf):
    return T.parquet(spark, sf, "events").select(
        "event_id",
        clipped(F.col("event_id") % 40 - 5, 25).alias("state"),
        clipped(F.col("user_id") % 14 - 2, 9).alias("action"),
    )


# ---- bins and states -----------------------------------------------------------

CUTS = [0.0, 5.0, 20.0, 60.0, 150.0, math.inf]


@query(
    f"""SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 4 ELSE {X.digitize_sql('value', CUTS)} END AS five,
  CASE WHEN event_id % 19 = 0 THEN 4 ELSE {X.digitize_sql('value / 20', X.EDGES)} END AS by_default, 0::BIGINT AS one FROM events""",
)
def digitize(spark, sf):
    e = F.col("event_id") % 38
    value = F.when(e == 0, F.lit(NAN)).when(e == 19, F.lit(None)).otherwise(F.col("value"))
    edges = F.array(*[F.lit(c) for c in CUTS])
    return T.parquet(spark, sf, "events").select(
        "event_id",
        B.digitize_by(value, edges).alias("five"),
        B.digitize(value / 20, B.DEFAULT_EDGES).alias("by_default"),
        B.digitize(value, [0.0, 9.0]).alias("one"),
    )


@query(
    """SELECT feature, i - 1 AS pos, CASE WHEN isfinite(edges[i]) THEN round(edges[i], 6) + 0.0 END AS edge
FROM (SELECT f.feature, coalesce(b.edges, [0.0::DOUBLE, 0.5, 1, 2, 3, 'inf'::DOUBLE]) AS edges
  FROM (SELECT DISTINCT event_type AS feature FROM events) f LEFT JOIN (SELECT * FROM qbins WHERE feature > 'f') b USING (feature)),
range(1, 7) t(i)""",
    ("qbins",),
)
def default_bins(spark, sf):
    names = T.parquet(spark, sf, "events").select(F.col("event_type").alias("feature")).distinct()
    bins = _event_bins(spark, sf).where(F.col("feature") > "f")
    rows = _edge_rows(B.with_default_edges(names, bins))
    return rows.withColumn("edge", finite(F.col("edge")))


@query(f"SELECT sample_id, {', '.join(f + '_bin' for f in FEATS)} FROM binned", ("binned",))
def discretize(spark, sf):
    return X.samples(spark, sf).select("sample_id", *[f"{f}_bin" for f in FEATS])


@query(
    """SELECT event_id, ((event_id % 5) * 4 + user_id % 4) * 3 + floor(value)::BIGINT % 3 AS mixed,
  (event_id % 4) * 4 + user_id % 4 AS by_default FROM events""",
)
def encode_state(spark, sf):
    e, u, v = F.col("event_id"), F.col("user_id"), F.floor("value").cast("bigint")
    return T.parquet(spark, sf, "events").select(
        "event_id",
        B.encode_state([e % 5, u % 4, v % 3], [5, 4, 3]).alias("mixed"),
        B.encode_state([e % 4, u % 4]).alias("by_default"),
    )


@query("SELECT sample_id, state, (ifna_bin * 5 + 0) * 5 + cd14_bin AS partial FROM samples", ("samples",))
def state_from_bins(spark, sf):
    s = X.samples(spark, sf)
    partial = B.state_column(s.columns, X.BINS, ["ifna", "unseen", "cd14"])
    return s.select("sample_id", "state", partial.alias("partial"))


@query(
    "SELECT event_id, event_id % 125 // 25 AS b0, event_id % 25 // 5 AS b1, event_id % 5 AS b2 FROM events",
)
def decode_state(spark, sf):
    parts = B.decode_state(F.col("event_id") % 125, [5, 5, 5])
    return T.parquet(spark, sf, "events").select("event_id", *[p.alias(f"b{i}") for i, p in enumerate(parts)])


@query(
    """SELECT feature, i - 1 AS bin, lo, hi, '[' || CAST(lo AS VARCHAR) || ', ' || CASE WHEN isfinite(hi) THEN CAST(hi AS VARCHAR) ELSE 'inf' END || ')' AS text
FROM (SELECT feature, i, round(edges[i], 2) + 0.0 AS lo, round(edges[i + 1], 2) + 0.0 AS hi FROM qbins, range(1, 6) t(i))""",
    ("qbins",),
)
def bin_catalog(spark, sf):
    bins = _event_bins(spark, sf)
    two = bins.withColumn("edges", F.transform("edges", lambda e: F.round(e, 2) + F.lit(0.0)))
    return B.bin_catalog(two)


def _range_sql(f: str) -> str:
    names = ["0.0", "0.5", "1.0", "2.0", "3.0", "inf"]
    cases = " ".join(f"WHEN {i} THEN '{f}: [{names[i]}, {names[i + 1]})'" for i in range(5))
    return f"CASE {f}_bin {cases} END"


@query(f"SELECT sample_id, {' || chr(32) || chr(124) || chr(32) || '.join(_range_sql(f) for f in FEATS)} AS text FROM binned", ("binned",))
def bin_interpretation(spark, sf):
    return B.describe_bins(X.samples(spark, sf), X.BINS, FEATS).select("sample_id", "text")


@query(
    """SELECT feature, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) + 0.0 AS share FROM ("""
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}_bin AS bin FROM binned" for f in FEATS)
    + ") GROUP BY 1, 2",
    ("binned",),
)
def bin_statistics(spark, sf):
    return rounded(B.bin_statistics(X.samples(spark, sf), FEATS), "share")


@query(
    "SELECT count(*) AS n_features, CAST(product(len(edges) - 1) AS BIGINT) AS n_states FROM qbins WHERE feature < 'q'",
    ("qbins",),
)
def state_space(spark, sf):
    return B.state_space(_event_bins(spark, sf).where(F.col("feature") < "q"))


@query("SELECT count(DISTINCT state) AS n_states FROM samples", ("samples",))
def state_coverage(spark, sf):
    return B.state_coverage(X.samples(spark, sf))


@query("SELECT state, count(*) AS n_samples, count(label) AS n_labeled, round(avg(tnfa), 6) + 0.0 AS mean_tnfa FROM samples GROUP BY 1", ("samples",))
def profile_states(spark, sf):
    """The flagship: cells to states, counted."""
    return X.samples(spark, sf).groupBy("state").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count("label").alias("n_labeled"),
        r6(F.avg("tnfa")).alias("mean_tnfa"),
    )


# ---- summaries -----------------------------------------------------------------

SUMMARY_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in M)


@query(f"SELECT sample_id, filename, {SUMMARY_SQL}, label FROM summary", ("summary",))
def summarize_median(spark, sf):
    raw = CL.asinh_transform(X.cells(spark, sf), M)
    return rounded(S.summarize(raw, ["sample_id"], M, name="filename"), *M)


@query(f"SELECT sample_id, filename, {SUMMARY_SQL}, label FROM summary", ("summary",))
def summarize_median_hot(spark, sf):
    """The same medians by counting passes, as for samples too large for one task."""
    raw = CL.asinh_transform(X.cells(spark, sf), M)
    return rounded(S.summarize(raw, ["sample_id"], M, name="filename", direct_limit=50), *M)


@query(
    f"SELECT sample_id, filename, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in M)}, {X.LABEL_SQL} AS label FROM clean GROUP BY 1, 2",
    ("clean",),
)
def summarize_mean(spark, sf):
    raw = CL.asinh_transform(X.cells(spark, sf), M)
    return rounded(S.summarize(raw, ["sample_id"], M, "mean", "filename"), *M)


@query(
    f"SELECT filename, ord, line, {finite_sql(['ifna', 'il6', 'cd14'])}, CASE WHEN sample_id % 2 = 0 THEN round(tnfa, 6) + 0.0 END AS tnfa FROM clean",
    ("clean",),
)
def summarize_all(spark, sf):
    """Cleaned cells of two batches of samples, one of them without tnfa."""
    raw = CL.asinh_transform(X.cells(spark, sf), M)
    cells = CL.clean_values(raw, ["sample_id"], M)
    even, odd = cells.where("sample_id % 2 = 0"), cells.where("sample_id % 2 = 1").drop("tnfa")
    keys = ["filename", "ord", "line"]
    both = S.union_samples([S.summarize(even, keys, M, "all"), S.summarize(odd, keys, M[:3], "all")])
    return shown(both, keys)


@query(
    """SELECT count(*) FILTER (label = 'positive') AS n_positive, count(*) FILTER (label = 'negative') AS n_negative,
  count(label) AS n_labeled FROM named""",
    ("named",),
)
def label_counts(spark, sf):
    return S.label_counts(_named(spark, sf).withColumn("label", label_from_name(F.col("filename"))))


@query("SELECT filename, size, rest, root, label FROM (SELECT filename, size, rest, round(root, 6) + 0.0 AS root FROM docf) JOIN labn USING (filename)", ("docf", "labn"))
def join_labels(spark, sf):
    labels = CL.normalize_label_rows(X.label_rows(spark, sf))
    return rounded(CL.join_labels(X.document_files(spark, sf), labels), "root")
