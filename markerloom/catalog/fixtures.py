"""Inputs derived from the given tables, once with Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.catalog.base import big, table
from markerloom.functions.scalars import INF, NAN, label_from_name, zfill
from markerloom.operators.clustering import nearest_centroid
from markerloom.operators.qtable import Learning
from markerloom.plans.profile import profile_samples
from markerloom.sources.tables import parquet

MARKERS = ["ifna", "il6", "cd14", "tnfa"]
FEATURES = ["ifna", "il6", "cd14"]
EDGES = [0.0, 0.5, 1.0, 2.0, 3.0, INF]
BINS = {f: EDGES for f in FEATURES}
LEARNING = Learning()
KS = list(range(LEARNING.min_k, LEARNING.max_k + 1))


# ---- cells: one sample per supplier, one cell per order line ----------------


def sample_name(s: Column) -> Column:
    suffix = F.when(s % 3 == 0, "_Positive").when(s % 3 == 1, "_neg").otherwise("")
    return F.concat(F.lit("patient"), F.lpad(s.cast("string"), 5, "0"), suffix, F.lit(".fcs"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = parquet(spark, sf, "lineitem")
    s, spot = F.col("l_suppkey"), F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        s.alias("sample_id"),
        sample_name(s).alias("filename"),
        F.col("l_orderkey").alias("ord"),
        big("l_linenumber").alias("line"),
        F.when(spot % 101 == 0, F.lit(NAN))
        .when(spot % 103 == 0, F.lit(-INF))
        .otherwise(F.col("l_quantity") - 25 + (s % 7) * 100)
        .alias("ifna"),
        F.when(s % 10 == 7, F.lit(NAN)).otherwise(F.col("l_discount") * 3000 + (s % 5) * 200).alias("il6"),
        (F.col("l_tax") * 1000 + F.when(s % 3 == 0, 300).otherwise(0)).alias("cd14"),
        (F.col("l_extendedprice") / 100).alias("tnfa"),
    )


table(
    "cells",
    """SELECT l_suppkey AS sample_id,
  concat('patient', lpad(CAST(l_suppkey AS VARCHAR), 5, '0'),
    CASE l_suppkey % 3 WHEN 0 THEN '_Positive' WHEN 1 THEN '_neg' ELSE '' END, '.fcs') AS filename,
  l_orderkey AS ord, CAST(l_linenumber AS BIGINT) AS line,
  CASE WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN (l_orderkey + l_linenumber) % 103 = 0 THEN CAST('-Infinity' AS DOUBLE)
       ELSE l_quantity - 25 + (l_suppkey % 7) * 100 END AS ifna,
  CASE WHEN l_suppkey % 10 = 7 THEN CAST('NaN' AS DOUBLE)
       ELSE l_discount * 3000 + (l_suppkey % 5) * 200 END AS il6,
  l_tax * 1000 + CASE WHEN l_suppkey % 3 = 0 THEN 300 ELSE 0 END AS cd14,
  l_extendedprice / 100 AS tnfa
FROM lineitem""",
)

_KEEP = "sample_id, filename, ord, line"


def _each(template: str, names=MARKERS) -> str:
    return ",\n  ".join(template.format(c=c) for c in names)


table("trans", f"SELECT {_KEEP},\n  {_each('asinh({c} / 150) AS {c}')}\nFROM cells", ("cells",))
table(
    "meds",
    f"SELECT sample_id,\n  {_each('median(CASE WHEN isfinite({c}) THEN {c} END) AS {c}_m')}\nFROM trans GROUP BY 1",
    ("trans",),
)
table(
    "clean",
    f"SELECT {_KEEP},\n  {_each('CASE WHEN isfinite({c}) THEN {c} ELSE coalesce({c}_m, 0.0) END AS {c}')}"
    "\nFROM trans JOIN meds USING (sample_id)",
    ("trans", "meds"),
)
LABEL_SQL = (
    "CASE WHEN contains(lower(filename), 'pos') THEN 'positive' "
    "WHEN contains(lower(filename), 'neg') THEN 'negative' END"
)
table(
    "summary",
    f"SELECT sample_id, filename,\n  {_each('median({c}) AS {c}')},\n  {LABEL_SQL} AS label\n"
    "FROM clean GROUP BY sample_id, filename",
    ("clean",),
)


def digitize_sql(x: str, edges=EDGES) -> str:
    tests = " + ".join(f"CASE WHEN {x} >= {t} THEN 1 ELSE 0 END" for t in edges[1:-1])
    return f"CAST({tests} AS BIGINT)"


table(
    "binned",
    f"SELECT *, {', '.join(digitize_sql(f) + f' AS {f}_bin' for f in FEATURES)} FROM summary",
    ("summary",),
)
table("samples", "SELECT *, (ifna_bin * 5 + il6_bin) * 5 + cd14_bin AS state FROM binned", ("binned",))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, markers, bins, state, filename, label), one row per supplier."""
    rows = profile_samples(cells(spark, sf), ["sample_id"], MARKERS, BINS, FEATURES)
    named = rows.withColumn("filename", sample_name(F.col("sample_id")))
    return named.withColumn("label", label_from_name(F.col("filename")))


# ---- matrix and fixed clusterings of the samples ----------------------------


def first_centers(points: DataFrame, key: str, ks=KS) -> DataFrame:
    """(k, cluster, center): the rows with the k lowest keys. At most max(ks) rows of
    `points` are ever sorted together."""
    top = points.orderBy(key).limit(max(ks)).select(F.struct(key, "features").alias("p"))
    rows = top.agg(F.array_sort(F.collect_list("p")).alias("ps"))
    each = rows.select(F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])).alias("k"), "ps")
    kept = each.select("k", F.posexplode(F.slice("ps", F.lit(1), F.col("k").cast("int"))).alias("cluster", "p"))
    return kept.select("k", big("cluster").alias("cluster"), F.col("p.features").alias("center"))


def fixed_clusters(points: DataFrame, key: str, ks=KS) -> DataFrame:
    """(k, key, cluster): every row at its nearest first center."""
    return nearest_centroid(points, first_centers(points, key, ks), key).select("k", key, "cluster")


def _fixed_cluster_tables(prefix: str, points: str, key: str) -> None:
    table(
        f"{prefix}ctr",
        f"""SELECT k, rn - 1 AS cluster, features AS center
FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS rn FROM {points}) p, range(2, 11) t(k) WHERE rn <= k""",
        (points,),
    )
    table(
        f"{prefix}near",
        f"""SELECT k, {key}, cluster, d * d AS distance2 FROM (
  SELECT c.k, p.{key}, c.cluster, list_distance(p.features, c.center) AS d FROM {points} p, {prefix}ctr c)
QUALIFY row_number() OVER (PARTITION BY k, {key} ORDER BY d, cluster) = 1""",
        (points, f"{prefix}ctr"),
    )
    table(f"{prefix}asg", f"SELECT k, {key}, cluster FROM {prefix}near", (f"{prefix}near",))
    table(
        f"{prefix}dist",
        f"SELECT a.{key}, b.{key} AS other, list_distance(a.features, b.features) AS d FROM {points} a, {points} b",
        (points,),
    )
    table(
        f"{prefix}mean",
        f"""SELECT g.k, d.{key}, g.cluster, count(*) FILTER (d.{key} <> d.other) AS n,
  sum(d.d) / nullif(count(*) FILTER (d.{key} <> d.other), 0) AS mean_distance
FROM {prefix}dist d JOIN {prefix}asg g ON g.{key} = d.other GROUP BY 1, 2, 3""",
        (f"{prefix}dist", f"{prefix}asg"),
    )
    table(
        f"{prefix}sil",
        f"""SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
FROM (SELECT m.k, m.{key},
    max(mean_distance) FILTER (m.cluster = o.cluster) AS a,
    min(mean_distance) FILTER (m.cluster <> o.cluster) AS b
  FROM {prefix}mean m JOIN {prefix}asg o ON o.k = m.k AND o.{key} = m.{key} GROUP BY 1, 2)
GROUP BY 1""",
        (f"{prefix}mean", f"{prefix}asg"),
    )


table("pts", f"SELECT sample_id, [{', '.join(MARKERS)}] AS features FROM summary", ("summary",))
_fixed_cluster_tables("s", "pts", "sample_id")
table("lpts", "SELECT * FROM pts WHERE sample_id IN (SELECT sample_id FROM labeled)", ("pts", "labeled"))
_fixed_cluster_tables("lb", "lpts", "sample_id")


def sample_points(sampled: DataFrame) -> DataFrame:
    return sampled.select("sample_id", F.array(*MARKERS).alias("features"))


# ---- vectors ------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), big("label").alias("label")
    )


table(
    "vec",
    "SELECT vec_id, embedding::DOUBLE[] AS features, CAST(label AS BIGINT) AS label FROM embeddings",
)
_fixed_cluster_tables("v", "vec", "vec_id")
TRUTH_SQL = "CASE WHEN label < 4 THEN 'positive' ELSE 'negative' END"
table("vtruth", f"SELECT vec_id, {TRUTH_SQL} AS truth FROM vec", ("vec",))


def vector_truth(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(
        "vec_id", F.when(F.col("label") < 4, "positive").otherwise("negative").alias("truth")
    )


# ---- events as values, transitions, visits ------------------------------------


def marker_values(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("marker"), "value"
    )


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "events").select(
        (F.col("user_id") % 25).alias("state"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 9).alias("action"),
        (F.col("value") / 517.0).alias("reward"),
    )


table(
    "tr",
    """SELECT user_id % 25 AS state, event_id AS seq, event_id % 9 AS action, value / 517.0 AS reward,
  row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS step FROM events""",
)
table(
    "trq",
    """(
SELECT DISTINCT state, 0::BIGINT AS step, NULL::BIGINT AS seq, NULL::DOUBLE AS td,
  [0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0] AS q FROM tr
UNION ALL
SELECT f.state, t.step, t.seq, t.reward + 0.9::DOUBLE * list_max(f.q) - f.q[t.action + 1],
  [CASE WHEN i - 1 = t.action THEN f.q[i] + 0.1::DOUBLE * (t.reward + 0.9::DOUBLE * list_max(f.q) - f.q[i])
        ELSE f.q[i] END FOR i IN range(1, 10)]
FROM trq f JOIN tr t ON t.state = f.state AND t.step = f.step + 1)""",
    ("tr",),
)
table(
    "trlast",
    """SELECT state, a AS action, q[a + 1] AS q
FROM (SELECT state, arg_max(q, step) AS q FROM trq GROUP BY state), range(9) t(a)""",
    ("trq",),
)


def mean_q(spark: SparkSession, sf: str) -> DataFrame:
    """(state, action, q): entries of both signs, squares modulo 9 as the only actions."""
    e = F.col("event_id")
    return (
        parquet(spark, sf, "events")
        .groupBy((F.col("user_id") % 20).alias("state"), (e * e % 9).alias("action"))
        .agg((F.avg("value") - 25.0).alias("q"))
    )


table(
    "mq",
    "SELECT user_id % 20 AS state, event_id * event_id % 9 AS action, avg(value) - 25.0 AS q FROM events GROUP BY 1, 2",
)
table("mqrow", "SELECT s AS state, a AS action, coalesce(q, 0.0) AS q FROM (SELECT DISTINCT state AS s FROM mq) x CROSS JOIN range(9) t(a) LEFT JOIN mq ON mq.state = s AND mq.action = a", ("mq",))
table("mqpol", "SELECT state, action FROM mqrow QUALIFY row_number() OVER (PARTITION BY state ORDER BY q DESC, action) = 1", ("mqrow",))


def event_visits(spark: SparkSession, sf: str) -> DataFrame:
    """visits(phase, iteration, rank, state, action, explored, reward): 14 events make
    an iteration, two users in three belong to phase 1."""
    e = F.col("event_id")
    return parquet(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 < 2, 1).otherwise(2).cast("bigint").alias("phase"),
        F.floor(e / F.lit(14)).cast("bigint").alias("iteration"),
        (e % 14).alias("rank"),
        (F.col("user_id") % 25).alias("state"),
        (e % 7).alias("action"),
        ((e + F.col("user_id")) % 4 == 0).alias("explored"),
        (F.col("value") / 517.0).alias("reward"),
    )


table(
    "ev",
    """SELECT CASE WHEN user_id % 3 < 2 THEN 1 ELSE 2 END::BIGINT AS phase, event_id // 14 AS iteration,
  event_id % 14 AS rank, user_id % 25 AS state, event_id % 7 AS action,
  (event_id + user_id) % 4 = 0 AS explored, value / 517.0 AS reward FROM events""",
)
EPS = "greatest(CAST(0.05 AS DOUBLE), CAST(0.3 AS DOUBLE) * power(CAST(0.995 AS DOUBLE), {t}))"
table(
    "evlog",
    f"""SELECT phase, iteration, sum(reward) AS cumulative_payoff, avg(reward) AS average_payoff,
  count(DISTINCT action) AS action_diversity, {EPS.format(t='iteration + 1')} AS exploration_rate
FROM ev GROUP BY 1, 2""",
    ("ev",),
)


# ---- labels ---------------------------------------------------------------------


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label) text as in a hand-kept label file, with gaps."""
    d = F.col("doc_id")
    return parquet(spark, sf, "labels").select(
        F.when(d % 17 != 0, d.cast("string")).alias("id"),
        F.when(d % 13 == 0, F.lit(None)).when(d % 5 == 0, "heu").when(F.col("quality") == 1, "HEU").otherwise("UE").alias("label"),
    )


table(
    "lab",
    """SELECT CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id AS VARCHAR) END AS id,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'heu' WHEN quality = 1 THEN 'HEU' ELSE 'UE' END AS label
FROM labels""",
)
ZFILL = "CASE WHEN length({x}) < 4 THEN lpad({x}, 4, '0') ELSE {x} END"
table(
    "labn",
    f"""SELECT {ZFILL.format(x='id')} AS id, {ZFILL.format(x='id')} || '.FCS' AS filename, label
FROM lab WHERE id IS NOT NULL AND label IS NOT NULL""",
    ("lab",),
)


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """(filename, size, rest, root): a measurement file for every longer document."""
    return every_document(spark, sf).where(F.col("size") >= 1000)


def every_document(spark: SparkSession, sf: str) -> DataFrame:
    """(filename, size, rest, root): a measurement file for every document."""
    d = parquet(spark, sf, "documents")
    name = F.concat(zfill(F.col("doc_id").cast("string"), 4), F.lit(".FCS"))
    return d.select(
        name.alias("filename"),
        F.col("n_chars").cast("double").alias("size"),
        (F.col("n_chars") % 50).cast("double").alias("rest"),
        F.sqrt("n_chars").alias("root"),
    )


table(
    "docf",
    f"""SELECT {ZFILL.format(x='CAST(doc_id AS VARCHAR)')} || '.FCS' AS filename,
  CAST(n_chars AS DOUBLE) AS size, CAST(n_chars % 50 AS DOUBLE) AS rest, sqrt(n_chars) AS root
FROM documents WHERE n_chars >= 1000""",
)
table(
    "docall",
    f"""SELECT {ZFILL.format(x='CAST(doc_id AS VARCHAR)')} || '.FCS' AS filename,
  CAST(n_chars AS DOUBLE) AS size, CAST(n_chars % 50 AS DOUBLE) AS rest, sqrt(n_chars) AS root
FROM documents""",
)


# ---- quintile edges of the event values ------------------------------------------

_QUINT = """SELECT event_type AS feature, quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q
FROM events GROUP BY 1"""
table("quint", _QUINT)
# Unrolled tie rule, one edge after the other.
table(
    "qbins",
    """SELECT feature, [e0, e1, e2, e3, e4, CASE WHEN q[6] <= e4 THEN e4 + 1e-6 ELSE q[6] END] AS edges FROM (
SELECT *, CASE WHEN q[5] <= e3 THEN e3 + 1e-6 ELSE q[5] END AS e4 FROM (
SELECT *, CASE WHEN q[4] <= e2 THEN e2 + 1e-6 ELSE q[4] END AS e3 FROM (
SELECT *, CASE WHEN q[3] <= e1 THEN e1 + 1e-6 ELSE q[3] END AS e2 FROM (
SELECT *, q[1] AS e0, CASE WHEN q[2] <= q[1] THEN q[1] + 1e-6 ELSE q[2] END AS e1 FROM quint))))""",
    ("quint",),
)
