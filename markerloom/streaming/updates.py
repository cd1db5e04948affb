"""Q-table kept up to date by a stream of transitions, with keyed state in hash buckets.

The state of the stream is one table with a row per state of the Q-table: the number of its last applied transition, its row of q,
and the transitions that wait for an earlier one. The rows lie in BUCKETS buckets by a hash of the state. A micro-batch reads and
writes the buckets of the states it has transitions of, all others stay where they are, and a commit names the
newest version of each bucket. So the bytes of a micro-batch follow the states it touches, not the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from markerloom.functions.scalars import clip_index
from markerloom.operators.qtable import CHUNK_ROWS, q_step, q_update
from markerloom.session import checkpointed, remove_path, stored_small
from markerloom.sources.commits import FOLDER, commit_numbers, forget_commits, newest_commit, read_commit, write_commit

BUCKETS = 64
# Number of a state's first transition.
FIRST = 1

_ENTRY = "struct<seq: bigint, action: bigint, reward: double>"
SCHEMA = f"bucket int, state bigint, last bigint, q array<double>, waiting array<{_ENTRY}>"


def _ready(rows: DataFrame, applied: DataFrame) -> DataFrame:
    """The rows (state, seq, ...) that follow each other without a gap from the last applied one (state, last) on.

    The first row without a successor ends the run; it is found by a join, so no task
    needs all rows of a state.
    """
    keys = rows.select("state", "seq")
    ends = keys.join(keys.select("state", (F.col("seq") - 1).alias("seq")), ["state", "seq"], "left_anti")
    bounds = ends.groupBy("state").agg(F.min("seq").alias("end"))
    starts = keys.groupBy("state").agg(F.min("seq").alias("start"))
    known = bounds.join(starts, "state").join(applied, "state", "left")
    open_ = known.where(F.col("start") == F.coalesce(F.col("last") + 1, F.lit(FIRST)))
    return rows.join(open_.select("state", "end"), "state").where("seq <= end").drop("end")


def _fold(entries: Column, q: Column, alpha: float, gamma: float, n_actions: int) -> Column:
    start = F.coalesce(q, F.array_repeat(F.lit(0.0), n_actions))
    return F.aggregate(entries, start, lambda now, e: q_step(now, clip_index(e["action"], n_actions), e["reward"], alpha, gamma))


def _applied(arrived: DataFrame, known: DataFrame, alpha: float, gamma: float, n_actions: int) -> DataFrame:
    """The new rows of the states of both tables, all that a state has at once: one shuffle, by bucket."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("last", "bigint"), ("q", "array<double>"))]
    news = arrived.select("bucket", "state", *none, F.array("entry").alias("waiting"))
    both = news.unionByName(known).repartition("bucket").groupBy("bucket", "state")
    rows = both.agg(
        F.max("last").alias("last"), F.first("q", True).alias("q"), F.flatten(F.collect_list("waiting")).alias("waiting")
    )
    done = F.coalesce("last", F.lit(FIRST - 1))
    rows = rows.withColumn("sorted", F.array_sort(F.filter("waiting", lambda e: e["seq"] > done)))
    # Of several deliveries of one number the least counts.
    same = lambda e, i: (i > 0) & (e["seq"] == F.get("sorted", i - 1)["seq"])
    rows = rows.withColumn("once", F.filter("sorted", lambda e, i: ~F.coalesce(same(e, i), F.lit(False))))
    rows = rows.withColumn("ready", F.filter("once", lambda e, i: e["seq"] == done + 1 + i))
    # Not by `last` below: a lambda would take the new column of that name.
    rows = rows.withColumn("upto", done + F.size("ready"))
    some = F.size("ready") > 0
    return rows.select(
        "bucket",
        "state",
        F.when(some, F.col("upto")).otherwise(F.col("last")).alias("last"),
        F.when(some, _fold(F.col("ready"), F.col("q"), alpha, gamma, n_actions)).otherwise(F.col("q")).alias("q"),
        F.filter("once", lambda e: e["seq"] > F.col("upto")).alias("waiting"),
    )


def _applied_in_chunks(
    arrived: DataFrame, known: DataFrame, alpha: float, gamma: float, n_actions: int, chunk_rows: int
) -> DataFrame:
    """The same for states of any number of transitions; what waits is spread over rows of about `chunk_rows`."""
    heads = checkpointed(known.where("last IS NOT NULL").select("bucket", "state", "last", "q"))
    applied = heads.select("state", "last")
    rows = arrived.select("bucket", "state", "entry.*").unionByName(known.select("bucket", "state", F.inline("waiting")))
    rows = rows.join(applied, "state", "left").where(F.col("seq") > F.coalesce("last", F.lit(FIRST - 1)))
    rows = rows.groupBy("bucket", "state", "seq").agg(F.min(F.struct("action", "reward")).alias("e"))
    rows = checkpointed(rows.select("bucket", "state", "seq", "e.*"))
    ready = checkpointed(_ready(rows, applied))
    first = heads.select("state", F.posexplode("q").alias("action", "q"))
    q = q_update(ready.drop("bucket"), alpha, gamma, n_actions, first, chunk_rows=chunk_rows)
    q = q.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("action", "q"))).getField("q").alias("q"))
    last = ready.groupBy("bucket", "state").agg(F.max("seq").alias("last")).join(q, "state")
    last = last.select("bucket", "state", "last", "q").unionByName(heads.join(last, "state", "left_anti"))
    left = rows.join(ready.select("state", "seq"), ["state", "seq"], "left_anti")
    parts = left.groupBy("state").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).alias("parts"))
    left = left.join(parts, "state").groupBy("bucket", "state", F.pmod(F.xxhash64("seq"), F.col("parts")).alias("part"))
    left = left.agg(F.collect_list(F.struct("seq", "action", "reward")).alias("waiting"))
    nothing = F.expr(f"cast(array() as array<{_ENTRY}>)").alias("waiting")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("last", "bigint"), ("q", "array<double>"))]
    return last.select("*", nothing).unionByName(left.select("bucket", "state", *none, "waiting"))


def _buckets(spark: SparkSession, path: str, commit: dict, wanted: set[int] | None = None) -> DataFrame:
    """The newest rows of the wanted buckets."""
    paths = [
        f"{path}/version={v}/bucket={b}" for b, v in commit.get("versions", {}).items() if wanted is None or int(b) in wanted
    ]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    columns = SCHEMA.split(", ", 1)[1]
    rows = spark.read.schema(columns).parquet(*paths)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("state"), F.lit(commit["buckets"])).cast("int")).select(
        "bucket", "state", "last", "q", "waiting"
    )


def stream_q_update(
    transitions: DataFrame,
    path: str,
    checkpoint: str,
    alpha: float = 0.1,
    gamma: float = 0.9,
    n_actions: int = 9,
    buckets: int = BUCKETS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply what has arrived of transitions(state, seq, action, reward) and return (state, action, q).

    `seq` numbers the transitions of a state from 1 on without gaps. They may arrive in any order and be
    cut into micro-batches in any way: a transition is applied when all before it have been, and waits until then.
    Repeated deliveries are applied once; if they differ, the least of those that arrived together counts.

    A micro-batch writes a version of the buckets it touches below `path`, numbered by the micro-batch, and commits it; a
    repeated micro-batch writes the same version again. Versions that the last two commits do not name are removed.
    States with more than `chunk_rows` transitions at a time go through the batch operator in chunks.
    """

    def apply(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        if number == 0:  # what lies there is another stream's
            remove_path(here, f"{path}/{FOLDER}")
        old = read_commit(here, path, number - 1) if number else {"buckets": buckets, "versions": {}, "waiting": {}}
        count, versions, waiting = old["buckets"], dict(old["versions"]), dict(old["waiting"])
        state = F.col("state").cast("bigint")
        entry = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("action").cast("bigint").alias("action"), F.col("reward").cast("double").alias("reward"))
        rows = batch.select(F.pmod(F.xxhash64(state), F.lit(count)).cast("int").alias("bucket"), state.alias("state"), entry.alias("entry"))
        rows = rows.persist()
        try:
            sizes = rows.groupBy("bucket", "state").count()
            touched = {r["bucket"]: r["n"] for r in sizes.groupBy("bucket").agg(F.max("count").alias("n")).collect()}
            if touched:
                known = _buckets(here, path, old, set(touched))
                if max(n + waiting.get(str(b), 0) for b, n in touched.items()) <= chunk_rows:
                    new = _applied(rows, known, alpha, gamma, n_actions)
                else:
                    new = split(rows, known, sizes)
                longest = Observation()
                new = new.observe(longest, F.max(F.size("waiting")).alias("n"))
                new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
                versions |= {str(b): number for b in touched}
                # Rows of one state are added up where they are read; a state has more than one only beyond chunk_rows.
                most = longest.get["n"] or 0
                waiting |= {str(b): most for b in touched}
        finally:
            rows.unpersist()
        write_commit(here, path, number, {"buckets": count, "versions": versions, "waiting": waiting})
        if number - 2 in commit_numbers(here, path):
            clear(here, read_commit(here, path, number - 2), old)
            forget_commits(here, path, number - 1)

    def split(rows: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
        """Only states of many transitions go the long way."""
        held = known.select("bucket", "state", F.size("waiting").cast("bigint").alias("count"))
        total = sizes.unionByName(held).groupBy("state").agg(F.sum("count").alias("n")).where(F.col("n") > chunk_rows)
        hot = stored_small(total.select("state"))
        few = _applied(*(t.join(hot, "state", "left_anti") for t in (rows, known)), alpha, gamma, n_actions)
        many = [t.join(hot, "state", "left_semi") for t in (rows, known)]
        return few.unionByName(_applied_in_chunks(*many, alpha, gamma, n_actions, chunk_rows).select(few.columns))

    def clear(spark: SparkSession, before: dict, last: dict) -> None:
        for b, v in before["versions"].items():
            if last["versions"].get(b) != v:
                remove_path(spark, f"{path}/version={v}/bucket={b}")

    query = (
        transitions.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return current_table(transitions.sparkSession, path)


def current_table(spark: SparkSession, path: str, name: str = "q") -> DataFrame:
    """The committed q (state, action, q), applied (state, last) or pending (state, seq, action, reward)."""
    rows = _buckets(spark, path, newest_commit(spark, path)[1])
    if name == "q":
        cells = rows.where("q IS NOT NULL").select("state", F.posexplode("q").alias("action", "q"))
        return cells.withColumn("action", F.col("action").cast("bigint"))
    if name == "applied":
        return rows.where("last IS NOT NULL").select("state", "last")
    return rows.select("state", F.inline("waiting"))
