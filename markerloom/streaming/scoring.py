"""Policy lookup on a stream of sample summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.operators.binning import Edges, discretize, state_count, state_from_bins
from markerloom.operators.qtable import Learning, policy, policy_lookup
from markerloom.session import checkpointed
from markerloom.sources.commits import commit_numbers, newest_commit, read_commit, write_commit
from markerloom.sources.tables import load_table

# Size of a micro-batch of a file source.
BYTES_PER_TRIGGER = 128 * 1024 * 1024


def read_parts(spark, schema, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the parquet files that arrive below a path, in micro-batches of
    bounded size, or of a number of files if given."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is None:
        reader = reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_score(
    summaries: DataFrame, q: DataFrame, bins: Edges, features: Sequence[str], p: Learning = Learning()
) -> DataFrame:
    """Adds state, action and k to each arriving summary. Stateless: the policy is a
    static table, worked out once and joined to every micro-batch."""
    encoded = state_from_bins(discretize(summaries, bins, features), bins, features)
    greedy = checkpointed(policy(q, p.n_actions))
    return policy_lookup(encoded, greedy, p.min_k, state_count(bins, features))


def score_with_newest(
    summaries: DataFrame, agent: str, bins: Edges, features: Sequence[str], path: str, checkpoint: str, p: Learning = Learning()
) -> DataFrame:
    """Score arriving summaries with the agent that is committed at `agent` when their micro-batch starts, and return all
    that was scored: the summaries with state, action, k and `agent_version`, the number of the commit.

    A micro-batch writes a folder of its own below `path`, overwritten if it is repeated. Which version it uses is noted
    before, so that a repeated micro-batch does not take a newer one.
    """
    spark = summaries.sparkSession

    def score(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        if number in commit_numbers(here, path):
            version = read_commit(here, path, number)["version"]
        else:
            version, _ = newest_commit(here, agent)
            write_commit(here, path, number, {"version": version})
        encoded = state_from_bins(discretize(batch, bins, features), bins, features)
        greedy = policy(load_table(here, agent, "q", version), p.n_actions)
        scored = policy_lookup(encoded, greedy, p.min_k, state_count(bins, features))
        scored = scored.withColumn("agent_version", F.lit(version).cast("bigint"))
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = summaries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    folders = [f"{path}/batch={n}" for n in commit_numbers(spark, path)]
    if not folders:
        raise FileNotFoundError(f"nothing was scored in {path}")
    return spark.read.parquet(*folders)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, append it to parquet at `path`, and read that back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
