"""Reading and writing the tables of a project."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from markerloom.operators.cleaning import normalize_label_rows
from markerloom.session import remove_path
from markerloom.sources.commits import commit_numbers, forget_commits, newest_commit, read_commit, write_commit

LABEL_SCHEMA = "FCSFileName string, Label string"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, filename, label) of a label file with a header."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return normalize_label_rows(raw.selectExpr("FCSFileName AS id", "Label AS label"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "filename string, encoded_state bigint, selected_cluster_count bigint, "
        "assigned_cluster bigint, predicted_hiv_status string"
    )
    return spark.read.schema(schema).option("header", True).csv(path)


def save_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """An agent (q, visits, params) or bins (bins, feature_importance) as parquet, all of them or none.

    The tables go to a folder of their own, and a commit names it when all are there. Until then, and if a write fails, the tables
    of the last commit are read. The one before it is kept for those who are reading it.
    """
    spark = next(iter(tables.values())).sparkSession
    done = commit_numbers(spark, path)
    number = done[-1] + 1 if done else 0
    folder = f"version-{number:06d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    write_commit(spark, path, number, {"folder": folder, "tables": sorted(tables)})
    for old in done[:-1]:
        remove_path(spark, f"{path}/{read_commit(spark, path, old)['folder']}")
    forget_commits(spark, path, number - 1)


def load_table(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the newest commit, or of the commit of that number."""
    commit = newest_commit(spark, path)[1] if number is None else read_commit(spark, path, number)
    return spark.read.parquet(f"{path}/{commit['folder']}/{name}")
