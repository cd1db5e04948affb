"""Numbered commits of a folder: small JSON files that say which versions of its tables belong together.

Tables are written to folders that nobody reads yet; the commit that names them is written last, under another name, and
then renamed. A write that fails midway thus leaves the commit before it as the newest one.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from markerloom.session import folder_names, remove_path

FOLDER = "_commits"


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _name(root: str, number: int) -> str:
    return f"{root}/{FOLDER}/{number:012d}.json"


def write_commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Make `content` the commit of that number; a repeated one replaces it."""
    files, hidden = _file(spark, f"{root}/{FOLDER}/.{number:012d}.tmp")
    out = files.create(hidden, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _file(spark, _name(root, number))
    files.delete(final, False)
    if not files.rename(hidden, final):
        raise OSError(f"could not write {final}")


def read_commit(spark: SparkSession, root: str, number: int) -> dict:
    files, where = _file(spark, _name(root, number))
    opened = files.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()


def commit_numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished commits, in order."""
    files, where = _file(spark, f"{root}/{FOLDER}")
    if not files.exists(where):
        return []
    return sorted(int(n[:12]) for n in folder_names(spark, f"{root}/{FOLDER}") if n.endswith(".json") and n[:12].isdigit())


def newest_commit(spark: SparkSession, root: str) -> tuple[int, dict]:
    numbers = commit_numbers(spark, root)
    if not numbers:
        raise FileNotFoundError(f"nothing was committed in {root}")
    return numbers[-1], read_commit(spark, root, numbers[-1])


def forget_commits(spark: SparkSession, root: str, before: int) -> None:
    for number in commit_numbers(spark, root):
        if number < before:
            remove_path(spark, _name(root, number))
