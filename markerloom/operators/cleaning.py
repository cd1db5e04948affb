"""Transforms, filters and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.functions.ordered import DIRECT_LIMIT, exact_quantiles
from markerloom.functions.scalars import finite, scaled_asinh, zfill
from markerloom.operators.markers import located_name
from markerloom.operators.summaries import sample_medians, to_long
from markerloom.session import checkpointed, stored_small

NOT_FEATURES = {"filename", "label", "diagnosis"}


def asinh_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scaled_asinh(F.col(c)) for c in columns})


def clean_values(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    direct_limit: int = DIRECT_LIMIT,
    biggest: int | None = None,
) -> DataFrame:
    """NaN, null and infinities become the sample's median, or 0 if none of its values is
    finite. A marker that a sample has nulls for only is absent and stays null.

    A null key is a sample of its own. The medians are one row per sample, stored and broadcast if they are few. Beyond
    that it is a sort-merge join, whose hot samples AQE splits.
    """
    medians = sample_medians(df, keys, columns, direct_limit, biggest)
    medians = stored_small(medians.withColumnsRenamed({c: f"__{c}" for c in [*keys, *columns]}))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    filled = {c: F.coalesce(finite(F.col(c)), F.col(f"__{c}")) for c in columns}
    out = df.join(medians, same).withColumns(filled)
    return out.select(*df.columns)


def corpus_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of the finite values per column; columns without any are left out.

    The result has one number per column, so it is brought to the driver and goes
    back into plans as literals.
    """
    clean = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    found = exact_quantiles(to_long(clean, [], columns), ["marker"], "value", [0.5])
    return {r["marker"]: r["q"][0] for r in found.collect()}


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    taken = NOT_FEATURES | set(skip)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in taken
    ]


def feature_matrix(
    df: DataFrame, key: str, markers: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """(key, features array<double>) and the columns used.

    Markers are looked up by containment; without a match all numeric columns
    count. Columns without a finite value are dropped, gaps get corpus medians.
    """
    columns: list[str] = []
    for m in markers or []:
        name = located_name([c for c in df.columns if c != key], m)
        if name in df.columns:
            columns.append(name)
    columns = columns or numeric_columns(df, [key])
    if not columns:
        raise ValueError(f"no feature columns among {df.columns}")
    # Read several times from here on.
    df = checkpointed(df.select(key, *dict.fromkeys(columns)))
    medians = corpus_medians(df, list(dict.fromkeys(columns)))
    columns = [c for c in columns if c in medians]
    if not columns:
        raise ValueError("no feature column holds a finite value")
    features = [F.coalesce(finite(F.col(c).cast("double")), F.lit(medians[c])) for c in columns]
    return df.select(key, F.array(*features).alias("features")), columns


def numeric_coerce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text that is no finite number becomes the corpus median of its column."""
    cast = checkpointed(df.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns}))
    medians = corpus_medians(cast, columns)
    return cast.withColumns(
        {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns if c in medians}
    )


def labeled_only(df: DataFrame, label: str = "label") -> DataFrame:
    out = df.where(F.col(label).isNotNull())
    if out.isEmpty():
        raise ValueError("no labeled samples")
    return out


def label_to_binary(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds y: contains HEU if any label does, else whether the number is positive."""
    is_heu = F.lower(F.col(label)).contains("heu")
    any_heu = df.agg(F.coalesce(F.max(is_heu), F.lit(False))).scalar()
    number = F.coalesce(F.col(label).try_cast("double"), F.lit(0.0))
    y = F.when(any_heu, F.coalesce(is_heu, F.lit(False))).otherwise(~F.isnan(number) & (number > 0))
    return df.withColumn("y", y.cast("bigint"))


def normalize_label_rows(rows: DataFrame) -> DataFrame:
    """(id, filename, label) from raw label rows: nulls out, ids padded to 4 digits."""
    kept = rows.select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"))
    kept = kept.dropna().withColumn("id", zfill(F.col("id"), 4))
    return kept.select("id", F.concat("id", F.lit(".FCS")).alias("filename"), "label")


def missing_files(labels: DataFrame, files: DataFrame) -> DataFrame:
    return labels.join(files.select("filename"), "filename", "left_anti")


def join_labels(summary: DataFrame, labels: DataFrame) -> DataFrame:
    return summary.join(labels.select("filename", "label"), "filename")
