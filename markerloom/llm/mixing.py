"""Mixing to target weights by iterative proportional fitting.

Every document weighs its number of words. The words per cell (source, language, topic) are summed in one pass; the
cell weights are raked to the target shares of the three margins in turn until all fit; a document stays with the
probability of its cell, and the draw is a hash of its key and the seed. The expected words of the sample are a stated share
of all, whatever cells there are: a cell whose probability would be above one stays whole and the rest is raked
again, a category with fewer words than its target stays whole and the others of its margin share what it lacks. Else the
expected words have the target margins exactly.

Targets name categories; all others of a margin form one more category, which keeps its own share of the words. Of a margin
with very many values (tempered_targets) the NAMED largest are categories of their own, the others are grouped by size, EIGHTHS
classes for each doubling of the words. A class's target is the sum of its members' tempered shares; within a class
sizes differ by less than 9 %, so at a power of 0.8 a member is within 2 % of its own target. The cell table is thus
bounded by the targets (MAX_CELLS), however many sources there are, and is raked on the driver.

Defined results: null values form the category "" together with empty ones, unless targets name it. Texts without words weigh
0 and are drawn with their cell's probability; a cell without any words has probability 0 unless there are no
words at all, where everything stays. A row without a key is drawn by its text. Repeated rows are drawn alike. An empty
table stays empty. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import stored

MAX_CELLS = 1_000_000
ROUNDS, TOLERANCE = 1000, 1e-10
# Expected words of the sample for a word of the table.
KEEP = 0.5
# Values of a margin with a target of their own, and classes of the others for each doubling.
NAMED, EIGHTHS = 1000, 8
OTHER, SIZE = "\0other", "\0size"

Targets = Mapping[str, Mapping[str, float]]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_kind(text: Column) -> Column:
    """A topic by form: tables, pages with links or addresses, notices, and prose. Plain searches, no patterns."""
    size = F.octet_length(text)
    bars = size - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(bars * 60 >= F.greatest(size, F.lit(60)), "table")
        .when(text.contains("http://") | text.contains("https://") | text.contains("@"), "contact")
        .when(text.contains("icense") | text.contains("icence") | text.contains("ights reserved"), "notice")
        .otherwise("prose")
    )


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares raised to a power and normalised; 1 keeps them, 0 makes them equal."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(words: np.ndarray, codes: np.ndarray, targets: Sequence[np.ndarray]) -> np.ndarray:
    """Factors per cell so that words * factors has the target shares in every margin.

    codes[m] is the category of each cell in margin m. A target whose category has no words is spread over the
    others of its margin.
    """
    factors = np.ones(len(words))
    if words.sum() <= 0:
        return factors
    goals = []
    for code, goal in zip(codes, targets):
        goal = np.where(np.bincount(code, words, len(goal)) > 0, goal, 0.0)
        if goal.sum() <= 0:
            raise ValueError("a margin's targets name no category that has words")
        goals.append(goal / goal.sum())
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            have = np.bincount(code, words * factors, len(goal))
            share = have / have.sum()
            worst = max(worst, float(np.abs(share - goal).max()))
            scale = np.divide(goal, share, out=np.zeros(len(goal)), where=share > 0)
            factors = factors * scale[code]
        if worst < TOLERANCE:
            break
    return factors


def goal_words(have: np.ndarray, goal: np.ndarray, total: float) -> np.ndarray:
    """`total` words dealt by the shares `goal`, no category getting more than it has."""
    out = np.zeros(len(have))
    free = (goal > 0) & (have > 0)
    while free.any():
        dealt = np.where(free, goal, 0.0) * ((total - out[~free].sum()) / goal[free].sum())
        full = free & (dealt >= have)
        if not full.any():
            return np.where(free, dealt, out)
        out[full] = have[full]
        free &= ~full
    return out


def _scales(words: np.ndarray, factors: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Per category the scale at which the words times min(1, factor * scale) sum to its goal."""
    order = np.lexsort((-factors, code))
    order = order[(words[order] > 0) & (factors[order] > 0)]
    w, f, c = words[order], factors[order], code[order]
    scales = np.zeros(len(goal))
    if not len(c):
        return scales
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[starts, len(c)])
    before = np.cumsum(w) - w
    whole = before - np.repeat(before[starts], size)  # words of the cells with a larger factor
    rest = np.cumsum((w * f)[::-1])[::-1]
    rest = rest - np.repeat(np.r_[rest[starts[1:]], 0.0], size)
    scale = np.maximum(goal[c] - whole, 0.0) / np.maximum(rest, 1e-300)
    # The first cell of a category that stays at one or less with the ones before it whole.
    fits = np.flatnonzero(f * scale <= 1 + 1e-15)
    np.maximum.at(scales, c, 1 / f)  # all whole, where none does
    first = fits[np.unique(c[fits], return_index=True)[1]]
    scales[c[first]] = scale[first]
    return scales


def rake_to_total(words: np.ndarray, codes: np.ndarray, targets: Sequence[np.ndarray], total: float) -> np.ndarray:
    """Factors per cell so that words * min(1, factors) sum to `total` with the target shares in every margin, as far as
    the words suffice."""
    if words.sum() <= 0:
        return np.ones(len(words))
    haves = [np.bincount(code, words, len(goal)) for code, goal in zip(codes, targets)]
    goals = [goal_words(have, goal, total) for have, goal in zip(haves, targets)]
    if not all(goal.sum() > 0 for goal in goals):
        raise ValueError("a margin's targets name no category that has words")
    factors = np.ones(len(words))
    for _ in range(ROUNDS):
        before, worst = np.minimum(factors, 1.0), 0.0
        for code, goal in zip(codes, goals):
            have = np.bincount(code, words * np.minimum(factors, 1.0), len(goal))
            worst = max(worst, float(np.abs(have - goal).max()) / total)
            factors = np.clip(factors * _scales(words, factors, code, goal)[code], 0.0, 1e12)
        if worst < TOLERANCE or np.abs(np.minimum(factors, 1.0) - before).max() < 1e-3 * TOLERANCE:
            break
    return factors


def share_kept(cells: DataFrame) -> float:
    """Expected share of the words that stay, from the cells of mix."""
    sums = cells.agg(F.sum(F.col("words") * F.col("probability")).alias("kept"), F.sum("words").alias("all")).first()
    return sums["kept"] / sums["all"] if sums["all"] else 0.0


def cell_words(docs: DataFrame, margins: Mapping[str, Column], text: str = "text") -> DataFrame:
    """The words of every combination of the margins' values, null as empty, summed in one pass over the texts and stored."""
    values = [F.coalesce(m.cast("string"), F.lit("")).alias(f"v{i}") for i, m in enumerate(margins.values())]
    cells = docs.select(*values, word_count(F.col(text)).alias("w")).groupBy(*(f"v{i}" for i in range(len(values))))
    return stored(cells.agg(F.sum("w").alias("w")).withColumnsRenamed({f"v{i}": m for i, m in enumerate(margins)}), "cells")


def mix(
    docs: DataFrame,
    margins: Mapping[str, Column],
    targets: Targets,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    rate: float = 1.0,
    keep: float = KEEP,
    cells: DataFrame | None = None,
    classes: Mapping[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sampled documents with all their columns, and the cells: margins, words, factor, probability.

    `margins` maps each margin of `targets` to its expression over `docs`. `keep` is the share of the words to be kept,
    `rate` scales all probabilities down. `cells` is cell_words of the same documents and margins, if it is there already.
    `classes` has for a margin the table (value, class) of values that are not categories but belong to one.
    """
    names = list(targets)
    classes = classes or {}
    limit = int(np.prod([len(targets[m]) + 1 for m in names]))
    if limit > MAX_CELLS:
        raise ValueError(f"the targets allow {limit} cells, at most {MAX_CELLS} are raked")

    def categorized(rows: DataFrame) -> DataFrame:
        """c0, c1, ... have the margins' values before, their categories after."""
        for i, m in enumerate(names):
            if m in classes:
                of = classes[m].select(F.col("value").alias(f"c{i}"), F.col("class").alias(f"class{i}"))
                rows = rows.join(of, f"c{i}", "left").withColumn(f"c{i}", F.coalesce(f"class{i}", f"c{i}")).drop(f"class{i}")
        named = {f"c{i}": F.when(F.col(f"c{i}").isin(*targets[m]), F.col(f"c{i}")).otherwise(OTHER) for i, m in enumerate(names)}
        return rows.withColumns(named)

    def value(m: Column) -> Column:
        return F.coalesce(m.cast("string"), F.lit(""))

    words_of = cell_words(docs, {m: margins[m] for m in names}, text) if cells is None else cells
    sums = categorized(words_of.select(*(value(F.col(m)).alias(f"c{i}") for i, m in enumerate(names)), "w"))
    sums = sums.groupBy(*(f"c{i}" for i in range(len(names))))
    found = sums.agg(F.sum("w").alias("w")).orderBy(*(f"c{i}" for i in range(len(names)))).collect()  # at most `limit` rows
    words = np.array([float(r.w) for r in found])
    codes, goals = [], []
    for i, m in enumerate(names):
        kinds = {kind: n for n, kind in enumerate([*targets[m], OTHER])}
        code = np.array([kinds[r[f"c{i}"]] for r in found], np.int64)
        rest = np.bincount(code, words, len(kinds))[-1] / max(words.sum(), 1.0)
        named = sum(targets[m].values())
        codes.append(code)
        goals.append(np.array([(1 - rest) * v / named for v in targets[m].values()] + [rest]))
    codes = np.array(codes).reshape(len(names), -1)
    factors = rake_to_total(words, codes, goals, keep * words.sum()) if found else words
    chances = rate * np.minimum(factors, 1.0)
    spark = docs.sparkSession
    rows = [
        (*(r[f"c{i}"] for i in range(len(names))), int(r.w), float(f), float(p)) for r, f, p in zip(found, factors, chances)
    ]
    kind = ", ".join(f"c{i} string" for i in range(len(names))) + ", words long, factor double, probability double"
    table = spark.createDataFrame(rows, kind)
    known = F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), F.col(key)))
    known = known.otherwise(F.xxhash64(F.lit(seed), F.col(text)))
    draw = F.shiftrightunsigned(known, 11).cast("double") * F.lit(2.0**-53)
    own = [value(margins[m]).alias(f"c{i}") for i, m in enumerate(names)]
    whole = categorized(docs.select(F.struct("*").alias("row"), draw.alias("draw"), *own))
    joined = whole.join(F.broadcast(table.drop("words", "factor")), [f"c{i}" for i in range(len(names))])
    sample = joined.where(F.col("draw") < F.col("probability")).select("row.*")
    named = table.select(*(F.col(f"c{i}").alias(m) for i, m in enumerate(names)), "words", "factor", "probability")
    return sample, named


def _sums(cells: DataFrame, margin: str) -> DataFrame:
    return cells.groupBy(F.col(margin).alias("c")).agg(F.sum("w").alias("w"))


def observed_shares(cells: DataFrame, margin: str, limit: int = NAMED) -> dict[str, float]:
    """Share of the words of each of a margin's `limit` largest categories (the others are not named), from cell_words."""
    rows = _sums(cells, margin).orderBy(F.desc("w"), "c").limit(limit).collect()
    total = cells.agg(F.sum("w").alias("w")).first().w
    return {r.c: r.w / total for r in rows if total and r.w}


def tempered_targets(cells: DataFrame, margin: str, power: float, limit: int = NAMED) -> tuple[dict[str, float], DataFrame | None]:
    """Tempered shares of a margin's `limit` largest values and of the size classes of all others, and the table (value,
    class) of those others, if there are any; from cell_words."""
    shares = observed_shares(cells, margin, limit)
    raised = {k: v**power for k, v in shares.items()}
    classes = None
    if len(shares) == limit:
        total = cells.agg(F.sum("w").alias("w")).first().w
        size = F.floor(F.log2(F.col("w").cast("double")) * EIGHTHS).cast("string")
        rest = _sums(cells, margin).where((F.col("w") > 0) & ~F.col("c").isin(*shares))
        classes = stored(rest.select(F.col("c").alias("value"), F.concat(F.lit(SIZE), size).alias("class"), "w"), "size-classes")
        sums = classes.groupBy("class").agg(F.sum(F.pow(F.col("w") / F.lit(total), F.lit(power))).alias("t"))
        tail = {r["class"]: r.t for r in sums.collect()}
        raised, classes = raised | tail, classes.drop("w") if tail else None
    return {k: v / sum(raised.values()) for k, v in raised.items()}, classes
