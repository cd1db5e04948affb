"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding makes disguised spellings equal: lower case, homoglyphs of other scripts to Latin letters, digits
and signs inside words to the letters they stand for, and i, l, 1 to one letter. Entries without accents are also
sought in the text with its accents taken off. The lexicon holds whole words and word
beginnings; its weights are log odds learned from labelled documents, or given. Phrases that are harmless although they hold an
entry are patterns of their own, and a match inside one doesn't count: given ones, and learned ones, in which an entry
stands in clean documents. The weights found are set against the number of words; a logistic curve fitted on the same
labelled documents gives the score.

Defined results: a null or empty text has no matches and the score of its length. Repeated rows get equal scores. If
the labels hold no toxic or no clean documents, only given entries count. A row without an id is scored and never learned from. Labels, lang,
source and the id are no inputs of a score. Extra columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm.common import appended, crc_fold, slices, strings

# Labelled documents that the lexicon is learned from: so many toxic and so many clean ones, lowest hashes first.
MAX_PER_CLASS = 10_000
# Lengths of word beginnings, documents an entry must be in, least log odds, and most entries.
PREFIXES = range(3, 9)
MIN_DOCS, MIN_ODDS, MAX_TERMS = 4, 3.0, 4000
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "абвгдеёзийкмнопрстухѕіјһԁԛԝьαβγδεζηικμνοπρστυχωɑɡɩʟοѵ∂ø",
    "a6brдee3nnkmhonpctyxsijhdqwbaby5e3nikmvonpotyxwagiiovdo",
)
_FOREIGN = re.compile(r"[ɐ-ʯͰ-ԯ∂ø]")
_SIGNS = re.compile(rb"[@$!|+](?=[a-z0-9])")
_SIGN_LETTERS = bytes.maketrans(b"@$!|+", b"asiit")
# 0 o, 1 i, 2 z, 3 e, 4 a, 5 s, 6 b, 7 t, 8 b, 9 g; l as i.
_LETTERS = bytearray(b" " * 128 + bytes(range(128, 256)))
for _a, _b in zip(b"abcdefghijklmnopqrstuvwxyz0123456789", b"abcdefghijkimnopqrstuvwxyzoizeasbtbg"):
    _LETTERS[_a] = _b
_LETTERS = bytes(_LETTERS)


def fold(text: str) -> str:
    """The words of the text in folded letters, one blank around each; accented letters stay."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _FOREIGN.search(text):
            text = text.translate(HOMOGLYPHS)
    raw = text.encode().replace(b"'", b"")
    raw = _SIGNS.sub(lambda m: m.group().translate(_SIGN_LETTERS), raw)
    return f" {b' '.join(raw.translate(_LETTERS).split()).decode()} "


def without_accents(folded: str) -> str:
    return unicodedata.normalize("NFKD", folded).encode("ascii", "ignore").decode()


@dataclass
class Lexicon:
    """Folded entries with weights, folded harmless phrases, and the curve's coefficients."""

    terms: dict[str, float]
    phrases: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.phrases:
            if phrase not in self.terms:
                found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries that count: not inside a harmless phrase, and of several that begin at one
    place the heaviest."""
    best: dict[int, tuple[int, float]] = {}
    harmless = []
    if len(automaton):
        for last, (size, weight) in automaton.iter(folded):
            start = last + 1 - size
            if weight == 0.0:
                harmless.append((start, last + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (last + 1, weight)
    return [
        (start, end, weight)
        for start, (end, weight) in sorted(best.items())
        # A phrase and an entry may share their last blank.
        if not any(a <= start and end - 1 <= b for a, b in harmless)
    ]


def features(folded: str, automaton) -> tuple[float, float, float]:
    total = sum(w for _, _, w in matches(folded, automaton))
    if not folded.isascii():
        plain = without_accents(folded)
        whole = (w for a, b, w in matches(plain, automaton) if plain[a:b].endswith(" "))
        total = max(total, sum(whole))
    words = max(folded.count(" ") - 1, 0)
    return 1.0, float(np.log1p(total)), float(np.log1p(100.0 * total / max(words, 20)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _entries(folded: str) -> set[str]:
    """Whole words, with both blanks, and beginnings, with the first."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if n < len(word))
    return found


def training_rows(labels: DataFrame, key: str, label: str, held: int = 1, folds: int = 3, most: int = MAX_PER_CLASS) -> DataFrame:
    """At most `most` ids of each class outside the held-out fold, with their label."""
    rows = labels.where((crc_fold(key, folds) != held) & F.col(label).isin(0, 1))
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def learn_lexicon(
    docs: DataFrame,
    training: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    given: Mapping[str, float] | None = None,
    harmless: Iterable[str] = (),
) -> Lexicon:
    """Learn entries and the curve from the documents in `training` (id, y), a bounded table.

    Documents per class are counted for every word and beginning in Spark; at most MAX_TERMS entries with a log odds of MIN_ODDS or more come to
    the driver. A beginning replaces the longer entries that it covers unless those are clearly stronger.
    """
    rows = (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(training), "id")
        .select("text", F.col("y").cast("int").alias("y"))
    )
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = {f" {' '.join(fold(t).split())} ": float(w) for t, w in (given or {}).items()}
    phrases = [f" {' '.join(fold(p).split())} " for p in harmless]
    if not toxic or not clean:
        return Lexicon(terms, phrases)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = (Counter(), Counter())
            for body, y in zip(strings(part.column("text")), part.column("y").to_pylist()):
                found[y].update(_entries(fold(body)))
            names = list(found[0].keys() | found[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in found)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "clean", "toxic"])

    counts = (
        rows.mapInArrow(count, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    strong = counts.where(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    chosen = strong.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term").limit(MAX_TERMS).collect()
    learned: dict[str, float] = {}
    for r in sorted(chosen, key=lambda r: (len(r.term), r.term)):
        cover = max((learned[r.term[:n]] for n in range(PREFIXES.start + 1, len(r.term)) if r.term[:n] in learned), default=0.0)
        if r.odds > cover + 1.5:
            learned[r.term] = r.odds
    terms = learned | terms
    model = Lexicon(terms, phrases)
    model.phrases += _learned_phrases(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for part in slices(batches):
            x = [features(fold(t), automaton) for t in strings(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[1] for v in x], pa.float64()), pa.array([v[2] for v in x], pa.float64()), part.column("y")],
                names=["a", "b", "y"],
            )

    # Two numbers and a label for each training row, of which there is a bounded number.
    points = sorted(tuple(p) for p in rows.mapInArrow(measure, "a double, b double, y int").collect())
    x = np.array([(1.0, a, b) for a, b, _ in points])
    model.curve = fit_curve(x, np.array([float(y) for *_, y in points]))
    return model


def _learned_phrases(rows: DataFrame, model: Lexicon, share: float = 0.8) -> list[str]:
    """Entries with a neighbouring word that stand mostly in clean documents."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for part in slices(batches):
            names, ys = [], []
            for body, y in zip(strings(part.column("text")), part.column("y").to_pylist()):
                folded, seen = fold(body), set()
                for start, end, _ in matches(folded, automaton):
                    stop = folded.find(" ", max(end - 1, start + 1))
                    after = folded.find(" ", stop + 1)
                    before = folded.rfind(" ", 0, start)
                    if after > 0:
                        seen.add(folded[start : after + 1])
                    if before >= 0:
                        seen.add(folded[before : stop + 1])
                names += seen
                ys += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int64())], names=["phrase", "y"])

    found = rows.mapInArrow(near, "phrase string, y long").groupBy("phrase")
    found = found.agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    mostly = found.where((F.col("n") >= 3) & (F.col("toxic") <= (1 - share) * F.col("n")))
    return [r.phrase for r in mostly.orderBy(F.desc("n"), "phrase").limit(MAX_TERMS).collect()]


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of every text, between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        automaton = model.__dict__.get("_built")
        if automaton is None:
            automaton = model._built = model.automaton()
        x = np.array([features(fold(t), automaton) for t in strings(part.column(text))]).reshape(-1, 3)
        return [pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30))), pa.float64())]

    return appended(docs.drop(score), [T.StructField(score, T.DoubleType())], run)


def judge_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's id, whether it was held out, score and prediction."""
    lexicon = learn_lexicon(docs, training_rows(labels, key, "toxic"), key, text)
    scored = score_toxicity(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), lexicon)
    return scored.select(
        F.col("id").alias(key),
        F.coalesce(crc_fold("id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

