"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled text. A text is parsed greedily into the longest phrases that
occur in a language's text; the fewer phrases, the closer the language. Phrases are normalised by the length of the text
and by the information of a phrase's place in the language's text, log2 of its length, which gives bits per letter. The language with
the least wins; ties go to the first in alphabetical order.

Texts are folded to lower-case letters with single blanks between words. They are cut into pieces of PIECE letters, every one of which
starts a phrase, and all pieces of many texts walk all automata side by side.

Defined results: a null text, or one without letters, is `und` with score 0. With no labelled text every text is
`und`. Repeated rows get equal results. Rows without an id are judged and never learned from. Languages, sources and ids are no
inputs of a prediction. Extra columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm.common import appended, crc_fold, strings

# Letters of labelled text per language, rows that are looked at for them, and how much of a long text is.
MAX_LETTERS, MAX_ROWS, MAX_ROW_LETTERS = 40_000, 200, 20_000
MAX_LANGUAGES = 256
PIECE = 512
# Symbols with a column of their own in the table of transitions: 0 between words, then the letters of the labelled texts, most
# frequent first, and any letter that they do not have. The transitions of all rarer letters are looked up by their number.
ALPHABET = 96

UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")

_BUILT: dict[int, Parser] = {}


def letters_of(text: str) -> str:
    """Lower-case words with single blanks; empty if there is no letter."""
    body = _GAPS.sub(" ", text.lower()).strip()
    return body if any(map(str.isalpha, body)) else ""


def training_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held: int = 0, folds: int = 5
) -> dict[str, str]:
    """Labelled text of each language, of documents outside the held-out fold: texts, of long ones the first MAX_ROW_LETTERS
    characters, in the order of a hash of the id, up to MAX_LETTERS in all. Of rows of one id the least text is taken. At
    most MAX_ROWS rows per language come to the driver, and of those what MAX_LETTERS may need.

    The hashes are uniform, so a bound on them that follows from the languages' counts of ids leaves a few hundred rows per
    language before any are ranked.
    """
    rows = docs.where((crc_fold(key, folds) != held) & F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = rows.select(
        F.col(lang).alias("lang"), F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h")
    )
    counts = rows.groupBy("lang").agg(F.count_distinct("id").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    least = -(1 << 63)
    bounds = {r.lang: least + min((1 << 64) - 1, int((1 << 64) * 2 * MAX_ROWS / r.n)) for r in counts}
    limit = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
    near = rows.where(F.col("h") <= limit[F.col("lang")])
    near = near.groupBy("lang", "h", "id").agg(F.min(F.substring("text", 1, MAX_ROW_LETTERS)).alias("text"))
    order = W.partitionBy("lang").orderBy("h", "id")
    before = F.sum(F.length("text")).over(order) - F.length("text")
    ranked = near.select("lang", "h", "id", "text", F.row_number().over(order).alias("place"), before.alias("before"))
    ranked = ranked.where((F.col("place") <= MAX_ROWS) & (F.col("before") < 4 * MAX_LETTERS))
    found: dict[str, list[str]] = {r.lang: [] for r in counts}
    sizes = dict.fromkeys(found, 0)
    for r in ranked.orderBy("lang", "place").select("lang", "text").toLocalIterator():
        body = letters_of(r.text)
        if body and sizes[r.lang] + len(body) <= MAX_LETTERS:
            found[r.lang].append(body)
            sizes[r.lang] += len(body)
    return {k: " ".join(v) for k, v in found.items() if v}


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton; state 1 is the start, 0 is none: a table (state, symbol) for the symbols below
    `width`, and rows of state, symbol and next state for the others."""
    most = 2 * len(symbols) + 2
    steps: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for s in symbols:
        new = len(steps)
        steps.append({})
        link.append(1)
        length.append(length[last] + 1)
        at = last
        while at and s not in steps[at]:
            steps[at][s] = new
            at = link[at]
        if at:
            to = steps[at][s]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at and steps[at].get(s) == to:
                    steps[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    assert len(steps) <= most + 2
    table = np.zeros((len(steps), width), np.int32)
    rare: list[tuple[int, int, int]] = []
    for state, out in enumerate(steps):
        for s, to in out.items():
            if s < width:
                table[state, s] = to
            else:
                rare.append((state, s, to))
    return table, np.array(rare, np.int64).reshape(-1, 3)


class Parser:
    """Counts phrases of texts in all languages at once."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.weights = np.array([np.log2(max(len(texts[k]), 2)) for k in self.languages])
        letters, counts = np.unique([c for t in texts.values() for c in t if c != " "], return_counts=True)
        ranked = letters[np.lexsort((letters, -counts))].tolist()
        often, rarely = ranked[: ALPHABET - 2], ranked[ALPHABET - 2 :]
        # The last column is that of letters without transitions.
        self.width, self.others = len(often) + 2, len(rarely)
        self.codes = np.full(0x110000, self.width - 1, np.int32)
        self.codes[ord(" ")] = 0
        for i, c in enumerate(often):
            self.codes[ord(c)] = i + 1
        for i, c in enumerate(rarely):
            self.codes[ord(c)] = self.width + i
        tables, starts, shift = [np.zeros((1, self.width), np.int32)], [], 0
        keys, ends = [], []
        self.rare_starts = np.zeros((len(self.languages), max(self.others, 1)), np.int64)
        for n, k in enumerate(self.languages):
            table, rare = suffix_automaton(self.symbols(texts[k]).tolist(), self.width)
            tables.append(np.where(table[1:] > 0, table[1:] + shift, 0))
            starts.append(tables[-1][0])
            state, letter, to = rare.T
            keys.append((state + shift) * self.others + letter - self.width)
            ends.append(to + shift)
            self.rare_starts[n, letter[state == 1] - self.width] = to[state == 1] + shift
            shift += len(table) - 1
        self.table = np.concatenate(tables).ravel()
        self.starts = np.concatenate(starts)
        order = np.argsort(np.concatenate(keys))
        self.rare_keys, self.rare_ends = np.concatenate(keys)[order], np.concatenate(ends)[order]

    def _rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states of rarer letters, 0 for none."""
        wanted = state * self.others + letter
        at = np.minimum(np.searchsorted(self.rare_keys, wanted), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == wanted, self.rare_ends[at], 0)

    def symbols(self, letters: str) -> np.ndarray:
        return self.codes[np.frombuffer(letters.encode("utf-32-le"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases of each text, cut into pieces."""
        symbols = [self.symbols(t) for t in texts]
        sizes = np.array([len(s) for s in symbols])
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not len(owner):
            return total
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + place * PIECE
        length = np.minimum(sizes[owner] - place * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        begin, length, flat = begin[order], length[order], np.concatenate(symbols)
        state = np.zeros((len(self.languages), len(owner)), np.int64)
        count = np.zeros(state.shape, np.int64)
        root = (np.arange(len(self.languages)) * self.width)[:, None]
        for step in range(int(length[0])):
            n = int(np.searchsorted(-length, -step))
            now = flat[begin[:n] + step].astype(np.int64)
            column = np.minimum(now, self.width - 1)
            to = self.table.take(state[:, :n] * self.width + column)
            start = self.starts.take(root + column)
            if len(rare := np.flatnonzero(now >= self.width)):
                letter = now[rare] - self.width
                to[:, rare] = self._rare(state[:, rare], letter)
                start[:, rare] = self.rare_starts[:, letter]
            ends = to == 0
            count[:, :n] += ends
            state[:, :n] = np.where(ends, start, to)
        np.add.at(total, owner[order], count.T)
        return total


def parser_of(texts: dict[str, str]) -> Parser:
    """The parser of these texts, built once per Python worker."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser(texts)
    return _BUILT[key]


def predict_language(
    docs: DataFrame, texts: dict[str, str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """docs with the predicted language and a score: the weight of the best language among all, 2 to the power of minus the bits that the
    text takes in each, at most 1."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        bodies = [letters_of(t) for t in strings(part.column(text))]
        if not shared.value:
            return [pa.array([UNKNOWN] * len(bodies)), pa.array([0.0] * len(bodies), pa.float64())]
        parser = parser_of(shared.value)
        bits = parser.phrases(bodies) * parser.weights
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
        found = [parser.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), bodies)]
        return [pa.array(found, pa.string()), pa.array(np.where([bool(t) for t in bodies], score, 0.0), pa.float64())]

    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return appended(docs.drop(*names), fields, run)


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every document's id, whether it was held out, the language and the score."""
    texts = training_texts(docs, key, text, lang)
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return predict_language(plain, texts).select(
        F.col("id").alias(key), F.coalesce(crc_fold("id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
