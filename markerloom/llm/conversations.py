"""Structure repair of conversations: the cheapest edits that make the roles `(s?(ua)+)?`, by bidirectional Dijkstra.

A conversation is a lattice. A node is the number of rows consumed and the state of the role automaton; edges keep, rerole or delete the next
row or insert an empty one. A heap from the start and a heap from the ends take turns; when the two smallest keys together
exceed the best crossing, every node of every cheapest path is settled by one of them. All crossings of that cost are
joined then, and the walk over them that takes the least letter at each node spells the least audit.

An audit determines its states (an inserted or reroled row always takes the one role that the state allows), so no two
audits of one piece that end with a row are each other's beginning, and comparing piece by piece is comparing whole audits.
That is used for long conversations: rows are numbered by a range-partitioned sort and cut into segments of bounded length, each
segment gives the cheapest edits between each two states, the segments are chained by those numbers, and each segment is then
edited between the states that were chosen. Only numbers meet in one task.

Defined results: null ids form one conversation; other nulls are one space. Rows of equal turn go by role, then text. A
repeated row is a row of its own, and thus a duplicate. A role other than system, user or assistant counts by its first
character. A conversation whose rows are all dropped, or an empty table, has no edits. Extra columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import slices, stored
from markerloom.session import stored_small

# Rows that one task edits at a time; longer conversations are cut.
LONG = 10_000
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant. What a role leads to, and the role a state lacks.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)

# What a finished piece still needs in each state; no way at all.
TAIL = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
LEGAL = ("su", "ua", "au")

# A row's code: `x` has to go; else its role's initial, or `o`, in capitals if the text is truncated.
GONE = "x"


def _forward(rows: str, node: int, trailing: bool) -> Iterator[tuple[str, int, int]]:
    """(letter, next node, cost), letters in ASCII order. A node is 4 * rows + state."""
    i, q = divmod(node, 4)
    code = rows[i] if i < len(rows) else ""
    if code:
        yield "D", node + 4, DELETE
    if code or trailing:
        yield "I", 4 * i + NEXT[q], INSERT
    if code and code != GONE:
        more = TRUNCATED if code.isupper() else 0
        to = STEP[q].get(code.lower())
        if to is not None:
            yield "K", 4 * i + 4 + to, more
        yield "R", 4 * i + 4 + NEXT[q], REROLE + more


def _backward(rows: str, node: int, trailing: bool) -> Iterator[tuple[int, int]]:
    """(previous node, cost)."""
    i, q = divmod(node, 4)
    before = [p for p in range(4) if NEXT[p] == q]
    if i < len(rows) or trailing:
        for p in before:
            yield 4 * i + p, INSERT
    if i:
        code = rows[i - 1]
        yield node - 4, DELETE
        if code != GONE:
            more = TRUNCATED if code.isupper() else 0
            for p in range(4):
                if STEP[p].get(code.lower()) == q:
                    yield 4 * i - 4 + p, more
            for p in before:
                yield 4 * i - 4 + p, REROLE + more


def least_edits(rows: str, start: int = START, ends: tuple[int, ...] = ENDS, trailing: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of the coded rows between a state and one of `ends`, ties to the least audit; None if
    there are none. Without `trailing` nothing is inserted after the last row."""
    first, goals = start, {4 * len(rows) + q for q in ends}
    near, far = {first: 0}, dict.fromkeys(goals, 0)
    heap, reverse = [(0, first)], [(0, g) for g in sorted(goals)]
    settled: dict[int, int] = {}
    known: dict[int, int] = {}
    best = 0 if first in goals else float("inf")
    while heap and reverse and heap[0][0] + reverse[0][0] <= best:
        if heap[0][0] <= reverse[0][0]:
            cost, node = heapq.heappop(heap)
            if node in settled:
                continue
            settled[node] = cost
            for _, to, w in _forward(rows, node, trailing):
                if cost + w < near.get(to, best + 1):
                    near[to] = cost + w
                    heapq.heappush(heap, (cost + w, to))
                    best = min(best, cost + w + far.get(to, best))
        else:
            cost, node = heapq.heappop(reverse)
            if node in known:
                continue
            known[node] = cost
            for to, w in _backward(rows, node, trailing):
                if cost + w < far.get(to, best + 1):
                    far[to] = cost + w
                    heapq.heappush(reverse, (cost + w, to))
                    best = min(best, cost + w + near.get(to, best))
    if best == float("inf"):
        return None
    known |= dict.fromkeys(goals, 0)
    # What is left to pay from nodes that only the forward heap has settled; an edge that costs nothing consumes a row.
    for node in sorted(settled.keys() - known.keys(), key=lambda x: (settled[x], x), reverse=True):
        left = [known[to] + w for _, to, w in _forward(rows, node, trailing) if to in known]
        if left and settled[node] + min(left) == best:
            known[node] = min(left)
    audit, node, left = [], first, best
    while left or node not in goals:
        for letter, to, w in _forward(rows, node, trailing):
            if known.get(to, best + 1) + w == left:
                audit.append(letter)
                node, left = to, left - w
                break
    return best, "".join(audit)


@lru_cache(maxsize=50_000)
def _short_edits(rows: str) -> tuple[int, str]:
    return least_edits(rows)


def whole_edits(rows: str) -> tuple[int, str]:
    """least_edits of a whole conversation; short shapes are remembered."""
    return _short_edits(rows) if len(rows) <= 64 else least_edits(rows)


def edited(audit: str, rows: list[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each edit; a deleted row comes with what it held."""
    turns = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter in "IR":
            state = NEXT[state]
            role = NAMES[state]
        elif letter == "K":
            state = STEP[state][role[:1]]
        yield letter, role, text


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped) of the rows as they are. Marked rows only keep their conversation in the result."""
    gap = F.lit(" ")
    return conversations.select(
        F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), gap).alias("role"),
        F.coalesce(F.col(text), gap).alias("text"), F.lit(False).alias("dropped"),
    )


def damage(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns_of the rows after a reproducible damage: by the checksum of `key:turn` modulo 20 a row is dropped (0), emptied (1),
    loses its sentence ends (2), is repeated (3) or becomes the user's (4). Dropped rows are only marked."""
    rows = turns_of(conversations, key, turn, role, text)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    rows = rows.withColumn("fold", F.crc32(name.cast("binary")) % 20)
    body = F.when(F.col("fold") == 1, "").when(F.col("fold") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("fold") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
        (F.col("fold") == 0).alias("dropped"),
        F.explode(F.when(F.col("fold") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FACTS = ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")


class Run:
    """Rows of one conversation, or of a segment of one, in order, and what is wrong with them."""

    def __init__(self, found: list[dict]):
        found = [r for r in found if not r["dropped"]]
        self.rows = [(r["role"], r["text"]) for r in found]
        self.blank = self.duplicate = self.truncated = 0
        met: set[tuple[str, str]] = set()
        codes = []
        for row, fact in zip(self.rows, found):
            role, body = row[0], row[1].rstrip(BLANKS)
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not body:
                self.blank += 1
                code = GONE
            elif row in met or fact.get("seen"):
                self.duplicate += 1
                code = GONE
            elif body[-1] not in ".!?":
                self.truncated += 1
                code = code.upper()
            met.add(row)
            codes.append(code)
        self.codes = "".join(codes)
        initials = [r[:1] for r, _ in self.rows]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        self.first, self.last = (initials[0], initials[-1]) if initials else (None, None)
        turns = [r["turn"] for r in found if r["turn"] is not None]
        self.low, self.high = (turns[0], turns[-1]) if turns else (None, None)
        self.turns = len(set(turns))

    def facts(self) -> tuple:
        return tuple(getattr(self, name) for name in _FACTS)


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return high - low + 1 - turns if turns else 0


def chained(segments: list[dict]) -> tuple[tuple, list[tuple[int, int]]]:
    """A conversation's counts, in the order of COUNTS, and the states that each of its segments enters and leaves by; -1 for the
    last one, which ends the conversation."""
    blank, duplicate, truncated, illegal = (sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated", "illegal"))
    full = [s for s in segments if s["first"] is not None]
    illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
    timed = [s for s in segments if s["turns"]]
    turns = sum(s["turns"] for s in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    left = [list(TAIL)]
    for s in reversed(segments):
        left.append([min((s["costs"][4 * p + q] + left[-1][q] for q in range(4) if s["costs"][4 * p + q] >= 0), default=NEVER) for p in range(4)])
    left.reverse()
    state, ways = START, []
    for k, s in enumerate(segments):
        cheapest = [q for q in range(4) if s["costs"][4 * state + q] >= 0 and s["costs"][4 * state + q] + left[k + 1][q] == left[k][state]]
        to = min(cheapest, key=lambda q: s["ranks"][4 * state + q])
        ways.append((state, to))
        state = to
    ways[-1] = (ways[-1][0], -1)
    low, high = (timed[0]["low"], timed[-1]["high"]) if timed else (None, None)
    return (gaps(low, high, turns), blank, duplicate, truncated, illegal, left[0][START]), ways


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same keys, of rows that come sorted."""
    key, held = None, []
    for part in slices(batches):
        for row in part.to_pylist():
            now = tuple(row[k] for k in keys)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


class _Table:
    """Column names with their types for Spark and for Arrow; `conv` is typed as the conversation's id."""

    ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def __init__(self, kind: str, **columns: str):
        columns = {"conv": kind, **columns}
        self.ddl = ", ".join(f"{c} {t}" for c, t in columns.items())
        self.schema = pa.schema([(c, self.ARROW[t]) for c, t in columns.items()])

    def batches(self, rows: Iterator[tuple], size: int = 1000) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == size:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


def _edits_table(kind: str) -> _Table:
    return _Table(kind, segment="long", n="long", edit="string", role="string", text="string", **dict.fromkeys(COUNTS, "long"))


def _joined(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """The join on conversation and the named columns, null ids equal, with the other columns of both."""
    other = b.withColumnsRenamed({c: f"{c}_b" for c in ("conv", *names)})
    on = F.col("conv").eqNullSafe(F.col("conv_b"))
    for name in names:
        on = on & (F.col(name) == F.col(f"{name}_b"))
    return a.join(other, on, how).drop("conv_b", *(f"{c}_b" for c in names))


def _edit_rows(conv, segment: int, counts: tuple, audit: str, run: Run, state: int) -> Iterator[tuple]:
    """A row with the counts, then one for each edit."""
    yield (conv, segment, -1, None, None, None, *counts)
    for n, edit in enumerate(edited(audit, run.rows, state)):
        yield (conv, segment, n, *edit, *[None] * len(COUNTS))


def _short_edit_rows(rows: DataFrame, kind: str) -> DataFrame:
    out = _edits_table(kind)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), found in _runs(batches, "conv"):
            run = Run(found)
            cost, audit = whole_edits(run.codes)
            counts = (gaps(run.low, run.high, run.turns), run.blank, run.duplicate, run.truncated, run.illegal, cost)
            yield from _edit_rows(conv, 0, counts, audit, run, START)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(lambda batches: out.batches(repair(batches)), out.ddl)


def _long_edit_rows(rows: DataFrame, kind: str, long: int) -> DataFrame:
    """The same for conversations of any length, in segments of at most `long` rows."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # The number holds the partition and the place in it.
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    segment = (part * F.lit((1 << 33) // long + 1) + F.floor(place / F.lit(long))).cast("long")
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    turns = stored(placed.drop("row").select("*", segment.alias("segment"), digest.alias("digest")), "repair-turns")
    # What a segment cannot see is a turn that an earlier one has; here a turn has one row a segment.
    once = turns.where("NOT dropped").groupBy("conv", "segment", "digest").agg(F.min("at").alias("at"))
    once = stored(once, "repair-once")
    first = once.groupBy("conv", "digest").agg(F.min("at").alias("first"))
    late = _joined(once, first, "digest").where(F.col("at") > F.col("first"))
    late = late.select("conv", "segment", "digest", F.lit(True).alias("seen"))
    marked = stored(_joined(turns, late, "segment", "digest", how="left").drop("digest"), "repair-marked")

    def by_segment(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "at")

    numbers = _Table(
        kind, segment="long", first="string", last="string", **dict.fromkeys(_FACTS, "long"), costs="array<long>", ranks="array<long>"
    )

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each two states the cost of the segment and the place of its audit among those from the first."""
        for (conv, seg), found in _runs(batches, "conv", "segment"):
            run = Run(found)
            costs, ranks = [-1] * 16, [0] * 16
            for p in range(4):
                ways = {q: way for q in range(4) if (way := least_edits(run.codes, p, (q,), trailing=False))}
                for rank, q in enumerate(sorted(ways, key=lambda q: ways[q][1])):
                    costs[4 * p + q], ranks[4 * p + q] = ways[q][0], rank
            yield (conv, seg, run.first, run.last, *run.facts(), costs, ranks)

    segments = stored(by_segment(marked).mapInArrow(lambda b: numbers.batches(between(b)), numbers.ddl), "repair-segments")
    ways = _Table(kind, segment="long", enter="long", leave="long", **dict.fromkeys(COUNTS, "long"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), found in _runs(batches, "conv"):
            counts, chosen = chained(found)
            for s, way in zip(found, chosen):
                yield (conv, s["segment"], *way, *counts)

    chosen = segments.repartition("conv").sortWithinPartitions("conv", "segment")
    chosen = stored(chosen.mapInArrow(lambda b: ways.batches(chain(b)), ways.ddl), "repair-chain")
    out = _edits_table(kind)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, seg), found in _runs(batches, "conv", "segment"):
            run, way = Run(found), found[0]
            last = way["leave"] < 0
            _, audit = least_edits(run.codes, way["enter"], ENDS if last else (way["leave"],), trailing=last)
            yield from _edit_rows(conv, seg, tuple(way[c] for c in COUNTS), audit, run, way["enter"])

    known = _joined(marked, chosen, "segment")
    return by_segment(known).mapInArrow(lambda b: out.batches(edit(b)), out.ddl)


def edit_rows(turns: DataFrame, long: int = LONG) -> list[DataFrame]:
    """The edits of conversations, of turns_of or damage: (conv, segment, n, edit, role, text), in the order of segment and n, and before those
    of each segment a row with n = -1 and the conversation's counts. A deleted row comes with what it held.

    Tables of which a partition holds whole conversations in order; the second one, of long conversations, does not."""
    kind = dict(turns.dtypes)["conv"]
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > long)
    many = stored_small(sizes)
    if many.isEmpty():
        return [_short_edit_rows(turns, kind)]
    few, rest = (_joined(turns, many.select("conv"), how=how) for how in ("left_anti", "left_semi"))
    return [_short_edit_rows(few, kind), _long_edit_rows(rest, kind, long)]


def repaired_turns(turns: DataFrame, key: str = "conv_id", long: int = LONG) -> DataFrame:
    """The repaired conversations: (key, segment, n, edit, role, text) in the order of segment and n, without what was deleted."""
    parts = edit_rows(turns, long)
    whole = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return whole.where("edit <> 'D'").select(F.col("conv").alias(key), "segment", "n", "edit", "role", "text")


def repair_report(turns: DataFrame, key: str = "conv_id", long: int = LONG) -> DataFrame:
    """Per conversation the counts, the audit, and the sha256 of the repaired `role:text` lines.

    The digest of a long conversation is taken by one task, as it can only be taken in order; the rows stream through it.
    """
    kind = dict(turns.dtypes)["conv"]
    out = _Table(kind, **dict.fromkeys(COUNTS, "long"), audit="string", repaired_sha256="string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, counts, audit, lines, digest = None, None, [], 0, None
        for part in slices(batches):
            for row in part.to_pylist():
                if row["n"] < 0:
                    if counts is not None and row["conv"] == conv:
                        continue
                    if counts is not None:
                        yield (conv, *counts, "".join(audit), digest.hexdigest())
                    conv, counts, audit, lines, digest = row["conv"], tuple(row[c] for c in COUNTS), [], 0, sha256()
                else:
                    audit.append(row["edit"])
                    if row["edit"] != "D":
                        line = f"{row['role']}:{row['text']}"
                        digest.update(("\n" + line if lines else line).encode())
                        lines += 1
        if counts is not None:
            yield (conv, *counts, "".join(audit), digest.hexdigest())

    short, *more = edit_rows(turns, long)
    parts = [short, *(m.repartition("conv").sortWithinPartitions("conv", "segment", "n") for m in more)]
    found = [p.mapInArrow(lambda b: out.batches(digest(b)), out.ddl) for p in parts]
    whole = found[0].unionByName(found[1]) if more else found[0]
    return whole.withColumnRenamed("conv", key)
