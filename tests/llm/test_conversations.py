"""Conversation repair against an exhaustive search, in one piece and in segments."""

import random
import re
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from markerloom.llm import conversations, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The least (cost, audit, repaired) by trying every edit, with at most three insertions in a row."""
    n = len(rows)

    @lru_cache(None)
    def rest(i, q, inserted):
        found = []
        if i == n and q in "0a":
            found.append((0, "", ()))
        lacking = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[lacking]

        def then(cost, letter, state, made, j, more=0):
            sub = rest(j, state, more)
            if sub is not None:
                found.append((cost + sub[0], letter + sub[1], made + sub[2]))

        if inserted < 3:
            then(3, "I", lacking, ((name, ""),), i, inserted + 1)
        if i < n:
            role, text, fault = rows[i]
            then(4, "D", q, (), i + 1)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                r = role[:1]
                if r and (r == lacking or (r == "s" and q == "0")):
                    then(more, "K", r, ((role, text),), i + 1)
                then(3 + more, "R", lacking, ((name, text),), i + 1)
        return min(found, key=lambda x: x[:2]) if found else None

    return rest(0, "0", 0)


def by_hand(rows, damaged=True):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        here = convs.setdefault(conv, [])
        fold = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if fold == 0:
            continue
        text = "" if fold == 1 else re.sub("[.!?]", "", text) if fold == 2 else text
        row = (turn, "user" if fold == 4 else role, text)
        here.extend([row, row] if fold == 3 else [row])
    out = []
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faulty, seen = [], set()
        for _, role, text in here:
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        cost, audit, repaired = cheapest(tuple(faulty))
        digest = sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_up(n, seed, conv=None):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "One more.", "so on...", "I see.", None, "übrig?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for i in range(n):
        turn = rng.choice([None, i, i, i, i, i + 1])
        text = rng.choice(texts)
        rows.append((conv if conv is not None else rng.choice([None, 1, 2, 3, 4]), turn, rng.choice(roles), text and text + f"{rng.randrange(6)}." * rng.randrange(2)))
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversations"](spark, FOLDER)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert ordered(got) == by_hand(rows)


def test_search_against_all_edits():
    rng = random.Random(5)
    for _ in range(1500):
        codes = "".join(rng.choice("suaouaxSUAO") for _ in range(rng.randrange(9)))
        rows = tuple(
            ({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "", "blank" if c == "x" else "truncated" if c.isupper() else "")
            for c in codes
        )
        assert conversations.least_edits(codes) == cheapest(rows)[:2]


@pytest.mark.parametrize("long", [1, 3, 1000])
def test_pieces_give_the_same(spark, long):
    rows = made_up(90, 1) + made_up(40, 2, conv=7) + [(8, 1, "user", "Yes."), (9, 8, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ordered(conversations.repair_report(conversations.damage(df), long=long))
    assert got == by_hand(rows)


def test_undamaged_rows_and_repaired_turns(spark):
    rows = made_up(60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    report = ordered(conversations.repair_report(conversations.turns_of(df)))
    assert report == by_hand(rows, damaged=False)
    for long in (4, 1000):
        turns = conversations.repaired_turns(conversations.turns_of(df), long=long).orderBy("conv_id", "segment", "n").collect()
        for conv, *_, audit, digest in report:
            mine = [t for t in turns if t.conv_id == conv]
            assert "".join(t.edit for t in mine) == audit.replace("D", "")
            assert sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == digest


def test_nothing_clashing_columns_and_text_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(conversations.damage(df)).count() == 0
    rows = made_up(30, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.select("*", *(F.lit(1).alias(c) for c in ("conv", "dropped", "copy", "fold", "segment", "n", "edit", "at", "row", "seen")))
    assert ordered(conversations.repair_report(conversations.damage(extra))) == by_hand(rows)
    named = df.withColumn("conv_id", F.col("conv_id").cast("string"))
    got = ordered(conversations.repair_report(conversations.damage(named)))
    assert [r[1:] for r in got] == [r[1:] for r in by_hand([(c if c is None else str(c), *x) for c, *x in rows])]


def test_all_rows_dropped(spark):
    lost = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Yes.")], SCHEMA)
    assert ordered(conversations.repair_report(conversations.damage(df))) == [(lost, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_a_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"Turn {i % 21_000}.") for i in range(25_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = ordered(conversations.repair_report(conversations.turns_of(df), long=100_000))
    assert ordered(conversations.repair_report(conversations.turns_of(df))) == whole
    assert whole[0][3] == 4000
