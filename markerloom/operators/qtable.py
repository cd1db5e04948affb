"""Q-learning on tables: q(state, action, q), absent entries being 0."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions.ordered import dense_index, largest_group
from markerloom.functions.scalars import clip_index, draw, first_max_index
from markerloom.session import checkpointed, stored_small


@dataclass(frozen=True)
class Learning:
    """Parameters of a training run; the defaults are fixed values."""

    min_k: int = 2
    max_k: int = 10
    alpha: float = 0.1
    gamma: float = 0.9
    eps_start: float = 0.3
    eps_end: float = 0.05
    eps_decay: float = 0.995
    iterations: int = 1000
    batch: int = 10
    seed: int = 42

    @property
    def n_actions(self) -> int:
        return self.max_k - self.min_k + 1


# Transitions of one state that are folded in one go.
CHUNK_ROWS = 65_536
# Entries a fold writes its story in at a time.
STORY_BLOCK = 64
# Visits that one state can collect in one fold.
FOLD_VISITS = 20_000
# Draws that may be broadcast to the samples.
BROADCAST_DRAWS = 1_000_000


# ---- actions -------------------------------------------------------------


def action_space(ks: DataFrame) -> DataFrame:
    """(action, k) for the inclusive range in the one-row table ks(min_k, max_k)."""
    both = F.posexplode(F.sequence(F.col("min_k").cast("bigint"), F.col("max_k").cast("bigint")))
    return ks.select(both.alias("action", "k")).select(F.col("action").cast("bigint").alias("action"), "k")


def action_of_k(ks: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds the action of each k, null where k is no action."""
    return ks.join(actions, "k", "left")


def require_actions(ks: DataFrame, actions: DataFrame) -> DataFrame:
    bad = ks.join(actions, "k", "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"cluster count {bad[0]['k']} is not in the action space")
    return action_of_k(ks, actions)


def action_distribution(visits: DataFrame, actions: DataFrame) -> DataFrame:
    """(action, label, n) for every action in order, unused ones with 0."""
    counts = visits.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return (
        actions.join(counts, "action", "left")
        .select(
            "action",
            F.concat(F.lit("k="), F.col("k").cast("string")).alias("label"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("action")
    )


# ---- rows of the Q-table -------------------------------------------------


def dense_rows(q: DataFrame, n_actions: int) -> DataFrame:
    """(state, q array) of the states present, absent actions filled with 0."""
    present = F.map_from_entries(F.collect_list(F.struct(F.col("action").cast("bigint"), "q")))
    fill = F.transform(
        F.sequence(F.lit(0), F.lit(n_actions - 1)),
        lambda a: F.coalesce(F.element_at(F.col("m"), a.cast("bigint")), F.lit(0.0)),
    )
    return q.groupBy("state").agg(present.alias("m")).select("state", fill.alias("q"))


def sparse_rows(rows: DataFrame) -> DataFrame:
    """(state, action, q) from (state, q array)."""
    cells = rows.select("state", F.posexplode("q").alias("action", "q"))
    return cells.select("state", F.col("action").cast("bigint").alias("action"), "q")


def _all_states(rows: DataFrame, n_states: int | None, n_actions: int) -> DataFrame:
    if n_states is None:
        return rows
    zero = F.array_repeat(F.lit(0.0), n_actions)
    states = rows.sparkSession.range(n_states).withColumnRenamed("id", "state")
    return states.join(rows, "state", "left").withColumn("q", F.coalesce("q", zero))


def policy(q: DataFrame, n_actions: int, n_states: int | None = None) -> DataFrame:
    """(state, action): first best action, also of unvisited states if n_states is given."""
    rows = _all_states(dense_rows(q, n_actions), n_states, n_actions)
    return rows.select("state", first_max_index(F.col("q")).alias("action"))


def state_values(q: DataFrame, n_actions: int, n_states: int | None = None) -> DataFrame:
    rows = _all_states(dense_rows(q, n_actions), n_states, n_actions)
    return rows.select("state", F.array_max("q").alias("value"))


def policy_lookup(
    samples: DataFrame, greedy: DataFrame, min_k: int, n_states: int | None = None
) -> DataFrame:
    """Adds action and k by state. States out of range are clipped; a state without
    a row has an all-zero row, whose first best action is 0."""
    state = F.col("state") if n_states is None else clip_index(F.col("state"), n_states)
    return (
        samples.withColumn("state", state)
        .join(greedy.select("state", "action"), "state", "left")
        .withColumn("action", F.coalesce("action", F.lit(0)).cast("bigint"))
        .withColumn("k", F.col("action") + F.lit(min_k))
    )


def q_table_stats(q: DataFrame, n_states: int | Column, n_actions: int) -> DataFrame:
    """Statistics over the dense table, from its stored entries and its size."""
    size = (n_states if isinstance(n_states, Column) else F.lit(n_states)) * F.lit(n_actions)
    hit = F.col("q") != 0
    nz = F.when(hit, F.col("q"))
    sums = q.where(hit).agg(
        F.count(nz).alias("non_zero"),
        F.avg(nz).alias("mean_non_zero"),
        F.stddev_pop(nz).alias("std_non_zero"),
        F.min(nz).alias("lo"),
        F.max(nz).alias("hi"),
        F.countDistinct("state").alias("seen"),
    )
    total = size.cast("double")
    zeros = total - F.col("non_zero")
    m1 = F.coalesce("mean_non_zero", F.lit(0.0))
    v1 = F.pow(F.coalesce("std_non_zero", F.lit(0.0)), F.lit(2.0))
    mean = F.col("non_zero") * m1 / total
    spread = F.col("non_zero") * (v1 + (m1 - mean) * (m1 - mean)) + zeros * mean * mean
    zero_if = F.when(zeros > 0, F.lit(0.0))
    return sums.select(
        size.cast("bigint").alias("entries"),
        mean.alias("mean_q"),
        F.sqrt(spread / total).alias("std_q"),
        F.least("lo", zero_if).alias("min_q"),
        F.greatest("hi", zero_if).alias("max_q"),
        F.col("non_zero").alias("non_zero_entries"),
        (F.col("non_zero") / total * 100.0).alias("non_zero_percentage"),
        (F.col("seen") * F.lit(float(n_actions)) / total * 100.0).alias("state_coverage"),
        F.col("mean_non_zero").alias("mean_non_zero_q"),
        F.col("std_non_zero").alias("std_non_zero_q"),
    )


# ---- update rule ---------------------------------------------------------


def q_step(q: Column, action: Column, reward: Column, alpha: float, gamma: float) -> Column:
    target = lambda x: x + F.lit(alpha) * (reward + F.lit(gamma) * F.array_max(q) - x)
    return F.transform(q, lambda x, i: F.when(i == action, target(x)).otherwise(x))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold_and_tell(log: str, start: Column, step: Callable, fields: str) -> Column:
    """Struct of the final q and what every step told, in blocks t. A list that grows
    by one entry is copied each time, so entries are gathered per block first."""
    none = F.expr(f"cast(array() as array<struct<{fields}>>)")
    nothing = F.expr(f"cast(array() as array<array<struct<{fields}>>>)")
    last = F.floor((F.size(log) - 1) / F.lit(STORY_BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.slice(F.col(log), b * F.lit(STORY_BLOCK) + 1, F.lit(STORY_BLOCK)),
    )

    def block(acc: Column, entries: Column) -> Column:
        inner = F.aggregate(entries, F.struct(acc["q"].alias("q"), none.alias("t")), step)
        return _once(
            inner, lambda r: F.struct(r["q"].alias("q"), F.array_append(acc["t"], r["t"]).alias("t"))
        )

    return F.aggregate(blocks, F.struct(start.alias("q"), nothing.alias("t")), block)


def _chunk_logs(transitions: DataFrame, order: str, n_actions: int, chunk_rows: int) -> DataFrame:
    """(state, chunk, log): the ordered transitions of a state, about `chunk_rows` at a
    time. Chunks are whole ranges of the order, which is unique within a state, so
    their sizes follow from counts per range."""
    entry = F.struct(
        F.col(order).alias("o"),
        clip_index(F.col("action"), n_actions).alias("a"),
        F.col("reward").cast("double").alias("r"),
    )
    rows = transitions.select("state", F.col(order).cast("bigint").alias(order), entry.alias("e"))
    if largest_group(rows, ["state"]) <= chunk_rows:
        tagged = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    else:
        width = max(1, chunk_rows // 4)
        ranged = rows.withColumn("range", F.floor(F.col(order) / F.lit(width)))
        sizes = ranged.groupBy("state", "range").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(W.partitionBy("state").orderBy("range")) - F.col("n")
        chunk = F.floor(before / F.lit(chunk_rows)).cast("bigint").alias("chunk")
        tagged = ranged.join(stored_small(sizes.select("state", "range", chunk)), ["state", "range"])
    return tagged.groupBy("state", "chunk").agg(F.array_sort(F.collect_list("e")).alias("log"))


def _solve_chunks(
    logs: DataFrame, q0: DataFrame | None, alpha: float, gamma: float, n_actions: int
) -> DataFrame:
    """(state, chunk, log, q0, start, q_end, seen): every chunk folded from its true start.

    The fold is sequential, but a start is forgotten quickly (each update keeps
    1-alpha of it). So all chunks are folded at once from a guessed start, the ends
    are handed to the next chunks, and this is repeated until no start changes:
    after j rounds chunk j is exact, and in practice two or three rounds do. An
    action that a chunk does not update is taken over from the last chunk that did.
    """
    zero = F.array_repeat(F.lit(0.0), n_actions)
    seen = F.array_distinct(F.transform("log", lambda e: e["a"]))
    logs = logs.withColumn("seen", seen)
    if q0 is None:
        logs = logs.withColumn("q0", zero)
    else:
        first = dense_rows(q0, n_actions).withColumnRenamed("q", "q0")
        logs = logs.join(first, "state", "left").withColumn("q0", F.coalesce("q0", zero))
    end = F.aggregate(
        "log", F.col("start"), lambda q, e: q_step(q, e["a"], e["r"], alpha, gamma)
    )
    before = W.partitionBy("state").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    handed = F.array(
        *[
            F.coalesce(
                F.last(F.when(F.array_contains("seen", F.lit(a).cast("bigint")), F.col("q_end")[a]), True).over(before),
                F.col("q0")[a],
            )
            for a in range(n_actions)
        ]
    )
    logs = checkpointed(logs)
    chunks = logs.groupBy("state").count().agg(F.max("count")).first()[0] or 0
    cur = logs.withColumn("start", F.col("q0"))
    for _ in range(max(chunks - 1, 0)):
        folded = cur.withColumn("q_end", end)
        moved = checkpointed(
            folded.select("state", "chunk", "start", handed.alias("next")).withColumn(
                "change",
                F.exists(F.zip_with("start", "next", lambda x, y: x != y), lambda x: x),
            )
        )
        change = moved.agg(F.max("change")).first()[0]
        cur = logs.join(moved.select("state", "chunk", F.col("next").alias("start")), ["state", "chunk"])
        if not change:
            break
    return cur.withColumn("q_end", end)


def q_update(
    transitions: DataFrame,
    alpha: float = 0.1,
    gamma: float = 0.9,
    n_actions: int = 9,
    q0: DataFrame | None = None,
    order: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(state, action, q) after the self-loop transitions(state, order, action, reward)
    were applied in order, starting from q0 or zeros. Dense for the states present.

    `order` is an integer, unique within a state.
    """
    done = _solve_chunks(_chunk_logs(transitions, order, n_actions, chunk_rows), q0, alpha, gamma, n_actions)
    cells = done.select("state", "chunk", "seen", "q0", F.posexplode("q_end").alias("action", "q"))
    cells = cells.withColumn("action", F.col("action").cast("bigint"))
    hit = F.array_contains("seen", F.col("action"))
    # Where no chunk touched an action, its value is still the first one.
    return (
        cells.groupBy("state", "action")
        .agg(
            F.max_by("q", F.when(hit, F.col("chunk"))).alias("last"),
            F.max(hit).alias("hit"),
            F.first("q0").alias("q0"),
        )
        .select("state", "action", F.when(F.col("hit"), F.col("last")).otherwise(F.get("q0", F.col("action").cast("int"))).alias("q"))
    )


def td_error(
    transitions: DataFrame,
    alpha: float = 0.1,
    gamma: float = 0.9,
    n_actions: int = 9,
    q0: DataFrame | None = None,
    order: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(state, order, td_error) of every transition."""
    done = _solve_chunks(_chunk_logs(transitions, order, n_actions, chunk_rows), q0, alpha, gamma, n_actions)
    fields = f"{order}: bigint, td_error: double"

    def step(acc: Column, e: Column) -> Column:
        q = acc["q"]
        error = e["r"] + F.lit(gamma) * F.array_max(q) - F.get(q, e["a"].cast("int"))
        told = F.struct(e["o"].alias(order), error.alias("td_error"))
        return F.struct(
            q_step(q, e["a"], e["r"], alpha, gamma).alias("q"),
            F.array_append(acc["t"], told).alias("t"),
        )

    story = done.withColumn("r", _fold_and_tell("log", F.col("start"), step, fields))
    return story.select("state", F.inline(F.flatten("r.t")))


def q_sweep(
    transitions: DataFrame,
    q: DataFrame | None = None,
    alpha: float = 0.1,
    gamma: float = 0.9,
    n_actions: int = 9,
) -> DataFrame:
    """One synchronous update of all transitions(state, action, next_state, reward).

    Equals the sequential rule where each (state, action) occurs once and no next
    state is updated. Entries absent from q are 0.
    """
    if q is None:
        now = transitions.withColumns({"q": F.lit(0.0), "v": F.lit(0.0)})
    else:
        gap = F.when(F.count(F.lit(1)) < n_actions, F.lit(0.0))
        value = q.groupBy(F.col("state").alias("next_state")).agg(F.greatest(F.max("q"), gap).alias("v"))
        now = (
            transitions.join(value, "next_state", "left")
            .join(q, ["state", "action"], "left")
            .na.fill(0.0, ["q", "v"])
        )
    new = F.col("q") + F.lit(alpha) * (F.col("reward") + F.lit(gamma) * F.col("v") - F.col("q"))
    moved = now.select("state", "action", new.alias("q"))
    if q is None:
        return moved
    kept = q.join(transitions, ["state", "action"], "left_anti").select("state", "action", "q")
    return moved.unionByName(kept)


# ---- exploration ---------------------------------------------------------


def epsilon(t: Column, p: Learning) -> Column:
    return F.greatest(F.lit(p.eps_end), F.lit(p.eps_start) * F.pow(F.lit(p.eps_decay), t.cast("double")))


def epsilon_schedule(
    iterations: DataFrame, p: Learning = Learning(), done: int = 0, reset: bool = False
) -> DataFrame:
    """Adds the epsilon an iteration uses and the one logged after its decay. `done`
    iterations went before, unless the schedule is reset."""
    t = F.col("iteration") + F.lit(0 if reset else done)
    return iterations.withColumns({"eps_used": epsilon(t, p), "eps_logged": epsilon(t + 1, p)})


def minibatch(samples: DataFrame, key: str, p: Learning = Learning()) -> DataFrame:
    """(iteration, rank, idx, samples...): `batch` different samples per iteration, or
    all of them in order if there are no more.

    Floyd's method draws the indices of an iteration in `batch` steps, every subset
    being equally likely, so the draws are iterations x batch rows however many
    samples there are, and meet them by index. The samples are read three times: pass
    a stored table.
    """
    indexed = dense_index(samples, key)
    n = samples.agg(F.count(F.lit(1))).scalar()
    m = p.batch
    rounds = samples.sparkSession.range(p.iterations).select(F.col("id").alias("iteration"), n.alias("n"))

    def pick(chosen: Column, j: Column) -> Column:
        u = draw("pick", p.seed, F.col("iteration").cast("string"), j.cast("string"))
        t = F.floor(u * (j + 1)).cast("bigint")
        return F.array_append(chosen, F.when(F.array_contains(chosen, t), j).otherwise(t))

    some = F.aggregate(
        F.sequence(F.col("n") - m, F.col("n") - 1), F.expr("cast(array() as array<bigint>)"), pick
    )
    picked = F.when(F.col("n") > m, some).otherwise(
        F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    )
    draws = rounds.select("iteration", "n", F.explode(picked).alias("idx"))
    order = F.when(F.col("n") > m, F.md5(F.concat_ws(":", F.lit("rank"), F.lit(str(p.seed)), "iteration", "idx")))
    w = W.partitionBy("iteration").orderBy(order, "idx")
    draws = draws.select("iteration", F.row_number().over(w).cast("bigint").alias("rank"), "idx")
    if p.iterations * m <= BROADCAST_DRAWS:
        draws = F.broadcast(draws)
    return indexed.join(draws, "idx")


def explored_visits(batches: DataFrame, p: Learning = Learning(), phase: int = 1, done: int = 0) -> DataFrame:
    """Adds `explore`: the random action of an exploring visit, -1 for a greedy one."""
    key = [str(phase), str(p.seed), F.col("iteration").cast("string"), F.col("rank").cast("string")]
    coin, act = draw("coin", *key), draw("act", *key)
    random = F.floor(act * F.lit(p.n_actions)).cast("bigint")
    eps = epsilon(F.col("iteration") + F.lit(done), p)
    return batches.withColumn("explore", F.when(coin < eps, random).otherwise(F.lit(-1).cast("bigint")))


def fold_visits(
    visits: DataFrame, rewards: Sequence[float], p: Learning, q0: DataFrame | None = None
) -> DataFrame:
    """(state, q, log) after the visits(state, iteration, rank, explore) of each state
    in order; a greedy visit takes the first best action of the running row and log
    lists the actions taken. A state collects at most the visits given: callers pass
    no more than FOLD_VISITS at a time.
    """
    pay = F.array(*[F.lit(float(r)) for r in rewards])
    zero = F.array_repeat(F.lit(0.0), p.n_actions)
    entry = F.struct("iteration", "rank", "explore")
    grouped = visits.groupBy("state").agg(F.array_sort(F.collect_list(entry)).alias("visits"))
    if q0 is None:
        grouped = grouped.withColumn("q0", zero)
    else:
        first = dense_rows(q0, p.n_actions).withColumnRenamed("q", "q0")
        grouped = grouped.join(first, "state", "left").withColumn("q0", F.coalesce("q0", zero))

    def step(acc: Column, e: Column) -> Column:
        action = F.when(e["explore"] >= 0, e["explore"]).otherwise(first_max_index(acc["q"]))

        def act(a: Column) -> Column:
            told = F.struct(e["iteration"].alias("iteration"), e["rank"].alias("rank"), a.alias("action"))
            return F.struct(
                q_step(acc["q"], a, F.get(pay, a.cast("int")), p.alpha, p.gamma).alias("q"),
                F.array_append(acc["t"], told).alias("t"),
            )

        return _once(action, act)

    fields = "iteration: bigint, rank: bigint, action: bigint"
    folded = grouped.select("state", _fold_and_tell("visits", F.col("q0"), step, fields).alias("r"))
    return folded.select("state", "r.q", F.flatten("r.t").alias("log"))


def learn(
    samples: DataFrame,
    key: str,
    rewards: Mapping[int, float],
    p: Learning = Learning(),
    phase: int = 1,
    done: int = 0,
    q0: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(q(state, action, q), visits(phase, iteration, rank, state, action, explored,
    reward)) of one training phase over samples(key, state).

    The visits are iterations x batch rows. They are folded a bounded number at a
    time, each part starting from the table the part before left.
    """
    pay = [float(rewards[k]) for k in range(p.min_k, p.max_k + 1)]
    batches = explored_visits(minibatch(samples.select(key, "state"), key, p), p, phase, done)
    batches = batches.select("state", "iteration", "rank", "explore")
    step = max(1, FOLD_VISITS // p.batch)
    parts = [(a, min(a + step, p.iterations)) for a in range(0, p.iterations, step)]
    if len(parts) > 1:
        batches = checkpointed(batches)
    table, logs = q0, []
    for a, b in parts:
        part = batches if len(parts) == 1 else batches.where(F.col("iteration").between(a, b - 1))
        folded = fold_visits(part, pay, p, table)
        if len(parts) > 1 or q0 is not None:
            folded = checkpointed(folded)
        fresh = sparse_rows(folded.select("state", "q"))
        logs.append(folded.select("state", F.inline("log")).join(part, ["state", "iteration", "rank"]))
        if table is not None:
            fresh = fresh.unionByName(table.join(folded, "state", "left_anti").select("state", "action", "q"))
        table = fresh
    taken = logs[0]
    for more in logs[1:]:
        taken = taken.unionByName(more)
    reward = F.get(F.array(*[F.lit(r) for r in pay]), F.col("action").cast("int"))
    visits = taken.select(
        F.lit(phase).cast("bigint").alias("phase"),
        "iteration",
        "rank",
        "state",
        "action",
        (F.col("explore") >= 0).alias("explored"),
        reward.alias("reward"),
    )
    return table, visits


# ---- logs ----------------------------------------------------------------


def record_episode(visits: DataFrame) -> DataFrame:
    """(phase, iteration, total, n_actions): one row per iteration."""
    return visits.groupBy("phase", "iteration").agg(
        F.sum("reward").alias("total"), F.count(F.lit(1)).alias("n_actions")
    )


def training_log(visits: DataFrame, p: Learning = Learning(), done: int = 0) -> DataFrame:
    """(phase, iteration, cumulative_payoff, average_payoff, exploration_rate,
    action_diversity)."""
    return (
        visits.groupBy("phase", "iteration")
        .agg(
            F.sum("reward").alias("cumulative_payoff"),
            F.avg("reward").alias("average_payoff"),
            F.countDistinct("action").alias("action_diversity"),
        )
        .withColumn("exploration_rate", epsilon(F.col("iteration") + F.lit(done + 1), p))
    )


def last_n_mean(episodes: DataFrame, order: Sequence[str] = ("phase", "iteration"), n: int = 10) -> DataFrame:
    """(last_n_mean): mean total of the last n episodes, taken as a top-n."""
    last = episodes.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.agg(F.avg("total").alias("last_n_mean"))


def agent_statistics(visits: DataFrame, p: Learning = Learning()) -> DataFrame:
    """One row: epsilon, episode rewards, exploration."""
    episodes = visits.groupBy("phase", "iteration").agg(
        F.sum("reward").alias("total"),
        F.count_if("explored").alias("explored"),
        F.count_if(~F.col("explored")).alias("greedy"),
    )
    over = episodes.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.coalesce(F.avg("total"), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.stddev_pop("total"), F.lit(0.0)).alias("std_reward"),
        F.min("total").alias("min_reward"),
        F.max("total").alias("max_reward"),
        F.coalesce(F.sum("explored"), F.lit(0)).alias("total_exploration"),
        F.coalesce(F.sum("greedy"), F.lit(0)).alias("total_exploitation"),
    )
    both = F.col("total_exploration") + F.col("total_exploitation")
    rate = F.when(both > 0, F.col("total_exploration") / both).otherwise(0.0)
    return over.withColumns(
        {
            "epsilon": epsilon(F.col("n_episodes"), p),
            "last_10_mean_reward": last_n_mean(episodes).scalar(),
            "exploration_rate": rate,
        }
    )
