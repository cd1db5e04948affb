"""Policy learning, reports and streams."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from markerloom.catalog import fixtures as X
from markerloom.catalog.base import big, query, r6, rounded, table
from markerloom.catalog.groups import plain_f1, plain_silhouettes
from markerloom.functions.ordered import numbered
from markerloom.operators import qtable as Q
from markerloom.operators import reports as R
from markerloom.operators.binning import quantile_bins
from markerloom.operators.cleaning import feature_matrix
from markerloom.operators.clustering import cluster_lookup as lookup_clusters
from markerloom.plans import train as TR
from markerloom.plans.score import score_samples as score
from markerloom.session import checkpointed, new_path
from markerloom.sources import tables as T
from markerloom.streaming.scoring import read_parts, run_available, score_with_newest
from markerloom.streaming.scoring import stream_score as score_stream
from markerloom.streaming.updates import stream_q_update as update_stream

P = X.LEARNING
S = "sample_id"

# ---- actions and epsilon ----------------------------------------------------------


def _actions(spark, sf):
    """As many actions as there are vector labels, from k = 2 on."""
    labels = T.parquet(spark, sf, "embeddings").agg(F.countDistinct("label").alias("n"))
    return Q.action_space(labels.select(F.lit(2).alias("min_k"), (F.col("n") + 0).alias("max_k")))


table("act", "SELECT i AS action, i + 2 AS k FROM range(100) t(i) WHERE i + 2 <= (SELECT count(DISTINCT label) FROM embeddings)")


@query("SELECT * FROM act", ("act",))
def action_space(spark, sf):
    return _actions(spark, sf)


@query("SELECT vec_id, CAST(label AS BIGINT) + 2 AS k, action FROM embeddings LEFT JOIN act ON act.k = label + 2", ("act",))
def action_of_k(spark, sf):
    ks = T.parquet(spark, sf, "embeddings").select("vec_id", (big("label") + 2).alias("k"))
    return Q.action_of_k(ks, _actions(spark, sf)).select("vec_id", "k", "action")


@query(
    f"""SELECT iteration, round({X.EPS.format(t='iteration')}, 6) + 0.0 AS eps_used, round({X.EPS.format(t='iteration + 1')}, 6) + 0.0 AS eps_logged
FROM (SELECT DISTINCT iteration FROM ev)""",
    ("ev",),
)
def epsilon_schedule(spark, sf):
    iterations = X.event_visits(spark, sf).select("iteration").distinct()
    return rounded(Q.epsilon_schedule(iterations, P), "eps_used", "eps_logged")


def _draw_sql(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496"


def _training_tables(tag: str, source: str, phase: int, done: int, rewards: str, q0: str | None) -> None:
    """SQL side of one training phase over source(sample_id, state)."""
    m = P.batch
    table(
        f"{tag}idx",
        f"SELECT *, row_number() OVER (ORDER BY substr(md5(CAST({S} AS VARCHAR)), 1, 3), {S}) - 1 AS idx, count(*) OVER () AS n FROM {source}",
        (source,),
    )
    table(
        f"{tag}pick",
        f"""(
SELECT i AS it, 0 AS step, []::BIGINT[] AS chosen FROM range({P.iterations}) t(i)
UNION ALL
SELECT it, step + 1, list_append(chosen, CASE WHEN list_contains(chosen, t) THEN j ELSE t END) FROM (
  SELECT it, step, chosen, j, CAST(floor({_draw_sql(f"'pick:{P.seed}:' || it || ':' || j")} * (j + 1)) AS BIGINT) AS t
  FROM (SELECT it, step, chosen, n - {m} + step AS j FROM {tag}pick, (SELECT count(*) AS n FROM {source})
    WHERE step < {m} AND n > {m})))""",
        (source,),
    )
    table(
        f"{tag}batch",
        f"""SELECT it AS iteration, row_number() OVER (PARTITION BY it ORDER BY o, idx) AS rank, {S}, state FROM (
  SELECT it, idx, md5('rank:{P.seed}:' || it || ':' || idx) AS o
  FROM (SELECT it, unnest(chosen) AS idx FROM {tag}pick WHERE step = {m})
  UNION ALL SELECT i, idx, NULL FROM range({P.iterations}) t(i), {tag}idx WHERE n <= {m})
JOIN {tag}idx USING (idx)""",
        (f"{tag}idx", f"{tag}pick"),
    )
    table(
        f"{tag}vis",
        f"""SELECT iteration, rank, {S}, state, row_number() OVER (PARTITION BY state ORDER BY iteration, rank) AS seq,
  CASE WHEN {_draw_sql(f"'coin:{phase}:{P.seed}:' || iteration || ':' || rank")} < {X.EPS.format(t=f'(iteration + {done})')}
    THEN CAST(floor({_draw_sql(f"'act:{phase}:{P.seed}:' || iteration || ':' || rank")} * 9) AS BIGINT) ELSE -1 END AS explore
FROM {tag}batch""",
        (f"{tag}batch",),
    )
    table(f"{tag}pay", f"SELECT list(reward ORDER BY k) AS r FROM {rewards}", (rewards,))
    zero = "[0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0]"
    start = (
        f"SELECT DISTINCT state, 0::BIGINT AS seq, {zero} AS q, -1::BIGINT AS a FROM {tag}vis"
        if q0 is None
        else f"SELECT DISTINCT v.state, 0::BIGINT AS seq, coalesce(z.q, {zero}) AS q, -1::BIGINT AS a FROM {tag}vis v LEFT JOIN {q0} z ON z.state = v.state"
    )
    table(
        f"{tag}fold",
        f"""(
{start}
UNION ALL
SELECT state, seq, [CASE WHEN i - 1 = na THEN q[i] + 0.1::DOUBLE * (r[na + 1] + 0.9::DOUBLE * list_max(q) - q[i]) ELSE q[i] END
    FOR i IN range(1, 10)], na
FROM (SELECT f.state, v.seq, f.q, p.r,
    CASE WHEN v.explore >= 0 THEN v.explore ELSE list_position(f.q, list_max(f.q)) - 1 END AS na
  FROM {tag}fold f JOIN {tag}vis v ON v.state = f.state AND v.seq = f.seq + 1, {tag}pay p))""",
        (f"{tag}vis", f"{tag}pay") + ((q0,) if q0 else ()),
    )
    own = f"SELECT state, arg_max(q, seq) AS q FROM {tag}fold GROUP BY state"
    if q0 is not None:
        own += f" UNION ALL SELECT state, q FROM {q0} WHERE state NOT IN (SELECT state FROM {tag}vis)"
    table(f"{tag}row", own, (f"{tag}fold",))
    table(f"{tag}q", f"SELECT state, a AS action, q[a + 1] AS q FROM {tag}row, range(9) t(a)", (f"{tag}row",))
    table(
        f"{tag}visits",
        f"""SELECT {phase}::BIGINT AS phase, v.iteration, v.rank, v.state, f.a AS action, v.explore >= 0 AS explored, p.r[f.a + 1] AS reward
FROM {tag}fold f JOIN {tag}vis v ON v.state = f.state AND v.seq = f.seq, {tag}pay p""",
        (f"{tag}fold", f"{tag}vis", f"{tag}pay"),
    )


table("rew1", "SELECT k, silhouette AS reward FROM ssil", ("ssil",))
_training_tables("one", "samples", 1, 0, "rew1", None)
table("labeled", "SELECT * FROM samples WHERE label IS NOT NULL", ("samples",))
table(
    "rew2",
    """SELECT k, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS reward FROM (
  SELECT k, sum(CASE WHEN p > n THEN p ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p > n THEN n ELSE 0 END)::DOUBLE AS fp,
    sum(CASE WHEN p > n THEN 0 ELSE p END)::DOUBLE AS fn
  FROM (SELECT k, cluster, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label <> 'positive') AS n
    FROM lbasg JOIN labeled USING (sample_id) GROUP BY 1, 2) GROUP BY 1)""",
    ("lbasg", "labeled"),
)
_training_tables("two", "labeled", 2, P.iterations, "rew2", "onerow")


def _setting(spark, sf):
    """Samples, their matrix and the fixed clusterings; one row per sample, kept."""
    samples = checkpointed(X.samples(spark, sf))
    points = X.sample_points(samples)
    return samples, points, X.fixed_clusters(points, S)


def _phase1(spark, sf):
    samples, points, clusters = _setting(spark, sf)
    return samples, points, clusters, TR.train_quality(samples, points, clusters, S, P)


@query("SELECT iteration, rank, sample_id FROM onebatch", ("onebatch",))
def minibatch(spark, sf):
    return Q.minibatch(checkpointed(X.samples(spark, sf)), S, P).select("iteration", "rank", S)


@query("SELECT iteration, rank, state, explore FROM onevis", ("onevis",))
def epsilon_greedy(spark, sf):
    """The exploring visits with their action, -1 where the greedy one is taken."""
    batches = Q.minibatch(checkpointed(X.samples(spark, sf)), S, P)
    return Q.explored_visits(batches, P).select("iteration", "rank", "state", "explore")


# ---- update rule -------------------------------------------------------------------


@query("SELECT state, action, round(q, 6) + 0.0 AS q FROM trlast", ("trlast",))
def q_update(spark, sf):
    return rounded(Q.q_update(X.transitions(spark, sf)), "q")


@query("SELECT state, action, round(q, 6) + 0.0 AS q FROM trlast", ("trlast",))
def q_update_chunked(spark, sf):
    """The same with the log of a state in chunks, as for states too large for one task."""
    return rounded(Q.q_update(X.transitions(spark, sf), chunk_rows=200), "q")


@query("SELECT state, seq, round(td, 6) + 0.0 AS td_error FROM trq WHERE step > 0", ("trq",))
def td_error(spark, sf):
    return rounded(Q.td_error(X.transitions(spark, sf)), "td_error")


@query(
    """SELECT t.state, t.action, round(coalesce(m.q, 0) + 0.1 * (reward + 0.9 * coalesce(v.v, 0) - coalesce(m.q, 0)), 6) + 0.0 AS q
FROM (SELECT user_id % 10 AS state, event_id % 9 AS action, 10 + min(event_id) % 10 AS next_state, avg(value) / 517 AS reward
  FROM events GROUP BY 1, 2) t
LEFT JOIN mq m ON m.state = t.state AND m.action = t.action
LEFT JOIN (SELECT state, max(q) AS v FROM mqrow GROUP BY 1) v ON v.state = t.next_state
UNION ALL SELECT state, action, round(q, 6) + 0.0 FROM mq WHERE state >= 10""",
    ("mq", "mqrow"),
)
def q_sweep(spark, sf):
    ev = T.parquet(spark, sf, "events")
    moves = ev.groupBy((F.col("user_id") % 10).alias("state"), (F.col("event_id") % 9).alias("action")).agg(
        (F.min("event_id") % 10 + 10).alias("next_state"), (F.avg("value") / 517).alias("reward")
    )
    return rounded(Q.q_sweep(moves, X.mean_q(spark, sf)), "q")


@query("SELECT state, action FROM mqpol", ("mqpol",))
def policy(spark, sf):
    return Q.policy(X.mean_q(spark, sf), 9)


@query(
    """SELECT s AS state, coalesce(action, 0) AS action, round(coalesce(v, 0), 6) + 0.0 AS value
FROM range(30) t(s) LEFT JOIN mqpol ON state = s
LEFT JOIN (SELECT state AS x, max(q) AS v FROM mqrow GROUP BY 1) ON x = s""",
    ("mqpol", "mqrow"),
)
def state_values(spark, sf):
    """Value and first best action of all 30 states, ten of them never visited."""
    q = checkpointed(X.mean_q(spark, sf))
    values = Q.state_values(q, 9, 30)
    return rounded(Q.policy(q, 9, 30).join(values, "state"), "value").select("state", "action", "value")


@query(
    """SELECT user_id, greatest(0, least(29, user_id % 40 - 3)) AS state, coalesce(action, 0) AS action, coalesce(action, 0) + 2 AS k
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN mqpol ON state = greatest(0, least(29, user_id % 40 - 3))""",
    ("mqpol",),
)
def policy_lookup(spark, sf):
    users = T.parquet(spark, sf, "events").select("user_id").distinct()
    asked = users.withColumn("state", F.col("user_id") % 40 - 3)
    greedy = Q.policy(X.mean_q(spark, sf), 9)
    return Q.policy_lookup(asked, greedy, 2, 30).select("user_id", "state", "action", "k")


@query("SELECT vec_id, k, cluster FROM vasg WHERE k = vec_id % 9 + 2", ("vasg",))
def cluster_lookup(spark, sf):
    points = X.vectors(spark, sf).select("vec_id", "features")
    chosen = points.select("vec_id", (F.col("vec_id") % 9 + 2).alias("k"))
    return lookup_clusters(chosen, X.fixed_clusters(points, "vec_id"), "vec_id").select("vec_id", "k", "cluster")


# ---- logs and statistics -------------------------------------------------------------


@query("SELECT phase, iteration, round(sum(reward), 6) + 0.0 AS total, count(*) AS n_actions FROM ev GROUP BY 1, 2", ("ev",))
def record_episode(spark, sf):
    return rounded(Q.record_episode(X.event_visits(spark, sf)), "total")


LOG = ["cumulative_payoff", "average_payoff", "exploration_rate"]


@query(
    f"SELECT phase, iteration, action_diversity, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in LOG)} FROM evlog",
    ("evlog",),
)
def training_log(spark, sf):
    return rounded(Q.training_log(X.event_visits(spark, sf), P), *LOG)


table("eps", "SELECT phase, iteration, sum(reward) AS total FROM ev GROUP BY 1, 2", ("ev",))


@query(
    f"""SELECT count(*) AS n_episodes, round(avg(total), 6) + 0.0 AS mean_reward, round(stddev_pop(total), 6) + 0.0 AS std_reward,
  round(min(total), 6) + 0.0 AS min_reward, round(max(total), 6) + 0.0 AS max_reward,
  round({X.EPS.format(t='count(*)')}, 6) + 0.0 AS epsilon,
  (SELECT round(avg(total), 6) + 0.0 FROM (SELECT total FROM eps ORDER BY phase DESC, iteration DESC LIMIT 10)) AS last_10_mean_reward,
  (SELECT count(*) FROM ev WHERE explored) AS total_exploration, (SELECT count(*) FROM ev WHERE NOT explored) AS total_exploitation,
  (SELECT round(avg(CASE WHEN explored THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM ev) AS exploration_rate FROM eps""",
    ("ev", "eps"),
)
def agent_statistics(spark, sf):
    got = Q.agent_statistics(X.event_visits(spark, sf), P)
    return rounded(
        got, "mean_reward", "std_reward", "min_reward", "max_reward", "epsilon", "last_10_mean_reward", "exploration_rate"
    )


@query(
    "SELECT round(avg(total), 6) + 0.0 AS last_n_mean FROM (SELECT total FROM eps ORDER BY phase DESC, iteration DESC LIMIT 10)",
    ("eps",),
)
def last_n_mean(spark, sf):
    return rounded(Q.last_n_mean(Q.record_episode(X.event_visits(spark, sf))), "last_n_mean")


table(
    "dense",
    "SELECT s AS state, a AS action, coalesce(q, 0.0) AS q FROM range(30) x(s) CROSS JOIN range(9) y(a) LEFT JOIN mq ON state = s AND action = a",
    ("mq",),
)
STATS = ["mean_q", "std_q", "min_q", "max_q", "non_zero_percentage", "state_coverage", "mean_non_zero_q", "std_non_zero_q"]
table(
    "qstats",
    """SELECT count(*) AS entries, avg(q) AS mean_q, stddev_pop(q) AS std_q, min(q) AS min_q, max(q) AS max_q,
  count(*) FILTER (q <> 0) AS non_zero_entries, 100.0 * count(*) FILTER (q <> 0) / count(*) AS non_zero_percentage,
  100.0 * count(DISTINCT state) FILTER (q <> 0) / 30 AS state_coverage,
  avg(q) FILTER (q <> 0) AS mean_non_zero_q, stddev_pop(q) FILTER (q <> 0) AS std_non_zero_q FROM dense""",
    ("dense",),
)


@query(f"SELECT entries, non_zero_entries, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in STATS)} FROM qstats", ("qstats",))
def q_table_stats(spark, sf):
    return rounded(Q.q_table_stats(X.mean_q(spark, sf), 30, 9), *STATS)


@query("SELECT a AS action, 'k=' || (a + 2) AS label, count(ev.action) AS n FROM range(9) t(a) LEFT JOIN ev ON ev.action = a GROUP BY 1, 2", ("ev",))
def action_distribution(spark, sf):
    return Q.action_distribution(X.event_visits(spark, sf), _actions(spark, sf))


# ---- training and scoring --------------------------------------------------------------


@query("SELECT state, action, round(q, 6) + 0.0 AS q FROM oneq", ("oneq",))
def train_quality(spark, sf):
    return rounded(_phase1(spark, sf)[3][0], "q")


@query(
    "SELECT phase, iteration, rank, state, action, CAST(explored AS BIGINT) AS explored, round(reward, 6) + 0.0 AS reward FROM onevisits",
    ("onevisits",),
)
def train_visits(spark, sf):
    visits = _phase1(spark, sf)[3][1]
    return rounded(visits.withColumn("explored", big("explored")), "reward")


def _phase2(spark, sf):
    samples, points, clusters, (q1, visits1) = _phase1(spark, sf)
    q1 = checkpointed(q1)
    labeled = samples.where(F.col("label").isNotNull())
    own = X.fixed_clusters(X.sample_points(labeled), S)
    q2, visits2 = TR.train_diagnostic(labeled, own, S, P, q0=q1, done=P.iterations)
    return samples, clusters, q2, visits1, visits2


@query("SELECT state, action, round(q, 6) + 0.0 AS q FROM twoq", ("twoq",))
def train_diagnostic(spark, sf):
    return rounded(_phase2(spark, sf)[2], "q")


@query(
    """SELECT filename, state AS encoded_state, a.k AS selected_cluster_count, a.cluster AS assigned_cluster,
  CASE WHEN a.cluster = 0 THEN 'positive' ELSE 'negative' END AS predicted_hiv_status
FROM (SELECT s.*, list_position(q, list_max(q)) + 1 AS k FROM samples s JOIN tworow USING (state)
  UNION ALL SELECT *, 2 FROM samples WHERE state NOT IN (SELECT state FROM tworow)) s
JOIN sasg a ON a.k = s.k AND a.sample_id = s.sample_id""",
    ("samples", "tworow", "sasg"),
)
def score_samples(spark, sf):
    samples, clusters, q, _, _ = _phase2(spark, sf)
    return score(samples, clusters, q, S, P, 125)


_PICKED = "least({}, (SELECT count(*) FROM {{}}))".format(P.batch)


def _plain_rewards(spark, samples, clusters):
    """(phase, action, plain): silhouettes of phase 1 and F1 scores of phase 2 from their definitions."""
    one, two = (clusters.where(F.col("phase") == i).drop("phase") for i in (1, 2))
    first = samples.where("label = 'positive'")
    points = checkpointed(feature_matrix(first.select(S, *X.MARKERS), S, X.MARKERS)[0])
    quality = plain_silhouettes(points, one, S).select(F.lit(1).cast("bigint").alias("phase"), "k", F.col("silhouette").alias("plain"))
    truth = samples.select(S, F.col("label").alias("truth"))
    diagnosis = plain_f1(two, truth, S).select(F.lit(2).cast("bigint").alias("phase"), "k", F.col("f1").alias("plain"))
    return quality.unionByName(diagnosis).select("phase", (F.col("k") - P.min_k).cast("bigint").alias("action"), "plain")


@query(
    f"""SELECT {P.iterations}::BIGINT AS phase1_iterations, {P.iterations}::BIGINT AS phase2_iterations,
  {P.iterations} * {_PICKED.format("samples WHERE label = 'positive'")} AS phase1_visits,
  {P.iterations} * {_PICKED.format("labeled")} AS phase2_visits,
  2 * {P.iterations}::BIGINT AS episodes, 2 * {P.iterations}::BIGINT AS done, 0::BIGINT AS wrong_log,
  0::BIGINT AS wrong_rewards, 0::BIGINT AS unknown_states""",
    ("samples", "labeled"),
)
def train_full(spark, sf):
    """Phase 1 on the positive samples, phase 2 on all labeled ones, each on fitted clusterings; of the saved agent, read back,
    the log is held against the visits and every reward against its definition over the saved clusterings."""
    samples = checkpointed(X.samples(spark, sf))
    path = new_path(spark, "agent")
    TR.train_full(samples.where("label = 'positive'"), samples, S, X.MARKERS, path, P)
    q, visits, episodes, log = (T.load_table(spark, path, n) for n in ("q", "visits", "episodes", "log"))
    _, done = TR.load_params(spark, path)
    sums = visits.groupBy("phase", "iteration").agg(F.sum("reward").alias("own"), F.avg("reward").alias("mean"))
    checked = log.join(sums, ["phase", "iteration"], "full")
    agrees = F.abs(F.col("cumulative_payoff") - F.col("own")) < 1e-6
    rewards = visits.groupBy("phase", "action").agg(F.min("reward").alias("low"), F.max("reward").alias("high"))
    rewards = rewards.join(_plain_rewards(spark, samples, T.load_table(spark, path, "clusters")), ["phase", "action"], "left")
    off = F.greatest(F.abs(F.col("low") - F.col("plain")), F.abs(F.col("high") - F.col("plain"))) < 1e-9
    parts = [
        log.agg(*[F.count_if(F.col("phase") == i).alias(f"phase{i}_iterations") for i in (1, 2)]),
        visits.agg(*[F.count_if(F.col("phase") == i).alias(f"phase{i}_visits") for i in (1, 2)]),
        episodes.agg(F.count(F.lit(1)).alias("episodes")),
        checked.agg(F.count_if(~F.coalesce(agrees, F.lit(False))).alias("wrong_log")),
        rewards.agg(F.count_if(~F.coalesce(off, F.lit(False))).alias("wrong_rewards")),
        q.join(samples, "state", "left_anti").agg(F.count(F.lit(1)).alias("unknown_states")),
    ]
    row = {c: v for part in parts for c, v in part.first().asDict().items()}
    out = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row))
    return out.withColumn("done", F.lit(done).cast("bigint"))


# ---- saved agents ----------------------------------------------------------------------


def _saved(spark, sf) -> str:
    path = new_path(spark, "agent")
    visits = X.event_visits(spark, sf)
    tables = {"q": X.mean_q(spark, sf), "visits": visits, "episodes": Q.record_episode(visits), "log": Q.training_log(visits, P)}
    tables["params"] = TR.params_table(spark, P, P.iterations)
    # Another agent is there already, and then replaced.
    T.save_tables({n: t.limit(1) for n, t in tables.items()}, path)
    T.save_tables(tables, path)
    return path


@query(
    """SELECT 'q' AS name, count(*) AS n FROM mq UNION ALL SELECT 'visits', count(*) FROM ev
UNION ALL SELECT 'episodes', count(*) FROM eps UNION ALL SELECT 'params', 1""",
    ("mq", "ev", "eps"),
)
def save_agent(spark, sf):
    path = _saved(spark, sf)
    out = None
    for name in ("q", "visits", "episodes", "params"):
        n = T.load_table(spark, path, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


_PARAMS = [(f.name, float(getattr(P, f.name))) for f in fields(P) if isinstance(getattr(P, f.name), (int, float))]
_PARAM_ROWS = ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in [*_PARAMS, ("n_actions", float(P.n_actions)), ("done", float(P.iterations))])


@query(
    f"""SELECT part, a, b, c, d, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM (
SELECT 'q' AS part, state AS a, action AS b, 0::BIGINT AS c, 0::BIGINT AS d, q AS x, 0.0::DOUBLE AS y FROM mq
UNION ALL SELECT 'visits', phase, iteration, rank, state * 20 + action * 2 + CAST(explored AS BIGINT), reward, 0.0 FROM ev
UNION ALL SELECT 'episodes', phase, iteration, count(*), 0, sum(reward), 0.0 FROM ev GROUP BY phase, iteration
UNION ALL SELECT 'log', phase, iteration, action_diversity, 0, cumulative_payoff, average_payoff FROM evlog
UNION ALL SELECT name, 0, 0, 0, 0, v, 0.0 FROM (VALUES {_PARAM_ROWS}) t(name, v))""",
    ("mq", "ev", "evlog"),
)
def load_agent(spark, sf):
    """A whole agent, saved twice over another one and read back: q, visits, episodes, log and parameters."""
    path = _saved(spark, sf)
    q, visits, episodes, log, params = (T.load_table(spark, path, n) for n in ("q", "visits", "episodes", "log", "params"))
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    spot = F.col("state") * 20 + F.col("action") * 2 + F.col("explored").cast("bigint")
    names = [n for n, _ in _PARAMS] + ["n_actions", "done"]
    values = params.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).cast("double").alias("x")) for n in names])))

    def shaped(df, part, a, b, c, d, x, y=none):
        kinds = zip("abcd", (a, b, c, d))
        return df.select(part.alias("part"), *[big(v).alias(k) for k, v in kinds], r6(x).alias("x"), r6(y).alias("y"))

    phase, iteration = F.col("phase"), F.col("iteration")
    out = shaped(q, F.lit("q"), F.col("state"), F.col("action"), zero, zero, F.col("q"))
    for more in (
        shaped(visits, F.lit("visits"), phase, iteration, F.col("rank"), spot, F.col("reward")),
        shaped(episodes, F.lit("episodes"), phase, iteration, F.col("n_actions"), zero, F.col("total")),
        shaped(log, F.lit("log"), phase, iteration, F.col("action_diversity"), zero, F.col("cumulative_payoff"), F.col("average_payoff")),
        shaped(values, F.col("part"), zero, zero, zero, zero, F.col("x")),
    ):
        out = out.unionByName(more)
    return out


# ---- report tables -----------------------------------------------------------------------

table("wide", "SELECT phase, least(50, count(*) // 10) AS w FROM evlog GROUP BY 1", ("evlog",))
# The average over the last w rows as an explicit self-join.
table(
    "curve",
    """SELECT a.phase, a.iteration, any_value(a.cumulative_payoff) AS cumulative_payoff, any_value(a.average_payoff) AS average_payoff,
  CASE WHEN any_value(a.w) > 1 AND any_value(a.rn) >= any_value(a.w) THEN avg(b.cumulative_payoff) END AS moving_average
FROM (SELECT l.*, w, row_number() OVER (PARTITION BY phase ORDER BY iteration) AS rn FROM evlog l JOIN wide USING (phase)) a
JOIN (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY iteration) AS rn FROM evlog) b
  ON b.phase = a.phase AND b.rn BETWEEN a.rn - a.w + 1 AND a.rn
GROUP BY 1, 2""",
    ("evlog", "wide"),
)


@query("SELECT phase, iteration, round(moving_average, 6) + 0.0 AS moving_average FROM curve", ("curve",))
def moving_average(spark, sf):
    log = Q.training_log(X.event_visits(spark, sf), P)
    averaged = R.moving_average(log, "cumulative_payoff")
    return rounded(averaged.select("phase", "iteration", "moving_average"), "moving_average")


@query(
    "SELECT phase, iteration, round(cumulative_payoff, 6) + 0.0 AS cumulative_payoff, round(average_payoff, 6) + 0.0 AS average_payoff, round(moving_average, 6) + 0.0 AS moving_average FROM curve",
    ("curve",),
)
def learning_curve(spark, sf):
    curve = R.learning_curve(Q.training_log(X.event_visits(spark, sf), P))
    return rounded(curve, "cumulative_payoff", "average_payoff", "moving_average")


@query(
    "SELECT state, " + ", ".join(f"round(max(CASE WHEN action = {k - 2} THEN q END), 6) + 0.0 AS k{k}" for k in X.KS) + " FROM mqrow GROUP BY 1",
    ("mqrow",),
)
def q_heatmap(spark, sf):
    return rounded(R.q_heatmap(X.mean_q(spark, sf), 2, 10), *[f"k{k}" for k in X.KS])


@query(
    """SELECT marker, bar, round(lo + bar * w, 6) + 0.0 AS lo, round(lo + (bar + 1) * w, 6) + 0.0 AS hi, count(x) AS n
FROM (SELECT event_type AS marker, min(value) AS lo, (max(value) - min(value)) / 50.0 AS w FROM events GROUP BY 1) s
CROSS JOIN range(50) t(bar)
LEFT JOIN (SELECT event_type AS m, value AS x FROM events) e ON e.m = s.marker AND least(49, floor((x - lo) / w)) = bar
GROUP BY marker, bar, lo, w""",
)
def feature_histogram(spark, sf):
    return rounded(R.feature_histogram(X.marker_values(spark, sf)), "lo", "hi")


@query(
    "SELECT feature, round(edges[i], 6) + 0.0 AS edge FROM qbins, range(2, 6) t(i)", ("qbins",)
)
def histogram_edges(spark, sf):
    return rounded(R.inner_edges(quantile_bins(X.marker_values(spark, sf))), "edge")


@query(
    "SELECT k, sample_id, cluster, round(ifna, 6) + 0.0 AS x, round(cd14, 6) + 0.0 AS y FROM sasg JOIN summary USING (sample_id)",
    ("sasg", "summary"),
)
def cluster_scatter(spark, sf):
    samples, _, clusters = _setting(spark, sf)
    return rounded(R.cluster_scatter(samples.select(S, *X.MARKERS), clusters, S, "IFN", "cd14"), "x", "y").select(
        "k", S, "cluster", "x", "y"
    )


@query(
    """SELECT (SELECT count(*) FROM evlog WHERE phase = 1) AS phase1_iterations,
  (SELECT round(arg_max(average_payoff, iteration), 6) + 0.0 FROM evlog WHERE phase = 1) AS phase1_average_payoff,
  (SELECT count(*) FROM evlog WHERE phase = 2) AS phase2_iterations,
  (SELECT round(arg_max(average_payoff, iteration), 6) + 0.0 FROM evlog WHERE phase = 2) AS phase2_average_payoff,
  round(state_coverage, 6) + 0.0 AS state_coverage, round(mean_q, 6) + 0.0 AS mean_q, round(max_q, 6) + 0.0 AS max_q FROM qstats""",
    ("evlog", "qstats"),
)
def summary_report(spark, sf):
    log = Q.training_log(X.event_visits(spark, sf), P)
    got = R.summary_report(log, Q.q_table_stats(X.mean_q(spark, sf), 30, 9))
    return rounded(got, "phase1_average_payoff", "phase2_average_payoff", "state_coverage", "mean_q", "max_q")


# ---- streams ---------------------------------------------------------------------------------


@query(
    """SELECT sample_id, s.state, coalesce(action, 0) AS action, coalesce(action, 0) + 2 AS k
FROM samples s LEFT JOIN mqpol USING (state)""",
    ("samples", "mqpol"),
)
def stream_score(spark, sf):
    arriving = new_path(spark, "summaries")
    X.samples(spark, sf).select(S, *X.FEATURES).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    scored = score_stream(read_parts(spark, schema, arriving), X.mean_q(spark, sf), X.BINS, X.FEATURES, P)
    out = scored.select(S, "state", "action", "k")
    return run_available(out, new_path(spark, "scored"), new_path(spark, "progress"))


table("mqworst", "SELECT state, action FROM mqrow QUALIFY row_number() OVER (PARTITION BY state ORDER BY q, action) = 1", ("mqrow",))


@query(
    """SELECT sample_id, s.state, coalesce(p.action, 0) AS action, coalesce(p.action, 0) + 2 AS k, version AS agent_version
FROM (SELECT *, sample_id % 2 AS version FROM samples) s
LEFT JOIN (SELECT 0 AS v, * FROM mqpol UNION ALL SELECT 1, * FROM mqworst) p ON p.state = s.state AND p.v = version""",
    ("samples", "mqpol", "mqworst"),
)
def stream_score_versions(spark, sf):
    """Half of the summaries arrive, then another agent is saved, of the negated table, then the other half."""
    arriving, agent, path, progress = (new_path(spark, n) for n in ("summaries", "agent", "scored", "progress"))
    samples = checkpointed(X.samples(spark, sf).select(S, *X.FEATURES))
    q = X.mean_q(spark, sf)
    for half, saved in enumerate((q, q.withColumn("q", -F.col("q")))):
        T.save_tables({"q": saved}, agent)
        samples.where(F.col(S) % 2 == half).write.mode("append").parquet(arriving)
        stream = read_parts(spark, samples.schema, arriving)
        out = score_with_newest(stream, agent, X.BINS, X.FEATURES, path, progress, P)
    return out.select(S, "state", "action", "k", "agent_version")


@query("SELECT state, action, round(q, 6) + 0.0 AS q FROM trlast", ("trlast",))
def stream_q_update(spark, sf):
    """The transitions arrive in four files that are not in their order, one file a micro-batch."""
    arriving = new_path(spark, "transitions")
    moves = numbered(X.transitions(spark, sf), "state", "seq", "number")
    moves = moves.select("state", F.col("number").alias("seq"), "action", "reward")
    moves.repartition(4, F.xxhash64("state", "seq")).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    parts = read_parts(spark, schema, arriving, files_per_trigger=1)
    return rounded(update_stream(parts, new_path(spark, "versions"), new_path(spark, "progress")), "q")
