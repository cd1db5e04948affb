"""The operators of this subpackage as queries over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.llm import (
    conversations,
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    resampling,
    simhash,
    token_counts,
    token_files,
    toxicity,
    url_filter,
)
from markerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def _rho_sql(children: str, parents: str, on: str) -> str:
    p = "(p.bad / p.n)"
    return f"""SELECT greatest({url_filter.LOW_RHO}::DOUBLE, least({url_filter.HIGH_RHO}::DOUBLE,
      coalesce(CASE WHEN sum(c.n) > count(*) THEN
        (sum(c.n * power(c.bad / c.n - {p}, 2) / ({p} * (1 - {p}))) - count(*)) / (sum(c.n) - count(*)) END,
        {url_filter.LOW_RHO}::DOUBLE))) AS rho
    FROM (SELECT * FROM {children} WHERE n > 0) c JOIN {parents} p ON {on} WHERE p.bad > 0 AND p.bad < p.n"""


def _mean_sql(mean: str, rho: str) -> str:
    return f"(((1.0::DOUBLE - {rho}) / {rho}) * {mean} + c.bad) / ((1.0::DOUBLE - {rho}) / {rho} + c.n)"


def _rule_sql(result: int) -> str:
    cases = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[result]}'"
        for v, h, p in url_filter.rule_order(URL_RULES)
    ]
    return "CASE " + " ".join(cases) + " END"


_SUFFIX_LIST = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
SQL["op1_url_filter"] = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
outcomes AS (SELECT doc_id, count(*) AS n, sum((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]?$', '') AS bare
  FROM parsed LEFT JOIN outcomes ON doc_id = page_id GROUP BY host),
split AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$|^\[') AS address FROM counted),
ends AS (
  SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({_SUFFIX_LIST}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS last
  FROM split),
hosts AS MATERIALIZED (
  SELECT host, n, bad, CASE WHEN address THEN '' ELSE last END AS suffix,
    CASE WHEN address THEN bare
      ELSE array_to_string(parts[greatest(len(parts) - len(string_split(last, '.')), 1):], '.') END AS domain
  FROM ends),
domains AS MATERIALIZED (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
tops AS MATERIALIZED (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
total AS MATERIALIZED (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM tops),
r0 AS ({_rho_sql("tops", "total", "true")}),
r1 AS ({_rho_sql("domains", "tops", "p.suffix = c.suffix")}),
r2 AS ({_rho_sql("hosts", "domains", "p.suffix = c.suffix AND p.domain = c.domain")}),
m0 AS (SELECT c.suffix, {_mean_sql(f"((total.bad + {url_filter.PRIOR_BAD}::DOUBLE) / (total.n + {url_filter.PRIOR}::DOUBLE))", "r0.rho")} AS mean FROM tops c, total, r0),
m1 AS (SELECT c.domain, c.suffix, {_mean_sql("m0.mean", "r1.rho")} AS mean FROM domains c JOIN m0 ON m0.suffix = c.suffix, r1),
m2 AS (
  SELECT c.host, c.n, c.bad, {_mean_sql("m1.mean", "r2.rho")} AS rate, (1.0::DOUBLE - r2.rho) / r2.rho + c.n AS size
  FROM hosts c JOIN m1 ON m1.domain = c.domain AND m1.suffix = c.suffix, r2),
bounds AS (SELECT host, n, bad, rate - {url_filter.Z}::DOUBLE * sqrt(rate * (1 - rate) / (size + 1)) AS bound FROM m2)
SELECT page_id, p.host, path, {_rule_sql(0).replace("host", "p.host")} AS rule,
  coalesce({_rule_sql(1).replace("host", "p.host")}, CASE WHEN bound >= {url_filter.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labels, bad::BIGINT AS n_bad, round(bound, 6) AS bound
FROM parsed p JOIN bounds b ON b.host = p.host
"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, _ = url_filter.url_parts(F.col("url"))
    return line_dedup.drop_boilerplate(
        table(spark, sf_dir, "pages"), "page_id", host, line_dedup.html_text(F.col("html"))
    )


def _html_sql(text: str) -> str:
    for pattern, replacement in line_dedup.HTML_STEPS:
        new = "chr(10)" if replacement == "\n" else "'" + replacement + "'"
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return text


SQL["op4_line_dedup"] = rf"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(list_transform(string_split(coalesce({_html_sql("html")}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM cut),
totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split) GROUP BY host, line),
common AS (
  SELECT host, list(line) AS boilerplate FROM counts JOIN totals USING (host)
  WHERE pages >= {line_dedup.MIN_PAGES} AND n >= {line_dedup.MIN_RATIO}::DOUBLE * pages GROUP BY host),
kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boilerplate, []), x)) AS kept
  FROM split LEFT JOIN common USING (host))
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(kept))::BIGINT AS n_dropped
FROM kept
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


# Share of the words by language; sources and kinds of text are flattened.
LANGUAGE_TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}
SOURCE_POWER, KIND_POWER = 0.8, 0.9


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.text_kind(F.col("text"))}
    cells = mixing.cell_words(docs, margins)
    sources, classes = mixing.tempered_targets(cells, "source", SOURCE_POWER)
    topics = mixing.tempered(mixing.observed_shares(cells, "topic"), KIND_POWER)
    targets = {"source": sources, "lang": LANGUAGE_TARGETS, "topic": topics}
    return mixing.mix(docs, margins, targets, cells=cells, classes={} if classes is None else {"source": classes})


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, _ = mixed(table(spark, sf_dir, "documents"))
    words = mixing.word_count(F.col("text")).alias("n_words")
    return sample.select("doc_id", "source", "lang", mixing.text_kind(F.col("text")).alias("topic"), words)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, sf_dir, "conversations")))


def _crc_table() -> str:
    """What the checksum of one byte is, by the rule of its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return "[" + ",".join(out) + "]::BIGINT[]"


def _crc_sql(text: str) -> str:
    """crc32 of a text of ASCII characters."""
    start = "4294967295::BIGINT"
    codes = f"list_prepend({start}, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    step = f"xor(a >> 8, list_extract({_crc_table()}, 1 + (xor(a, b) & 255)))"
    return f"xor(list_reduce({codes}, lambda a, b: {step}), {start})"


def _plus(label: str, cost: int | str, letter: str) -> str:
    """A label is the cost in nine digits and the audit, so that labels are ordered as texts; null is no way."""
    return f"(lpad((substr({label}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({label}, 10) || '{letter}')"


def _repair_sql() -> str:
    c = conversations
    # l0 to l3 are the labels of the states after the rows so far, k0 to k3 with insertions before the next one.
    inserted = f"""l0 AS k0, l1 AS k1,
      least(l2, {_plus("l0", c.INSERT, "I")}, {_plus("l1", c.INSERT, "I")}, {_plus("l3", c.INSERT, "I")}) AS k2,
      least(l3, {_plus("l2", c.INSERT, "I")}, {_plus("l0", 2 * c.INSERT, "II")}, {_plus("l1", 2 * c.INSERT, "II")}) AS k3"""
    keep = {q: _plus(q, "more", "K") for q in ("k0", "k1", "k2", "k3")}
    turn = {q: _plus(q, f"{c.REROLE} + more", "R") for q in ("k0", "k1", "k2", "k3")}
    drop = {q: _plus(q, c.DELETE, "D") for q in ("k0", "k1", "k2", "k3")}
    to_user = ", ".join(f"CASE WHEN NOT gone AND initial = 'u' THEN {keep[q]} END, CASE WHEN NOT gone THEN {turn[q]} END" for q in ("k0", "k1", "k3"))
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fold
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fold = 4 THEN 'user' ELSE role END AS role, i,
    CASE fold WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named JOIN (VALUES (1), (2)) copies(i) ON i = 1 OR fold = 3 WHERE fold <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, i) AS rn,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, i) > 1 AS again FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN regexp_extract(text, '([^{space}])[{space}]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
coded AS MATERIALIZED (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {c.TRUNCATED} ELSE 0 END AS more,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS pair FROM judged),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM coded GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS rn, '000000000' AS l0, NULL::VARCHAR AS l1, NULL::VARCHAR AS l2, NULL::VARCHAR AS l3 FROM facts
  UNION ALL
  SELECT w.conv_id, w.rn + 1, {drop["k0"]}, least({drop["k1"]}, CASE WHEN NOT gone AND initial = 's' THEN {keep["k0"]} END),
    least({drop["k2"]}, {to_user}),
    least({drop["k3"]}, CASE WHEN NOT gone AND initial = 'a' THEN {keep["k2"]} END, CASE WHEN NOT gone THEN {turn["k2"]} END)
  FROM (SELECT conv_id, rn, {inserted} FROM walk) w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rn = w.rn + 1),
best AS (
  SELECT conv_id, least(k0, k3) AS label FROM (
    SELECT w.conv_id, {inserted} FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.rn)),
letters AS (
  SELECT conv_id, i, substr(label, 9 + i::INT, 1) AS letter FROM (SELECT *, unnest(range(1, len(label) - 8)) AS i FROM best)),
edits AS (
  SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS rn,
    sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS place FROM letters),
repaired AS (
  SELECT e.conv_id, e.i, letter, place, c.role, CASE WHEN letter = 'I' THEN '' ELSE c.text END AS text,
    max(CASE WHEN letter = 'K' AND place = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.rn = e.rn WHERE letter <> 'D'),
written AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM repaired GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(label, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(label, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL["op11_conversations"] = _repair_sql()


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def _resampling_sql() -> str:
    r = resampling
    words = "list_filter(regexp_split_to_array(translate(text, '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    words = words.format(u="ABCDEFGHIJKLMNOPQRSTUVWXYZ", l="abcdefghijklmnopqrstuvwxyz")
    byte = "(instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1"
    start = "4294967295::BIGINT"
    codes = f"list_prepend({start}, list_transform(range(1, len(h)::BIGINT // 2 + 1), lambda i: ({byte})::BIGINT))"
    step = f"xor(a >> 8, list_extract({_crc_table()}, 1 + (xor(a, b) & 255)))"
    runs = " UNION ALL ".join(
        f"SELECT side, row, array_to_string(words[i:i + {k}], ' ') AS feature FROM (SELECT *, unnest(range(1, len(words)::BIGINT - {k} + 1)) AS i FROM texts)"
        for k in range(r.WIDTH)
    )
    unit = "(('0x' || substr(sha256('{s}:' || coalesce(id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE)".format(s=r.SEED)
    return f"""
WITH texts AS MATERIALIZED (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id AS id, CASE WHEN text IS NULL THEN [] ELSE {words} END AS words FROM documents
  UNION ALL SELECT 'b', 0, NULL, CASE WHEN text IS NULL THEN [] ELSE {words} END FROM benchmark),
runs AS MATERIALIZED (SELECT side, row, feature, count(*) AS n FROM ({runs}) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT feature, xor(list_reduce({codes}, lambda a, b: {step}), {start}) % {r.BUCKETS} AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs))),
found AS MATERIALIZED (SELECT side, row, bucket, n FROM runs JOIN hashed USING (feature)),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM found),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM found GROUP BY 1),
gains AS (
  SELECT bucket, floor({r.SCALE}::DOUBLE * ln((c.t + 1.0::DOUBLE) * (a.s + {r.BUCKETS}::DOUBLE) / ((c.s + 1.0::DOUBLE) * (a.t + {r.BUCKETS}::DOUBLE))))::BIGINT AS gain
  FROM counts c, totals a),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scores AS (
  SELECT id, row, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-{r.SCALE}::DOUBLE * ln(-ln({unit} / 4294967296::DOUBLE))))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, id NULLS LAST, row) AS place, count(*) OVER () AS n FROM scores WHERE n_words >= {r.MIN_WORDS})
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
  CASE WHEN place <= {r.SHARE[0]} * n // {r.SHARE[1]} THEN place END AS rank
FROM scores LEFT JOIN able USING (row)
"""


SQL["op13_resampling"] = _resampling_sql()
