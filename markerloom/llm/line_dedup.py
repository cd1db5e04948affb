"""Line deduplication by site-relative frequency: lines that a large share of a host's pages contain are boilerplate
of that host and are dropped from its pages.

Every page counts a line once. The counts are combined before the shuffle, so a hot host or a line on very many pages is one row per
task. A host has at most (lines per page / MIN_RATIO) boilerplate lines, whatever its number of pages, so the lists that
the pages meet in the end are short.

Defined results: null or empty texts have no lines and stay empty. Blank lines are dropped and count nowhere. A null host is a host of
its own. Hosts with fewer than MIN_PAGES pages keep all lines. Repeated rows are pages of their own. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import stored

MIN_RATIO, MIN_PAGES = 0.3, 4

# Applied in this order. Fixed values of HTML: elements without text, elements that break lines, entities.
HTML_STEPS = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|template|noscript)\b.*?</(script|style|template|noscript)\s*>", ""),
    (r"[\r\n\t]+", " "),
    (
        r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav"
        r"|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>",
        "\n",
    ),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
)


def html_text(html: Column) -> Column:
    """The text of a page, one line for each block."""
    for pattern, replacement in HTML_STEPS:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def text_lines(text: Column) -> Column:
    """The lines that are not blank, without blanks around them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def boilerplate_lines(pages: DataFrame, min_ratio: float = MIN_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, boilerplate): the lines that `min_ratio` of the host's pages or more contain; `pages` has host and lines."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    each = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n"))
    common = counts.join(totals, counts.host.eqNullSafe(totals.host)).where(F.col("n") >= F.lit(min_ratio) * F.col("pages"))
    return common.groupBy(counts.host).agg(F.collect_list("line").alias("boilerplate"))


def drop_boilerplate(
    pages: DataFrame, key: str, host: Column, text: Column, min_ratio: float = MIN_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Per page: key, host, the text without its host's boilerplate, n_lines (not blank), n_dropped."""
    split = pages.select(F.col(key).alias("key"), host.alias("host"), text_lines(text).alias("lines"))
    common = stored(boilerplate_lines(split.select("host", "lines"), min_ratio, min_pages), "boilerplate")
    common = common.withColumnRenamed("host", "its_host")
    joined = split.join(common, F.col("host").eqNullSafe(F.col("its_host")), "left")
    dropped = F.coalesce("boilerplate", F.array().cast("array<string>"))
    kept = joined.select(
        "key", "host", F.size("lines").alias("n"), F.expr("lines").alias("lines"), dropped.alias("boilerplate")
    ).withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)))
    return kept.select(
        F.col("key").alias(key),
        "host",
        F.array_join("kept", "\n").alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
    )
