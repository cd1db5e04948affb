from pyspark.sql import functions as F

from markerloom.llm.line_dedup import drop_boilerplate, html_text


def dropped(df, **kw):
    return drop_boilerplate(df, "id", F.col("host"), F.col("text"), **kw)


def slow(rows, ratio=0.3, least=4):
    lines = [[x.strip(" ") for x in (t or "").split("\n")] for _, _, t in rows]
    lines = [[x for x in ls if x] for ls in lines]
    pages, counts = {}, {}
    for (_, h, _), ls in zip(rows, lines):
        pages[h] = pages.get(h, 0) + 1
        for x in set(ls):
            counts[h, x] = counts.get((h, x), 0) + 1
    common = {k for k, n in counts.items() if pages[k[0]] >= least and n >= ratio * pages[k[0]]}
    return sorted(
        str((i, h, "\n".join(x for x in ls if (h, x) not in common), len(ls), sum((h, x) in common for x in ls)))
        for (i, h, _), ls in zip(rows, lines)
    )


def test_against_brute_force(spark):
    rows = [(i, f"h{i % 3}", f"menu\nbody {i}\nmenu\n seldom {i % 7} \n\nfooter h{i % 3}") for i in range(50)]
    rows += [(100, "alone", "menu\nmenu"), (101, None, "x\ny"), (102, None, "x"), (103, None, None), (104, None, "")]
    rows += [(100, "alone", "menu\nmenu"), (None, "h1", "menu"), (105, "h1", None)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    found = sorted(str(tuple(r)) for r in dropped(df).collect())
    assert found == slow(rows)


def test_hot_host_and_empty(spark):
    df = spark.range(5000).select("id", F.lit("hot").alias("host"), F.concat(F.lit("same line\nown "), "id").alias("text"))
    out = dropped(df)
    assert out.where("n_dropped <> 1").count() == 0 and out.first().text.startswith("own ")
    assert dropped(df.limit(0)).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame(
        [(1, "h", "a\nb", 1, 2, 3, 4, 5)], "id long, host string, text string, lines int, boilerplate int, n int, kept int, pages int"
    )
    assert dropped(df).columns == ["id", "host", "text", "n_lines", "n_dropped"]
    assert dropped(df).first().text == "a\nb"


def test_html_text(spark):
    html = "<p>A &amp; b</p><!-- <p>no</p> --><SCRIPT>var x='<p>';</SCRIPT><div class=x>c<br/>d <b>e</b>\nf</div>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(html_text(F.col("h")).alias("t"))
    found = [r.t for r in df.collect()]
    assert [x.strip() for x in found[0].split("\n") if x.strip()] == ["A & b", "c", "d e f"] and found[1:] == [None, ""]
