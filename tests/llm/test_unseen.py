"""Models on names and pages they were not made from."""

import time

from pyspark.sql import functions as F

from cellvote.llm import html_text, url_filter

SF = "/root/testdata/sf0.1"
NAMES = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")


def test_the_labelled_urls_hold_no_name_of_the_test_pages(spark):
    table = dict(url_filter.labelled_urls())
    assert not [url for url in table if any(name in url for name in NAMES)]
    hosts = {url.split("/")[2] for url in table}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(url_filter.host_of(F.col("url")).alias("host"))
    assert not hosts & {row.host for row in pages.distinct().collect()}


def test_unseen_hosts_without_rules(spark):
    model = url_filter.train(url_filter.labelled(spark))
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    got = url_filter.judge(pages, model, rules=[]).withColumn("spam", F.col("host").rlike("|".join(NAMES)))
    count = {(row.spam, row.verdict): row["count"] for row in got.groupBy("spam", "verdict").count().collect()}
    blocked, missed = count.get((True, "block"), 0), count.get((True, "allow"), 0)
    wrong, clean = count.get((False, "block"), 0), count.get((False, "allow"), 0)
    assert blocked >= 0.95 * (blocked + missed) and wrong <= 0.01 * (wrong + clean)


def test_pages_of_unclosed_tags_take_linear_time():
    def seconds(n):
        pages = ["<b>" * n + "</i>" * n, "<p><button>" + "<b>" * n + "<div>x</div>" * n, "<b>" * n + "x<hr>" * n, "<svg/>" * n]
        began = time.process_time()
        for page in pages:
            html_text.parse(page)
        return time.process_time() - began

    seconds(2_000)
    assert seconds(64_000) < 64 * max(seconds(4_000), 0.02)  # four times the linear share; a quadratic parser takes 256


def test_elements_end_with_their_own_scope():
    tree = html_text.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<div>f</div></i></b>g")
    texts = [(tree.text[i], tree.features[tree.parent[i]][0]) for i in range(len(tree.parent)) if tree.text[i]]
    assert texts == [("a", "tag:li"), ("b", "tag:li"), ("c", "tag:li"), ("d", "tag:li"), ("e", "tag:p"), ("f", "tag:div"), ("g", "tag:root")]
