import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import queries, url_filters

SPACE = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = [(0 if not h else h.count(".") + 1, len(p), v, h + p) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def answers(df, rules, **named):
    return sorted((r.i, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, rules, **named).collect())


@pytest.mark.parametrize("joined", [False, True])
def test_against_a_plain_search(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(url_filters, "RULES_ROWS", 3)
    draw = random.Random(5)
    labels, segments = ["a", "b", "co", "org", ""], ["", "x", "xy", "y", "xyz", "é"]
    name = lambda n: ".".join(draw.choice(labels) for _ in range(draw.randint(0, n)))
    rules = {(name(3), draw.choice(["", "/"]) + "/".join(draw.choice(segments) for _ in range(draw.randint(0, 3))), draw.choice(["allow", "block"])) for _ in range(60)}
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{draw.choice(['', 'W.', 'www.'])}{name(4)}{draw.choice(['', '/', '?q=://z/x', '#t'])}" + "/".join(draw.choice(segments) for _ in range(4)) + draw.choice(["", "?x/y", "#/x"]) for _ in range(400)]
    urls += [None, "", "no scheme/x", "a://b://c/x", "://", "s://ÀB.org/X", urls[0], "http://" + "a." * 60 + "org/" + "x/" * 300, "s://org/a\nb/x", "s://x\ny.org/z"]
    df = spark.createDataFrame(list(enumerate(urls)), "i long, url string").withColumn("path", F.lit(1)).withColumn("verdict", F.lit(None))
    assert answers(df, spark.createDataFrame(list(rules), SPACE), default="block") == sorted((i, *plain(u, rules, "block")) for i, u in enumerate(urls))


@pytest.mark.parametrize("joined", [False, True])
def test_defined_cases(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(url_filters, "RULES_ROWS", -1)
    df = spark.createDataFrame([(1, "http://x.ORG/a"), (1, "http://x.ORG/a"), (2, None)], "i long, url string")
    both = spark.createDataFrame([("org", "/", "allow"), ("ORG", "/", "block"), (None, None, "allow")], SPACE)
    assert answers(df, both) == [(1, "x.org", "/a", "org/", "block")] * 2 + [(2, "", "", "", "allow")]
    assert answers(df, both.limit(0)) == [(1, "x.org", "/a", None, "allow")] * 2 + [(2, "", "", None, "allow")]
    assert answers(df.limit(0), both) == []
    with pytest.raises(Exception, match="allows or blocks"):
        answers(df, spark.createDataFrame([("org", "/", "deny")], SPACE))


def test_the_query_covers_all_pages(spark, sf_dir):
    got = queries.op11_url_filters(spark, sf_dir)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert got.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and got.select("rule").distinct().count() > 3
