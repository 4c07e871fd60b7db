import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from leafscribe.llm.hosts import host_of, host_reputation, judge_image_urls, path_of

RULES = [("allow", "se", "/"), ("block", "riks.se", "/en/"), ("block", "net", "/es/")]


def urls(spark, values, **more):
    rows = [Row(i, u) for i, u in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, image_url string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_parts(spark):
    cases = {
        "https://Sok.Riks.SE/bild/A1?x=/y#z": ("sok.riks.se", "/bild/A1"),
        "http://a?b://c/d": ("a", ""),
        "http://ÅA.se": ("Åa.se", ""),
        "x://y://z/p": ("y:", "//z/p"),
        "no scheme/path": ("", ""),
        "http://#frag": ("", ""),
        "": ("", ""),
    }
    df = urls(spark, [*cases, None]).select("doc_id", host_of(F.col("image_url")), path_of(F.col("image_url")))
    got = [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]
    assert got == [*cases.values(), ("", "")]


def test_rules_and_hard_rows(spark):
    values = ["http://riks.se/en/1", "http://a.riks.se/en/", "http://krriks.se/en/", "http://riks.se", "ftp://b.net/es/x", None, "", "x" * 200_000, "http://a.net/sv"]
    df = urls(spark, values, host="x", rule="y", verdict="z", bound="q", n=1)
    rows = judge_image_urls(df, RULES).orderBy("doc_id").collect()
    assert [r.rule for r in rows] == ["riks.se/en/", "riks.se/en/", "se/", None, "net/es/", None, None, None, None]
    assert [r.verdict for r in rows][:3] == ["block", "block", "allow"]
    assert len(rows) == len(values)
    assert judge_image_urls(df.limit(0), RULES).collect() == []
    assert {r.verdict for r in judge_image_urls(df, []).collect()} == {"allow"}


def test_reputation_shrinks_and_decides(spark):
    bad = [f"http://bad.net/es/{i}" for i in range(40)] + ["http://bad.net/sv/1"]
    good = [f"http://good.se/{i}" for i in range(40)] + ["http://good.se"]
    fresh = ["http://new.org/1"]
    rows = judge_image_urls(urls(spark, bad + good + fresh), RULES).orderBy("doc_id").collect()
    assert rows[40].rule is None and rows[40].verdict == "block"
    assert rows[81].rule is None and rows[81].verdict == "allow"
    assert rows[82].verdict == "allow"


def test_posterior_by_hand(spark):
    # One host: the strengths fall back to 2, so each level is (k + 2 m) / (n + 2).
    df = spark.createDataFrame([("a.b.se", 1)] * 6 + [("a.b.se", 0)] * 2 + [("a.b.se", None)], "host string, blocked int")
    row = host_reputation(df).first()
    m = 7 / 10
    for _ in range(2):
        m = (6 + 2 * m) / 10
    assert (row.pages, row.blocked_pages) == (8, 6)
    assert row["mean"] == pytest.approx((6 + 2 * m) / 10)
    a, b = 6 + 2 * m, 2 + 2 * (1 - m)
    assert row["bound"] == pytest.approx(a / 10 - 1.645 * (a * b / (100 * 11)) ** 0.5)


def test_nothing_leaves_the_jvm(spark):
    df = judge_image_urls(urls(spark, ["http://a.se/1"]), RULES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
