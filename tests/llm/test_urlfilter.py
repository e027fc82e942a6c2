import hashlib
import re

import numpy as np
import pytest

from sparkvane.llm import urlfilter


@pytest.fixture(scope="module")
def model(spark):
    return urlfilter.train(urlfilter.labelled_urls(spark))


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else None


URLS = [
    "http://a.example.com/en/7", "http://A.EXAMPLE.com/en/8?x=://y", "https://example.com/en/71#t", "http://xexample.com/en/7", "http://b.example.net/de/8", "http://b.example.net/de/9",
    "http://q.org/es/", "http://q.org/es", "http://org/es/1", None, "", "no scheme", "://", "://h", "ftp://H?q/x", "http://casino-win.info/x\ny", "http://h#a://b/c", "x" * 5000 + "://h/en/",
]


def test_parts_and_rules(spark, model):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(d, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        assert got[i]["verdict"] == (rule[1] if rule else "block" if got[i]["p_block"] >= 0.5 else "allow")


def grams(url):
    host, path, _ = brute(url)
    framed = [("h", f"^{host}$"), ("p", f"^{path}$")]
    every = [k + f[i : i + n] for k, f in framed for n in urlfilter.SIZES for i in range(len(f) - n + 1)]
    return sorted(int(hashlib.md5(g.encode()).hexdigest()[:7], 16) % urlfilter.BUCKETS for g in every)


def test_features_and_weights_equal_numpy(spark, model):
    d = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    got = {r["i"]: sorted(r["g"]) for r in d.select("i", urlfilter.grams(*urlfilter.host_and_path(d["url"])).alias("g")).collect()}
    assert got == {i: grams(u) for i, u in enumerate(URLS)}
    x, y = np.zeros((len(urlfilter.LABELLED), urlfilter.BUCKETS)), np.array([v for _, v in urlfilter.LABELLED])
    for i, (u, _) in enumerate(urlfilter.LABELLED):
        np.add.at(x[i], grams(u), 1 / np.sqrt(len(grams(u))))
    w, b = np.zeros(urlfilter.BUCKETS), 0.0
    for _ in range(urlfilter.STEPS):
        miss = (y - 1 / (1 + np.exp(-(x @ w + b)))) / len(y)
        keep = 1 - urlfilter.RATE * urlfilter.RIDGE
        w, b = w * keep + urlfilter.RATE * x.T @ miss, b * keep + urlfilter.RATE * miss.sum()
    fitted = model.first()
    assert np.allclose(fitted["weights"], w, atol=1e-6) and abs(fitted["intercept"] - b) < 1e-6


def test_held_out_names(spark, model):
    bad = [f"http://{s}{n}.info/{p}" for n in ("casino-club", "cheap-pills24", "online-bets") for s, p in (("", "en/1"), ("www.", "de/77"))]
    good = [f"http://{s}{n}.info/{p}" for n in ("riverside", "winterthur", "thornbury", "schoolhouse") for s, p in (("", "en/1"), ("www.", "de/77"))]
    d = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    p = [r["p_block"] for r in urlfilter.judge(d, model).orderBy("page_id").collect()]
    pairs = [(a, b) for a in p[: len(bad)] for b in p[len(bad) :]]
    assert sum(a > b for a, b in pairs) / len(pairs) >= 0.9


def test_held_out_urls(spark):
    """Fitted on the words alone, the model knows the same words with additions that it has not met."""
    half = len(urlfilter.LABELLED) // 2
    fitted = urlfilter.train(spark.createDataFrame(urlfilter.LABELLED[:half], "url string, label int"))
    held = urlfilter.LABELLED[half:]
    d = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    p = {r["page_id"]: r["p_block"] for r in urlfilter.judge(d, fitted, rules=()).collect()}
    right = [(p[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(held)]
    assert sum(right) / len(right) >= 0.9


def test_odd_rows(spark, model):
    """Null ids, repeated rows and extra columns: each row is judged once, by its url alone."""
    rows = [(None, "http://h/x", "a"), (1, None, "b"), (1, None, "b"), (2, "http://h/x", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "1 AS rule", "'v' AS verdict")
    got = urlfilter.judge(d, model).collect()
    assert sorted((r["page_id"] or 0, r["host"]) for r in got) == [(0, "h"), (1, ""), (1, ""), (2, "h")]
    assert len({r["verdict"] for r in got if r["host"] == "h"}) == 1 and all(r["rule"] is None for r in got)


def test_plan_has_no_python(spark, model):
    d = spark.createDataFrame([(1, "http://h/x")], "page_id long, url string")
    plan = urlfilter.judge(d, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark, model):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0
