"""The URL filter where its threshold lies below zero."""

from echolith.llm import urlfilter


def test_urls_without_a_text_are_allowed_whatever_the_threshold(spark, monkeypatch):
    train = urlfilter.train

    def low(*args):
        model = train(*args)
        model.threshold = -9.0
        return model

    monkeypatch.setattr(urlfilter, "train", low)
    urls = [None, "", "no scheme", "http:/x", "https://a.org/fr/1", "https://b.com/en/1", "https://b.net/de/1", "https://c.net/de/2"]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    assert [got[i]["verdict"] for i in range(8)] == ["allow"] * 4 + ["block"] * 2 + ["allow"] * 2
    assert all(got[i]["rule"] is None and got[i]["host"] == got[i]["path"] == "" for i in range(4)) and got[4]["rule"] is None


def test_models_learn_from_all_urls(spark, monkeypatch):
    """Scores are those of UrlModel's Markov models on all labelled URLs, and the threshold is exact, however few scores the driver sorts."""
    monkeypatch.setattr(urlfilter, "AT_ONCE", 7)
    urls = [f"http://a{i % 7}.{h}{i}" for i in range(150) for h in ("com/en/", "net/de/", "fr/x/")]
    pages = spark.createDataFrame(list(enumerate(urls + urls[:30])), "page_id long, url string")
    ruled = urlfilter.with_rules(pages)
    model, rows = urlfilter.train(ruled), ruled.selectExpr("url", "rule_verdict", f"pmod(xxhash64(url), {urlfilter.CALIBRATE}) = 0 apart").distinct().collect()
    of = lambda v, apart: [r["url"] for r in rows if r["rule_verdict"] == v and r["apart"] == apart]
    good, bad = (urlfilter.Markov(of(v, False)) for v in ("allow", "block"))
    plain = {u: (bad.score(u) - good.score(u)) / (len(u) + 1) for u in urls}
    got = {r["url"]: r["score"] for r in model.scores.collect()}
    assert got.keys() == plain.keys() and all(abs(got[u] - plain[u]) < 1e-8 for u in urls)
    most, least = sorted(got[u] for u in of("allow", True)), sorted(got[u] for u in of("block", True))
    assert model.threshold == max(most[-1], (most[-1] + least[0]) / 2)
    assert urlfilter.judge(pages).count() == len(urls) + 30
