"""URL filter: domain rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (interpolated Witten-Bell, up to ORDER characters of context) learn accepted and rejected URLs. A URL's score is the difference of their log-likelihoods, rejected less accepted, over its length; it is blocked if the score exceeds a threshold calibrated on labelled URLs of both classes left out of training: where the scores of the two are apart, half-way between them, else where no more than FALSE_BLOCKS of the accepted ones are blocked.

Both models and the threshold come from all distinct labelled URLs, of which those whose hash is divisible by CALIBRATE calibrate (a class without such, or without others, uses all of its own for both). The n-grams' counts are a table; the models are tables of the distinct windows' probabilities, made order by order by joins; a URL's score is the sum over its windows, in whole units of 2**-UNIT, so that no order of adding changes it. The threshold is an exact order statistic, found by counting. UrlModel is the same for lists at hand.

Defined results: a null url, or one without `://`, has empty host and path, no rule and an empty text for the models, and is allowed. With no training URLs of one class, all without a rule are allowed. Rows that repeat are judged alike. An empty table gives an empty result. Columns other than page_id and url play no part.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.llm.shared import shared_table, values

#: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
ORDER, CALIBRATE = 5, 5
#: Bits of a score's unit; n-grams that a task counts before it hands the counts on; scores sorted by the driver at once.
UNIT, HELD, AT_ONCE = 32, 300_000, 10_000
#: Share of accepted calibration URLs that may be blocked.
FALSE_BLOCKS = 0.01
#: A symbol that starts and ends each URL, and the size of the alphabet that the lowest order spreads over.
EDGE, ALPHABET = "\x02", 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls (with a column url) with host, path, rule (the longest that fits, or null) and rule_verdict."""
    host, path = host_and_path(F.col("url"))
    df = urls.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones win
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


class Markov:
    """A smoothed variable-order Markov model of strings: contexts of 0 to order characters, interpolated by Witten-Bell weights down to a uniform alphabet."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            t = EDGE * order + t + EDGE
            for i in range(order, len(t)):
                for n in range(order + 1):
                    self.after[t[i - n : i]][t[i]] += 1
        self.totals = {c: n.total() for c, n in self.after.items()}
        self.seen: dict[str, float] = {}

    def log_prob(self, window: str) -> float:
        """Log probability of the last character of window after the others."""
        if window not in self.seen:
            p, c = 1 / ALPHABET, window[-1]
            for n in range(len(window)):
                context = window[len(window) - 1 - n : -1]
                if context not in self.after:
                    break
                total, kinds = self.totals[context], len(self.after[context])
                p = (self.after[context].get(c, 0) + kinds * p) / (total + kinds)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[window] = log(p)
        return self.seen[window]

    def score(self, text: str) -> float:
        t = EDGE * self.order + text + EDGE
        return sum(self.log_prob(t[i - self.order : i + 1]) for i in range(self.order, len(t)))


class UrlModel:
    """The two models and the calibrated threshold, with the shares of calibration URLs that it blocks (false_blocks of the accepted, recall of the rejected)."""

    def __init__(self, accepted: list[str], rejected: list[str], most: float = FALSE_BLOCKS):
        keep = [[u for i, u in enumerate(us) if i % CALIBRATE] or us for us in (accepted, rejected)]
        self.models = [Markov(us) for us in keep] if accepted and rejected else None
        good, bad = (sorted(self.ratio(u) for u in us[::CALIBRATE]) if self.models else [0.0] for us in (accepted, rejected))
        least = good[len(good) - 1 - int(len(good) * most)]  # all but so many accepted ones lie there or under
        self.threshold = max(least, (least + bad[int(len(bad) * most)]) / 2)
        self.false_blocks, self.recall = (sum(x > self.threshold for x in xs) / len(xs) for xs in (good, bad))

    def ratio(self, text: str) -> float:
        """Log-likelihood under the rejected model less that under the accepted one, per character."""
        if not self.models or not text:
            return 0.0
        return (self.models[1].score(text) - self.models[0].score(text)) / (len(text) + 1)


@dataclass
class Fitted:
    """The score of each distinct url that has a text (url, score), and the threshold."""

    scores: DataFrame
    threshold: float


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, good, bad): how often each context and character stand in accepted and rejected URLs (url, bad)."""

    def made(n: dict[bool, Counter]) -> pa.RecordBatch:
        grams = list(n[False].keys() | n[True].keys())
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([n[bad][g] for g in grams], pa.int64()) for bad in (False, True))], ["gram", "good", "bad"])

    seen = {False: Counter(), True: Counter()}
    for b in batches:
        for url, bad in zip(values(b.column("url")), values(b.column("bad"))):
            t = EDGE * ORDER + url + EDGE
            for n in range(ORDER + 1):
                seen[bad].update(t[i - n : i + 1] for i in range(ORDER, len(t)))
            if len(seen[False]) + len(seen[True]) > HELD:
                yield made(seen)
                seen = {False: Counter(), True: Counter()}
    yield made(seen)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, window, n) of each URL (id, url): its stretches of ORDER + 1 characters."""
    for b in batches:
        for k, url in zip(values(b.column("id")), values(b.column("url"))):
            t = EDGE * ORDER + url + EDGE
            n = Counter(t[i - ORDER : i + 1] for i in range(ORDER, len(t)))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int64()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["id", "window", "n"])


def _ratios(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """(window, ratio): log probability of each window's last character after the others, rejected less accepted, in units of 2**-UNIT."""
    window, p = windows.select("window").distinct(), None
    size = F.char_length("gram")
    totals = [x for c in ("good", "bad") for x in (F.sum(c).alias(f"{c}_total"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))]
    for n in range(ORDER + 1):
        own = grams.where(size == n + 1)
        contexts = own.groupBy(F.substring("gram", 1, n).alias("context")).agg(*totals)
        some = window.select(F.substring("window", ORDER + 1 - n, n + 1).alias("gram")).distinct().withColumns({"context": F.substring("gram", 1, n), "shorter": F.substring("gram", 2, n)})
        some = some.withColumns({"p_good": F.lit(1 / ALPHABET), "p_bad": F.lit(1 / ALPHABET)}) if p is None else some.join(p, "shorter")
        some = some.join(own, "gram", "left").join(contexts, "context", "left")
        wider = {f"p_{c}": F.when(F.col(f"{c}_total") > 0, (F.coalesce(c, F.lit(0)) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}")) for c in ("good", "bad")}
        p = some.withColumns(wider).select(F.col("gram").alias("shorter"), "p_good", "p_bad")
    ratio = F.log("p_bad") - F.log("p_good")
    return p.select(F.col("shorter").alias("window"), F.round(ratio * 2.0**UNIT).cast("long").alias("ratio"))


def nth(scores: DataFrame, n: int, count: int) -> float:
    """The n-th least (from 0) of so many scores (column score), whatever their number: only AT_ONCE of them come to the driver."""
    while count > AT_ONCE:
        low, high = scores.agg(F.min("score"), F.max("score")).first()
        if low == high:
            return low
        part = F.least(F.floor((F.col("score") - low) / (high - low) * 1000), F.lit(999))
        for k, size in sorted(map(tuple, scores.groupBy(part.alias("k")).count().collect())):
            if n < size:
                break
            n -= size
        scores, count = scores.where(part == k), size
    return sorted(r[0] for r in scores.select("score").collect())[n]


def train(ruled: DataFrame) -> Fitted:
    """The scores of all urls with a text and the threshold, from all distinct urls of rows (url, rule_verdict) that have a verdict."""
    text = F.when(F.col("url").contains("://"), F.col("url"))
    urls = ruled.where(text.isNotNull()).groupBy("url").agg(F.first("rule_verdict").alias("verdict"))  # a url has one verdict
    urls = urls.select("url", (F.col("verdict") == "block").alias("bad"), (F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0).alias("apart"))
    urls = shared_table(urls.withColumn("id", F.monotonically_increasing_id()), "urls")
    sizes = {(r["bad"], r["apart"]): r["count"] for r in urls.where("bad is not null").groupBy("bad", "apart").count().collect()}
    both = [bad for bad in (False, True) if len([k for k in sizes if k[0] == bad]) < 2]  # classes that use all for both
    if {bad for bad, _ in sizes} != {False, True}:
        return Fitted(urls.select("url", F.lit(0.0).alias("score")), 0.0)
    learnt = urls.where("bad is not null").where(~F.col("apart") | F.col("bad").isin(both)).select("url", "bad")
    grams = shared_table(learnt.mapInArrow(_grams, "gram string, good long, bad long").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")
    windows = shared_table(urls.select("id", "url").mapInArrow(_windows, "id long, window string, n long"), "url-windows")
    ratios = shared_table(_ratios(windows, grams), "url-ratios")
    sums = windows.join(ratios, "window").groupBy("id").agg(F.sum(F.col("n") * F.col("ratio")).alias("sum"))
    score = F.col("sum") / 2.0**UNIT / (F.char_length("url") + 1)
    scored = shared_table(urls.join(sums, "id").select("url", "bad", "apart", score.alias("score")), "url-scores")
    found = []
    for bad in (False, True):
        own = scored.where((F.col("bad") == bad) & (F.lit(bad in both) | F.col("apart")))
        n = sum(v for k, v in sizes.items() if k[0] == bad and (bad in both or k[1]))
        at = int(n * FALSE_BLOCKS)
        found.append(nth(own, at if bad else n - 1 - at, n))  # all but so many accepted ones lie there or under
    return Fitted(scored.select("url", "score"), max(found[0], sum(found) / 2))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (positive: like rejected URLs)."""
    ruled = with_rules(pages.select("page_id", F.col("url").cast("string")), rules)
    model = train(ruled)
    scored = ruled.join(model.scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    has_text = F.coalesce(F.col("url").contains("://"), F.lit(False))  # without one nothing speaks against the url, wherever the threshold lies
    by_model = F.when(has_text & (F.col("score") > model.threshold), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")
