"""Operators on training data against brute force, round trips and held-out rows."""

import hashlib
import re
import zlib

import base64
import gzip
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from echolith.llm import decontaminate, exact_dedup, htmltext, langid, lm, pii, secrets, sentencepiece_bpe, simhash, urlfilter

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (5, "ab"), (None, "a b"), (6, "Ünï ▁ word \U0001f600"), (7, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit(1).alias("key"), F.lit(2).alias("fp"), F.lit("x").alias("word"), F.lit(3).alias("row"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("op", [exact_dedup.exact_copies, secrets.find_secrets, langid.identify, simhash.near_duplicates, pii.find_personal_data, lm.score, sentencepiece_bpe.encode])
def test_odd_and_empty_tables(spark, odd, op):
    assert op(odd).count() == len(ODD)
    assert op(odd.where("false")).count() == 0


def test_filters_keep_columns(spark, odd):
    bench = spark.createDataFrame([(1, "x y z"), (2, None), (3, "")], "item_id long, text string")
    for f in (langid.drop_unrecognised, exact_dedup.drop_exact_copies, simhash.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, bench)):
        assert f(odd).columns == odd.columns and f(odd.where("false")).count() == 0


def test_exact_dedup_by_brute_force(spark, odd):
    got = exact_dedup.exact_copies(odd.where("doc_id is not null")).collect()
    rows = [(d, t or "") for d, t in ODD if d is not None]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    for r in got:
        own = next(t for d, t in rows if d == r["doc_id"])
        group = [(d, t) for d, t in rows if norm(t) == norm(own)]
        keep = min(group, key=lambda x: (-len(x[1]), x[0]))[0]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), keep == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(norm(own).encode()).hexdigest()
    assert exact_dedup.drop_exact_copies(odd.where("doc_id is not null")).count() == 4


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_by_brute_force(docs, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_long_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.int64)
    prints = {int(b) ^ (1 << int(rng.integers(63))) for b in base for _ in range(40)}
    rows = spark.createDataFrame([(x,) for x in prints], "fp long")
    edges = simhash.links(rows).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e["a"])] = find(e["b"])
    for a in prints:
        for b in prints:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                assert find(a) == find(b)


def test_langid_on_held_out_documents(docs, texts):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.9 * len(held)


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    words = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b" "] for d, t in texts.items()}
    from collections import Counter

    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for d in train for w in words[d])
    n, v = sum(c.values()), len(c)
    for d, own in words.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(w in c for w in own), n, d not in set(train))
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_gradients_and_total_probability():
    rng = np.random.default_rng(0)
    lex = lm.Lexicon([(b"w%d" % i, 50 - i) for i in range(20)] + [(lm.END, 9)], 900, 21, 12)
    p = {k: v.astype(np.float64) for k, v in lm.fresh_parameters(lex).items()}
    docs = [rng.integers(0, lex.size, k).astype(np.int32) for k in (9, 4, 6)]
    net = lm.Network(lex, p)
    one = np.exp([net.score([np.array([i], np.int32)])[0] for i in range(lex.size)])
    assert one.sum() == pytest.approx(1, abs=1e-5)
    held: dict = {}
    net._update = lambda g, count, rate: held.update({k: held.get(k, 0) + x for k, x in g.items()})
    net.train(docs, 0.1)
    for k in p:
        for flat in np.argsort(-np.abs(held[k]).ravel())[:12].tolist():
            at = np.unravel_index(flat, held[k].shape)
            loss = []
            for sign in (1, -1):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += sign * 1e-4
                loss.append(-lm.Network(lex, q).score(docs).sum())
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(held[k][at], rel=1e-4, abs=1e-6)


def plain_score(lex, p, ids):
    """One token after the other, every probability written out."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, h, before, out = lm.STATE, np.zeros(lm.STATE), lex.size, 0.0
    for i in ids:
        a, u = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
        h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
        k = int(lex.cls[i])
        lo, hi = lex.bounds[k], lex.bounds[k + 1]
        for w, at in ((p["wc"], k), (p["ww"][lo:hi], i - lo)):
            e = np.exp(w[:, :-1] @ h + w[:, -1])
            out += np.log(e[at] / e.sum())
        before = i
    return out


def test_score_by_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    lex = lm.Lexicon([(b"w%d" % i, 500 - i) for i in range(300)] + [(lm.END, 9)], 90_000, 301)
    p = {k: (rng.standard_normal(v.shape) * 0.7) for k, v in lm.fresh_parameters(lex).items()}
    docs = [rng.integers(0, lex.size, k).astype(np.uint16) for k in (1, 2500, 40, 3, 130, 40)]
    want = [plain_score(lex, p, d.tolist()) for d in docs]
    assert lm.Network(lex, p).score(docs) == pytest.approx(want, rel=1e-9)
    small = lm.Network(lex, {k: v.astype(np.float32) for k, v in p.items()})
    assert small.score(docs) == pytest.approx(want, rel=1e-4)


def test_language_model_does_not_depend_on_split_or_batch(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)  # several shards here too
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = []
    for parts, rows in ((1, "2000"), (4, "64"), (7, "64")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        found.append({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(parts)).collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for other in found[1:]:
        assert all(other[d] == pytest.approx(x, rel=1e-5) for d, x in found[0].items())


def test_score_does_not_depend_on_windows_or_neighbours():
    rng = np.random.default_rng(0)
    lex = lm.Lexicon([(b"w%d" % i, 50 - i) for i in range(20)] + [(lm.END, 9)], 900, 21)
    net = lm.Network(lex, lm.fresh_parameters(lex))
    docs = [rng.integers(0, lex.size, k).astype(np.int32) for k in (200, 3, 77, 1)]
    assert np.allclose(net.score(docs), [net.score([d])[0] for d in docs], rtol=1e-4)


def test_a_task_trains_each_of_its_shards_by_itself():
    """However many shards Spark deals to a task, each gives the parameters that it reaches alone."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lex = lm.Lexicon([(b"w%d" % i, 50 - i) for i in range(20)] + [(lm.END, 9)], 900, 21)
    start = lm._flat(lm.fresh_parameters(lex))
    rows = [(shard, h, rng.integers(0, lex.size, 40).astype(np.uint16).tobytes()) for shard in (0, 1, 5) for h in range(6)]

    def trained(some):
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary())], ["shard", "h", "ids"])
        return [(r["slice"], r["tokens"], r["sums"]) for b in lm._train(lex, start, 1, 0.01)(iter([batch])) for r in b.to_pylist()]

    assert trained(rows) == [r for shard in (0, 1, 5) for r in trained([x for x in rows if x[0] == shard])]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_pii(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


TRICKY = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 1.2.3.256 300.1.1.1", "4111 1111-1111 1111 and 12 34", "+1 (555) 010-9999 +12", "a.b@c-d.e.f, g@h", "..@x.y %@q.w-", "x" * 9 + "@" + "a." * 5, "0001.02.3.4 4111111111111111"]


def test_pii_base_by_brute_force(spark, docs, texts):
    for t in TRICKY:
        assert pii.find(t) == plain_pii(t), t
    for r in pii.find_personal_data(docs).collect():
        want = plain_pii(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_pii_finds_and_removes_a_revealing_term(spark):
    rows = [(i, f"filler{i} text about thing{i % 7}") for i in range(60)] + [(100 + i, "write to Zorbaq at zorbaq@example.org for more") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "zorbaq" not in clean[100].lower() and "[EMAIL]" in clean[100] and clean[3] == rows[3][1]


def plain_terms(rows):
    """Places of disclosing terms of each (doc_id, text) by counting everything, with whether they are removed."""
    from collections import Counter
    from math import log2

    word, n_e, n_t, near, both = re.compile(r"[^\W_]+"), Counter(), Counter(), Counter(), Counter()
    found = []
    for _, t in rows:
        spans = plain_pii(t)
        words = [m for m in word.finditer(t)]
        free = [m for m in words if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        own = {pii.entity(k, t[a:b]) for k, a, b in spans}
        held = {m[0].lower() for m in free}
        every = {m[0].lower() for m in words}
        by = set()
        for k, a, b in spans:
            for m in [m for m in words if m.end() <= a][-10:] + [m for m in words if m.start() >= b][:10]:
                if m in free:
                    by.add((pii.entity(k, t[a:b]), m[0].lower()))
        n_e.update(own)
        n_t.update(every)
        near.update(by)
        both.update((e, w) for e in own for w in held)
        found.append(free)
    share = Counter()
    for (e, w), n in near.items():
        if n >= 2 and n_e[e] < len(rows):
            share[w] = max(share[w], log2(both[e, w] * len(rows) / (n_e[e] * n_t[w])) / log2(len(rows) / n_e[e]))
    return [[(m.start(), m.end(), share[m[0].lower()] >= 0.95) for m in free if share[m[0].lower()] >= 0.7] for free in found]


def test_pii_terms_by_brute_force(spark):
    rng = np.random.default_rng(6)
    people = [(f"name{i}", f"n{i}@site{i % 3}.org") for i in range(12)]
    rows = []
    for d in range(160):
        words = [f"w{x}" for x in rng.zipf(1.6, int(rng.integers(5, 120))) % 300]
        for _ in range(int(rng.integers(0, 3))):
            name, mail = people[int(rng.integers(len(people)))]
            at = int(rng.integers(0, len(words)))
            words[at:at] = [[name.title(), "at", mail], [mail], [name], [name, *(f"far{x}" for x in range(15)), mail]][int(rng.integers(4))]
        rows.append((None if d % 10 == 0 else d // 2, " ".join(words)))
    rows += [(900, "Zorbaq writes from zorbaq@example.org today")] * 3 + [(901, "we saw ZORBAQ alone"), (902, ""), (903, "İx n1@site1.org İx")]
    want = plain_terms(rows)
    assert sum(map(len, want)) > 20 and any(x[2] for w in want for x in w) and not all(x[2] for w in want for x in w)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("entity", F.lit("e")).withColumn("key", F.lit("k"))
    got = [(r["doc_id"] or -1, [tuple(t) for t in r["terms"]], r["spans"]) for r in pii.find_personal_data(df).collect()]
    key = lambda x: (x[0], x[1])
    assert sorted((x[:2] for x in got), key=key) == sorted(((d or -1, w) for (d, _), w in zip(rows, want)), key=key)
    for _, terms, spans in got:
        assert [s for s in spans.split(",") if s.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in terms]
    clean = [(r["doc_id"], r["text"]) for r in pii.sanitise(df).collect()]
    assert len(clean) == len(rows) and not any("zorbaq" in t.lower() or "@" in t for _, t in clean)
    assert (901, "we saw  alone") in clean or (901, "we saw [NAME] alone") in clean


def plain_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_base_by_brute_force(docs, texts):
    for r in secrets.find_secrets(docs).collect():
        want = plain_secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r["spans"].split(",")) | {""}


def test_secrets_in_layers():
    key = "password = abcDEF123456ghi"
    quoted = "".join(f"%{ord(c):02x}" for c in key)
    once = base64.b64encode(key.encode()).decode()
    twice = base64.b64encode(gzip.compress(once.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in key)
    for hidden in (quoted, once, twice, escaped):
        text = f"öö see {hidden} end"
        base, added = secrets.scan(text)
        span = next(x for x in added if x[0] == "assign")
        at = text.index(hidden)
        assert at <= span[1] < span[2] <= at + len(hidden)
    assert secrets.scan("nothing here")[1] == []


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.Example.COM/en/7x?q"), (2, "http://example.com/en/8"), (3, "https://www.foo.net/de/"), (4, "http://example.net/de/8"), (5, None), (6, "no scheme"), (7, "http://notexample.com"), (8, "x://com/en/#a"), (9, "http://b.org/es/z")]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4)] == [("a.example.com", "/en/7x", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("www.foo.net", "/de/", "net/de/"), ("example.net", "/de/8", "example.net/de/8")]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 8, 9)] == ["allow", "block", "allow", "block", "block", "block"]
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("", "", None) and got[7]["host"] == "notexample.com"
    model = urlfilter.UrlModel([f"http://good.net/news/{i}" for i in range(200)], [f"http://spam.org/casino-{i}" for i in range(200)])
    assert model.ratio("http://spam.org/casino-777") > model.threshold >= model.ratio("http://good.net/news/9999")


def edit_distance(p, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        last, row = row, [i]
        for j, d in enumerate(t, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def closest_words(item, text):
    """The least distance of the item to any stretch of whole words."""
    words = text.split()
    return min((edit_distance(item, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)), default=len(item))


def test_decontamination_by_brute_force():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), int(rng.integers(2, 6))))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 14))))) for i in range(12)]
    m = decontaminate.Matcher(items)
    for _ in range(60):
        item = items[int(rng.integers(len(items)))][1]
        chars = list(item)
        for _ in range(int(rng.integers(0, 6))):
            chars[int(rng.integers(len(chars)))] = str(rng.choice(list("abcde ")))
        text = " ".join([word(), word(), "".join(chars), word()])
        words = decontaminate.plain(text)
        want = {i: d for i, t in items if (d := closest_words(t, words)) <= decontaminate.budget(t)}
        got = m.matches(text)
        assert {i: d for i, d, *_ in got} == want
        for i, d, a, b in got:
            assert edit_distance(dict(items)[i], decontaminate.plain(text[a:b])) == d


def test_items_are_not_found_inside_words():
    m = decontaminate.Matcher([(1, "art"), (2, "cat sat"), (3, "The end.")])
    assert m.matches("the party started; concat satin; bend the endless") == []
    assert [(i, a, b) for i, _, a, b in m.matches("Art, the END: cat (sat)")] == [(1, 0, 3), (2, 14, 22), (3, 5, 12)]


def test_decontamination_in_blocks_and_of_odd_rows(spark):
    passage = " ".join(f"word{i} of the passage" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, "a rare item here"), (4, "zebra crossing")], "item_id long, text string")
    rows = [(1, f"before {passage} after"), (1, "clean text"), (None, f"see {passage}"), (None, "clean too"), (5, None), (6, ""), (7, "x " * 200_000 + "zebra crossing"), (8, "A rare item, here!"), (8, "A rare item, here!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("distance", F.lit("d"))
    for chars in (4_000_000, 100):  # one block, several
        got = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in decontaminate.contaminated(docs, bench, block_chars=chars).collect()))
        assert got == [(0, 1, 0)] * 2 + [(1, 1, 0)] * 2 + [(7, 4, 0), (8, 0, 0), (8, 0, 0)]
        kept = decontaminate.drop_contaminated(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "clean too"), (1, "clean text"), (5, ""), (6, "")]
        assert decontaminate.contaminated(docs.where("false"), bench, block_chars=chars).count() == 0
        assert decontaminate.contaminated(docs, bench.where("false"), block_chars=chars).count() == 0


def test_copy_filters_judge_each_row_by_itself(spark):
    rng = np.random.default_rng(8)
    make = lambda: [f"w{x}" for x in rng.integers(0, 5000, 120)]
    one, two, three = make(), make(), make()
    near = " ".join([*one[:60], "changed", *one[61:]])
    one, two, three = (" ".join(x) for x in (one, two, three))
    rows = [(3, one, "a"), (5, near, "a"), (5, two, "a"), (None, near + " end", "a"), (None, three, "a"), (None, three, "b"), (None, three, "b"), (7, None, "a"), (8, "", "a"), (9, " \n", None), (9, None, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(1)).withColumn("own", F.lit(2))
    got = [tuple(r)[:3] for r in simhash.drop_near_copies(docs).collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got) == sorted([(3, one), (5, two), (0, three), (7, "")])
    rows = [(1, "a b c", "x"), (1, "ab  c ", "x"), (1, "ab  c ", "y"), (1, "ab  c ", "y"), (2, "abc", "x"), (None, "q", None), (None, "q ", None), (4, None, "z"), (3, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("own", F.lit(2)).withColumn("n", F.lit(0))
    got = [tuple(r)[:3] for r in exact_dedup.drop_exact_copies(docs).collect()]
    assert len(got) == 3 and (None, "q ", None) in got and (3, " ", "z") in got
    assert [r[:2] for r in got if r[0] == 1] == [(1, "ab  c ")]


@pytest.mark.parametrize("broadcast", [21, 0])
def test_bloom_filter_share_does_not_depend_on_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_LOG2", broadcast)
    for n in (3_000, 100_000):
        keys = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
        log2 = exact_dedup.blocks_log2(n)
        assert 12 * n <= 64 << log2 <= 24 * n + 64
        maybe = exact_dedup.may_repeat(keys, exact_dedup.repeated_filter(keys, log2), log2).where("_maybe").count()
        assert maybe < 0.05 * n
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d"), (5, " d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 3, 5]
    assert sorted(r["keep_id"] for r in exact_dedup.exact_copies(docs).collect()) == [1, 1, 3, 5, 5]


def test_near_copies_meet_at_any_size():
    for n in (0, 10**6, 10**8, 10**11):
        bits = simhash.block_bits(n)
        assert n / 2 ** bits.shape[1] <= 256 and (1 - (1 - simhash.DIFFERING) ** bits.shape[1]) ** len(bits) <= simhash.MISS
    rng = np.random.default_rng(0)
    bits, met = simhash.block_bits(10**9), 0
    for _ in range(300):  # pairs at the mean distance of the least similarity
        x = np.zeros(256, bool)
        x[rng.choice(256, 39, replace=False)] = True
        met += any(not x[b].any() for b in bits)
    assert met >= 297


def test_shared_tables_can_be_removed(spark):
    from pathlib import Path

    from echolith.llm import shared

    mark = shared.tables_mark(spark)
    shared.shared_table(spark.range(5).toDF("a"), "gone")
    kept = shared.shared_table(spark.range(5).toDF("a"), "kept")
    paths = shared._written(spark)[mark:]
    shared.remove_tables(spark, mark, keep=1)
    assert kept.count() == 5 and [Path(x).exists() for x in paths] == [False, True]


def test_sentencepiece_round_trip_and_plain_rules(texts):
    import sentencepiece

    v = sentencepiece_bpe.Vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    rows = [(d, t) for d, t in list(texts.items())[:60]] + [(9, "  two  blanks "), (10, "▁ \U0001f600 ü\n\tx"), (11, "x" * 300), (12, ""), (13, None)]
    for rate in (0.0, 0.1, 1.0):
        ids = sentencepiece_bpe.Encoder(v, rate).encode(rows)
        assert all(sentencepiece_bpe.decode(x, v) == (t or "") for x, (_, t) in zip(ids, rows))
        if not rate:
            clean = [(x, t) for x, (_, t) in zip(ids, rows) if t and "▁" not in t and "  " not in t and t == t.strip() and t.isascii() and "\n" not in t and "\t" not in t]
            assert clean and all(x.tolist() == sp.encode(t) for x, t in clean)
    a, b = (sentencepiece_bpe.Encoder(v, 0.1, seed).encode(rows[:5]) for seed in (7, 8))
    again = sentencepiece_bpe.Encoder(v, 0.1, 7).encode(rows[:5])
    assert all((x == y).all() for x, y in zip(a, again)) and any(len(x) != len(y) or (x != y).any() for x, y in zip(a, b))


def test_heap_and_rounds_give_the_same_pieces(texts):
    e = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary(), 0.3)
    chunks = [" internationally", "  retokenization", " Straße", "abc" * 9, *{c for t in list(texts.values())[:40] for c in sentencepiece_bpe.CHUNK.findall(t or "")}]
    chunks = [c for c in chunks if len(c) <= sentencepiece_bpe.LONG]
    assert len(chunks) > 1000
    keys = np.arange(len(chunks), dtype=np.uint64) * np.uint64(977)
    odd = set(e.v.bytes.tolist())
    for own in (keys, None):
        pieces, offsets = e.segment(chunks, own)
        for i, c in enumerate(chunks):
            heap = [x for x in e.agenda(c, None if own is None else int(keys[i])) if 0 <= x < e.v.size]
            assert [x for x in pieces[offsets[i] : offsets[i + 1]].tolist() if x not in odd] == heap


def test_each_place_has_its_own_segmentation(texts):
    v = sentencepiece_bpe.Vocabulary()
    e = sentencepiece_bpe.Encoder(v, 0.1)
    rows = [(3, " internationalization" * 400), (4, " internationalization" * 400), *list(texts.items())[:30]]
    got = e.encode(rows)
    mix, m = sentencepiece_bpe._mix1, (1 << 64) - 1
    for (d, t), ids in zip(rows, got):
        want = []
        for place, c in enumerate(sentencepiece_bpe.CHUNK.findall(f" {t}" if t else "")):  # each chunk by its own heap
            key = mix(xxhash.xxh64_intdigest(c.encode(), 7) + mix(mix(d + 7) + place & m) & m)
            want += [x for x in e.agenda(c, key) if 0 <= x < v.size]
        odd = set(v.bytes.tolist())
        assert [x for x in ids.tolist() if x not in odd] == [x for x in want if x not in odd]
    kinds = {tuple(e.agenda(" internationalization", k)) for k in range(400)}
    assert len(kinds) > 30


def test_sentencepiece_tables_decode_again(spark, odd):
    out = sentencepiece_bpe.encode(odd)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in sentencepiece_bpe.decoded(out).collect())
    assert back == sorted((d or 0, t or "") for d, t in ODD)


def brute_cut(gain, edges):
    n = len(gain)
    cost = lambda s: sum(max(g, 0) if not s >> i & 1 else max(-g, 0) for i, g in enumerate(gain)) + sum(c for i, j, c in edges if (s >> i & 1) != (s >> j & 1))
    return min(cost(s) for s in range(1 << n)), cost


def test_minimum_cut_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        gain = rng.normal(0, 2, n).round(2).tolist()
        edges = [(i, j, 2 * round(rng.random(), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        least, cost = brute_cut(gain, edges)
        assert cost(sum(1 << i for i, x in enumerate(htmltext.min_cut(gain, edges)) if x)) == pytest.approx(least)


def test_html(spark):
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b> text.</p><p>Second one.</p></article><aside>Buy now</aside><div class='comments'><p>I agree!</p></div><footer>&copy; me</footer><script>x()</script></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltext.extract(rows).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst paragraph, with bold text.\n\nSecond one."
    assert got[1]["n_chars"] == len(got[1]["text"]) and (got[2]["text"], got[3]["n_chars"]) == ("", 0)


ARTICLE = "<article><h1>The title</h1><p>First long paragraph, with several words, of the article text.</p><p>Second paragraph goes on, and on, with more words.</p></article>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav>'
COMMENT = "<p>I agree with all of this, it is a great text, thanks.</p>"
INNER = ARTICLE[9:-10]
PAGES = [
    NAV + '<svg width="1"/>' + ARTICLE,
    NAV + "<svg-icon></svg-icon>" + ARTICLE + "<svg><title>x</title></svg>",
    NAV + ARTICLE.replace("<p>Second", "<video-player></video-player><video>no video</video><p>Second"),
    NAV + f'<div class="layout has-sidebar">{ARTICLE}<div class="sidebar"><p>Read this one next, it is great.</p></div></div>',
    NAV + f'<div class="elementor-widget-container">{ARTICLE}</div>',
    NAV + f'<article><div class="elementor-widget-container">{INNER}</div></article>',
    NAV + ARTICLE.replace("<article>", '<article class="post share-enabled">'),
    NAV + ARTICLE.replace("several words", "<math>several</math> words"),
    NAV + ARTICLE.replace("</article>", f'<section class="comments"><h3>Comments</h3>{COMMENT}{COMMENT}</section></article>'),
    NAV + ARTICLE + f'<div id="comments"><article class="comment">{COMMENT}</article></div>',
    NAV + '<iframe src="x"><select/>' + ARTICLE + "<form><p>Your name</p></form><script>if (1 < 2) x('</p>')",
    NAV + "<template><p>Hidden text here, not shown at all.</p></template>" + ARTICLE + '<p style="display: none">Hidden</p>',
    f'<div><a href="/">Home</a> <a href="/x">About us</a></div><div>{INNER}</div><div><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></div>',
]


@pytest.fixture(scope="module")
def weights(spark):
    return htmltext.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_articles_of_hard_pages(weights):
    want = "The title\n\nFirst long paragraph, with several words, of the article text.\n\nSecond paragraph goes on, and on, with more words."
    for page in PAGES:
        assert htmltext.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>", weights) == want, page
    last = htmltext.blocks(PAGES[-1])  # no element of this page says what is the article
    assert all(b.evidence == b.words == 0 for b in last)


def test_labels_of_pages_are_the_least_cut(spark, weights):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    checked = 0
    for page in [*PAGES, *pages]:
        found = htmltext.blocks(page)
        if 0 < len(found) <= 13:
            gain, edges = htmltext.graph(found, weights)
            least, cost = brute_cut(gain, edges)
            assert cost(sum(1 << i for i, x in enumerate(htmltext.min_cut(gain, edges)) if x)) == pytest.approx(least)
            checked += 1
    assert checked >= len(PAGES)
    found = htmltext.blocks("<div><p>A long paragraph of text, with many words in it.</p><p><a href=x>Read more</a></p><p>Another long paragraph of text, with many words.</p></div>")
    gain, edges = htmltext.graph(found, weights)
    assert gain[1] < 0 and all(htmltext.min_cut(gain, edges))  # its neighbours decide, not the block alone


def test_pages_of_odd_tables(spark):
    rows = [(1, "u", PAGES[0]), (1, "u", PAGES[0]), (None, None, None), (2, "v", ""), (3, "v", "<p>x" * 5_000), (4, "v", "< <<>& <!-- <p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("h", F.lit(1))
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows) and htmltext.extract(df.where("false")).count() == 0
    assert len({r["text"] for r in got if r["page_id"] == 1}) == 1 and all(r["n_chars"] == len(r["text"]) for r in got)


def plain_markov(texts, order):
    """Interpolated Witten-Bell by counting the training texts anew for each probability."""
    padded = ["\x02" * order + t + "\x02" for t in texts]

    def p(c, context):
        lower = p(c, context[1:]) if context else 1 / 256
        after = [t[i] for t in padded for i in range(order, len(t)) if t[i - len(context) : i] == context]
        return (after.count(c) + len(set(after)) * lower) / (len(after) + len(set(after))) if after else lower

    return lambda text: sum(np.log(p(c, ("\x02" * order + text)[i : i + order])) for i, c in enumerate(text + "\x02"))


def test_url_models_by_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab/."), int(rng.integers(1, 9)))) for _ in range(30)]
    model, plain = urlfilter.Markov(texts, 3), plain_markov(texts, 3)
    for t in ["", "a", "zz", "ab/ab.", *texts[:10]]:
        assert model.score(t) == pytest.approx(plain(t))


def test_url_threshold_uses_both_classes():
    good, bad = [f"http://good.net/news/{i}" for i in range(300)], [f"http://spam.org/casino-{i}" for i in range(300)]
    m = urlfilter.UrlModel(good, bad)
    assert (m.false_blocks, m.recall) == (0, 1)
    scores = [sorted(m.ratio(u) for u in us[::5]) for us in (good, bad)]
    assert m.threshold == pytest.approx((scores[0][-1] + scores[1][0]) / 2)
    mixed = urlfilter.UrlModel(good + bad[:60], bad)
    assert mixed.false_blocks <= 0.011


def test_urls_of_odd_tables(spark):
    rows = [(1, None), (None, "http://a.net/de/1"), (None, "http://a.net/de/1"), (2, ""), (3, "http://b.com/en/" + "x" * 100_000), (4, "http://c.fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("score", F.lit(1)).withColumn("rule", F.lit("r"))
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows) and urlfilter.judge(df.where("false")).count() == 0
    assert {r["rule"] for r in got} == {None, "net/de/", "com/en/"} and all(r["verdict"] in ("allow", "block") for r in got)


def plain_ngrams(text):
    from collections import Counter

    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_langid_by_brute_force(spark, docs, texts):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], sum(ord(k) << 21 * i for i, k in enumerate(x[0][::-1]))))[:300]]
    by = {}
    for d, t in texts.items():
        if lang[d] and zlib.crc32(str(d).encode()) % 4 != 2:
            by.setdefault(lang[d], plain_ngrams("")).update(plain_ngrams(t))
    profiles = {k: {g: i for i, g in enumerate(rank(c))} for k, c in by.items()}
    for r in langid.identify(docs).collect():
        own = rank(plain_ngrams(texts[r["doc_id"]]))
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        off = {k: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(off), key=off.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - off[best] / (300 * len(own)))


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    assert all(r["lossless"] for r in out) and len(out) > 0.6 * docs.count()
    left = {r["doc_id"]: r["text"] or "" for r in langid.drop_unrecognised(docs).collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for d, t in sorted(left.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(norm(t), d)
    left = {d: left[d] for d in sorted(best.values())}
    words = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for d, t in left.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    root = {d: d for d in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    m = decontaminate.Matcher(items)
    want = {d for d in left if find(d) == d and not m.matches(left[d])}
    assert {r["doc_id"] for r in out} == want
    v = sentencepiece_bpe.Vocabulary()
    assert all(sentencepiece_bpe.decode(np.array(r["ids"]), v) == left[r["doc_id"]] for r in out)


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(150):  # pairs on both sides of the least similarity
        own = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(60, 300)))]
        other = list(own)
        for at in rng.choice(len(own), max(1, round(len(own) * rng.uniform(0.005, 0.04))), replace=False):
            other[at] = f"new{g}x{at}"
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(other))]
    line = " ".join(f"r{x}" for x in range(40))
    rows += [(900, line), (901, f"{line} " * 30)]  # much the same set, whatever the repeats
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    want = {d: d for d, _ in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for d in range(0, 300, 2):
        want[d + 1] = d if alike(d, d + 1) else d + 1
    want[901] = 900 if alike(900, 901) else 901
    assert 30 < sum(d % 2 == 1 and k == d for d, k in want.items()) < 120
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sketches_rule_out_only_pairs_that_are_not_alike():
    rng, ruled = np.random.default_rng(3), [0, 0]
    for n in (0, 1, 3, 40, 150, 1000, 6000):
        for share in np.linspace(0, 0.3, 60):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.random(len(x)) < share
            y = np.unique(np.concatenate([x[~gone], rng.integers(0, 1 << 63, int(gone.sum() * rng.choice([0, 1]))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            may = bool(simhash.may_be_similar(simhash.odd_sketch(x)[None], simhash.odd_sketch(y))[0])
            similar = both >= 0.8 * (len(x) + len(y) - both)
            assert may or not similar
            if n == 150 and both < 0.74 * (len(x) + len(y) - both):
                ruled = [ruled[0] + (not may), ruled[1] + 1]
    assert ruled[1] > 10 and ruled[0] >= 0.9 * ruled[1]


def test_a_large_group_about_the_least_similarity_by_brute_force(spark):
    rng = np.random.default_rng(11)
    base, rows = [f"w{x}" for x in rng.integers(0, 4000, 150)], []
    for d in range(160):  # one text with up to five words changed
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
            own[at] = f"n{d}x{at}"
        rows.append((d, " ".join(own)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    root = list(range(160))
    for a in range(160):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                least, most = sorted((root[a], root[b]))
                root = [least if x == most else x for x in root]
    assert 20 < len(set(root)) < 140
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_language_stage_rejects_noise_and_unlearned_languages(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(2)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 1500))
    junk = base64.b64encode(rng.bytes(900)).decode()
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin."
    bad = spark.createDataFrame([(-1, letters, None), (-2, junk, None), (-3, finnish, None), (-4, "12 34 !", None)], known.schema)
    kept = {r["doc_id"] for r in langid.drop_unrecognised(known.unionByName(bad)).select("doc_id").collect()}
    real = {r["doc_id"] for r in known.where("length(text) > 0").select("doc_id").collect()}
    assert min(kept) >= 0 and len(real - kept) <= 0.002 * len(real)


def test_every_place_of_a_repeated_encoded_secret():
    hidden = base64.b64encode(b"password = abcDEF123456ghi").decode()
    text = f"one {hidden} two {hidden}\nthree {hidden}."
    spans = [x for x in secrets.scan(text)[1] if x[0] == "assign"]
    assert len(spans) == 3
    for at, (_, a, b, _) in zip([m.start() for m in re.finditer(re.escape(hidden), text)], spans):
        assert at <= a < b <= at + len(hidden)


def test_base64_at_any_alignment_over_lines_and_in_pieces(monkeypatch):
    key = b"password = abcDEF123456ghi"
    plain = base64.b64encode(key).decode()
    stream = base64.b64encode(gzip.compress(b"much more text before it, " + bytes(range(32, 127)) * 3 + key)).decode()
    wrap = lambda x, n: "\n".join(x[i : i + n] for i in range(0, len(x), n))
    for hidden in (plain, stream, wrap(plain, 10), wrap(plain, 20), wrap(stream, 76).replace("\n", "\r\n  ")):
        for before in ("", "api/", "cfg_", "id-", "x", "xy", "xyz", "a/b_c-"):
            for after in ("", "Q", "/Q"):
                text = f"see {before}{hidden.rstrip('=')}{after} end"
                spans = [x for x in secrets.scan(text)[1] if x[0] == "assign"]
                assert any(4 <= a <= b <= len(text) - 4 for _, a, b, _ in spans), text
    monkeypatch.setattr(secrets, "UNPACKED", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for pack in (gzip.compress, zlib.compress):
        assert any(x[0] == "assign" for x in secrets.scan(base64.b64encode(pack(b"a b " * 246 + key + b" c d" * 700)).decode())[1])


def test_language_model_tells_words_past_the_first_thousand_apart():
    lex = lm.Lexicon([(b"w%d" % i, 9000 - i) for i in range(6000)] + [(lm.END, 9)], 40_000_000, 6001)
    assert len({lex.id.get(b"w%d" % i, 1) for i in range(4000)}) == 4000
    assert len(lex.bounds) - 1 > 32


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """A group's candidates grow with its size times the blocks of one split, not of all, and no link is lost."""
    rng, verified, made = np.random.default_rng(5), simhash._verified, []
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        own = list(base)
        for i in rng.choice(150, int(rng.integers(1, 6)), replace=False).tolist():
            own[i] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(docs).collect()}
    sets = [simhash.shingle_set(t) for t in texts]
    root = list(range(300))
    for i in range(300):
        for j in range(i):
            if root[i] != root[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= simhash.SIMILAR * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root[i], root[j]))
                    root = [a if x == b else x for x in root]
    assert got == dict(enumerate(root))
    assert made[0] < 300 * 18


@pytest.mark.parametrize("chars", [1, 20, 1 << 23])
def test_words_of_pieces_of_a_column(monkeypatch, chars):
    """Each distinct word of a piece is looked up once; the words are those of lm.words."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "CHARS", chars)
    texts = ["", None, " \t\x0b\x0c\r\n", "  A b  A ", "a\x1cb\x85c d Ü x", "word " * 50, "\n\n", "x", "İI ſ a　b", None]
    got = []
    for rows, kinds, codes, ends in lm._coded(pa.array(texts)):
        assert len(set(kinds)) == len(kinds) and rows == len(ends)
        got += [[kinds[c] for c in codes[a:b]] for a, b in zip([0, *ends], ends)]
    assert got == [lm.words(t) for t in texts]
