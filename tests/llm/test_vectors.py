"""Whitening and hard negatives against plain linear algebra and brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.llm import hard_negatives, queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, x int, place string, distance double"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, "p", 0.5) for r in rows], SCHEMA)


def test_jacobi_is_a_singular_value_decomposition():
    rng = np.random.default_rng(3)
    for n, d in ((9, 6), (6, 7), (40, 1), (3, 3), (0, 4)):
        a = rng.standard_normal((n, d)) * 10.0 ** rng.integers(-6, 6, d)
        s, v = whitening.one_sided_jacobi(a)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        want = np.concatenate([np.linalg.svd(a, compute_uv=False), np.zeros(max(0, d - n))])[:d]
        assert np.allclose(s, want, rtol=1e-10, atol=1e-9 * want.max(initial=1))
    # small singular values of a graded matrix keep their digits, which a squared covariance would lose
    s, _ = whitening.one_sided_jacobi(np.diag([1.0, 1e-9, 1e-14]))
    assert s == pytest.approx([1.0, 1e-9, 1e-14], rel=1e-12)


def plainly_whitened(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    e, v = np.linalg.eigh((d / n).T @ (d / n) / n)
    return n, (d * d).sum(axis=1), e[::-1], (d / n) @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_an_eigendecomposition(spark, monkeypatch, d):
    monkeypatch.setattr(whitening, "FOLD", 2)  # parts are folded in tasks too
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((500, d)) @ rng.standard_normal((d, d)) * 0.2 + 0.7).astype(np.float32)
    odd = [(900, None, 1), (901, [float("nan")] * d, 1), (902, [float("inf")] * d, 1), (903, [None] * d, 1), (904, [], 1), (905, [1.0], 1)]
    rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(None, vectors[7].tolist(), None), (7, vectors[7].tolist(), None)] + odd).repartition(7)
    got = whitening.whiten(rows).toPandas()
    n, deviation, e, white = plainly_whitened(np.vstack([vectors, vectors[7:8], vectors[7:8]]))
    k = min(32, d)
    assert len(got) == 502 * k and set(got["n"]) == {502} and set(got["component"]) == set(range(1, k + 1))
    assert set(got["vec_id"].dropna()) == set(range(500)) and got["vec_id"].isna().sum() == k
    own = got[got["vec_id"].notna() & (got["vec_id"] != 7)]
    assert (own["deviation"].to_numpy() == deviation[own["vec_id"].astype(int)]).all()
    p = own.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    w = white[p.index.astype(int), :k]
    assert np.allclose(p.to_numpy() * np.sign((p.to_numpy() * w).sum(axis=0)), w, atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), (e / e.sum())[:k], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8


def test_whitening_of_few_and_equal_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 1)])).count() == 0
    got = whitening.whiten(table(spark, [(1, [0.5, 0.5], 1)] * 3)).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, [(1, [0.0, 1.0], 1), (2, [0.0, 3.0], 1)])).collect()}
    assert got[1, 1]["whitened"] * got[2, 1]["whitened"] == pytest.approx(-1) and got[1, 1]["explained"] == pytest.approx(1)
    assert got[1, 2]["whitened"] is None and got[1, 2]["explained"] == pytest.approx(0) and got[1, 1]["identity_error"] < 1e-12


def test_whitening_where_longs_end(spark):
    """Deviations are exact up to a long's end and null beyond it; sums don't overflow."""
    found = whitening.Fit(10**9, np.array([0]), np.array([0]), np.eye(1), np.ones(1))
    assert found.deviations(np.array([[3], [1 << 40]])).tolist() == [[3 * 10**9], [(1 << 40) * 10**9]]
    big = float(1 << 39)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, [(1, [big], 1), (2, [-big], 1), (3, [0.0], 1)])).collect()}
    assert got[1] is None and got[2] is None and got[3] == 0


def brute_force(rows):
    """The contract, read plainly; rows are told apart by their place."""
    use = [(i, label, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, label in rows if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (i, label, x) in enumerate(use):
        if i % 100:
            continue
        scored = [(-dot(x, y), j, lab) for b, (j, lab, y) in enumerate(use) if b != a]
        for s, j, _ in sorted(t for t in scored if t[2] == label)[:5]:
            fits = sorted(t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits[:5])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("cell, block, blocks", [(4096, 256, 64), (7, 2, 1)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, cell, block, blocks):
    for name, value in (("CELL", cell), ("BLOCK", block), ("BLOCKS", blocks), ("PIVOTS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, 6))
    rows = [(i * 10, (centres[i % 4] + 0.5 * rng.standard_normal(6)).tolist(), int(rng.integers(3))) for i in range(240)]
    rows += [(100_000 + i, rows[0][1], i % 3) for i in range(30)] + [rows[3], rows[3], (200, rows[5][1], 9), (300, [-v for v in rows[5][1]], 8), (400, rows[6][1], 8)]
    rows += [(None, rows[0][1], 1), (500, rows[0][1], None), (600, None, 1), (700, [None] * 6, 1), (800, [float("inf")] * 6, 1), (900, [], 1), (1000, [0.0] * 6, 2)]
    got = mined(table(spark, rows).repartition(5))
    assert got == brute_force(rows) and len(got) > 100


def test_hard_negatives_of_empty_and_small_tables(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(100, [1.0], 1)])) == [] and mined(table(spark, [(100, [0.0, 0.0], 1), (1, [0.0, 0.0], 1)])) == []
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], 2), (4, [0.1, 0.0], 2)]
    assert mined(table(spark, rows)) == brute_force(rows) == [(100, 1, 1, 2, 65536, 65536), (100, 1, 2, 3, 65536, 65536)]


def test_hard_negatives_on_given_vectors_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_hard_negatives"]).df()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = queries.op12_hard_negatives(spark, DATA).select(*columns).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist())) and len(got)


def test_searches_scan_less_than_everything(spark, monkeypatch):
    """Among clustered vectors of like length, an anchor's first annuli leave out most cells."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 5))
    centres *= 4 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 8] + 0.02 * rng.standard_normal(5)).tolist(), i % 8 + 10 * (i % 3)) for i in range(4000)]
    found = hard_negatives.index(hard_negatives.prepared(table(spark, rows)))
    assert found.rows.count() == 4000 and found.rows.select("place").distinct().count() == 4000
    asked = hard_negatives.anchors(found)
    r, longest = F.lit(found.radius), found.pivots.longest
    near = asked.select("anchor", F.posexplode("distances").alias("pivot", "d")).join(found.cells, "pivot").where((F.col("low") <= F.col("d") + r) & (F.col("high") >= F.col("d") - r))
    assert asked.count() == 40 and found.radius < np.sqrt(longest) / 2 and near.count() < 40 * found.cells.count() / 2
