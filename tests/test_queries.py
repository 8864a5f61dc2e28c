"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import math
import os

import duckdb
import pandas as pd
import pytest

from echolith.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(df):
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    out = [tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    got = core.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in core.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.execute(core.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for a, b in zip(rows(got), rows(want), strict=True):
            assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)


def test_the_record_scan_opens_one_partition(spark, tmp_path):
    from pyspark.sql import functions as F

    from echolith.operators import records
    from echolith.sources import tables

    df = spark.range(40).select((F.col("id") % 4).cast("int").alias("band"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("type_data"), F.col("id").cast("double").alias("t30"))
    path = str(tmp_path / "records")
    assert not tables.exists(spark, path)
    out = records.scan(tables.cached_records(spark, path, lambda: df), 2, "train")
    assert out.count() == 10 and tables.exists(spark, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "band" in plan.split("PartitionFilters")[1].split("]")[0]


def test_wave_files_round_trip_in_batch_and_stream(spark, tmp_path):
    import numpy as np

    from echolith.sources import audio
    from echolith.streaming import ingest

    x = np.sin(np.arange(1600) / 9)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.wav").write_bytes(audio.wave_bytes(x, 16_000))
    (tmp_path / "in" / "broken.wav").write_bytes(b"no audio")
    got = {r["name"]: r for r in audio.read_audio(spark, str(tmp_path / "in")).collect()}
    assert np.allclose(got["a.b"]["x"], x / np.abs(x).max(), atol=1e-3)
    assert got["broken"]["x"] is None and got["broken"]["error"]
    ingest.ingest(ingest.audio_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_signals_become_wave_files(spark, tmp_path):
    from echolith.sources import audio

    (tmp_path / "b.flac").write_bytes(b"fLaC")
    rows = spark.createDataFrame([("a", [0.0, 0.5, -1.0]), ("none", None), ("empty", [])], "name string, x array<float>")
    got = {r["name"]: r["content"] for r in audio.with_wave_content(rows).collect()}
    assert got["none"] is None and got["empty"] == audio.wave_bytes([], 16_000) and got["a"] == audio.wave_bytes([0.0, 0.5, -1.0], 16_000)
    read = audio.read_audio(spark, str(tmp_path)).collect()
    assert [r["name"] for r in read] == ["b"] and read[0]["error"]


def test_results_and_measurements_round_trip(spark, tmp_path):
    from echolith.sources import tables

    path = str(tmp_path / "results")
    for value in (1.0, 2.0):
        tables.write_results(spark.createDataFrame([("a", 125, value), ("b", 250, value)], "name string, band int, err_t30 double"), path)
    tables.write_results(spark.createDataFrame([("c", 250, 3.0)], "name string, band int, err_t30 double"), path)
    assert sorted(tuple(r) for r in tables.read_results(spark, path).select("name", "band", "err_t30").collect()) == [("a", 125, 2.0), ("c", 250, 3.0)]
    assert [r["name"] for r in tables.read_results(spark, path, [125]).collect()] == ["a"]
    (tmp_path / "rooms.csv").write_text("name,band,t30,c50,c80,d50\nroom1,125,0.8,3,6,0.6\nroom1,250,,,,\n")
    got = sorted(tuple(r) for r in tables.read_measured(spark, str(tmp_path / "rooms.csv")).collect())
    assert got[0] == ("room1", 125, 0.8, 3.0, 6.0, 0.6) and got[1][:3] == ("room1", 250, None)


def test_estimates_need_no_more_than_the_signal(spark):
    import numpy as np

    from echolith.functions import kernels
    from echolith.plans import database

    x = np.random.default_rng(1).normal(size=80_000)
    rows = spark.createDataFrame([("a", x.tolist()), ("short", [0.5, 1.0]), ("none", None), ("empty", [])], "name string, x array<double>")
    s = database.Settings(bands=(250, 1000))
    got = {(r["name"], r["band"]): r for r in database.band_features(rows, s).collect()}
    assert len(got) == 8
    for band in s.bands:
        own = kernels.band_passed(x, band, s.fs, s.order, s.kind)
        assert np.allclose(got["a", band]["tae"], kernels.temporal_envelope(own / np.abs(own).max(), s.fs))
        assert all(got[n, band]["tae"] is None and got[n, band]["error"] for n in ("short", "none", "empty"))


def test_p_values():
    from echolith.operators.records import incomplete_beta

    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5, abs=1e-12)


def test_signals_leave_before_others_are_made(spark, monkeypatch):
    """Rows of one batch become signals in pieces: no more than MADE_BYTES and one signal are held at once."""
    from pyspark.sql import functions as F

    from echolith.functions import kernels, udfs

    import numpy as np
    import pyarrow as pa

    held, made = [], []
    monkeypatch.setattr(udfs, "MADE_BYTES", 1000)

    class Rows:
        dtypes = [("k", "bigint")]

        def mapInArrow(self, run, kind):
            for piece in run(iter([pa.RecordBatch.from_pydict({"k": list(range(10))}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64())})])):
                held.append(piece.column("x").flatten().nbytes)
                made.extend(piece.column("k").to_pylist())
            return kind

    assert udfs.with_made(Rows(), "x", "array<float>", lambda k: np.full(100, k, np.float32), "k") == "`k` bigint, `x` array<float>"
    assert made == list(range(10)) and max(held) <= 1400 and len(held) == 4
    rows = spark.range(20, numPartitions=1).select(F.lit(0.4).alias("tr"), F.col("id").alias("seed"))
    for r in udfs.with_synthetic_response(rows, 800).collect():
        assert np.array_equal(r["x"], kernels.synthetic_response(0.4, 800, r["seed"]).astype(np.float32))
    for r in udfs.with_synthetic_response(rows, 800, 20.0).collect():
        assert np.array_equal(r["x"], kernels.with_noise(kernels.synthetic_response(0.4, 800, r["seed"]).astype(np.float32).astype(float), 20.0, r["seed"]))


def test_a_small_file_of_keys_is_swept_by_many_tasks(spark):
    """One file's suppliers, each becoming 725 rows, aren't one task's."""
    from pyspark.sql import functions as F

    per_task = [r["count"] for r in core.QUERIES["sweep_tags"](spark, DATA).groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 1 and max(per_task) < sum(per_task)
