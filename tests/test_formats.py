"""Files written and read by the package's own data sources."""

import datetime
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.sources import audio, formats, tables

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, strings=(), sheets=("first", "rooms")):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"{HEAD}<workbook {NS}><sheets>" + "".join(f'<sheet name="{s}" sheetId="{i + 1}" r:id="rId{i}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="x" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i in range(len(sheets)):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"{HEAD}<worksheet {NS}><sheetData>{rows if i else ''}</sheetData></worksheet>")


ROWS = """
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>on</t></is></c><c r="AA1" t="str"><v>day</v></c></row>
<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>125</v></c><c r="D2" t="b"><v>1</v></c><c r="AA2"><v>45292.5</v></c></row>
<row r="3"/>
<row r="4"><c r="A4"><v>7</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="D4" t="b"><v>0</v></c><c r="AA4" t="d"><v>2024-02-03T00:00:00</v></c><c r="AB4"><v>9</v></c></row>
"""
STRINGS = ("<t>name</t>", "<r><t>ba</t></r><r><t>nd</t></r>", "<t>great &amp; öhall</t><rPh sb='0' eb='1'><t>x</t></rPh>")


def test_a_sheet_with_and_without_a_schema(spark, tmp_path):
    formats.register(spark)
    for name in "ab":
        workbook(tmp_path / f"{name}.xlsx", ROWS, STRINGS)
    (tmp_path / "~$a.xlsx").write_bytes(b"a lock, no workbook")
    read = lambda sheet="rooms": spark.read.format("workbook").option("sheet", sheet)
    found = read().schema("band int, name string, day timestamp, on boolean, none double").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 2
    noon = datetime.datetime(2024, 1, 1, 12)
    one, two = (125, "great & öhall", noon, True, None), (None, "7", datetime.datetime(2024, 2, 3), False, None)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([one, one, two, two], key=str)
    found = read().load(str(tmp_path / "a.xlsx"))
    assert dict(found.dtypes) == {"name": "string", "band": "double", "on": "boolean", "day": "string"} and found.count() == 2
    assert read("no such").schema("name string").load(str(tmp_path)).count() == 0
    assert spark.read.format("workbook").schema("name string").load(str(tmp_path)).count() == 0
    assert tables.read_measured(spark, str(tmp_path / "a.xlsx"), "rooms").select("name", "band").collect()[0][:] == ("great & öhall", 125)


@pytest.mark.parametrize("value, kind, want", [(2.5, formats.IntegralType(), None), (float("inf"), formats.IntegralType(), None), ("x", DOUBLE := formats.DoubleType(), None), ("2.5", DOUBLE, 2.5), (3.0, formats.StringType(), "3"), (True, formats.StringType(), "true"), (61.0, formats.DateType(), datetime.date(1900, 3, 1)), (1e12, formats.DateType(), None)])
def test_cells_that_fit_and_that_dont(value, kind, want):
    assert formats._fitted(value, kind) == want


def signals(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("name"), F.array(F.col("id") / 100.0, F.lit(-0.5)).alias("x"), F.lit(1).alias("more"))


def test_signals_written_and_read_again(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "out")
    signals(spark, 20).repartition(3).write.format("wave").option("fs", 8000).mode("append").save(path)
    found = audio.read_audio(spark, path, fs=8000, normalise=False).collect()
    assert len(found) == 20 and all(r["error"] is None for r in found)
    assert np.allclose(sorted(r["x"][0] for r in found), [int(i / 100 * 32767) / 32768 for i in range(20)])
    signals(spark, 4).write.format("wave").option("fs", 8000).mode("append").save(path)
    assert audio.audio_files(spark, path).count() == 24
    signals(spark, 2).write.format("wave").mode("overwrite").save(path)
    assert audio.audio_files(spark, path).count() == 2 and tables.exists(spark, path)
    signals(spark, 0).write.format("wave").mode("overwrite").save(path)
    assert os.listdir(path) and not [f for _, _, names in os.walk(path) for f in names if f.endswith(".wav")]


@pytest.mark.parametrize("name, x", [(None, "array(0.5D)"), ("'a/b'", "array(0.5D)"), ("'a'", "cast(null as array<double>)")])
def test_a_job_that_fails_leaves_no_file(spark, tmp_path, name, x):
    formats.register(spark)
    path = str(tmp_path / "out")
    good = signals(spark, 8).select("name", "x")
    bad = spark.sql(f"select cast({name or 'null'} as string) as name, {x} as x")
    with pytest.raises(Exception, match="no file can be made"):
        good.unionByName(bad).write.format("wave").mode("append").save(path)
    assert not [f for _, _, names in os.walk(path) for f in names]


def test_an_attempt_that_does_not_count_leaves_no_file(tmp_path):
    import pyarrow as pa

    w = formats.WaveWriter(str(tmp_path / "out"), 8000, False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a"], "x": [[0.1], [0.2]]})
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.folder != kept.folder
    w.commit([kept, None])
    assert sorted(f for _, _, names in os.walk(tmp_path) for f in names if f != "_SUCCESS" and not f.startswith(".")) == ["a-2.wav", "a.wav"]
