"""Readers, writers, foreign stores and the stream of sample files."""

import json
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import files, samples, stores
from lattica.streaming import ingest


def test_json_in_three_shapes(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "array.json").write_text('[\n {"id": 1},\n {"id": 2}]')
    (tmp_path / "held.json").write_text('{\n"data": [{"id": 1}, {"id": 2}]}')
    for name in ("lines", "array", "held"):
        assert sorted(r.id for r in files.read_json(spark, str(tmp_path / f"{name}.json")).collect()) == [1, 2], name


def test_malformed_json_is_an_error_unless_told(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, str(tmp_path / "bad.json"), "id long").collect()
    assert [r.id for r in files.read_json(spark, str(tmp_path / "bad.json"), "id long", skip_malformed=True).collect()] == [1]


def test_rows_from_a_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": k}) + "\n" for k in range(20)))
    got = files.load_rows(spark, str(tmp_path / "a.jsonl"), "id long", start=5, limit=3).collect()
    assert sorted((r.source_index, r.id) for r in got) == [(5, 5), (6, 6), (7, 7)]


def test_log_values(spark):
    lines = ["start run", "step 1 loss=0.5", "noise", "start run", "step 1 loss=0.25", "step 2 loss=0.125"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").repartition(3)
    got = sorted((r.part, r.line_no, r.metric) for r in files.log_values(df, "start", r"loss=([0-9.]+)").collect())
    assert got == [(1, 1, 0.5), (2, 4, 0.25), (2, 5, 0.125)]


def test_sqlite_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.db")
    df = spark.createDataFrame([(k, f"n{k}", [k, k + 1]) for k in range(50)] + [(99, None, None)], "id long, name string, xs array<int>")
    stores.write_sqlite(df, path, "rows")
    back = stores.read_sqlite(spark, path, "rows", "id long, name string, xs string", slices=3)
    assert sorted((r.id, r.name, r.xs) for r in back.where("id < 50").collect()) == [(k, f"n{k}", f"[{k},{k + 1}]") for k in range(50)]
    assert back.where("id = 99").first().name is None
    with sqlite3.connect(path) as base:
        base.execute('DELETE FROM "rows"')
    assert stores.read_sqlite(spark, path, "rows", "id long").count() == 0


def test_npy_append_and_gather(spark, tmp_path):
    path = str(tmp_path / "v.npy")
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "row long, vector array<float>").repartition(3)
    assert stores.write_npy(df, path) == (0, 10)
    assert stores.write_npy(df.where("row < 2"), path, append=True) == (10, 12)
    assert np.load(path)[[0, 9, 10, 11], 0].tolist() == [0, 9, 0, 1]
    got = stores.read_npy(spark, path, rows_per_task=5).collect()
    assert sorted((r.row, list(r.vector)) for r in got)[9:] == [(9, [9.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 1.0])]
    with pytest.raises(ValueError, match="3 numbers"):
        stores.write_npy(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "row long, vector array<float>"), path, append=True)
    assert len(np.load(path)) == 12


def test_manifest_aliases_and_digests(spark, tmp_path):
    stores.write_json_atomic(str(tmp_path / "m.json"), {"b": 1, "a": "é"})
    stores.write_json_atomic(str(tmp_path / "m.json"), {"Wunna": "Maung Wunna"})
    assert [(r.alias, r.name) for r in stores.read_aliases(spark, str(tmp_path / "m.json")).collect()] == [("Wunna", "Maung Wunna")]
    assert [p.name for p in tmp_path.iterdir()] == ["m.json"]
    report = stores.file_report(spark, str(tmp_path)).first()
    assert report.bytes == (tmp_path / "m.json").stat().st_size and len(report.sha256) == 64


def test_samples_of_odd_shapes(spark):
    rows = ['{"id": 7, "context": null}', '{"_id": "x", "context": [["T", "one text"], ["U", []], {"title": "V"}], "paragraphs": [{"paragraph_text": " p "}]}', '{"context": {"title": "S", "sentences": ["a", " ", null, "b"]}}', "{}", "not json", None]
    raw = spark.createDataFrame(list(enumerate(rows)), "source_index long, json string")
    parsed = samples.parse(raw, skip_malformed=True)
    got = {(r.sample_id, r.ord): (r.title, list(r.sentences)) for r in samples.contexts(parsed).collect()}
    assert got == {("x", 0): ("T", ["one text"]), ("x", 3): ("", ["p"]), ("2", 0): ("S", ["a", "b"])}
    assert samples.triples(parsed, "d").count() == 0 and {r.sample_id: r.hops for r in samples.hops(parsed).collect()} == {"7": None, "x": None, "2": None, "3": None}
    with pytest.raises(Exception, match="(?i)malformed"):
        samples.parse(raw).collect()


def line(k: int) -> str:
    return json.dumps({"id": k, "question": f"q{k}", "triple_list": [{"type": "RELATION", "name": f"s{k}", "description_type": "r", "description": "o"}]})


def test_stream_of_samples(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(f"{line(1)}\n\n{line(2)}\nbroken\n")
    time.sleep(0.01)
    (tmp_path / "in" / "b.jsonl").write_text(f"{line(3)}\n")
    ingest.ingest(spark, source, target, checkpoint, "d", files=1).awaitTermination()
    (tmp_path / "in" / "c.jsonl").write_text(f"{line(4)}\n")
    for _ in range(2):
        ingest.ingest(spark, source, target, checkpoint, "d", files=1).awaitTermination()
    assert sorted(r.sample_id for r in ingest.upto(spark, target, "samples").collect()) == ["1", "2", "3", "4"]
    assert sorted(r.subject for r in ingest.upto(spark, target, "triples").collect()) == ["s1", "s2", "s3", "s4"]
    assert [(r.value, r.reason) for r in ingest.upto(spark, target, "rejected").collect()] == [("broken", "not JSON")]
    first = ingest.upto(spark, target, "samples", 0).count()
    assert 0 < first < 4


def test_event_counts(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double")
    got = ingest.event_counts(events.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert sorted((r.n, r.total) for r in got) == [(1, 4.0), (2, 3.0)]
