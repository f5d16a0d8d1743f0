"""Stores that several data sets share, lines that are no works, compaction, scratch tables."""

import json

from pyspark.sql import functions as F

from corpusmap.operators.kmeans import grouped_kmeans
from corpusmap.plans import steps
from corpusmap.sources import scratch, tables
from corpusmap.streaming.records import compact, read_latest, stream_records

POINT = "id string, title string, year bigint, faculty string, abstract string, source string, url string, x double, y double, cluster int"


def point(spark, name, inst_id):
    rows = spark.createDataFrame([(name, "t", 2000, None, None, "s", "u", 1.0, 2.0, 3)], POINT)
    return rows.withColumns({"inst_id": F.lit(inst_id), "mode": F.lit("full")})


def test_map_points_keep_other_data_sets(spark, tmp_path):
    path = str(tmp_path / "map")
    for name, inst in (("a", "02e463172"), ("b", "04e456789"), ("c", "0123"), ("d", "02e463172")):
        tables.write_map_points(point(spark, name, inst), path)
    got = {i: [r["id"] for r in tables.read_map_points(spark, path, i, "full").collect()] for i in ("02e463172", "04e456789", "0123", "123")}
    assert got == {"02e463172": ["d"], "04e456789": ["b"], "0123": ["c"], "123": []}
    row = tables.read_map_points(spark, path, "0123", "full").first()
    assert row["inst_id"] == "0123" and row["x"] == 1.0


def work(i, title="t"):
    return {"id": i, "display_name": title, "publication_year": 2000, "authorships": [{"institutions": [{"id": "i", "ror": "r", "display_name": "d"}]}]}


def test_records_without_an_id_are_returned(spark, tmp_path):
    (tmp_path / "w.json").write_text("\n".join(json.dumps(work(i)) for i in ("w1", None, "", "w1")))
    works, broken = tables.read_works(spark, str(tmp_path / "w.json"))
    kept, rejects = steps.build_records(works, "ror", "r")
    assert kept.count() == 1 and rejects.count() == 2 and broken.count() == 0


def test_stream_sets_broken_lines_apart_and_compacts(spark, tmp_path):
    source, log, state = (str(tmp_path / d) for d in ("in", "log", "state"))
    (tmp_path / "in").mkdir()
    for n, lines in enumerate(([json.dumps(work("w1", "old")), '{"id": ', ""], [json.dumps({**work("w1", "new"), "publication_year": 2001}), json.dumps(work(None))])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        stream_records(spark, source, log, state, trigger={"once": True}).awaitTermination()
    assert [r["title"] for r in read_latest(spark, log).collect()] == ["new"]
    assert spark.read.parquet(f"{log}/broken/batch=*").first()[0] == '{"id": '
    assert spark.read.parquet(f"{log}/rejects/batch=*").count() == 1
    compact(spark, log, f"{log}-2")
    assert read_latest(spark, f"{log}-2").collect() == read_latest(spark, log).collect()


def test_kmeans_runs_until_the_centres_rest(spark):
    rows = [(i, 0, float(i % 7) + 10.0 * (i % 3), float(i % 5)) for i in range(120)]
    points = spark.createDataFrame(rows, "id int, cluster int, x double, y double")
    _, rest = grouped_kmeans(points)
    _, more = grouped_kmeans(points, iters=60)
    assert rest.collect() == more.collect()


def test_scratch_needs_no_local_folder(spark):
    assert scratch.scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")
