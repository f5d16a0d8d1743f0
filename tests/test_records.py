import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmap.operators import records
from corpusmap.operators.sampling import sample_points
from corpusmap.schemas import RECORD
from corpusmap.sources import tables
from corpusmap.streaming.records import read_latest, stream_records

WORKS = [
    {
        "id": f"https://w/W{i}",
        "display_name": f"T{i}",
        "publication_year": year,
        "authorships": [{"institutions": []}, {"institutions": [{"id": "https://i/I1", "ror": "https://ror.org/R1", "display_name": "One"}]}],
        "abstract_inverted_index": {"b": [1], "a": [0]},
        "primary_location": None,
    }
    for i, year in [(1, 2001), (1, 2003), (1, None), (2, 2000)]
] + [{"id": None, "display_name": "lost", "publication_year": 1999, "authorships": None}]


@pytest.fixture
def works(spark, tmp_path):
    lines = [json.dumps(w) for w in WORKS] + ["{broken"]
    (tmp_path / "works.json").write_text("\n".join(lines))
    return tables.read_works(spark, str(tmp_path / "works.json"))


def test_read_works_separates_broken_lines(works):
    good, bad = works
    assert good.count() == 5
    assert [r[0] for r in bad.collect()] == ["{broken"]


def test_records_of_an_institution(works):
    good, _ = works
    flat = records.flatten_works(records.filter_institution(good, "ror", "R1"))
    assert flat.schema.fieldNames() == RECORD.fieldNames()
    latest = records.dedupe_latest(flat).orderBy("id").collect()
    assert [(r["id"], r["year"], r["faculty"], r["abstract"], r["url"]) for r in latest] == [
        ("https://w/W1", 2003, "One", "a b", "https://w/W1"),
        ("https://w/W2", 2000, "One", "a b", "https://w/W2"),
    ]
    assert records.filter_institution(good, "openalex_id", "I1").count() == 4
    assert records.filter_institution(good, "ror", "I1").count() == 0


def test_rows_without_id_are_set_aside(works):
    kept, lost = records.split_rejects(records.flatten_works(works[0]))
    assert kept.count() == 4
    assert [r["title"] for r in lost.collect()] == ["lost"]


def test_dedupe_puts_null_years_last_and_breaks_ties_by_the_rest(spark):
    rows = [("a", None, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q")]
    df = spark.createDataFrame(rows, "id string, year bigint, v string")
    got = {tuple(r) for r in records.dedupe_latest(df).collect()}
    assert got == {("a", 1, "y"), ("b", None, "q")}


def test_dedupe_ranks_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "id string, year bigint")
    plan = records.dedupe_latest(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n", [0, 1, 3, 5, 9])
def test_cap_records(spark, n):
    rows = [("a", 1), ("b", 3), ("c", 3), ("d", None), ("e", None), ("f", 2)]
    df = spark.createDataFrame(rows, "id string, year bigint")
    order = ["b", "c", "f", "a", "d", "e"]
    got = {r["id"] for r in records.cap_records(df, n).collect()}
    assert got == set(order[:n] if n else order)


def test_cap_of_an_empty_table(spark):
    assert records.cap_records(spark.createDataFrame([], "id string, year bigint"), 5).count() == 0


def test_no_batches_give_an_empty_record_table(spark):
    empty = tables.merge_batches(spark, [])
    assert empty.schema == RECORD and not tables.has_rows(empty)


def test_batches_round_trip(spark, works, tmp_path):
    flat = records.flatten_works(works[0])
    tables.write_records(flat, str(tmp_path / "a"))
    tables.write_records(flat.limit(2), str(tmp_path / "b"))
    merged = tables.merge_batches(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert merged.count() == 3 and merged.schema == RECORD


def test_short_queries_find_nothing(spark):
    df = spark.createDataFrame([("1", "MIT", 3), ("2", "Summit Lab", 5), ("3", "Lab of Mites", 1)],
                               "id string, display_name string, works_count bigint")
    assert records.search_institutions(df, "m").count() == 0
    assert [r["id"] for r in records.search_institutions(df, "mi").collect()] == ["1", "3"]
    assert records.search_entities({"a": df}, "m").count() == 0


@pytest.mark.parametrize("n", [1, 10, 400, 1000, 2000])
def test_sample_is_the_hash_order_prefix(spark, n):
    import hashlib

    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    for parts in (1, 16):
        got = {r["id"] for r in sample_points(df.repartition(parts), n).collect()}
        assert got == set(order[:n])


def test_stream_keeps_the_latest_record(spark, tmp_path):
    source, log, state = (str(tmp_path / d) for d in ("in", "log", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(w) for w in WORKS[:1] + WORKS[3:]))
    stream_records(spark, source, log, state).awaitTermination()
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps(w) for w in WORKS[1:3]))
    stream_records(spark, source, log, state).awaitTermination()
    got = {(r["id"], r["year"]) for r in read_latest(spark, log).collect()}
    assert got == {("https://w/W1", 2003), ("https://w/W2", 2000)}


def test_search_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    words = ["river", "rivers", "ri", "oak ridge", "Ríos", "delta", "x", "", "a" * 40, "a" * 35 + "b"]
    rows = [(f"i{i}", " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.randint(0, 9)) for i in range(400)]
    rows += [("none", None, 5), ("empty", "", 3)]
    df = spark.createDataFrame(rows, "id string, display_name string, works_count long")
    entities = {"a": df, "b": df.where("works_count > 4")}
    path = str(tmp_path / "index")
    records.write_search_index(entities, path)
    index = spark.read.parquet(path)
    for q in ("ri", "RI", "rid", "oak r", "x x", "a" * 36, "a" * 35 + "b", "zz", "r", "delta ri", "rí"):
        scan = records.search_entities(entities, q, 50)
        assert [tuple(r) for r in records.search_index(index, q, 50).collect()] == [tuple(r) for r in scan.collect()], q
    assert records.search_index(index.where("false"), "ri").count() == 0


def test_search_index_reads_few_rows(spark, tmp_path):
    df = spark.range(60_000).select(
        F.col("id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" inst")).alias("display_name"), F.col("id").alias("works_count")
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    records.write_search_index({"a": df}, str(tmp_path / "index"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    index = spark.read.parquet(str(tmp_path / "index"))
    hits = records.search_index(index, "abc", 5)
    assert "StringStartsWith(start,abc)" in hits._jdf.queryExecution().executedPlan().toString()
    # The two ends of the sorted index lie in files of their own.
    kept = index.where(F.col("start").startswith("abc")).select(F.input_file_name()).distinct().count()
    assert kept < index.select(F.input_file_name()).distinct().count()
