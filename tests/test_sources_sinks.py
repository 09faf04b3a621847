import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tocsin import schemas
from tocsin.plans import views
from tocsin.sinks import writers
from tocsin.sources import readers

SAMPLES = [
    ("Water rising, family on the roof, send boats \U0001F198", "en", "RESCUE_REQUEST", "CRITICAL"),
    ('He said "go", then\nleft, quickly', "en", "SITUATIONAL_UPDATE", "LOW"),
    ("Beautiful evening", "en", "NOT_CRISIS", "NONE"),
]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


def test_json(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"text": "a", "type": "T", "label": "L"}, {"text": "b", "label": "L"}, {"text": "c"}]))
    assert [tuple(r) for r in readers.read_messages_json(spark, str(path), lines=False).collect()] == [("a", "T"), ("b", "L"), ("c", "")]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    one = write_csv(tmp_path / "a.csv", ["id", "tweet_text", "text", "class_label", "type"], [[1, "t, 1\nx", "no", "c", "y"], [2, "t2", "no", "", "y"]])
    assert [tuple(r) for r in readers.read_messages_csv(spark, one).collect()] == [("t, 1\nx", "c"), ("t2", "nan")]
    two = write_csv(tmp_path / "b.csv", ["text", "type"], [["x", "T"]])
    assert readers.read_messages_csv(spark, two).first().label == "T"
    assert readers.read_eval_csv(spark, two).first().label == ""
    three = write_csv(tmp_path / "c.csv", ["body", "type"], [["x", "T"]])
    with pytest.raises(ValueError):
        readers.read_messages_csv(spark, three)


def test_splits(spark, tmp_path):
    write_csv(tmp_path / "my_train.csv", ["tweet_text", "class_label"], [["a", "x"], ["b", "y"]])
    only = readers.read_splits(spark, str(tmp_path))
    assert {(r.text, r.split) for r in only.collect()} == {("a", "train"), ("b", "train"), ("a", "eval"), ("b", "eval")}
    write_csv(tmp_path / "my_test.csv", ["tweet_text", "class_label"], [["t", "x"]])
    write_csv(tmp_path / "my_development.csv", ["tweet_text", "class_label"], [["d", "x"]])
    rows = readers.read_splits(spark, str(tmp_path)).where("split = 'eval'").collect()
    assert [r.text for r in rows] == ["d"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_splits(spark, str(tmp_path / "none"))


def test_parquet_splits(spark, tmp_path):
    df = spark.createDataFrame(SAMPLES, schemas.SAMPLE)
    df.write.parquet(str(tmp_path / "train.parquet"))
    readers.convert_parquet_splits(spark, {"train": str(tmp_path / "train.parquet")}, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out" / "train"))
    assert sorted(map(tuple, back.collect())) == sorted(SAMPLES)


def test_limits_and_requests(spark):
    df = spark.createDataFrame([(3, "x" * 5000), (1, ""), (2, "y" * 5001), (0, None)], "arrival_seq long, text string")
    assert [r.arrival_seq for r in readers.limit_input(df, 2).collect()] == [0, 1]
    assert readers.limit_input(df, None).count() == 4
    rows = {r.arrival_seq: (r.accepted, r.reason) for r in readers.validate_requests(df).collect()}
    assert rows == {3: (True, None), 1: (False, "empty text"), 2: (False, "text too long"), 0: (False, "missing text")}
    batches = spark.range(201).select((F.col("id") >= 100).cast("int").alias("batch_id"), "id")
    got = {r.batch_id: (r["items"], r.accepted) for r in readers.validate_batches(batches).collect()}
    assert got == {0: (100, True), 1: (101, False)}
    assert readers.batches_within(batches).count() == 100


def results(spark):
    place = [("Lyon", "LOC", 0.9, 45.757, 4.832, "Lyon, France", "FR"), ("X", "LOC", 0.8, None, None, None, None)]
    zero = [("Null Island", "LOC", 0.5, 0.0, 0.0, "", "")]
    rows = [
        (1, 1, "a" * 250, "en", True, 0.9, ["RESCUE_REQUEST", "DISPLACEMENT"], {"RESCUE_REQUEST": 0.9}, "LOW", 0.2, place, False, "cluster_000000"),
        (2, 2, "b", "en", True, 1.0, [], {}, "CRITICAL", 0.9, zero, True, "cluster_000000"),
        (3, 3, "c", "fr", False, 0.1, [], {}, "LOW", 0.0, [], False, None),
        (4, 4, "d", "fr", True, 0.65, ["DISPLACEMENT"], {}, "CRITICAL", 0.9, [], False, "cluster_000001"),
        (5, 5, "e", "fr", True, 0.7, ["DISPLACEMENT"], {}, "ODD", 0.9, [], False, "cluster_000002"),
    ]
    schema = (
        "message_id long, arrival_seq long, cleaned_text string, lang_code string, is_relevant boolean, relevance_confidence double,"
        "event_types array<string>, type_scores map<string,double>, urgency_level string, urgency_score double,"
        f"locations array<{schemas.LOCATION.simpleString()}>, is_duplicate boolean, cluster_id string"
    )
    return spark.createDataFrame(rows, schema).withColumns({
        "original_text": F.col("cleaned_text"), "lang_confidence": F.lit(1.0), "lang_method": F.lit("given"),
        "pipeline_version": F.lit("0.1.0"),
    })


def test_views(spark):
    df = results(spark)
    feed = views.priority_feed(df).orderBy("position").collect()
    assert [r.message_id for r in feed] == [2, 4, 1, 5] and [r.position for r in feed] == [1, 2, 3, 4]
    assert feed[2].text == "a" * 200 + "..." and feed[0].types == "—"
    assert feed[2].places == "Lyon (45.76, 4.83), X" and feed[0].places == "Null Island (0.00, 0.00)"
    assert views.headline_metrics(df).first().relevant_share == "80%"
    assert views.headline_metrics(df.where("false")).first().relevant_share == "0%"
    pins = {(r.message_id, r.pos): r for r in views.map_layer(df).collect()}
    assert set(pins) == {(1, 0), (2, 0)}
    assert (pins[1, 0].colour, pins[1, 0].icon) == ("green", "life-ring")
    assert (pins[2, 0].colour, pins[2, 0].icon, pins[2, 0].popup_place) == ("red", "info-sign", "Null Island")
    assert tuple(views.map_centre(df).first()) == (45.757, 4.832)
    assert tuple(views.map_centre(df.where("false")).first()) == (20.0, 0.0)
    cross = {(r.event_type, r.urgency_level): r.messages for r in views.type_by_urgency(df).collect()}
    assert cross[("—", "CRITICAL")] == 1 and cross[("DISPLACEMENT", "CRITICAL")] == 1
    bins = {r.bin: r.messages for r in views.confidence_histogram(df).collect()}
    assert bins == {18: 1, 19: 1, 2: 1, 13: 1, 14: 1}
    assert [r.lang_code for r in views.rate_by_language(df).collect()] == ["fr", "en"]
    assert views.positive_histogram(spark.createDataFrame([(0.0,), (2.0,), (2.0,)], "v double"), "v").first().messages == 2


def test_sinks(spark, tmp_path):
    df = results(spark)
    writers.write_samples(spark.createDataFrame(SAMPLES, schemas.SAMPLE), str(tmp_path / "s"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "s/csv")).collect())) == sorted(SAMPLES)
    assert spark.read.schema(schemas.SAMPLE).json(str(tmp_path / "s/json")).count() == 3
    writers.write_priority_feed(df, str(tmp_path / "feed"))
    feed = readers.read_csv(spark, str(tmp_path / "feed"))
    assert feed.columns == ["urgency", "types", "lang", "text", "locations"] and feed.count() == 4
    writers.write_full_results(df, str(tmp_path / "full"))
    assert readers.read_csv(spark, str(tmp_path / "full")).count() == 5
    writers.write_nested_results(df, str(tmp_path / "nested"))
    lines = [json.loads(x) for f in Path(tmp_path / "nested").glob("part-*") for x in f.read_text().splitlines()]
    first = next(x for x in lines if x["cleaned_text"] == "b")
    assert first["deduplication"] == {"is_duplicate": True, "cluster_id": "cluster_000000"}
    assert first["language"] == {"code": "en", "confidence": 1.0, "method": "given"}
    assert first["locations"][0]["latitude"] == 0.0 and first["pipeline_version"] == "0.1.0"
    assert next(x for x in lines if x["cleaned_text"] == "c")["deduplication"]["cluster_id"] is None
    writers.write_evaluation(views.session_totals(df), df.select("message_id"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev/metrics")).first().metrics.total == 5
