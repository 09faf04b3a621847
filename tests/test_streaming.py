import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import tables
from tocsin.plans import analysis
from tocsin.sources.readers import stream_messages
from tocsin.operators.dedup import deduplicate
from tocsin.streaming import jobs

SCHEMA = "message_id long, arrival_seq long, source string, vector array<double>"


def arrivals(spark, folder, rows=240, files=4):
    """One file per arriving batch, in order."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(rows, 4))
    for i in range(3, rows):
        if rng.random() < 0.5:
            vectors[i] = vectors[i - rng.integers(1, 4)] + 0.2 * rng.normal(size=4)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # a third and more of all messages come from one source
    data = [(i, i, "hot" if i % 5 < 3 else f"s{i % 2}", v.tolist()) for i, v in enumerate(vectors)]
    step = rows // files
    for i in range(files):
        spark.createDataFrame(data[i * step:(i + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def run(writer, folder):
    query = writer.option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("by", [None, "source"])
def test_stream_equals_batch(spark, tmp_path, by):
    folder = str(tmp_path / "in")
    table = arrivals(spark, folder)
    options = dict(text_col=None, by=by, window=9, threshold=0.8)
    stream = stream_messages(spark, folder, table.schema, files_per_batch=1)
    state = jobs.WindowState(spark, str(tmp_path / "state"))
    query = run(jobs.deduplicate_stream(stream, state, **options), str(tmp_path / "cp"))
    assert query.lastProgress["batchId"] >= 3
    want = {tuple(r) for r in deduplicate(table, **options).collect()}
    got = {tuple(r) for r in state.results().select(*deduplicate(table, skip=True, by=by).columns).collect()}
    assert got == want and sum(r.is_duplicate for r in state.results().collect()) > 20
    # a retried batch gives the same answer
    last = table.where("arrival_seq >= 180")
    jobs.check_batch(last, 3, state, **options)
    again = {tuple(r) for r in state.results().select(*deduplicate(table, skip=True, by=by).columns).collect()}
    assert again == want
    # a new run starts from nothing
    fresh = jobs.WindowState(spark, str(tmp_path / "state"), run_id="run-1")
    jobs.check_batch(last, 0, fresh, **options)
    assert fresh.results().agg(F.min("cluster_id")).first()[0] == "cluster_000000"


def test_stream_totals_and_whole_analysis(spark, tmp_path):
    rows = [(i, i, t) for i, t in enumerate(["fire in Lyon", "fire in Lyon", "lunch", " ", "flood near Hatay"])]
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "message_id long, arrival_seq long, text string")
    df.coalesce(1).write.parquet(folder)
    scored = {
        "label_score": F.when(F.col("text").contains("lunch"), 0.2).otherwise(0.9),
        "type_scores_raw": F.array(*[F.lit(0.5 if i == 2 else 0.1) for i in range(8)]),
        "urgency_scores": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        "vector": F.when(F.col("text").contains("fire"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))),
    }
    stream = stream_messages(spark, folder, df.schema).withColumns(scored)
    totals = jobs.stream_totals(jobs.analyse_stream(stream, analysis.ScoreColumns()))
    run(totals.writeStream.outputMode("complete").format("memory").queryName("tot"), str(tmp_path / "cp1"))
    assert tuple(spark.table("tot").first()) == (5, 3, 0)

    job = lambda batch: analysis.analyze(batch, analysis.ScoreColumns(), tables.gazetteer(spark))
    run(jobs.analyse_each_batch(stream, job, str(tmp_path / "out")), str(tmp_path / "cp2"))
    out = {r.message_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [out[i].is_relevant for i in range(5)] == [True, True, False, False, True]
    assert [out[i].is_duplicate for i in range(5)] == [False, True, False, False, True]
    assert out[0].event_types == ["MEDICAL_EMERGENCY"] and out[2].event_types == [] and out[2].locations == []
    assert out[0].locations[0].display_name == "Lyon, France" and out[4].locations[0].text == "Hatay"
    assert out[3].lang_code == "und" and out[3].cluster_id is None and out[3].urgency_level == "LOW"
    batch = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(analysis.running_totals(batch).first()) == (5, 3, 0, 2, 4)
    assert tuple(analysis.batch_totals(batch).first()) == (5, 3, 0)


def test_known_results(spark):
    known = spark.createDataFrame(
        [("a", "tr", 0.9, True, 0.7, ["DISPLACEMENT"], "HIGH", 0.8)],
        "sample_key string, lang_code string, lang_confidence double, is_relevant boolean, relevance_confidence double, "
        "event_types array<string>, urgency_level string, urgency_score double",
    )
    asked = spark.createDataFrame([("a",), ("b",)], "sample_key string")
    rows = {r.sample_key: r for r in analysis.known_results(asked, known).collect()}
    assert rows["a"].lang_code == "tr" and rows["a"].urgency_level == "HIGH"
    assert (rows["b"].lang_code, rows["b"].urgency_score, rows["b"].event_types) == ("und", 0.6, ["SITUATIONAL_UPDATE"])
    assert rows["a"].locations == rows["b"].locations == []
    placed = known.withColumn("locations", F.expr("array(struct('Izmir' AS text, 38.4D AS latitude))"))
    rows = {r.sample_key: r for r in analysis.known_results(asked, placed).collect()}
    assert [tuple(p) for p in rows["a"].locations] == [("Izmir", 38.4)] and rows["b"].locations == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, i, k, [float(x) for x in v]) for i, k, v in rows], SCHEMA)


def rows_of(state):
    return sorted(map(tuple, state.results().select("message_id", "is_duplicate", "cluster_id", "matched_id").collect()))


OPTIONS = dict(text_col=None, by="source", window=3, threshold=0.9)


def test_batch_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    state = jobs.WindowState(spark, str(tmp_path / "s"), buckets=64)
    many = vectors(spark, [(i, f"key{i % 500}", (1, i % 7)) for i in range(1_000)])
    jobs.check_batch(many, 0, state, **OPTIONS)
    before = state.committed(0)
    assert len(before.buckets) > 50
    jobs.check_batch(vectors(spark, [(2_000, "key7", (1, 0))]), 1, state, **OPTIONS)
    after = state.committed(1)
    changed = [b for b in after.buckets if after.buckets[b] != before.buckets.get(b)]
    assert len(changed) == 1 and set(after.buckets) == set(before.buckets)
    written = list((tmp_path / "s" / "run-0" / "state" / after.buckets[changed[0]] / "tail").glob("_bucket=*"))
    assert len(written) == 1
    # Other keys of that bucket still have their window.
    keys = {r["_key"] for r in state.read(after, "opened", [int(changed[0])], "_key string, clusters long").collect()}
    for n, key in enumerate(sorted(keys)[:2]):
        at = int(key.removeprefix("key"))
        jobs.check_batch(vectors(spark, [(3_000 + n, key, (1, (at + 500) % 7))]), 2 + n, state, **OPTIONS)
        found = {r.message_id: r for r in state.results().collect()}[3_000 + n]
        assert found.is_duplicate and found.matched_id in (at, at + 500)


def test_killed_and_repeated_batches(spark, tmp_path, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", (1, i % 4)) for i in range(40)]
    parts = [vectors(spark, rows[i:i + 10]) for i in range(0, 40, 10)]
    want = jobs.WindowState(spark, str(tmp_path / "plain"))
    for i, part in enumerate(parts):
        jobs.check_batch(part, i, want, **OPTIONS)
    state = jobs.WindowState(spark, str(tmp_path / "killed"))
    jobs.check_batch(parts[0], 0, state, **OPTIONS)
    with monkeypatch.context() as patch:
        patch.setattr(state, "commit", lambda record: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # results and state are written, the record is not
            jobs.check_batch(parts[1], 1, state, **OPTIONS)
    assert len(rows_of(state)) == 10 and state.totals().first()["total_processed"] == 10
    for i, part in enumerate(parts[1:], 1):
        jobs.check_batch(part, i, state, **OPTIONS)
        jobs.check_batch(part, i, state, **OPTIONS)  # comes again
    assert rows_of(state) == rows_of(want) and len(rows_of(state)) == 40
    assert tuple(state.totals(window=3).first()) == tuple(want.totals(window=3).first())
    assert state.totals(window=3).first()["dedup_window_size"] == 3


def test_missing_and_foreign_records_raise(spark, tmp_path):
    part = vectors(spark, [(1, "a", (1, 0))])
    state = jobs.WindowState(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no commit record"):
        jobs.check_batch(part, 3, state, **OPTIONS)
    jobs.check_batch(part, 0, state, **OPTIONS)
    later = jobs.WindowState(spark, str(tmp_path / "s"), "run-1", first_batch=5)
    with pytest.raises(ValueError, match="before the first"):
        jobs.check_batch(part, 4, later, **OPTIONS)
    jobs.check_batch(part, 5, later, **OPTIONS)
    copied = tmp_path / "s" / "run-0" / "commits"
    for name in ("batch-000000000005.json",):
        (copied / name.replace("5", "1")).write_bytes((tmp_path / "s" / "run-1" / "commits" / name).read_bytes())
    with pytest.raises(ValueError, match="belongs to batch 5 of run-1"):
        jobs.check_batch(part, 2, state, **OPTIONS)
    assert jobs.WindowState(spark, str(tmp_path / "none")).totals().first()["total_processed"] == 0


def test_places_and_all_totals_on_a_stream(spark, tmp_path):
    texts = ["fire in Lyon", "fire in Lyon", "lunch", " ", "flood near Hatay", "fire in Lyon", "東京 fire", "flood near Hatay"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "message_id long, arrival_seq long, text string")
    scored = {
        "label_score": F.when(F.col("text").contains("lunch"), 0.2).otherwise(0.9),
        "type_scores_raw": F.array(*[F.lit(0.5 if i == 2 else 0.1) for i in range(8)]),
        "urgency_scores": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
    }
    folder = str(tmp_path / "in")
    for i in range(4):
        df.where(f"message_id div 2 = {i}").coalesce(1).write.mode("append").parquet(folder)
    stream = stream_messages(spark, folder, df.schema, files_per_batch=1).withColumns(scored)
    asked = []

    def gazetteer(batch_id):
        asked.append(batch_id)
        base = tables.gazetteer(spark)
        tokyo = base.limit(1).withColumns({"name": F.lit("東京"), "display_name": F.lit("Tokyo")})
        return base.unionByName(tokyo) if batch_id >= 3 else base

    state = jobs.WindowState(spark, str(tmp_path / "state"))
    run(jobs.analyse_whole_stream(stream, state, analysis.ScoreColumns(), gazetteer), str(tmp_path / "cp"))
    out = {r.message_id: r for r in state.results().collect()}
    assert len(out) == 8 and asked == [0, 1, 2, 3]
    assert [out[i].is_duplicate for i in range(8)] == [False, True, False, False, False, True, False, True]
    assert out[5].locations[0].display_name == "Lyon, France" and out[6].locations[0].display_name == "Tokyo"
    assert out[2].locations == [] and out[0].event_types == ["MEDICAL_EMERGENCY"]
    assert tuple(state.totals().first()) == (8, 6, sum(r.is_relevant and r.urgency_level == "CRITICAL" for r in out.values()), 3, 7)
