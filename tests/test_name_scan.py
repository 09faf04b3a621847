"""Automata over gazetteer names: scripts without blanks, long names, shards, and kept lookups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks import tables
from tocsin.operators import name_scan, places

EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def gaz(spark, *names):
    rows = [(n, "LOC", n, 1.0, 2.0, 0.5 + i / 1000, None, "jp") for i, n in enumerate(names)]
    from tocsin import schemas
    return spark.createDataFrame(rows, schemas.GAZETTEER)


def found(spark, texts, names, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "message_id long, cleaned_text string")
    rows = places.match_places(df, gaz(spark, *names), **options).orderBy("message_id", "start").collect()
    for r in rows:
        assert texts[r.message_id][r.start:r.end] == r.text
    return [(r.message_id, r.text) for r in rows]


def test_scripts_without_blanks(spark):
    texts = ["昨日東京で地震がありました", "東京都庁とTokyo駅、大阪", "น้ำท่วมกรุงเทพมหานครวันนี้", "Tokyoは「Osaka」", "subTokyo Tokyotown"]
    names = ["東京", "東京都", "大阪", "กรุงเทพมหานคร", "Tokyo", "Osaka"]
    assert found(spark, texts, names) == [
        (0, "東京"), (1, "東京都"), (1, "Tokyo"), (1, "大阪"), (2, "กรุงเทพมหานคร"), (3, "Tokyo"), (3, "Osaka"),
    ]


def test_offsets_where_lower_case_is_longer(spark):
    assert found(spark, ["İİİ then Lyon İzmir."], ["lyon", "İzmir"]) == [(0, "Lyon"), (0, "İzmir")]


def test_long_name_and_null_texts(spark):
    name = " ".join(f"w{i}" for i in range(50))
    assert found(spark, [f"at {name.upper()}, now", None, "", "w1 w2", f"({name})"], [name, "w2"]) == [
        (0, name.upper()), (3, "w2"), (4, name),
    ]


def reference_matches(text, names):
    """Word by word: the longest run of words that equals a name, but for outer marks."""
    words, kept, reach, offset = text.split(" "), [], -1, 0
    for i, word in enumerate(words):
        best = None
        if EDGE.sub("", word):
            for n in range(1, 5):
                raw = " ".join(words[i:i + n])
                if i + n <= len(words) and EDGE.sub("", raw).lower() in names:
                    best = (EDGE.sub("", raw), offset + len(raw) - len(re.sub(r"^[^\w]+", "", raw)))
        if best:
            end = best[1] + len(best[0])
            if end > reach:
                kept.append(best[0])
            reach = max(reach, end)
        offset += len(word) + 1
    return kept


@pytest.mark.parametrize("shard_chars", [4_000_000, 6])
def test_automata_equal_a_search_by_words(spark, shard_chars, monkeypatch):
    rnd = random.Random(3)
    names = {"a", "a b", "b c d", "c", "d.e", "a-b", "e"}
    parts = ["a", "b", "c", "d", "e", "A", "(a", "b)", "d.e", "-", "a-b", "c,", "'e'", "d", "x", "_a"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(300)]
    monkeypatch.setattr(name_scan.shards_of, "__defaults__", (shard_chars,))
    monkeypatch.setattr(name_scan.find_names, "__kwdefaults__", {"shard_chars": shard_chars})
    got = {i: [] for i in range(len(texts))}
    for i, text in found(spark, texts, sorted(names)):
        got[i].append(text)
    assert got == {i: reference_matches(t, names) for i, t in enumerate(texts)}


def mentions(spark, names):
    return spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "message_id long, text string, hint string")


def test_lookups_are_kept_and_asked_once(spark, tmp_path):
    table, gazetteer = places.LookupTable(spark, str(tmp_path / "known")), tables.gazetteer(spark)
    first = mentions(spark, ["Lyon", "lyon", "Nowhere", None, " ", "!!"])
    want = sorted(map(tuple, places.geocode(first, gazetteer).collect()), key=str)
    assert sorted(map(tuple, places.geocode(first, gazetteer, lookups=table).collect()), key=str) == want
    asked = sorted(map(tuple, table.known().select("_key").collect()))
    assert asked == [("lyon",), ("nowhere",)]
    # The second run asks nothing: an empty gazetteer gives the same answers.
    assert sorted(map(tuple, places.geocode(first, gazetteer.limit(0), lookups=table).collect()), key=str) == want
    assert table.known().count() == 2
    more = places.geocode(mentions(spark, ["Hatay", "Lyon"]), gazetteer, lookups=table).collect()
    assert {r.display_name for r in more} == {"Hatay, Turkey", "Lyon, France"} and table.known().count() == 3


def test_hot_name_is_spread(spark):
    names = spark.range(0, 4_000).select(F.col("id").alias("message_id"), F.lit("Lyon").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = places.geocode(names, tables.gazetteer(spark)).where(F.col("display_name") == "Lyon, France")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4_000 and max(sizes) < 1_600
