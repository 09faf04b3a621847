import random

import pytest

from checks import tables
from tocsin import schemas
from tocsin.operators.places import (
    extract_places, geocode, keep_places, locations_by_message, lookup_requests, match_places, merge_adjacent,
)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "message_id long, cleaned_text string")


def test_match_longest_with_offsets(spark):
    df = texts(spark, "Near (Lyon), then San Pedro Sula; san pedro! City Hospital", "nothing here", "", "Lyon")
    found = match_places(df, tables.gazetteer(spark)).orderBy("message_id", "start").collect()
    raw = df.collect()[0].cleaned_text
    assert [(r.message_id, r.text, r.kind) for r in found] == [
        (0, "Lyon", "LOC"), (0, "San Pedro Sula", "LOC"), (0, "san pedro", "LOC"), (0, "City Hospital", "ORG"), (3, "Lyon", "LOC"),
    ]
    assert all(raw[r.start:r.end] == r.text for r in found[:4])


def test_same_mentions_with_few_and_many_names(spark):
    gaz = tables.gazetteer(spark).where("name in ('St. John''s', 'Washington D.C.', 'Lyon', '[Port Vila]')")
    more = spark.range(50_000).selectExpr("concat('Zz', id, ' place') AS name", "'LOC' AS kind", "'' AS display_name")
    long_text = "word " * 20_000 + "(Lyon)"
    rows = ["flood near St. John's and Lyon", "from WASHINGTON D.C., to - Port Vila]", long_text]
    df = texts(spark, *rows)
    named = [(0, "St. John's"), (0, "Lyon"), (1, "WASHINGTON D.C"), (1, "Port Vila"), (2, "Lyon")]
    want = [(i, name, rows[i].index(name)) for i, name in named]
    for names in (gaz, gaz.unionByName(more, allowMissingColumns=True)):
        found = match_places(df, names).orderBy("message_id", "start").collect()
        assert [(r.message_id, r.text, r.start) for r in found] == want


def mention_rows(spark, rows):
    return spark.createDataFrame(rows, "message_id long, text string, kind string, score double, start int, end int")


def test_keep_rules(spark):
    df = mention_rows(spark, [
        (1, " Nile ", "B-LOC", 0.98765, 0, 4), (1, "Support Group", "ORG", 0.9, 6, 19),
        (1, "Acme Ltd", "ORG", 0.9, 20, 28), (1, "Ana", "PER", 0.9, 30, 33), (1, "St Mary HOSPITAL", "ORG", 0.5, 35, 51),
    ])
    rows = keep_places(df).orderBy("start").collect()
    # "Support" holds "port"
    assert [(r.text, r.label) for r in rows] == [("Nile", "LOC"), ("Support Group", "FACILITY"), ("St Mary HOSPITAL", "FACILITY")]
    assert rows[0].confidence == pytest.approx(0.9877, abs=1e-4)


def fold(rows):
    out = []
    for row in rows:
        if out and row["start"] - out[-1]["end"] <= 2 and row["label"] == out[-1]["label"]:
            last = out[-1]
            out[-1] = dict(last, text=f"{last['text']} {row['text']}", end=row["end"],
                           confidence=min(last["confidence"], row["confidence"]))
        else:
            out.append(dict(row))
    return out


def test_merge_matches_a_fold(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for message in range(60):
        at, mine = 0, []
        for i in range(rng.randint(0, 7)):
            at += rng.choice([0, 1, 2, 3, 9])
            end = at + rng.randint(1, 4)
            mine.append({"text": f"w{i}", "label": rng.choice(["LOC", "LOC", "FACILITY"]),
                         "confidence": rng.randint(1, 99) / 100, "start": at, "end": end})
            at = end
        rows += [(message, m["text"], m["label"], m["confidence"], m["start"], m["end"]) for m in mine]
        want |= {(message, m["text"], m["label"], m["confidence"], m["start"], m["end"]) for m in fold(mine)}
    df = spark.createDataFrame(rows, schemas.MENTION).repartition(4)
    assert {tuple(r) for r in merge_adjacent(df).collect()} == want


def test_geocode(spark):
    names = spark.createDataFrame(
        [(1, " lyon ", None, 0), (1, "Lyon", "us", 5), (2, "Atlantis", None, 0), (2, "San Pedro", None, 9),
         (3, "  ", None, 0), (3, "Hatay", "fr", 4), (4, "San Pedro Sula", None, 0)],
        "message_id long, text string, hint string, start int",
    )
    rows = {(r.message_id, r.start): r for r in geocode(names, tables.gazetteer(spark), country_col="hint").collect()}
    assert rows[1, 0].display_name == "Lyon, France" and rows[1, 0].country == "FR"
    assert rows[1, 0].latitude == 45.757814
    assert rows[1, 5].display_name == "Lyon, Mississippi"
    assert rows[2, 0].latitude is None and rows[3, 0].latitude is None and rows[3, 4].latitude is None
    # no importance counts as 0.5, no box as 0.5
    assert rows[2, 9].geo_confidence == pytest.approx(0.6 * 0.5 + 0.4 * (1 - 0.1 * 0.2 / 100), abs=1e-4)
    assert rows[4, 0].geo_confidence == pytest.approx(0.6 * 0.55 + 0.4 * 0.5, abs=1e-4)
    asked = {tuple(r) for r in lookup_requests(names).select("query", "asked").collect()}
    assert ("lyon", 1) in asked and ("Lyon", 1) in asked and len(asked) == 6


def test_located_lists(spark):
    gaz = tables.gazetteer(spark)
    df = texts(spark, "Hatay then Nova Bank then City Hospital and Port Market", "none")
    rows = locations_by_message(geocode(extract_places(df, gaz), gaz)).collect()
    assert len(rows) == 1
    got = [(p.text, p.label, p.country) for p in rows[0].locations]
    assert got == [("Hatay", "LOC", "TR"), ("City Hospital", "FACILITY", "GB"), ("Port Market", "FACILITY", None)]
    assert rows[0].locations[2].latitude is None
