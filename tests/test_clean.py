import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tocsin.functions import text as X
from tocsin.operators.clean import clean_messages


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "message_id long, text string")
    return clean_messages(df, **options).orderBy("message_id").collect()


def test_blank_and_null(spark):
    rows = run(spark, ["", None, " \t "])
    assert [r.cleaned_text for r in rows] == ["", "", ""]
    assert [r.original_text for r in rows] == ["", "", " \t "]
    assert all(r.urls == [] and r.mentions == [] and r.hashtags == [] for r in rows)
    assert not any(r.has_media for r in rows)


@pytest.mark.parametrize("raw, cleaned", [
    ("Road closed https://example.org/a.jpg use bypass", "Road closed use bypass"),
    ("see www.example.org now", "see now"),
    ("@crew Send boats", "Send boats"),
    ("#RiverWatch at noon", "River Watch at noon"),
    ("#HELPNow #SOS #x_y", "HELP Now SOS x_y"),
    ("RT @user1: shaking felt", "shaking felt"),
    ("rt  @user1:  shaking felt", "shaking felt"),
    ("RT @user1 no colon", "RT no colon"),
    ("much   too \n wide", "much too wide"),
    ("Tu\u0308rkiye\u200b quake", "Türkiye quake"),
    ("Tu\u0308rkiye", "T\u00fcrkiye"),
    ("mail me@host.org", "mail me.org"),
    ("पुल टूट गया है", "पुल टूट गया है"),
    ("الطريق مغلق الآن", "الطريق مغلق الآن"),
    ("\u1112\u1161\u11ab", "\ud55c"),
    ("a # b #", "a # b #"),
])
def test_cleaned(spark, raw, cleaned):
    assert run(spark, [raw])[0].cleaned_text == cleaned


def test_symbols(spark):
    rows = run(spark, ["on fire \U0001F525 need\U0001F198!", "\u2764\ufe0f", "plain"])
    assert [r.cleaned_text for r in rows] == ["on fire fire need SOS_button !", "red_heart", "plain"]
    custom = run(spark, ["x \U0001F1F9\U0001F1F7 y"], aliases={"\U0001F1F9\U0001F1F7": "flag"})
    assert custom[0].cleaned_text == "x flag y"


def test_metadata(spark):
    row = run(spark, ["RT @a: city @b https://t.co/x#Frag.PNG #Rescue #HelpNeeded"])[0]
    assert row.mentions == ["@a", "@b"]
    assert row.urls == ["https://t.co/x#Frag.PNG"]
    assert row.hashtags == ["Frag", "Rescue", "HelpNeeded"]
    assert row.has_media


def test_switches(spark):
    raw = "@a #FloodAlert www.x.org \U0001F525"
    row = run(spark, [raw], remove_urls=False, remove_mentions=False,
              convert_symbols=False, segment_hashtags=False)[0]
    assert row.cleaned_text == raw


def test_normal_form_of_every_character(spark):
    texts = [f"a{chr(p)}b e{chr(p)}" for p in range(0xA1, 0x3200) if unicodedata.category(chr(p))[0] in "LM"]
    rows = run(spark, texts, convert_symbols=False)
    for text, row in zip(texts, rows):
        want = unicodedata.normalize("NFC", text)
        want = re.sub(r"\s+", " ", re.sub("[\u200b\u200c\u200d\ufeff]", "", want)).strip()
        assert row.cleaned_text == want


def test_symbol_sequences(spark):
    cases = {
        "x\U0001F1E9\U0001F1EAy": "x flag_de y", "\U0001F1E9 alone": "\U0001F1E9 alone", "call 112 or #1 *": "call 112 or #1 *",
        "2\uFE0F\u20E3\u26F0": " keycap_2  mountain ", "\U0001F44D\U0001F3FB\U0001F44D": " thumbs_up_light_skin_tone  thumbs_up ",
        "\U0001F468\U0001F3FD\u200D\u2695\uFE0F!": " man_medium_skin_tone_medical_symbol !", "no symbol \u200D here": "no symbol \u200D here",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    found = [r.w for r in df.select("i", X.symbols_to_words(F.col("text")).alias("w")).orderBy("i").collect()]
    assert found == list(cases.values())
    family = run(spark, ["\U0001F468\u200D\U0001F469\u200D\U0001F466 in \U0001F1F9\U0001F1F7"])[0].cleaned_text
    assert family == "man_woman_boy in flag_tr"
