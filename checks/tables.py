"""Inputs of the registered queries, from the provided tables.

The texts of ``documents`` lack most of what the operators look for.  The
``messages`` table therefore holds every document whole, with marks added
around it, a blank message after each document labelled toxic, and reposts
that equal another message once they are cleaned.  The same
expressions build it in Spark and in the SQL used for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_TEXT = """concat(
    CASE WHEN doc_id % 7 = 0 THEN concat('RT @user', CAST(doc_id % 50 AS STRING), ': ') ELSE '' END,
    text,
    CASE doc_id % 6
      WHEN 0 THEN ' The river took the mill road towards Hatay; two ferries are missing and the ward has no light. Immediately call a medical boat, please help. Au secours, socorro'
      WHEN 1 THEN ' flood damage near Lyon, hospital needs ambulance'
      WHEN 2 THEN ' necesitamos ayuda urgente en San Pedro Sula, San Pedro'
      WHEN 3 THEN ' fire at City Hospital, children missing near Port Market Lyon Hatay'
      WHEN 4 THEN concat(' rain tonight from St. John', chr(39), 's to Washington D.C., then (Stratford-upon-Avon) and - Port Vila; Port Vila]')
      ELSE ' great pizza at Nova Bank' END,
    CASE WHEN doc_id % 4 = 0 THEN ' #MillRoad #NINEFerries' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN concat('  https://t.co/', CAST(doc_id AS STRING), '.JPG') ELSE '' END,
    CASE WHEN doc_id % 9 = 0 THEN ' @rescue_team' ELSE '' END,
    CASE WHEN doc_id % 8 = 3 THEN ' \U0001F525\U0001F198 SOS' ELSE '' END,
    CASE WHEN doc_id % 10 = 7 THEN ' Tu\u0308rkiye\u200b cafe\u0301' ELSE '' END)"""

# Symbols and sequences that stand behind a message, by number, and the word each becomes.
SYMBOL_WORDS = (
    ("\U0001F525", "fire"), ("\U0001F198", "SOS_button"), ("\U0001F1F9\U0001F1F7", "flag_tr"), ("\U0001F1EF\U0001F1F5", "flag_jp"),
    ("1\uFE0F\u20E3", "keycap_1"), ("#\u20E3", "keycap_hash"), ("*\uFE0F\u20E3", "keycap_asterisk"),
    ("\U0001F44D\U0001F3FD", "thumbs_up_medium_skin_tone"), ("\U0001F44D", "thumbs_up"),
    ("\u270A\U0001F3FF", "raised_fist_dark_skin_tone"), ("\u270A", "raised_fist"), ("\u26F0\uFE0F", "mountain"),
    ("\u26F0", "mountain"), ("\U0001F468\u200D\U0001F469\u200D\U0001F467", "man_woman_girl"),
    ("\U0001F469\U0001F3FB\u200D\U0001F692", "woman_light_skin_tone_fire_engine"),
    ("\U0001F3F4\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F", "flag_gbsct"),
    ("\u2764\uFE0F", "red_heart"), ("\u2764\uFE0F\u200D\U0001F525", "red_heart_fire"), ("\u26A0\uFE0F", "warning"),
    ("\u2614", "umbrella_with_rain_drops"), ("\u2708\uFE0F", "airplane"), ("\u2620\uFE0F", "skull_and_crossbones"),
    ("\u2693", "anchor"), ("\u26FA", "tent"), ("\u23F0", "alarm_clock"), ("\u2B50", "white_medium_star"),
    ("\U0001F30A", "water_wave"), ("\U0001F6A8", "police_car_light"), ("\U0001F691", "ambulance"), ("\U0001F64F", "folded_hands"),
    ("\U0001FAE0", "melting_face"), ("\U0001F7E0", "large_orange_circle"), ("\U0001F9EF", "fire_extinguisher"),
    ("\U0001F3FB", "light_skin_tone"),
)


def symbol_case(value, around: str) -> str:
    """SQL: a choice by message of what ``value`` makes of each symbol, between other characters."""
    whens = (f"WHEN {i} THEN '{around.format(value(s, w))}'" for i, (s, w) in enumerate(SYMBOL_WORDS))
    return f"CASE message_id % {len(SYMBOL_WORDS)} " + " ".join(whens) + " END"


DOCUMENT_COLUMNS = {
    "message_id": "2 * doc_id",
    "arrival_seq": "2 * doc_id",
    "lang": "lang",
    "source": "source",
    "text": DOCUMENT_TEXT,
}
BLANK_COLUMNS = {
    "message_id": "2 * doc_id + 1",
    "arrival_seq": "2 * doc_id + 1",
    "lang": "CAST(NULL AS STRING)",
    "source": "'blank'",
    "text": "'   '",
}
REPOSTED = "doc_id % 11 = 5 AND doc_id % 7 <> 0"
REPOST_COLUMNS = {
    "message_id": "2 * doc_id + 4000000001",
    "arrival_seq": "2 * doc_id + 1",
    "lang": "lang",
    "source": "'repost'",
    "text": f"concat('RT @echo: ', {DOCUMENT_TEXT}, ' https://t.co/again')",
}


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


MESSAGES_SQL = f"{_select(DOCUMENT_COLUMNS, 'documents')} UNION ALL {_select(BLANK_COLUMNS, 'labels')} WHERE toxic = 1 UNION ALL {_select(REPOST_COLUMNS, 'documents')} WHERE {REPOSTED}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes as one small file.

    Large tables come as many files and row groups and are left as they are;
    one large file is dealt into parts that do not grow with it.
    """
    if len(df.inputFiles()) != 1:
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits <= cores else 2 * splits)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def messages(spark: SparkSession, sf_dir: str, *, spread_out: bool = True) -> DataFrame:
    given = documents(spark, sf_dir) if spread_out else table(spark, sf_dir, "documents")
    docs = given.selectExpr(*[f"{e} AS {n}" for n, e in DOCUMENT_COLUMNS.items()])
    reposts = given.where(REPOSTED).selectExpr(*[f"{e} AS {n}" for n, e in REPOST_COLUMNS.items()])
    blanks = table(spark, sf_dir, "labels").where("toxic = 1")
    blanks = blanks.selectExpr(*[f"{e} AS {n}" for n, e in BLANK_COLUMNS.items()])
    return docs.unionByName(blanks).unionByName(reposts)


# Small lookup table: name, kind, display name, lat, lng, importance, bbox, country.
GAZETTEER = (
    ("Hatay", "LOC", "Hatay, Turkey", 36.2123456789, 36.1612345678, 0.61, (35.8, 37.0, 35.8, 36.7), "tr"),
    ("Lyon", "LOC", "Lyon, France", 45.7578137, 4.8320114, 0.73, (45.7, 45.81, 4.77, 4.9), "fr"),
    ("Lyon", "LOC", "Lyon, Mississippi", 34.2176, -90.5415, 0.31, (34.2, 34.23, -90.55, -90.53), "us"),
    ("San Pedro Sula", "LOC", "San Pedro Sula, Honduras", 15.5049, -88.0249, 0.55, None, "hn"),
    ("San Pedro", "LOC", "San Pedro, Ivory Coast", 4.7485, -6.6363, None, (4.7, 4.8, -6.7, -6.5), "ci"),
    ("Pedro", "PER", "Pedro", None, None, 0.2, None, None),
    ("City Hospital", "ORG", "City Hospital", 51.5, -0.12, 0.41, (51.4, 51.6), "gb"),
    ("Port Market", "ORG", "Port Market", None, None, 0.33, None, None),
    ("St. John's", "LOC", "St. John's, Newfoundland", 47.5615, -52.7126, 0.58, (47.3, 47.7, -53.0, -52.6), "ca"),
    ("Washington D.C.", "LOC", "Washington, District of Columbia", 38.9072, -77.0369, 0.8, (38.79, 39.0, -77.12, -76.9), "us"),
    ("Stratford-upon-Avon", "LOC", "Stratford-upon-Avon, England", 52.1917, -1.7083, 0.47, None, "gb"),
    ("[Port Vila]", "LOC", "Port Vila, Vanuatu", -17.7334, 168.3273, 0.52, None, "vu"),
    ("Nova Bank", "ORG", "Nova Bank", 40.0, -3.0, 0.44, None, "es"),
)


def gazetteer(spark: SparkSession) -> DataFrame:
    from tocsin import schemas

    return spark.createDataFrame([(*r[:6], list(r[6]) if r[6] else None, r[7]) for r in GAZETTEER], schemas.GAZETTEER)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, tuple):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    return f"{float(value)!r}::DOUBLE"


GAZETTEER_SQL = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in GAZETTEER)
    + ") AS g(name, kind, display_name, lat, lng, importance, bbox, country)"
)
