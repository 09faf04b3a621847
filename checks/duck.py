"""The same answers in DuckDB SQL, for checking."""

from __future__ import annotations

from checks import tables
from checks.catalog import NOISY_TYPE, RELEVANCE_SCORE, TYPE_SCORE, URGENCY_WEIGHT
from tocsin import config as C
from tocsin.functions.text import symbol_aliases
from tocsin.operators.urgency import LEXICON

W, S, NS = C.WORD, C.SPACE, C.NOT_SPACE
URL = rf"(?i)https?://{NS}+|www\.{NS}+"
SHORT = [short for _, short in C.EVENT_TYPES]
LEVELS = [level for level, _ in C.URGENCY_LEVELS]


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def values(rows: list[tuple], columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in row) + ")"
        for row in rows
    ) + f") AS t({columns}))"


M = f"m AS (SELECT *, length(text) AS chars FROM ({tables.MESSAGES_SQL}))"

# --- cleaning --------------------------------------------------------------

USED_SYMBOLS = ("\U0001F525", "\U0001F198")


def symbols(text: str) -> str:
    for s in USED_SYMBOLS:
        text = f"replace({text}, '{s}', ' {symbol_aliases()[s]} ')"
    return text


def segmented(text: str) -> str:
    tag = r"regexp_replace(regexp_replace(x[2:], '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '(?s)#{W}+|[^#]+|#'), "
        f"lambda x: CASE WHEN x LIKE '#_%' THEN {tag} ELSE x END), '')"
    )


def finish(text: str) -> str:
    plain = f"regexp_replace(nfc_normalize({text}), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g')"
    return f"trim(regexp_replace({plain}, '{S}+', ' ', 'g'), ' ')"


REPOST = rf"regexp_replace(t, '(?i)^RT{S}+@{W}+:{S}*', '')"
STAGED = f"staged AS (SELECT *, CASE WHEN text IS NULL OR NOT regexp_matches(text, '{NS}') THEN '' ELSE text END AS t FROM m)"
CLEAN = f"""c1 AS (SELECT *, regexp_replace(regexp_replace({REPOST}, '{URL}', '', 'g'), '@{W}+', '', 'g') AS u FROM staged),
c2 AS (SELECT *, {symbols('u')} AS s FROM c1),
c AS (SELECT *, {finish(segmented('s'))} AS cleaned_text FROM c2)"""
CLEANED = [M, STAGED, CLEAN]

MEDIA = "|".join(m.replace(".", r"\.") for m in C.MEDIA_MARKS)

clean_messages = ctes(*CLEANED) + f"""SELECT message_id, coalesce(text, '') AS original_text, cleaned_text,
  array_to_string(regexp_extract_all(t, '#({W}+)', 1), '|') AS hashtags,
  array_to_string(regexp_extract_all(t, '@{W}+'), '|') AS mentions,
  array_to_string(regexp_extract_all(t, '{URL}'), '|') AS urls,
  len(list_filter(regexp_extract_all(t, '{URL}'), lambda x: regexp_matches(lower(x), '{MEDIA}'))) > 0 AS has_media
FROM c"""

clean_switches_off = ctes(M, STAGED) + f"SELECT message_id, {finish(REPOST)} AS cleaned_text FROM staged"
nfc_normalise = ctes(M) + "SELECT message_id, nfc_normalize(text) AS text FROM m"
SYMBOL_CASE = tables.symbol_case(lambda _, word: f" {word} ", " a{0}b {0} 3")
emoji_words = ctes(M) + f"SELECT message_id, {symbols('text')} || {SYMBOL_CASE} AS text FROM m"

# --- sources ---------------------------------------------------------------

request_validation = """SELECT doc_id, text IS NOT NULL AND length(text) BETWEEN 1 AND 5000 AS accepted,
  CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) < 1 THEN 'empty text'
       WHEN length(text) > 5000 THEN 'text too long' END AS reason FROM documents"""
batch_validation = """SELECT source, count(*) AS items, CASE WHEN count(*) > 100 THEN 'too many items' END AS reason,
  count(*) <= 100 AS accepted FROM documents GROUP BY source"""
limit_input = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100"
csv_roundtrip = "SELECT lang AS label, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang"
json_roundtrip = "SELECT source AS label, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source"

# --- language --------------------------------------------------------------

language_id = """WITH d AS (
  SELECT doc_id, lang, string_split(' ' || trim(replace(lower(text), chr(10), ' '), ' ') || ' ', '') AS c FROM documents),
g AS (SELECT doc_id, lang, unnest([(unicode(c[i]) * 961 + unicode(c[i+1]) * 31 + unicode(c[i+2])) % 32768 for i in range(1, len(c) - 1)]) AS code FROM d),
n AS (SELECT lang, code, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) + 32768 AS total FROM n GROUP BY lang),
p AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents)) AS prior FROM documents GROUP BY lang),
codes AS (SELECT DISTINCT code FROM n),
model AS (SELECT codes.code, t.lang, ln((coalesce(n.n, 0) + 1) / t.total) AS lp
  FROM codes CROSS JOIN t LEFT JOIN n ON n.code = codes.code AND n.lang = t.lang),
counts AS (SELECT doc_id, code, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT doc_id, model.lang, sum(k * lp) + any_value(prior) AS score
  FROM counts JOIN model USING (code) JOIN p ON p.lang = model.lang GROUP BY doc_id, model.lang)
SELECT doc_id, arg_max(lang, score) AS lang_code, 'trigram' AS lang_method FROM s GROUP BY doc_id"""

# --- prototypes ------------------------------------------------------------


def prototypes(labels: list[int]) -> str:
    return f"""mean AS (SELECT label, pos, avg(x) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
    WHERE label IN ({', '.join(map(str, labels))})) GROUP BY label, pos),
norm AS (SELECT label, sqrt(sum(x * x)) AS n FROM mean GROUP BY label),
proto AS (SELECT label, list(x / n ORDER BY pos) AS v FROM mean JOIN norm USING (label) GROUP BY label),
sims AS (SELECT vec_id, proto.label AS pos, list_dot_product(embedding::DOUBLE[], v) AS s FROM embeddings CROSS JOIN proto)"""


prototype_scores = ctes(prototypes([0, 1])) + """, e AS (SELECT vec_id, pos, exp(round(s, 10) * 10) AS w FROM sims),
p AS (SELECT vec_id, max(CASE WHEN pos = 0 THEN w END) / sum(w) AS share FROM e GROUP BY vec_id)
SELECT vec_id, share >= 0.65 AS is_relevant, round(share, 4) AS relevance_confidence,
  CASE WHEN share >= 0.65 THEN 'RELEVANT' ELSE 'NOT_RELEVANT' END AS relevance_label FROM p"""


def typed(source: str, key: str) -> str:
    """Kept labels, best label and score map from ``source(key, pos, score)``."""
    names = values([(i, s) for i, s in enumerate(SHORT)], "pos, short")
    return f"""typed AS (SELECT {key},
    CASE WHEN max(score) >= 0.4 THEN string_agg(CASE WHEN score >= 0.4 THEN short END, '|' ORDER BY score DESC, pos)
         ELSE arg_max(short, (score, -pos)) END AS event_types,
    arg_max(short, (score, -pos)) AS top_label, round(max(score), 4) AS top_score,
    string_agg(format('{{:.4f}}', round(score, 4)), '|' ORDER BY pos) AS type_scores
  FROM {source} JOIN {names} USING (pos) GROUP BY {key})"""


event_type_labels = ctes(
    prototypes(list(range(8))),
    "raw AS (SELECT vec_id, pos, round(1 / (1 + exp(-10 * (s - 0.3))), 8) AS score FROM sims)",
    typed("raw", "vec_id"),
) + "SELECT vec_id, event_types, top_label, top_score, type_scores FROM typed"

# --- urgency ---------------------------------------------------------------

BOOST = "least(1.0::DOUBLE, 0.0::DOUBLE + " + " + ".join(
    f"CASE WHEN contains(low, '{k}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for k, w in LEXICON.items()
) + ")"
KEYWORDS = "[" + ", ".join(f"'{k}'" for k in LEXICON) + "]"


def label_rows(labels: list[str], score: str) -> str:
    rows = values([(i, s) for i, s in enumerate(labels)], "pos, label")
    return f"(SELECT message_id, pos, label, {score} AS score FROM m CROSS JOIN {rows} AS l)"


WEIGHTS = f"weights AS {label_rows(LEVELS, URGENCY_WEIGHT)}"
SHARES = "shares AS (SELECT message_id, pos, score / sum(score) OVER (PARTITION BY message_id)::DOUBLE AS share FROM weights)"
SEMANTIC = "semantic AS (SELECT message_id, 0.0::DOUBLE + " + " + ".join(
    f"max(CASE WHEN pos = {i} THEN share END) * {w}::DOUBLE" for i, (_, w) in enumerate(C.URGENCY_LEVELS)
) + " AS sem FROM shares GROUP BY message_id)"
BOOSTED = f"boosted AS (SELECT *, {BOOST} AS boost FROM (SELECT *, lower(cleaned_text) AS low FROM c))"
URGENT = """urgent AS (SELECT boosted.*, CASE WHEN cleaned_text = '' THEN 0.0 ELSE boost END AS keyword_boost_raw,
    CASE WHEN cleaned_text = '' THEN 0.0 ELSE least(1.0::DOUBLE, sem * 0.7::DOUBLE + boost * 0.3::DOUBLE) END AS urgency_raw
  FROM boosted JOIN semantic USING (message_id))"""
URGENCY = [WEIGHTS, SHARES, SEMANTIC, BOOSTED, URGENT]


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 0.85 THEN 'CRITICAL' WHEN {score} >= 0.65 THEN 'HIGH' WHEN {score} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


urgency = ctes(*CLEANED, *URGENCY) + f"""SELECT message_id, {level('urgency_raw')} AS urgency_level,
  round(urgency_raw, 4) AS urgency_score, round(keyword_boost_raw, 4) AS keyword_boost,
  array_to_string(list_filter({KEYWORDS}, lambda k: contains(low, k)), '|') AS keywords FROM urgent"""

# --- places ----------------------------------------------------------------

EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
LEAD = r"^[^\p{L}\p{N}_]+"
GAZ = f"gaz AS ({tables.GAZETTEER_SQL})"
NAME_KEY = f"lower(regexp_replace(trim(name), '{EDGE}', '', 'g'))"
NAMES = f"""names AS (SELECT {NAME_KEY} AS key, arg_min(kind, (-coalesce(importance, 0.5), display_name)) AS kind,
    max(coalesce(importance, 0.5)) AS score FROM gaz GROUP BY {NAME_KEY})"""


def mentions(source: str) -> list[str]:
    return [
        GAZ,
        NAMES,
        f"words AS (SELECT message_id, string_split(cleaned_text, ' ') AS w FROM {source} WHERE cleaned_text <> '')",
        "starts AS (SELECT message_id, w, unnest(range(len(w))) AS i FROM words)",
        f"""spans AS (SELECT message_id, w, i, n, array_to_string(w[i+1:i+n], ' ') AS raw
    FROM starts CROSS JOIN range(1, 4) AS r(n) WHERE i + n <= len(w)
    AND regexp_matches(w[i+1], '[\\p{{L}}\\p{{N}}_]'))""",
        f"""hits AS (SELECT message_id, i, n, kind, score, text,
      (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1:i], ' ')) + 1 END
        + length(raw) - length(regexp_replace(raw, '{LEAD}', '')))::INT AS start
    FROM (SELECT *, regexp_replace(raw, '{EDGE}', '', 'g') AS text FROM spans) s JOIN names ON key = lower(text))""",
        """longest AS (SELECT *, (start + length(text))::INT AS "end" FROM hits
    QUALIFY row_number() OVER (PARTITION BY message_id, i ORDER BY n DESC) = 1)""",
        """found AS (SELECT message_id, text, kind, score, start, "end" FROM (SELECT *, max("end") OVER
      (PARTITION BY message_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM longest)
    WHERE reach IS NULL OR "end" > reach)""",
    ]


FACILITY = "|".join(C.FACILITY_KEYWORDS)
MERGED = [
    f"""kept AS (SELECT * FROM (SELECT message_id, text, CASE WHEN kind LIKE '%LOC%' THEN 'LOC'
      WHEN kind LIKE '%ORG%' AND regexp_matches(lower(text), '{FACILITY}') THEN 'FACILITY' END AS label,
      round(score, 4) AS confidence, start, "end" FROM found) WHERE label IS NOT NULL)""",
    """marked AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label
      OR start - lag("end") OVER w > 2 THEN 1 ELSE 0 END AS fresh FROM kept WINDOW w AS (PARTITION BY message_id ORDER BY start, "end"))""",
    """islands AS (SELECT *, sum(fresh) OVER (PARTITION BY message_id ORDER BY start, "end") AS island FROM marked)""",
    """merged AS (SELECT message_id, string_agg(text, ' ' ORDER BY start) AS text, label, min(confidence) AS confidence,
      min(start) AS start, arg_max("end", start) AS "end" FROM islands GROUP BY message_id, island, label)""",
]
CONFIDENCE = """round(least(1.0, coalesce(importance, 0.5) * 0.6 + CASE WHEN len(bbox) = 4
      THEN greatest(0.0, 1.0 - abs(bbox[2] - bbox[1]) * abs(bbox[4] - bbox[3]) / 100.0) ELSE 0.5 END * 0.4), 4)"""
ENTRIES = f"""entries AS (SELECT {NAME_KEY} AS key, upper(country) AS hint, round(lat, 6) AS latitude, round(lng, 6) AS longitude,
    display_name, upper(country) AS country, {CONFIDENCE} AS geo_confidence, coalesce(importance, 0.5) AS imp FROM gaz)"""
ANYWHERE = "anywhere AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY imp DESC, display_name) = 1)"
LOCAL = "local AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key, hint ORDER BY imp DESC, display_name) = 1)"

place_mentions = ctes(*CLEANED, *mentions("c")) + "SELECT * FROM found"
merged_mentions = ctes(*CLEANED, *mentions("c"), *MERGED) + "SELECT * FROM merged"
lookup_requests = ctes(*CLEANED, *mentions("c"), *MERGED) + "SELECT text AS query, count(*) AS asked FROM merged GROUP BY text"
geocoded = ctes(*CLEANED, *mentions("c"), *MERGED, ENTRIES, ANYWHERE, LOCAL) + """SELECT message_id, start, text,
  CASE WHEN message_id % 3 = 0 THEN l.latitude ELSE a.latitude END AS latitude,
  CASE WHEN message_id % 3 = 0 THEN l.longitude ELSE a.longitude END AS longitude,
  CASE WHEN message_id % 3 = 0 THEN l.display_name ELSE a.display_name END AS display_name,
  CASE WHEN message_id % 3 = 0 THEN l.country ELSE a.country END AS country,
  CASE WHEN message_id % 3 = 0 THEN l.geo_confidence ELSE a.geo_confidence END AS geo_confidence
FROM merged LEFT JOIN anywhere a ON a.key = lower(text) LEFT JOIN local l ON l.key = lower(text) AND l.hint = 'US'"""
place_recall = ctes(*CLEANED, *mentions("c"), *MERGED, ENTRIES, ANYWHERE) + """SELECT
  round(count(CASE WHEN latitude IS NOT NULL THEN 1 END) / count(*), 4) AS place_recall, count(*) AS places
FROM (SELECT DISTINCT message_id, text FROM merged) LEFT JOIN anywhere ON key = lower(text)"""

# --- duplicates ------------------------------------------------------------


def vectors_of(source: str, text: str) -> list[str]:
    """Unit vectors of hashed words and word pairs of ``source(message_id, seq)``."""
    return [
        f"toks AS (SELECT message_id, seq, regexp_extract_all(lower({text}), '{W}+') AS w FROM {source})",
        "terms AS (SELECT message_id, unnest(list_concat(w, [w[i] || ' ' || w[i+1] for i in range(1, len(w))])) AS term FROM toks)",
        "codes AS (SELECT message_id, ('0x' || substr(md5(term), 1, 6))::INT % 512 AS code FROM terms)",
        "cells AS (SELECT message_id, code % 256 AS b, sum(CASE WHEN code < 256 THEN 1 ELSE -1 END)::DOUBLE AS v FROM codes GROUP BY ALL)",
        "norms AS (SELECT message_id, sqrt(sum(v * v)) AS n FROM cells GROUP BY message_id)",
        """vecs AS (SELECT toks.message_id, toks.seq, list(CASE WHEN n > 0 THEN coalesce(v, 0) / n ELSE 0.0 END ORDER BY r.b) AS vec
    FROM toks CROSS JOIN range(256) AS r(b) LEFT JOIN norms USING (message_id)
    LEFT JOIN cells ON cells.message_id = toks.message_id AND cells.b = r.b GROUP BY toks.message_id, toks.seq)""",
    ]


def checked(vectors: str, window: int, threshold: float, by: str | None = None) -> list[str]:
    """Duplicate check of ``vectors(message_id, seq, vec)`` in order of seq."""
    part = f"PARTITION BY {by} " if by else ""
    same = f"AND b.{by} = a.{by} " if by else ""
    key = f"{by}, " if by else ""
    return [
        f"n AS (SELECT {key}message_id, vec, row_number() OVER ({part}ORDER BY seq, message_id) - 1 AS idx FROM {vectors})",
        f"""pairs AS (SELECT a.message_id, a.idx, b.idx AS j, b.message_id AS other, round(list_dot_product(a.vec, b.vec), 10) AS s
    FROM n a JOIN n b ON b.idx < a.idx AND b.idx >= a.idx - {window} {same})""",
        "best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY s DESC, j) = 1)",
        f"""links AS (SELECT n.*, s, CASE WHEN s >= {threshold} THEN j END AS parent, CASE WHEN s >= {threshold} THEN other END AS matched_id
    FROM n LEFT JOIN best USING (message_id))""",
        f"""walk(message_id, {key}cur) AS (SELECT message_id, {key}idx FROM links UNION ALL
    SELECT w.message_id, {'w.' + by + ', ' if by else ''}p.parent FROM walk w JOIN links p ON p.idx = w.cur
    {'AND p.' + by + ' = w.' + by if by else ''} WHERE p.parent IS NOT NULL)""",
        "heads AS (SELECT message_id, min(cur) AS head FROM walk GROUP BY message_id)",
        f"opened AS (SELECT {key}idx AS head, row_number() OVER ({part}ORDER BY idx) - 1 AS cluster FROM links WHERE parent IS NULL)",
        f"""dup AS (SELECT links.message_id, {'links.' + by + ', ' if by else ''}parent IS NOT NULL AS is_duplicate, cluster AS cluster_number,
      format('cluster_{{:06d}}', cluster) AS cluster_id, coalesce(round(s, 4), 0.0) AS similarity, matched_id
    FROM links JOIN heads USING (message_id) JOIN opened ON opened.head = heads.head {'AND opened.' + by + ' = links.' + by if by else ''})""",
    ]


EMB = "emb AS (SELECT vec_id AS message_id, vec_id AS seq, embedding::DOUBLE[] AS vec, label::VARCHAR AS source FROM embeddings)"
dedup_vectors = ctes(EMB, *checked("emb", 100, 0.3)) + "SELECT message_id, is_duplicate, cluster_id, similarity, matched_id FROM dup"
stream_dedup = dedup_vectors
stream_dedup_by_key = ctes(EMB, *checked("emb", 20, 0.25, "source")) + (
    "SELECT source, message_id, is_duplicate, cluster_id, similarity, matched_id FROM dup"
)
DOCS = "docs AS (SELECT doc_id AS message_id, doc_id AS seq, text FROM documents)"
DOC_DUP = [DOCS, *vectors_of("docs", "text"), *checked("vecs", 500, 0.85)]
dedup_documents = ctes(*DOC_DUP) + """SELECT dup.message_id, is_duplicate, cluster_id, similarity, matched_id, docs.text AS matched_text
FROM dup LEFT JOIN docs ON docs.message_id = dup.matched_id"""
KEYED = "keyed AS (SELECT vecs.*, source FROM vecs JOIN documents ON doc_id = message_id)"
dedup_by_key = ctes(DOCS, *vectors_of("docs", "text"), KEYED, *checked("keyed", 50, 0.6, "source")) + (
    "SELECT source, message_id, is_duplicate, cluster_id, similarity, matched_id FROM dup"
)
cluster_summary = ctes(*DOC_DUP) + """SELECT cluster_id, count(*) AS messages, arg_min(docs.text, docs.seq) AS first_text
FROM dup JOIN docs USING (message_id) GROUP BY cluster_id"""
window_count = ctes(*CLEANED) + "SELECT least(500, count(*) FILTER (cleaned_text <> ''))::BIGINT AS dedup_window_size FROM c"

# --- analysis --------------------------------------------------------------

TYPES = f"type_rows AS {label_rows(SHORT, TYPE_SCORE)}"
RESULTS = [
    *CLEANED, *URGENCY, TYPES, typed("type_rows", "message_id"),
    f"""base AS (SELECT u.*, CASE WHEN cleaned_text <> '' THEN coalesce(lang, 'und') ELSE 'und' END AS lang_code,
      CASE WHEN cleaned_text = '' THEN 'none' WHEN lang IS NULL THEN 'failed' ELSE 'given' END AS lang_method,
      cleaned_text <> '' AND share >= 0.65 AS is_relevant,
      CASE WHEN cleaned_text = '' THEN 0.0 ELSE round(share, 4) END AS relevance_confidence
    FROM (SELECT *, {RELEVANCE_SCORE} AS share FROM urgent) u)""",
    "rel AS (SELECT * FROM base WHERE is_relevant)",
    *mentions("rel"), *MERGED, ENTRIES, ANYWHERE,
    """placed AS (SELECT merged.*, latitude, longitude, display_name, country,
      text || CASE WHEN latitude IS NULL THEN '' ELSE format(' ({:.2f}, {:.2f})', latitude, longitude) END AS label_text
    FROM merged LEFT JOIN anywhere ON key = lower(text))""",
    """located AS (SELECT message_id, string_agg(label_text, '|' ORDER BY start) AS locations,
      string_agg(text, ', ' ORDER BY start) AS place_names, string_agg(label_text, ', ' ORDER BY start) AS place_text,
      arg_min(text, start) AS first_place, arg_min(country, start) AS first_country FROM placed GROUP BY message_id)""",
    f"""r AS (SELECT base.message_id, arrival_seq, text, cleaned_text, lang_code, lang_method, is_relevant, relevance_confidence,
      CASE WHEN is_relevant THEN typed.event_types ELSE '' END AS event_types,
      CASE WHEN is_relevant THEN typed.type_scores ELSE 'null|null|null|null|null|null|null|null' END AS type_scores,
      CASE WHEN is_relevant THEN {level('urgency_raw')} ELSE 'LOW' END AS urgency_level,
      CASE WHEN is_relevant THEN round(urgency_raw, 4) ELSE 0.0 END AS urgency_score,
      coalesce(locations, '') AS locations, coalesce(place_names, '') AS place_names, coalesce(place_text, '') AS place_text,
      first_place, first_country
    FROM base JOIN typed USING (message_id) LEFT JOIN located USING (message_id))""",
]
RESULT_DUP = [
    *RESULTS,
    "entering AS (SELECT message_id, arrival_seq AS seq, cleaned_text AS body FROM r WHERE cleaned_text <> '')",
    *vectors_of("entering", "body"), *checked("vecs", 500, 0.85),
    """rd AS (SELECT r.*, coalesce(is_duplicate, false) AS is_duplicate, cluster_id,
      coalesce(similarity, 0.0) AS similarity, matched_id FROM r LEFT JOIN dup USING (message_id))""",
]
TYPE_LIST = "replace(event_types, '|', ', ')"

analyze = ctes(*RESULT_DUP) + """SELECT message_id, cleaned_text, lang_code, lang_method, is_relevant, relevance_confidence,
  event_types, type_scores, urgency_level, urgency_score, locations, is_duplicate, cluster_id, similarity, matched_id,
  '0.1.0' AS pipeline_version FROM rd"""
analyze_json = ctes(*RESULT_DUP) + """SELECT message_id, lang_code AS code, urgency_level AS level,
  CASE WHEN is_relevant THEN 'true' ELSE 'false' END AS relevant, nullif(string_split(event_types, '|')[1], '') AS first_type,
  first_place, first_country, cluster_id AS cluster, '0.1.0' AS version FROM rd"""
analyze_response = ctes(*RESULTS) + """SELECT message_id, CAST(NULL AS VARCHAR) AS version, urgency_level AS level, 11 AS fields FROM r"""

known_results = """WITH known AS (SELECT source, min(lang) AS lang_code, max(quality) = 1 AS is_relevant,
    round(avg(quality), 4) AS relevance_confidence, min(documents.doc_id)::DOUBLE AS latitude
  FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING sum(toxic) >= 2)
SELECT doc_id, coalesce(k.lang_code, 'und') AS lang_code, CASE WHEN k.source IS NULL THEN 0.8 ELSE 0.9 END::DOUBLE AS lang_confidence,
  coalesce(k.is_relevant, true) AS is_relevant, coalesce(k.relevance_confidence, 0.85) AS relevance_confidence,
  CASE WHEN k.source IS NULL THEN 'SITUATIONAL_UPDATE' ELSE 'RESCUE_REQUEST' END AS event_types,
  CASE WHEN k.source IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS urgency_level,
  CASE WHEN k.source IS NULL THEN 0.6 ELSE 0.75 END::DOUBLE AS urgency_score,
  CASE WHEN k.source IS NULL THEN '[]' ELSE concat('[{"text":"place ', k.lang_code, '","label":"LOC","latitude":', k.latitude, '}]') END AS locations,
  false AS is_duplicate, CAST(NULL AS VARCHAR) AS cluster_id
FROM documents d LEFT JOIN known k ON k.source = d.source"""

batch_totals = ctes(*RESULTS) + """SELECT count(*) AS total_processed, count(*) FILTER (is_relevant) AS total_relevant,
  count(*) FILTER (urgency_level = 'CRITICAL') AS total_critical FROM r"""
running_totals = ctes(*RESULT_DUP) + """SELECT count(*) AS total_processed, count(*) FILTER (is_relevant) AS total_relevant,
  count(*) FILTER (is_relevant AND urgency_level = 'CRITICAL') AS total_critical, count(*) FILTER (is_duplicate) AS total_duplicates,
  least(500, count(*) FILTER (cleaned_text <> ''))::BIGINT AS dedup_window_size FROM rd"""
session_totals = ctes(*RESULT_DUP) + """SELECT count(*) AS total, count(*) FILTER (is_relevant) AS relevant,
  count(*) FILTER (is_relevant AND urgency_level = 'CRITICAL') AS critical, count(*) FILTER (is_duplicate) AS duplicates FROM rd"""
headline_metrics = ctes(*RESULT_DUP) + """SELECT count(*) AS total, count(*) FILTER (is_relevant) AS relevant,
  count(*) FILTER (urgency_level = 'CRITICAL') AS critical, count(*) FILTER (is_duplicate) AS duplicates,
  format('{:.0f}%', 100.0 * count(*) FILTER (is_relevant) / count(*)) AS relevant_share FROM rd"""

# --- views -----------------------------------------------------------------

RANK = "CASE urgency_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
FEED = f"""feed AS (SELECT row_number() OVER (ORDER BY {RANK}, arrival_seq, message_id) AS position, message_id, arrival_seq, urgency_level,
    CASE WHEN event_types = '' THEN '—' ELSE {TYPE_LIST} END AS types, lang_code AS lang,
    CASE WHEN length(cleaned_text) > 200 THEN substr(cleaned_text, 1, 200) || '...' ELSE cleaned_text END AS text, place_text AS places
  FROM r WHERE is_relevant)"""
priority_feed = ctes(*RESULTS, FEED) + "SELECT * FROM feed"
feed_heading = ctes(*RESULTS, FEED) + (
    "SELECT position, '#' || position || ' — ' || urgency_level || ' | ' || types || ' | ' || lang AS heading FROM feed"
)
feed_export = ctes(*RESULTS) + f"""SELECT urgency_level AS urgency, {TYPE_LIST} AS types, lang_code AS lang,
  substr(cleaned_text, 1, 200) AS text, place_names AS locations FROM r WHERE is_relevant"""


def choice(value: str, options: dict[str, str], default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in options.items()) + f" ELSE '{default}' END"


PINS = """pins AS (SELECT r.*, placed.text AS place, placed.latitude, placed.longitude, placed.display_name, placed.start,
    (row_number() OVER (PARTITION BY r.message_id ORDER BY placed.start) - 1)::INT AS pos
  FROM r JOIN placed USING (message_id) WHERE is_relevant)"""
map_layer = ctes(*RESULTS, PINS) + f"""SELECT message_id, pos, latitude, longitude,
  {choice('urgency_level', C.MARKER_COLOURS, C.DEFAULT_COLOUR)} AS colour,
  {choice("string_split(event_types, '|')[1]", C.MARKER_ICONS, C.DEFAULT_ICON)} AS icon,
  urgency_level || ': ' || place AS tooltip, urgency_level || ' — ' || {TYPE_LIST} AS heading,
  CASE WHEN urgency_level = 'CRITICAL' THEN '#ff4757' ELSE '#333' END AS heading_colour,
  substr(cleaned_text, 1, 200) AS popup_text, coalesce(nullif(display_name, ''), place) AS popup_place, lang_code AS popup_language
FROM pins WHERE latitude IS NOT NULL"""
map_centre = ctes(*RESULTS, PINS) + """SELECT coalesce(arg_min(latitude, (arrival_seq, start)), 20.0) AS latitude,
  coalesce(arg_min(longitude, (arrival_seq, start)), 0.0) AS longitude FROM pins WHERE latitude IS NOT NULL"""
urgency_distribution = ctes(*RESULTS) + "SELECT urgency_level, count(*) AS messages FROM r WHERE is_relevant GROUP BY urgency_level"
EXPLODED = "x AS (SELECT unnest(string_split(event_types, '|')) AS event_type, urgency_level FROM r WHERE is_relevant)"
type_distribution = ctes(*RESULTS, EXPLODED) + "SELECT event_type, count(*) AS messages FROM x GROUP BY event_type"
language_distribution = ctes(*RESULTS) + "SELECT lang_code, count(*) AS messages FROM r GROUP BY lang_code"
confidence_histogram = ctes(*RESULTS) + """SELECT least(floor(relevance_confidence * 20), 19)::INT AS bin,
  least(floor(relevance_confidence * 20), 19) / 20.0::DOUBLE AS low, (least(floor(relevance_confidence * 20), 19) + 1) / 20.0::DOUBLE AS high,
  count(*) AS messages, 0.65::DOUBLE AS threshold FROM r GROUP BY 1, 2, 3"""
time_histogram = """WITH v AS (SELECT value AS v FROM events WHERE value > 0),
l AS (SELECT min(v) AS lo, (max(v) - min(v)) / 15 AS width FROM v),
b AS (SELECT least(floor((v - lo) / width), 14)::INT AS bin, count(*) AS messages FROM v, l GROUP BY 1)
SELECT bin, round(lo + width * bin, 6) AS low, round(lo + width * (bin + 1), 6) AS high, messages FROM b, l"""
type_by_urgency = ctes(*RESULTS, EXPLODED) + """SELECT CASE WHEN event_type = '' THEN '—' ELSE event_type END AS event_type,
  urgency_level, count(*) AS messages FROM x GROUP BY 1, 2"""
type_by_urgency_wide = ctes(*RESULTS, EXPLODED) + "SELECT event_type, " + ", ".join(
    f"count(*) FILTER (urgency_level = '{v}') AS \"{v}\"" for v in LEVELS
) + " FROM x GROUP BY event_type"
rate_by_language = ctes(*RESULTS) + """SELECT lang_code, count(*) FILTER (is_relevant) / count(*) AS relevance_rate,
  count(*) AS messages FROM r GROUP BY lang_code"""
results_table = ctes(*RESULT_DUP) + f"""SELECT message_id, arrival_seq, CASE WHEN is_relevant THEN '✅' ELSE '❌' END AS relevant,
  CASE WHEN is_relevant THEN urgency_level ELSE '-' END AS urgency,
  CASE WHEN event_types = '' THEN '-' ELSE {TYPE_LIST} END AS types, lang_code AS language,
  CASE WHEN place_names = '' THEN '-' ELSE place_names END AS locations, CASE WHEN is_duplicate THEN '🔁' ELSE '' END AS duplicate,
  CASE WHEN length(cleaned_text) > 80 THEN substr(cleaned_text, 1, 80) || '...' ELSE cleaned_text END AS text, '0' AS time_ms FROM rd"""
class_distribution = "SELECT event_type AS label, count(*) AS rows FROM events GROUP BY event_type"

# --- evaluation ------------------------------------------------------------

GOLD = """g AS (SELECT doc_id, lang, text, CASE WHEN quality = 1 THEN 'rescue' WHEN toxic = 1 THEN 'NOT_CRISIS' ELSE 'not_humanitarian' END AS label,
    (n_chars % 101) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"""
JUDGED = "j AS (SELECT *, score >= 0.5 AS flag, lower(label) NOT LIKE '%not%' AS gold FROM g)"
COUNTS = """count(*) FILTER (flag AND gold) AS tp, count(*) FILTER (flag AND NOT gold) AS fp,
  count(*) FILTER (NOT flag AND gold) AS fn, count(*) FILTER (NOT flag AND NOT gold) AS tn"""
QUALITY = """round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0)
    / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1,
  round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, tp + fp + fn + tn AS n_samples, tp, fp, fn, tn"""

gold_rules = ctes(GOLD) + """SELECT doc_id, lower(label) NOT LIKE '%not%' AS by_substring, lower(label) <> 'not_humanitarian' AS by_name,
  score >= 0.5 AS flag FROM g"""
evaluation_rows = ctes(GOLD, JUDGED) + """SELECT doc_id, substr(text, 1, 80) || '...' AS text, label AS gold, flag AS pred_relevant,
  gold AS gold_relevant, flag = gold AS match FROM j"""
confusion = ctes(GOLD, JUDGED) + f"SELECT {COUNTS} FROM j"
quality = ctes(GOLD, JUDGED, f"k AS (SELECT {COUNTS} FROM j)") + f"SELECT {QUALITY} FROM k"
quality_by_language = ctes(GOLD, JUDGED, f"k AS (SELECT lang, {COUNTS} FROM j GROUP BY lang)") + f"SELECT lang, {QUALITY} FROM k"
POINTS = [
    GOLD,
    """p AS (SELECT score, count(*) FILTER (lower(label) <> 'not_humanitarian') AS pos,
    count(*) FILTER (lower(label) = 'not_humanitarian') AS neg FROM g GROUP BY score)""",
    """s AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM p)""",
]
roc_curve = ctes(*POINTS) + """SELECT score AS threshold, (fp / all_neg)::DOUBLE AS fpr, (tp / all_pos)::DOUBLE AS tpr FROM s
UNION ALL SELECT NULL, 0.0, 0.0"""
AREA = """a AS (SELECT (fp / all_neg)::DOUBLE AS x, (tp / all_pos)::DOUBLE AS y, coalesce(lag(fp / all_neg) OVER (ORDER BY score DESC), 0) AS x0,
    coalesce(lag(tp / all_pos) OVER (ORDER BY score DESC), 0) AS y0 FROM s)"""
auc = ctes(*POINTS, AREA) + "SELECT round(sum((x - x0) * (y + y0) / 2), 4) AS auc FROM a"
precision_recall_curve = ctes(*POINTS) + """SELECT score AS threshold, (tp / (tp + fp))::DOUBLE AS precision, (tp / all_pos)::DOUBLE AS recall FROM s
UNION ALL SELECT NULL, 1.0, 0.0"""
average_precision = ctes(*POINTS) + """SELECT round(sum((pos / all_pos) * (tp / (tp + fp))), 4) AS average_precision FROM s"""
GUESS = """z AS (SELECT lang AS gold, CASE n_chars % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' ELSE 'en' END AS pred FROM documents)"""
macro_f1 = ctes(GUESS) + """SELECT round(avg(2 * hits / (g + p)), 4) AS macro_f1 FROM (SELECT label, (SELECT count(*) FROM z WHERE gold = label) AS g,
  (SELECT count(*) FROM z WHERE pred = label) AS p, (SELECT count(*) FROM z WHERE gold = label AND pred = label) AS hits
  FROM (SELECT gold AS label FROM z UNION SELECT pred FROM z))"""
kappa = ctes(GUESS) + """, o AS (SELECT count(*) FILTER (gold = pred) / count(*) AS po, count(*) AS n FROM z),
e AS (SELECT sum(g * p)::DOUBLE AS agree_by_chance FROM (SELECT gold AS label, count(*) AS g FROM z GROUP BY gold)
  JOIN (SELECT pred AS label, count(*) AS p FROM z GROUP BY pred) USING (label))
SELECT round((po - agree_by_chance / (n * n)) / (1 - agree_by_chance / (n * n)), 4) AS kappa FROM o, e"""

# --- streams give the batch answer ------------------------------------------

stream_analysis = analyze
stream_totals = running_totals
HALF = "half AS (SELECT * FROM emb WHERE seq * 4 // (SELECT max(seq) + 1 FROM emb) >= 2)"
stream_reset = ctes(EMB, HALF, *checked("half", 100, 0.3)) + "SELECT message_id, is_duplicate, cluster_id, similarity, matched_id FROM dup"
dedup_skipped = f"""SELECT message_id, false AS is_duplicate, CAST(NULL AS VARCHAR) AS cluster_id, 0.0::DOUBLE AS similarity,
  CAST(NULL AS BIGINT) AS matched_id FROM ({tables.MESSAGES_SQL})"""

relevance_heldout = """
SELECT count(*) AS n_samples, TRUE AS f1_reached, TRUE AS auc_reached, TRUE AS best_kept
FROM documents WHERE doc_id % 4 = 0"""

type_calibration = f"""WITH gold AS (SELECT {NOISY_TYPE} AS kind FROM documents WHERE doc_id % 3 = 0),
labels AS (SELECT unnest({SHORT!r}) AS label)
SELECT label, (SELECT count(*) FROM gold) AS rows, (SELECT count(*) FROM gold WHERE kind = label) AS positives, TRUE AS calibrated
FROM labels"""

learnt_vectors = "SELECT lang, count(*) AS docs, TRUE AS closer FROM documents GROUP BY lang"

NOT_IN_SQL = ("analyze_models", "relevance_model")


def oracles(names: list[str]) -> dict[str, str]:
    return {name: globals()[name] for name in names if name not in NOT_IN_SQL}
