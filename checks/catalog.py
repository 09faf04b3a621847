"""The registered queries: each runs operators over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables
from tocsin import config as C
from tocsin import runtime
from tocsin.functions import text as X
from tocsin.functions.vectors import learn_prototypes, md5_code, similarities, unit_vectors, with_word_codes, with_word_counts
from tocsin.operators import calibration, dedup, evaluation, language, places, relevance, training, urgency, word_vectors
from tocsin.operators.clean import clean_messages
from tocsin.operators.event_types import SHORT_LABELS, label_event_types, scores_to_arrays
from tocsin.plans import analysis, views
from tocsin.sinks.writers import write_csv, write_json
from tocsin.sources import readers
from tocsin.streaming import jobs

BAR = "|"
LEVELS = [level for level, _ in C.URGENCY_LEVELS]


def bar(column: str) -> Column:
    return F.array_join(column, BAR).alias(column)


# --- derived inputs --------------------------------------------------------

def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean_messages(tables.messages(spark, d))


def score_table(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """One scored row per message and label; ``value`` is SQL over ``pos``."""
    names = F.array(*[F.lit(n) for n in labels])
    rows = df.select("*", F.posexplode(names).alias("pos", "label"))
    return rows.select("message_id", "label", F.expr(value).alias("score"))


RELEVANCE_SCORE = "((message_id * 13 + chars) % 101) / CAST(100 AS DOUBLE)"
TYPE_SCORE = "((message_id * 37 + pos * 53 + chars) % 97) / CAST(100 AS DOUBLE)"
URGENCY_WEIGHT = "(((message_id * 7 + pos * 29 + chars) % 50) + 1) * (CASE WHEN chars % 4 = pos THEN 60 ELSE 1 END)"


def given_scores(spark: SparkSession, d: str) -> analysis.ScoreTables:
    # Written once: the tables below read it several times, a stream in each batch.
    df = runtime.materialise(
        tables.messages(spark, d, spread_out=False).selectExpr("message_id", "length(text) AS chars"), "score_inputs"
    )
    weights = score_table(df, LEVELS, URGENCY_WEIGHT)
    total = weights.groupBy("message_id").agg(F.sum("score").alias("total"))
    return analysis.ScoreTables(
        relevance=score_table(df, [C.RELEVANCE_LABELS[0]], RELEVANCE_SCORE),
        types=score_table(df, SHORT_LABELS, TYPE_SCORE),
        urgency=weights.join(total, "message_id").select(
            "message_id", "label", (F.col("score") / F.col("total").cast("double")).alias("score")
        ),
    )


def analysed(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis with scores supplied as tables."""
    return analysis.analyze(
        tables.messages(spark, d), given_scores(spark, d), tables.gazetteer(spark),
        embed=lambda df: with_word_codes(df, "cleaned_text", code=md5_code),
    )


_saved: dict[tuple[str, str], str] = {}


def saved_results(spark: SparkSession, d: str) -> DataFrame:
    """Results table of this session, written on first use; the views read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _saved:
        path = runtime.new_table_path(spark, "results")
        analysed(spark, d).write.parquet(path)
        _saved[key] = path
    return spark.read.parquet(_saved[key])


def labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels with a score per document."""
    docs = tables.table(spark, d, "documents")
    return docs.join(tables.table(spark, d, "labels"), "doc_id").selectExpr(
        "doc_id", "lang", "text",
        "CASE WHEN quality = 1 THEN 'rescue' WHEN toxic = 1 THEN 'NOT_CRISIS' ELSE 'not_humanitarian' END AS label",
        "(n_chars % 101) / CAST(100 AS DOUBLE) AS score",
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    scored = labelled_scores(spark, d).withColumn("is_relevant", evaluation.flag_by_score(F.col("score")))
    return evaluation.evaluation_rows(scored, keep=("doc_id", "lang"))


def score_points(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_scores(spark, d).select("score", evaluation.gold_by_name(F.col("label")).alias("gold_relevant"))
    return evaluation.score_points(rows)


# --- queries ---------------------------------------------------------------

def q_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(spark, d).select(
        "message_id", "original_text", "cleaned_text", bar("hashtags"), bar("mentions"), bar("urls"), "has_media"
    )


def q_clean_switches(spark: SparkSession, d: str) -> DataFrame:
    """All switches off: only repost marks, normal form and spaces change."""
    off = clean_messages(
        tables.messages(spark, d), remove_urls=False, remove_mentions=False, convert_symbols=False, segment_hashtags=False
    )
    return off.select("message_id", "cleaned_text")


def q_nfc(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).select("message_id", X.to_nfc(F.col("text")).alias("text"))


def q_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Single symbols, flags, keycaps, skin tones and joined sequences behind and between other text."""
    text = F.concat("text", F.expr(tables.symbol_case(lambda s, _: s, " a{0}b {0} 3")))
    return tables.messages(spark, d).select("message_id", X.symbols_to_words(text).alias("text"))


def q_requests(spark: SparkSession, d: str) -> DataFrame:
    checked = readers.validate_requests(tables.table(spark, d, "documents"))
    return checked.select("doc_id", "accepted", "reason")


def q_batches(spark: SparkSession, d: str) -> DataFrame:
    return readers.validate_batches(tables.table(spark, d, "documents"), batch_col="source")


def q_language(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.documents(spark, d).select("doc_id", "text", "lang")
    model = language.train_language_model(docs)
    return language.detect_language(docs, model, text_col="text").select("doc_id", "lang_code", "lang_method")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "embeddings")


def q_prototypes(spark: SparkSession, d: str) -> DataFrame:
    df = embeddings(spark, d).withColumn("cleaned_text", F.lit("x"))
    centres = learn_prototypes(df, "label", "embedding", [0, 1])
    scored = relevance.score_with_prototypes(df, centres, vector_col="embedding", scale=10.0)
    return relevance.decide_relevance(scored, label_score="label_score").select(
        "vec_id", "is_relevant", "relevance_confidence", "relevance_label"
    )


def q_event_types(spark: SparkSession, d: str) -> DataFrame:
    df = embeddings(spark, d).withColumn("cleaned_text", F.lit("x"))
    centres = learn_prototypes(df, "label", "embedding", list(range(len(SHORT_LABELS))))
    sims = df.withColumn("_s", similarities(F.col("embedding"), centres))
    scored = sims.withColumn(
        "type_scores_raw", F.transform("_s", lambda s: F.round(1.0 / (1.0 + F.exp(-10.0 * (s - 0.3))), 8))
    )
    return label_event_types(scored).select(
        "vec_id", bar("event_types"), "top_label", "top_score", score_text("type_scores")
    )


def score_text(column: str) -> Column:
    """Scores by label position as text."""
    return F.array_join(
        F.transform(F.array(*[F.lit(n) for n in SHORT_LABELS]), lambda n: F.format_string("%.4f", F.try_element_at(F.col(column), n))),
        BAR,
    ).alias(column)


def q_urgency(spark: SparkSession, d: str) -> DataFrame:
    scores = scores_to_arrays(given_scores(spark, d).urgency, LEVELS, "urgency_scores")
    df = cleaned(spark, d).select("message_id", "cleaned_text").join(scores, "message_id", "left")
    df = df.withColumn("low", F.lower("cleaned_text"))
    df = df.withColumn("keywords", urgency.matched_keywords(F.col("low"))).drop("low")
    return urgency.score_urgency(df).select(
        "message_id", "urgency_level", "urgency_score", "keyword_boost", bar("keywords")
    )


def q_mentions(spark: SparkSession, d: str) -> DataFrame:
    return places.match_places(cleaned(spark, d), tables.gazetteer(spark))


def q_merged(spark: SparkSession, d: str) -> DataFrame:
    return places.extract_places(cleaned(spark, d), tables.gazetteer(spark))


def q_geocoded(spark: SparkSession, d: str) -> DataFrame:
    gaz = tables.gazetteer(spark)
    hint = F.when(F.col("message_id") % 3 == 0, "us")
    found = places.extract_places(cleaned(spark, d), gaz).withColumn("hint", hint)
    return places.geocode(found, gaz, country_col="hint").select(
        "message_id", "start", "text", "latitude", "longitude", "display_name", "country", "geo_confidence"
    )


def q_lookups(spark: SparkSession, d: str) -> DataFrame:
    return places.lookup_requests(places.extract_places(cleaned(spark, d), tables.gazetteer(spark)))


def q_dedup_vectors(spark: SparkSession, d: str) -> DataFrame:
    df = embeddings(spark, d).select(
        F.col("vec_id").alias("message_id"), F.col("vec_id").alias("arrival_seq"), F.col("embedding").alias("vector")
    )
    return dedup.deduplicate(df, text_col=None, window=100, threshold=0.3)


def document_codes(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.documents(spark, d).select(
        F.col("doc_id").alias("message_id"), F.col("doc_id").alias("arrival_seq"), F.col("text").alias("cleaned_text")
    )
    return with_word_codes(docs, "cleaned_text", code=md5_code)


def q_dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = document_codes(spark, d)
    return dedup.with_matched_text(dedup.deduplicate(docs), docs)


def q_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = document_codes(spark, d)
    return dedup.cluster_summary(docs.drop("vector").join(dedup.deduplicate(docs), "message_id"))


def q_window_count(spark: SparkSession, d: str) -> DataFrame:
    return dedup.window_count(cleaned(spark, d))


def place_summary(column: str = "locations") -> Column:
    return F.array_join(F.transform(column, views.place_text), BAR).alias(column)


def result_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "message_id", "cleaned_text", "lang_code", "lang_method", "is_relevant", "relevance_confidence",
        bar("event_types"), score_text("type_scores"), "urgency_level", "urgency_score", place_summary(),
        "is_duplicate", "cluster_id", "similarity", "matched_id", "pipeline_version",
    )


def q_analyze(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(saved_results(spark, d))


def q_analyze_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the nested JSON result."""
    path = {
        "code": "$.language.code", "level": "$.urgency.level", "relevant": "$.is_relevant",
        "first_type": "$.event_types[0]", "first_place": "$.locations[0].text",
        "first_country": "$.locations[0].country", "cluster": "$.deduplication.cluster_id", "version": "$.pipeline_version",
    }
    results = views.results_json(saved_results(spark, d))
    return results.select("message_id", *[F.get_json_object("result", p).alias(n) for n, p in path.items()])


def q_response(spark: SparkSession, d: str) -> DataFrame:
    results = views.results_json(saved_results(spark, d), with_version=False)
    return results.select(
        "message_id",
        F.get_json_object("result", "$.pipeline_version").alias("version"),
        F.get_json_object("result", "$.urgency.level").alias("level"),
        F.array_size(F.json_object_keys("result")).alias("fields"),
    )


def q_analyze_models(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis with everything learnt from the tables."""
    df = tables.messages(spark, d)
    # Cleaned and hashed once: the label vectors and the analysis read it.
    coded = runtime.materialise(with_word_counts(clean_messages(df), "cleaned_text"), "coded")
    marks = coded.select("message_id", "source", "vector").join(
        tables.table(spark, d, "labels").select((2 * F.col("doc_id")).alias("message_id"), "quality"), "message_id", "left"
    ).withColumns({
        "kind": F.pmod(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(8)),
        "level": F.pmod(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(4)),
    })
    marks = runtime.materialise(marks.select("quality", "kind", "level", "vector"), "marks")
    scores = analysis.Prototypes(
        relevance=learn_prototypes(marks, "quality", "vector", [1, 0]),
        types=learn_prototypes(marks, "kind", "vector", list(range(8))),
        urgency=learn_prototypes(marks, "level", "vector", list(range(4))),
    )
    model = language.train_language_model(df)
    return analysis.analyze(df, scores, tables.gazetteer(spark), language=model, cleaned=coded).select(
        "message_id", "lang_code", "lang_confidence", "is_relevant", "relevance_confidence", bar("event_types"),
        "urgency_level", "urgency_score", place_summary(), "is_duplicate", "cluster_id",
    )


def q_known(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = tables.table(spark, d, "documents"), tables.table(spark, d, "labels")
    known = docs.join(labels, "doc_id").groupBy(F.col("source").alias("sample_key")).agg(
        F.min("lang").alias("lang_code"),
        F.lit(0.9).alias("lang_confidence"),
        (F.max("quality") == 1).alias("is_relevant"),
        F.round(F.avg("quality"), 4).alias("relevance_confidence"),
        F.array(F.lit("RESCUE_REQUEST")).alias("event_types"),
        F.lit("HIGH").alias("urgency_level"),
        F.lit(0.75).alias("urgency_score"),
        F.array(F.struct(
            F.concat(F.lit("place "), F.min("lang")).alias("text"), F.lit("LOC").alias("label"),
            F.min("doc_id").cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        )).alias("locations"),
        F.sum("toxic").alias("toxic"),
    ).where("toxic >= 2").drop("toxic")
    asked = docs.select("doc_id", F.col("source").alias("sample_key"))
    return analysis.known_results(asked, known).select(
        "doc_id", "lang_code", "lang_confidence", "is_relevant", "relevance_confidence", bar("event_types"),
        "urgency_level", "urgency_score", F.to_json("locations").alias("locations"), "is_duplicate", "cluster_id",
    )


def on_results(view: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: view(saved_results(spark, d))


def q_feed_heading(spark: SparkSession, d: str) -> DataFrame:
    return views.priority_feed(saved_results(spark, d)).select("position", views.feed_heading().alias("heading"))


def q_time_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = views.positive_histogram(tables.table(spark, d, "events"), "value")
    return rows.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "messages")


def q_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return views.class_distribution(tables.table(spark, d, "events"), "event_type")


def q_evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).drop("lang")


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(judged(spark, d))


def q_quality(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality(evaluation.confusion(judged(spark, d)))


def q_quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality(evaluation.confusion(judged(spark, d), by=("lang",)))


def q_gold_rules(spark: SparkSession, d: str) -> DataFrame:
    return labelled_scores(spark, d).select(
        "doc_id",
        evaluation.gold_by_substring(F.col("label")).alias("by_substring"),
        evaluation.gold_by_name(F.col("label")).alias("by_name"),
        evaluation.flag_by_score(F.col("score")).alias("flag"),
    )


def finite(df: DataFrame) -> DataFrame:
    return df.withColumn("threshold", F.when(F.col("threshold") < F.lit(float("inf")), F.col("threshold")))


def q_roc(spark: SparkSession, d: str) -> DataFrame:
    return finite(evaluation.roc_curve(score_points(spark, d)))


def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(score_points(spark, d))


def q_pr(spark: SparkSession, d: str) -> DataFrame:
    return finite(evaluation.precision_recall_curve(score_points(spark, d)))


def q_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.average_precision(score_points(spark, d))


def language_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Gold language against a guess from the length of the text."""
    docs = tables.table(spark, d, "documents").selectExpr(
        "lang AS gold", "CASE n_chars % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' ELSE 'en' END AS pred"
    )
    return evaluation.confusion_matrix(docs)


def q_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro_f1(language_matrix(spark, d))


def q_kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.kappa(language_matrix(spark, d))


def q_place_recall(spark: SparkSession, d: str) -> DataFrame:
    gaz = tables.gazetteer(spark)
    # Both sides of the recall read it.
    found = runtime.materialise(places.extract_places(cleaned(spark, d), gaz), "found")
    located = places.geocode(found, gaz).where(F.col("latitude").isNotNull())
    return evaluation.recall_of_places(found, located, ["message_id", "text"])


def q_relevance_model(spark: SparkSession, d: str) -> DataFrame:
    """Learns English against the rest, which the texts do tell apart."""
    rows = tables.documents(spark, d).selectExpr(
        "doc_id AS message_id", "text AS cleaned_text", "text",
        "CASE WHEN lang = 'en' THEN 'rescue' ELSE 'not_humanitarian' END AS label",
    )
    model, _ = training.train_relevance(rows, features=1 << 14)
    scored = relevance.score_with_model(rows, model)
    return relevance.decide_relevance(scored, model_score="model_score", model_flag="model_flag").select(
        "message_id", "is_relevant", "relevance_confidence", "relevance_label"
    )


#: Types that the texts' languages stand for in the calibration query; one row in five has another one instead.
LANGUAGE_TYPES = {"en": "RESCUE_REQUEST", "fr": "MEDICAL_EMERGENCY", "de": "SUPPLY_REQUEST", "es": "CASUALTY_REPORT"}
NOISY_TYPE = "CASE WHEN doc_id % 5 = 1 THEN 'DISPLACEMENT' " + " ".join(
    f"WHEN lang = '{lang}' THEN '{kind}'" for lang, kind in LANGUAGE_TYPES.items()
) + " ELSE 'SITUATIONAL_UPDATE' END"


def q_type_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Whether learnt type scores are shares of right types on a held-out third, by type."""
    rows = tables.documents(spark, d).selectExpr("doc_id", "text AS cleaned_text", f"array({NOISY_TYPE}) AS gold")
    held = "doc_id % 3 = 0"
    models = calibration.train_type_models(rows.where(f"NOT ({held})"), gold_col="gold", features=1 << 12)
    scored = models.scores(rows.where(held))
    found = calibration.calibration_error(scored, "type_scores_raw", "gold")
    # A third of few rows is off by chance: two standard deviations of a share are allowed beside the 0.05.
    chance = 2 * F.sqrt(F.lit(0.16) / F.col("rows"))
    return found.select("label", "rows", "positives", (F.col("error") < 0.05 + chance).alias("calibrated"))


def q_learnt_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Whether two halves of a text that share no place (every other word) lie closer than with hashed counts, by language."""
    halves = tables.documents(spark, d).select("doc_id", "lang", F.split(F.trim("text"), r"\s+").alias("_w"))
    half = lambda odd: F.array_join(F.filter("_w", lambda _, i: i % 2 == odd), " ")
    rows = halves.select("doc_id", "lang", half(0).alias("first"), half(1).alias("second"))
    model = word_vectors.learn_word_vectors(tables.documents(spark, d), text_col="text", vocabulary=2048, size=32)
    for part in ("first", "second"):
        rows = with_word_codes(model.embed(rows, part, f"_{part}"), part, f"_{part}_codes")
    near = lambda name: word_vectors.cosine(F.col(f"_first{name}"), F.col(f"_second{name}"))
    rows = rows.withColumns({f"_{p}_codes": unit_vectors(F.col(f"_{p}_codes")) for p in ("first", "second")})
    closer = F.avg(F.when(near("") > near("_codes"), 1.0).otherwise(0.0))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), (closer >= 0.8).alias("closer"))


def q_relevance_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Whether training reaches its thresholds on a held-out quarter and keeps the epoch of least loss."""
    rows = tables.documents(spark, d).selectExpr(
        "doc_id", "text", "CASE WHEN lang = 'en' THEN 'rescue' ELSE 'not_humanitarian' END AS label"
    )
    held = rows.where("doc_id % 4 = 0")
    model, metrics = training.train_relevance(rows.where("doc_id % 4 <> 0"), held, features=1 << 14)
    area = training.area_under_roc(model, held)
    return metrics.select(
        "n_samples", (F.col("f1") >= 0.9).alias("f1_reached"), F.lit(area >= 0.95).alias("auc_reached"),
        (F.col("loss") == F.array_min(F.col("history.loss"))).alias("best_kept"),
    )


STREAM_BATCHES = 4
#: Rows of a file of a batch: with fewer a batch has fewer files than there are cores, with more it has more.
LEAST_FILE_ROWS, MOST_FILE_ROWS = 1_000, 20_000


def batch_files(rows: int, cores: int) -> int:
    """Files of each batch of a stream of ``rows``: one for each core or more, so that all work on it."""
    each = -(-rows // STREAM_BATCHES)
    if each < cores * LEAST_FILE_ROWS:
        return max(1, cores // STREAM_BATCHES)
    return max(cores, -(-each // MOST_FILE_ROWS))


def in_batches(spark: SparkSession, df: DataFrame, seq_col: str = "arrival_seq") -> DataFrame:
    """``df`` as a stream: files that arrive in ``STREAM_BATCHES`` groups by equal ranges of ``seq_col``."""
    folder, parts = runtime.new_table_path(spark, "arrivals"), runtime.new_table_path(spark, "arriving")
    top, rows = df.agg(F.max(seq_col), F.count(F.lit(1))).first()
    files = batch_files(rows, spark.sparkContext.defaultParallelism)
    part = F.floor(F.col(seq_col) * STREAM_BATCHES / F.lit(top + 1))
    # The rows are made once; each group of files is then written from its part only.
    df.withColumn("_part", part).write.partitionBy("_part").parquet(parts)
    made = spark.read.schema(df.schema.add("_part", "long")).parquet(parts)
    for i in range(STREAM_BATCHES):
        made.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(folder)
    return readers.stream_messages(spark, folder, df.schema, files_per_batch=files)


def run_to_end(writer, spark: SparkSession) -> None:
    folder = runtime.new_table_path(spark, "stream")
    query = writer.option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


_streamed: dict[tuple[str, str], jobs.WindowState] = {}


def streamed_results(spark: SparkSession, d: str) -> jobs.WindowState:
    """The whole analysis as a stream of several batches, run once in this session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _streamed:
        state = jobs.WindowState(spark, runtime.new_table_path(spark, "streamed"))
        run_to_end(
            jobs.analyse_whole_stream(
                in_batches(spark, tables.messages(spark, d)), state, given_scores(spark, d), lambda _: tables.gazetteer(spark),
                embed=lambda df: with_word_codes(df, "cleaned_text", code=md5_code),
                lookups=places.LookupTable(spark, runtime.new_table_path(spark, "lookups")),
            ), spark,
        )
        _streamed[key] = state
    return _streamed[key]


def q_stream_totals(spark: SparkSession, d: str) -> DataFrame:
    return streamed_results(spark, d).totals()


def q_stream_analysis(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(streamed_results(spark, d).results())


def streamed_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "embeddings").selectExpr(
        "vec_id AS message_id", "vec_id AS arrival_seq", "embedding AS vector", "CAST(label AS STRING) AS source"
    )
    return in_batches(spark, rows)


VECTOR_WINDOW = dict(text_col=None, window=100, threshold=0.3)


def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    state = jobs.WindowState(spark, runtime.new_table_path(spark, "window"))
    run_to_end(jobs.deduplicate_stream(streamed_vectors(spark, d), state, **VECTOR_WINDOW), spark)
    return state.results()


def q_stream_dedup_keyed(spark: SparkSession, d: str) -> DataFrame:
    state = jobs.WindowState(spark, runtime.new_table_path(spark, "keyed"))
    options = dict(text_col=None, by="source", window=20, threshold=0.25)
    run_to_end(jobs.deduplicate_stream(streamed_vectors(spark, d), state, **options), spark)
    return state.results()


def q_stream_reset(spark: SparkSession, d: str) -> DataFrame:
    """A new run in the middle of a stream: the second half meets an empty window."""
    folder, half = runtime.new_table_path(spark, "reset"), STREAM_BATCHES // 2
    runs = [jobs.WindowState(spark, folder), jobs.WindowState(spark, folder, "run-1", first_batch=half)]
    run_to_end(
        streamed_vectors(spark, d).writeStream.foreachBatch(
            lambda batch, i: jobs.check_batch(batch, i, runs[i >= half], **VECTOR_WINDOW)
        ), spark,
    )
    return runs[1].results()


def q_dedup_skipped(spark: SparkSession, d: str) -> DataFrame:
    """The duplicate check switched off."""
    return dedup.deduplicate(cleaned(spark, d), skip=True)


def q_dedup_by_key(spark: SparkSession, d: str) -> DataFrame:
    """One window per source of the documents."""
    docs = tables.documents(spark, d).select(
        F.col("doc_id").alias("message_id"), F.col("doc_id").alias("arrival_seq"), "source", "text"
    )
    docs = with_word_codes(docs, "text", code=md5_code)
    return dedup.deduplicate(docs, text_col="text", by="source", window=50, threshold=0.6)


def q_limit_input(spark: SparkSession, d: str) -> DataFrame:
    """A top-k by arrival: the limit is the feature."""
    docs = tables.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return readers.limit_input(docs, 100, seq_col="doc_id")


def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as labelled CSV and read back by column name."""
    path = runtime.new_table_path(spark, "csv")
    write_csv(tables.table(spark, d, "documents").select(F.col("text").alias("tweet_text"), F.col("lang").alias("class_label")), path)
    back = readers.read_messages_csv(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


def q_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read back as text and label."""
    path = runtime.new_table_path(spark, "json")
    write_json(tables.table(spark, d, "documents").select("text", F.col("source").alias("type")), path)
    back = readers.read_messages_json(spark, path, lines=True)
    return back.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_messages": q_clean,
    "clean_switches_off": q_clean_switches,
    "nfc_normalise": q_nfc,
    "emoji_words": q_symbols,
    "request_validation": q_requests,
    "batch_validation": q_batches,
    "limit_input": q_limit_input,
    "csv_roundtrip": q_csv_roundtrip,
    "json_roundtrip": q_json_roundtrip,
    "language_id": q_language,
    "prototype_scores": q_prototypes,
    "event_type_labels": q_event_types,
    "urgency": q_urgency,
    "place_mentions": q_mentions,
    "merged_mentions": q_merged,
    "geocoded": q_geocoded,
    "lookup_requests": q_lookups,
    "dedup_vectors": q_dedup_vectors,
    "dedup_documents": q_dedup_documents,
    "dedup_by_key": q_dedup_by_key,
    "cluster_summary": q_clusters,
    "window_count": q_window_count,
    "analyze": q_analyze,
    "analyze_json": q_analyze_json,
    "analyze_response": q_response,
    "analyze_models": q_analyze_models,
    "known_results": q_known,
    "batch_totals": on_results(analysis.batch_totals),
    "running_totals": on_results(analysis.running_totals),
    "session_totals": on_results(views.session_totals),
    "headline_metrics": on_results(views.headline_metrics),
    "priority_feed": on_results(views.priority_feed),
    "feed_heading": q_feed_heading,
    "feed_export": on_results(views.feed_export),
    "map_layer": on_results(views.map_layer),
    "map_centre": on_results(views.map_centre),
    "urgency_distribution": on_results(views.urgency_distribution),
    "type_distribution": on_results(views.type_distribution),
    "language_distribution": on_results(views.language_distribution),
    "confidence_histogram": on_results(views.confidence_histogram),
    "time_histogram": q_time_histogram,
    "type_by_urgency": on_results(views.type_by_urgency),
    "type_by_urgency_wide": on_results(views.type_by_urgency_wide),
    "rate_by_language": on_results(views.rate_by_language),
    "results_table": on_results(views.results_table),
    "class_distribution": q_class_distribution,
    "gold_rules": q_gold_rules,
    "evaluation_rows": q_evaluation_rows,
    "confusion": q_confusion,
    "quality": q_quality,
    "quality_by_language": q_quality_by_language,
    "roc_curve": q_roc,
    "auc": q_auc,
    "precision_recall_curve": q_pr,
    "average_precision": q_average_precision,
    "macro_f1": q_macro_f1,
    "kappa": q_kappa,
    "place_recall": q_place_recall,
    "relevance_model": q_relevance_model,
    "relevance_heldout": q_relevance_heldout,
    "type_calibration": q_type_calibration,
    "learnt_vectors": q_learnt_vectors,
    "stream_analysis": q_stream_analysis,
    "stream_totals": q_stream_totals,
    "stream_dedup": q_stream_dedup,
    "stream_dedup_by_key": q_stream_dedup_keyed,
    "stream_reset": q_stream_reset,
    "dedup_skipped": q_dedup_skipped,
}
