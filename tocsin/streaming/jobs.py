"""Streaming jobs over messages that arrive as files.

The stateless part of the analysis runs on a stream as it is.  The duplicate
check needs the last messages and the cluster count of all earlier batches.
It keeps them per key, in hash buckets: a batch reads and writes the buckets
of its own keys only.

A batch counts once its commit record is there, a file that appears in one
step and names the batch's results, its totals and, for each bucket, the
batch that wrote it last.  What a killed attempt left behind has no record
and is never read; a batch that comes again finds its record and is done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tocsin import config as C
from tocsin import schemas
from tocsin.functions.text import is_blank
from tocsin.functions.vectors import with_word_codes
from tocsin.operators.clean import clean_messages
from tocsin.operators.dedup import assign_clusters, entering_rows, name_matches, no_match
from tocsin.operators.language import LanguageModel
from tocsin.operators.ordering import with_row_index
from tocsin.operators.places import LookupTable, extract_places, geocode, locations_by_message
from tocsin.plans.analysis import RESULT_COLUMNS, Prototypes, ScoreColumns, ScoreTables, classify
from tocsin.runtime import materialise


def analyse_stream(
    stream: DataFrame,
    scores: ScoreColumns | Prototypes,
    *,
    language: LanguageModel | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Cleaning, language, relevance, types and urgency of a stream.

    Projections only: no state, no shuffle, append mode.
    """
    return classify(clean_messages(stream), scores, language=language, settings=settings)


def stream_totals(results: DataFrame) -> DataFrame:
    """Totals so far, for complete mode; partial sums keep the state at one row."""
    return results.groupBy().agg(
        F.count("*").alias("total_processed"),
        F.count_if("is_relevant").alias("total_relevant"),
        F.count_if(F.col("is_relevant") & (F.col("urgency_level") == "CRITICAL")).alias("total_critical"),
    )


#: Parts of the state; a batch touches those of its keys.
BUCKETS = 256
#: Parts into which the rows of one key are dealt.
SALTS = 64


@dataclass
class Commit:
    """What one batch of a run did."""

    run: str
    batch: int
    results: str
    #: Bucket to the attempt that wrote its state last, for all buckets so far.
    buckets: dict[str, str] = field(default_factory=dict)
    total_processed: int = 0
    total_relevant: int = 0
    total_critical: int = 0
    total_duplicates: int = 0
    entered: int = 0


class WindowState:
    """State, results and commit records of the batches of one run.

    ``run_id`` names an epoch: a new one starts with an empty window and
    cluster numbers from 0.  ``first_batch`` is the number of its first
    batch; each later one needs the record of the batch before it.
    """

    def __init__(
        self, spark: SparkSession, folder: str, run_id: str = "run-0", *, first_batch: int = 0, buckets: int = BUCKETS
    ) -> None:
        self.spark = spark
        self.root = f"{folder}/{run_id}"
        self.run_id, self.first_batch, self.buckets = run_id, first_batch, buckets

    # --- commit records

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    @staticmethod
    def _record_name(batch_id: int) -> str:
        return f"commits/batch-{batch_id:012d}.json"

    def committed(self, batch_id: int) -> Commit | None:
        """The record of a batch, none if it has not ended."""
        files, path = self._files(), self._path(self._record_name(batch_id))
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            record = Commit(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()
        if (record.run, record.batch) != (self.run_id, batch_id):
            raise ValueError(f"{path} belongs to batch {record.batch} of {record.run}, not to batch {batch_id} of {self.run_id}")
        return record

    def before(self, batch_id: int) -> Commit:
        """The record that ``batch_id`` goes on from."""
        if batch_id == self.first_batch:
            return Commit(self.run_id, batch_id - 1, "")
        if batch_id < self.first_batch:
            raise ValueError(f"batch {batch_id} comes before the first of {self.run_id}, {self.first_batch}")
        record = self.committed(batch_id - 1)
        if record is None:
            raise ValueError(f"batch {batch_id - 1} of {self.run_id} has no commit record; batch {batch_id} cannot go on from it")
        return record

    def commit(self, record: Commit) -> None:
        """Let the batch count: the record is written aside and renamed, which is one step."""
        files, path = self._files(), self._path(self._record_name(record.batch))
        aside = self._path(f"commits/_{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(asdict(record)).encode()))
        finally:
            stream.close()
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, False)
            if self.committed(record.batch) is None:
                raise RuntimeError(f"could not commit batch {record.batch} of {self.run_id}")

    def commits(self) -> DataFrame:
        """All records of the run, one row per batch that ended."""
        if not len(self._files().globStatus(self._path("commits/batch-*.json")) or ()):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.root}/commits/batch-*.json")

    # --- tables

    def write(self, df: DataFrame, attempt: str, table: str) -> None:
        """State of one attempt, cut by bucket."""
        df.withColumn("_bucket", self.bucket()).write.partitionBy("_bucket").parquet(f"{self.root}/state/{attempt}/{table}")

    def bucket(self):
        return F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int")

    def read(self, record: Commit, table: str, touched: list[int], schema: str) -> DataFrame:
        """State of the touched buckets after ``record``."""
        paths = [
            f"{self.root}/state/{record.buckets[str(b)]}/{table}/_bucket={b}" for b in touched if str(b) in record.buckets
        ]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def results_path(self, attempt: str) -> str:
        return f"{self.root}/results/{attempt}"

    def results(self) -> DataFrame:
        """Rows of all batches that ended."""
        paths = [r["results"] for r in self.commits().select("results").collect()]  # one path a batch
        return self.spark.read.parquet(*[self.results_path(p) for p in paths])

    def totals(self, *, window: int | None = None) -> DataFrame:
        """Totals since the run began; each batch has its own part, so one that comes again adds nothing."""
        window = window or C.DEFAULTS.duplicate_window
        return self.commits().agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
            F.least(F.lit(window), F.coalesce(F.sum("entered"), F.lit(0))).cast("long").alias("dedup_window_size"),
        )


COUNTERS = ("total_processed", "total_relevant", "total_critical", "total_duplicates")
COMMIT = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("results", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in (*COUNTERS, "entered")]
)


def _check_rows(
    batch: DataFrame, before: Commit, state: WindowState, attempt: str, *, text_col: str | None, vector_col: str,
    seq_col: str, by: str | None, window: int, threshold: float,
) -> tuple[DataFrame, dict[str, str]]:
    """Matches of a batch by key, and the buckets whose state this attempt wrote.

    The saved windows of the batch's keys go before the batch as rows with
    known clusters, so that the batch job and the stream share one
    block-parallel check.  A key's state is ``window`` rows at most and one
    count.
    """
    arrived = entering_rows(batch, text_col=text_col, vector_col=vector_col, seq_col=seq_col, by=by)
    fresh = arrived.where(~F.col("_blank")).select(
        "_key", "message_id", "_seq", "vector", F.lit(None).cast("long").alias("carried_cluster"), F.lit(1).alias("_fresh")
    )
    blanks = arrived.where("_blank").select(*no_match("_key", "message_id"))
    touched = [r[0] for r in fresh.select(state.bucket().alias("_b")).distinct().collect()]  # BUCKETS numbers at most
    if not touched:
        return blanks, {}
    # Other keys of a touched bucket are carried along unchanged.
    kind = dict(arrived.dtypes)["vector"]
    fields = f"_key string, message_id long, _seq long, vector {kind}, carried_cluster long"
    tail = state.read(before, "tail", touched, fields)
    opened = state.read(before, "opened", touched, "_key string, clusters long")
    keys = fresh.select("_key").distinct()
    mine = tail.join(keys, "_key", "left_semi").withColumn("_fresh", F.lit(0))
    numbered = materialise(
        with_row_index(
            fresh.unionByName(mine), "_seq", by=("_key",), lead_col="_fresh", tie_cols=("message_id",),
        ),
        "numbered",
    )
    clusters = materialise(
        assign_clusters(
            numbered, window=window, threshold=threshold, opened_before=opened.join(keys, "_key", "left_semi")
        ),
        "checked",
    )
    found = name_matches(clusters).join(
        numbered.where("_fresh = 1").select("_key", "message_id"), ["_key", "message_id"], "left_semi"
    )
    # Rows of a key are counted by tasks; the last ``window`` numbers follow from the count.
    rows = numbered.groupBy("_key").agg(F.max("row_index").alias("_last"))
    salted = clusters.withColumn("_salt", F.pmod("row_index", F.lit(SALTS)))
    ends = salted.select("_key", "_salt").distinct().join(rows, "_key")
    last = salted.join(ends, ["_key", "_salt"]).where(F.col("row_index") > F.col("_last") - window).select(
        "_key", "row_index", "cluster_number"
    )
    kept = numbered.select("_key", "message_id", "row_index", "vector").join(last, ["_key", "row_index"]).select(
        "_key", "message_id", F.col("row_index").alias("_seq"), "vector", F.col("cluster_number").alias("carried_cluster")
    )
    state.write(kept.unionByName(tail.join(keys, "_key", "left_anti")), attempt, "tail")
    counts = clusters.select("_key", (F.col("cluster_number") + 1).alias("clusters")).unionByName(opened)
    state.write(counts.groupBy("_key").agg(F.max("clusters").alias("clusters")), attempt, "opened")
    return found.unionByName(blanks), {str(b): attempt for b in touched}


def check_batch(
    batch: DataFrame,
    batch_id: int,
    state: WindowState,
    *,
    text_col: str | None = "cleaned_text",
    vector_col: str = "vector",
    seq_col: str = "arrival_seq",
    by: str | None = None,
    window: int | None = None,
    threshold: float | None = None,
) -> None:
    """Duplicate check of one batch after all earlier ones; a batch that has ended is left as it is."""
    if state.committed(batch_id):
        return
    before, attempt = state.before(batch_id), f"{batch_id}-{uuid.uuid4().hex}"
    found, written = _check_rows(
        batch, before, state, attempt, text_col=text_col, vector_col=vector_col, seq_col=seq_col, by=by,
        window=window or C.DEFAULTS.duplicate_window, threshold=threshold or C.DEFAULTS.duplicate_threshold,
    )
    (found.withColumnRenamed("_key", by) if by else found.drop("_key")).write.parquet(state.results_path(attempt))
    counted = state.spark.read.parquet(state.results_path(attempt)).agg(
        F.count("*").alias("n"), F.count_if("is_duplicate").alias("d"), F.count_if(F.col("cluster_id").isNotNull()).alias("e")
    ).first()
    state.commit(Commit(
        state.run_id, batch_id, attempt, before.buckets | written,
        total_processed=counted["n"], total_duplicates=counted["d"], entered=counted["e"],
    ))


def deduplicate_stream(stream: DataFrame, state: WindowState, **options) -> DataStreamWriter:
    """Exact duplicate check across micro-batches, in arrival order.

    With ``by`` every key has its own window; keys are not tied to tasks, so
    one that carries most of the stream is still split into blocks.
    """
    return stream.writeStream.foreachBatch(lambda batch, batch_id: check_batch(batch, batch_id, state, **options))


def analyse_batch(
    batch: DataFrame,
    batch_id: int,
    state: WindowState,
    scores: ScoreTables | ScoreColumns | Prototypes,
    gazetteer: DataFrame | Callable[[int], DataFrame],
    *,
    language: LanguageModel | None = None,
    vector_col: str = "vector",
    embed: Callable[[DataFrame], DataFrame] | None = None,
    lookups: LookupTable | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> None:
    """Whole analysis of one batch: classes, places, duplicates of all earlier batches, totals.

    A gazetteer given as a function is asked for its version at each batch.
    Vectors stand for the cleaned text, as in ``analysis.analyze``.
    """
    if state.committed(batch_id):
        return
    before, attempt = state.before(batch_id), f"{batch_id}-{uuid.uuid4().hex}"
    names = gazetteer(batch_id) if callable(gazetteer) else gazetteer
    cleaned = clean_messages(batch)
    if vector_col not in cleaned.columns:
        cleaned = embed(cleaned) if embed else with_word_codes(cleaned, "cleaned_text", vector_col)
    base = materialise(classify(cleaned, scores, language=language, settings=settings), "classified")
    found, written = _check_rows(
        base, before, state, attempt, text_col="cleaned_text", vector_col=vector_col, seq_col="arrival_seq", by=None,
        window=settings.duplicate_window, threshold=settings.duplicate_threshold,
    )
    relevant = base.where("is_relevant").select("message_id", "cleaned_text")
    located = locations_by_message(geocode(extract_places(relevant, names), names, lookups=lookups))
    narrow = found.drop("_key").join(located, "message_id", "left")
    base.join(narrow, "message_id", "left").withColumns({
        "locations": F.coalesce("locations", F.array().cast(f"array<{schemas.LOCATION.simpleString()}>")),
        "pipeline_version": F.lit(C.VERSION),
    }).select(*RESULT_COLUMNS, "similarity", "matched_id").write.parquet(state.results_path(attempt))
    counted = state.spark.read.parquet(state.results_path(attempt)).agg(
        F.count("*").alias("n"), F.count_if("is_relevant").alias("r"),
        F.count_if(F.col("is_relevant") & (F.col("urgency_level") == "CRITICAL")).alias("c"),
        F.count_if("is_duplicate").alias("d"), F.count_if(~is_blank(F.col("cleaned_text"))).alias("e"),
    ).first()
    state.commit(Commit(state.run_id, batch_id, attempt, before.buckets | written, *counted))


def analyse_whole_stream(
    stream: DataFrame,
    state: WindowState,
    scores: ScoreTables | ScoreColumns | Prototypes,
    gazetteer: DataFrame | Callable[[int], DataFrame],
    **options,
) -> DataStreamWriter:
    """The whole analysis of a stream, each batch exactly once; see ``analyse_batch``."""
    return stream.writeStream.foreachBatch(
        lambda batch, batch_id: analyse_batch(batch, batch_id, state, scores, gazetteer, **options)
    )


def analyse_each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Run a batch job, such as the whole analysis, on each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)
