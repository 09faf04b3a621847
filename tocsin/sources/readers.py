"""Readers: message and label files, splits, request checks, file streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin import schemas
from tocsin.sinks.writers import write_csv

TEXT_COLUMNS = ("tweet_text", "text")
LABEL_COLUMNS = ("class_label", "label", "type")
EVAL_LABEL_COLUMNS = ("class_label", "label")


def pick_text(columns: list[str]) -> str:
    found = [c for c in TEXT_COLUMNS if c in columns]
    if not found:
        raise ValueError(f"no text column; expected one of {', '.join(TEXT_COLUMNS)}")
    return found[0]


def pick_label(columns: list[str], candidates: tuple[str, ...] = LABEL_COLUMNS) -> str | None:
    return next((c for c in candidates if c in columns), None)


def read_messages_json(spark: SparkSession, path: str, *, lines: bool = True) -> DataFrame:
    """Objects with ``text`` and ``type`` or ``label`` as text and label.

    Files hold an object per line, which Spark can split.  A file that is one
    JSON array takes ``lines=False`` and is read by one task.
    """
    rows = spark.read.schema(schemas.LABELLED_JSON).option("multiLine", not lines).json(path)
    return rows.select("text", F.coalesce("type", "label", F.lit("")).alias("label"))


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled inside quoted fields, no inference."""
    return (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def as_labelled(df: DataFrame, candidates: tuple[str, ...] = LABEL_COLUMNS) -> DataFrame:
    """Text and label columns found by name.

    A missing label column gives empty labels, a missing value the word
    ``nan``, as a reader that turns everything into text would give.
    """
    text, label = pick_text(df.columns), pick_label(df.columns, candidates)
    value = F.coalesce(F.col(label).cast("string"), F.lit("nan")) if label else F.lit("")
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("nan")).alias("text"), value.alias("label"))


def read_messages_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    return as_labelled(read_csv(spark, path, multi_line=multi_line))


def read_eval_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """As ``read_messages_csv``, but ``type`` is not taken for a label."""
    return as_labelled(read_csv(spark, path, multi_line=multi_line), EVAL_LABEL_COLUMNS)


def _files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Sorted paths of the files in a folder that match a glob; reads no content."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return sorted(row["path"] for row in listing.select("path").collect())


def read_splits(spark: SparkSession, folder: str, *, multi_line: bool = True) -> DataFrame:
    """Training and evaluation rows with a ``split`` column.

    Training is the first CSV, else the first JSON, named ``train``;
    evaluation the first file named ``val``, ``development`` or ``test``.
    Without one, the training rows serve for both.  With ``multi_line`` fields
    may hold line ends and JSON files are arrays, and each file is one task's;
    without, a record is a line and files are split.
    """
    def first(*patterns: str) -> str | None:
        return next((f for p in patterns for f in _files(spark, folder, p)), None)

    def load(path: str) -> DataFrame:
        if path.endswith(".csv"):
            return as_labelled(read_csv(spark, path, multi_line=multi_line), EVAL_LABEL_COLUMNS)
        return read_messages_json(spark, path, lines=not multi_line)

    train = first("*train*.csv", "*train*.json")
    if train is None:
        raise FileNotFoundError(f"no train files in {folder}")
    held_out = first("*val*", "*development*", "*test*") or train
    return load(train).withColumn("split", F.lit("train")).unionByName(
        load(held_out).withColumn("split", F.lit("eval"))
    )


def convert_parquet_splits(spark: SparkSession, splits: dict[str, str], out_folder: str) -> None:
    """Parquet splits to CSV folders with a header, one per split."""
    for name, path in splits.items():
        write_csv(spark.read.parquet(path), f"{out_folder}/{name}")


def limit_input(df: DataFrame, n: int | None, *, seq_col: str = "arrival_seq") -> DataFrame:
    """First ``n`` rows in arrival order, all rows if ``n`` is none or 0."""
    return df.orderBy(seq_col).limit(n) if n else df


def request_fault(text: Column, settings: C.Settings = C.DEFAULTS) -> Column:
    """Why a single request is refused; null if it is not."""
    return (
        F.when(text.isNull(), "missing text")
        .when(F.length(text) < 1, "empty text")
        .when(F.length(text) > settings.max_request_chars, "text too long")
    )


def validate_requests(df: DataFrame, *, text_col: str = "text", settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Add ``accepted`` and ``reason`` by the length of the text."""
    fault = request_fault(F.col(text_col), settings)
    return df.withColumn("reason", fault).withColumn("accepted", F.col("reason").isNull())


def validate_batches(df: DataFrame, *, batch_col: str = "batch_id", settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Size of each batch and whether it is accepted.

    Only the number of items is bounded; items are not checked in a batch.
    """
    size = F.col("items")
    return (
        df.groupBy(batch_col)
        .agg(F.count("*").alias("items"))
        .withColumn("reason", F.when(size > settings.max_batch_items, "too many items"))
        .withColumn("accepted", F.col("reason").isNull())
    )


def stream_messages(
    spark: SparkSession, path: str, schema: T.StructType = schemas.MESSAGE, *, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Messages from files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batches_within(df: DataFrame, *, batch_col: str = "batch_id", settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Rows of accepted batches only."""
    accepted = validate_batches(df, batch_col=batch_col, settings=settings).where("accepted")
    return df.join(accepted, batch_col, "left_semi")
