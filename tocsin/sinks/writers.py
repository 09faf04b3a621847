"""Writers.  All of them write folders of part files, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.plans import views


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; outer blanks stay, an empty text is quoted and null is nothing."""
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_samples(df: DataFrame, folder: str) -> None:
    """Sample messages as JSON and as CSV."""
    write_json(df, f"{folder}/json")
    write_csv(df, f"{folder}/csv")


def write_priority_feed(results: DataFrame, path: str) -> None:
    """Feed rows in feed order; range partitioning keeps the sort parallel."""
    write_csv(views.feed_export(results), path)


def write_full_results(results: DataFrame, path: str) -> None:
    write_csv(views.results_table(results).orderBy("arrival_seq").drop("message_id", "arrival_seq"), path)


def write_nested_results(results: DataFrame, path: str) -> None:
    """One nested JSON object per line."""
    write_json(views.nested_results(results), path)


def write_evaluation(metrics: DataFrame, rows: DataFrame, folder: str) -> None:
    """The metrics as one object, the rows beside it as one object per line.

    The rows stay a table of their own, as a single object holding all of
    them would have to be built by one task.
    """
    write_json(metrics.select(F.struct("*").alias("metrics")), f"{folder}/metrics")
    write_json(rows, f"{folder}/results")
