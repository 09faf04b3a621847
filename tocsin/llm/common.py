"""Helpers that several jobs of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.runtime import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the rows of one key are dealt, whatever the key's size.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Later readers agree on every row, also after an executor is lost.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII text takes the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def salted_lookup(rows: DataFrame, values: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Join ``values`` (one row per key) to ``rows`` without gathering a key's rows in one task.

    The distinct pairs of key and salt meet the values first, ``SALTS`` rows
    a key at most; then the rows meet those pairs, spread by key and salt.
    Keys must not be null.
    """
    pairs = rows.select(*keys, salt).distinct().join(values, keys)
    return rows.join(pairs, [*keys, salt])


def rank_in_groups(
    rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], name: str
) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``bucket``, then ``order``.

    ``bucket`` cuts a group into ranges of the order, so a group with most
    rows is numbered by many tasks; only the counts per range meet.  ``rows``
    must be pinned or repeatable.  Group columns must not be null.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, bucket, F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = rows.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    return (
        numbered.join(starts, [*group, bucket])
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )
