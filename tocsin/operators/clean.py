"""Cleaning of raw message text: a chain of projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions import text as X


def clean_column(
    df: DataFrame,
    name: str,
    *,
    remove_urls: bool = True,
    remove_mentions: bool = True,
    convert_symbols: bool = True,
    segment_hashtags: bool = True,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Clean text column ``name`` in place; the order of steps matters.

    Every step is a projection of its own: steps that use the text more than
    once would otherwise repeat all earlier steps inside one expression.
    """
    steps = [
        (True, lambda t: X.drop(t, C.REPOST_PATTERN)),
        (remove_urls, lambda t: F.when(X.may_hold_url(t), X.drop(t, C.URL_PATTERN)).otherwise(t)),
        (
            remove_mentions,
            lambda t: F.when(X.may_hold_mention(t), X.drop(t, C.MENTION_PATTERN)).otherwise(t),
        ),
        (convert_symbols, lambda t: X.symbols_to_words(t, aliases)),
        (segment_hashtags, X.segment_hashtags),
        (True, X.to_nfc),
        (True, X.drop_zero_width),
        (True, X.collapse_spaces),
    ]
    for wanted, step in steps:
        if wanted:
            df = df.withColumn(name, step(F.col(name)))
    return df


def has_media(urls: Column) -> Column:
    marks = "|".join(m.replace(".", r"\.") for m in C.MEDIA_MARKS)
    return F.exists(urls, lambda u: F.lower(u).rlike(marks))


def clean_messages(
    df: DataFrame,
    *,
    text_col: str = "text",
    remove_urls: bool = True,
    remove_mentions: bool = True,
    convert_symbols: bool = True,
    segment_hashtags: bool = True,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Add original and cleaned text, hashtags, mentions, urls and has_media.

    Links, mentions and hashtags come from the raw text.  Blank messages get
    an empty cleaned text and empty lists.
    """
    raw = F.col(text_col)
    kept = [c for c in df.columns if c != text_col]
    text = F.col("cleaned_text")

    def found(test, pattern: str, group: int = 0) -> Column:
        return F.when(test(text), X.find_all(text, pattern, group)).otherwise(X.no_strings())

    staged = df.select(
        *kept,
        raw.alias("_raw"),
        F.when(X.is_blank(raw), F.lit("")).otherwise(raw).alias("cleaned_text"),
    )
    staged = staged.select(
        *kept,
        F.coalesce("_raw", F.lit("")).alias("original_text"),
        "cleaned_text",
        found(X.may_hold_hashtag, C.HASHTAG_PATTERN, 1).alias("hashtags"),
        found(X.may_hold_mention, C.MENTION_PATTERN).alias("mentions"),
        found(X.may_hold_url, C.URL_PATTERN).alias("urls"),
    )
    return clean_column(
        staged,
        "cleaned_text",
        remove_urls=remove_urls,
        remove_mentions=remove_mentions,
        convert_symbols=convert_symbols,
        segment_hashtags=segment_hashtags,
        aliases=aliases,
    ).withColumn("has_media", has_media(F.col("urls")))
