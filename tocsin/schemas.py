"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("urgency", T.StringType()),
])

LABELLED_JSON = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("text", T.StringType()),
])

GAZETTEER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("importance", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("country", T.StringType()),
])

MENTION = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

LOCATION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("country", T.StringType()),
])

# What is kept of a lookup: the name, the country hint and the place, null if unknown.
LOOKUP = T.StructType([
    T.StructField("_key", T.StringType()),
    T.StructField("_hint", T.StringType()),
    T.StructField("_place", T.StructType([
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("geo_confidence", T.DoubleType()),
    ])),
])
