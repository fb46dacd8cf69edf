"""Shape of an activity record and the column names used by every operator.

The record schema is fixed up front so that JSON is never scanned for inference.
Only fields that some operator reads are declared; Parquet and JSON readers skip
the rest.
"""

from pyspark.sql import types as T

_ENTITIES = T.StructType([
    T.StructField("hashtags", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType())]))),
    T.StructField("user_mentions", T.ArrayType(T.StructType([
        T.StructField("screen_name", T.StringType())]))),
])

_ACTOR = T.StructType([T.StructField("preferredUsername", T.StringType())])

ACTIVITY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("verb", T.StringType()),
    T.StructField("postedTime", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("twitter_lang", T.StringType()),
    T.StructField("actor", _ACTOR),
    T.StructField("object", T.StructType([
        T.StructField("body", T.StringType()),
        T.StructField("actor", _ACTOR),
        T.StructField("twitter_entities", _ENTITIES),
    ])),
    T.StructField("twitter_entities", _ENTITIES),
])

DATE = "postedDate"
HOUR = "postedHour"
AUTHOR = "AU"
TOKENS = "toks"
SENTIMENT = "sentiment"
COUNT = "count"
