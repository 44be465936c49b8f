"""Column types of the datasets the library reads and writes."""

from pyspark.sql import types as T

GEO = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("place", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("geo", GEO),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    ]
)

# A record as it comes off a keyed log.
RAW = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("event_ids", T.ArrayType(T.StringType())),
        T.StructField("absence", T.BooleanType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
