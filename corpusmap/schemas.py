"""Fixed schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_INSTITUTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ror", T.StringType()),
        T.StructField("display_name", T.StringType()),
    ]
)

WORK_RAW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("publication_year", T.LongType()),
        T.StructField(
            "authorships",
            T.ArrayType(
                T.StructType([T.StructField("institutions", T.ArrayType(_INSTITUTION))])
            ),
        ),
        T.StructField(
            "abstract_inverted_index",
            T.MapType(T.StringType(), T.ArrayType(T.IntegerType())),
        ),
        T.StructField(
            "primary_location",
            T.StructType([T.StructField("landing_page_url", T.StringType())]),
        ),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("faculty", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

MAP_POINT = T.StructType(
    RECORD.fields
    + [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("cluster", T.IntegerType()),
    ]
)
