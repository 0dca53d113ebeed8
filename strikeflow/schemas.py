"""Input schemas (explicit; no inference at the source)."""

from pyspark.sql import types as T

TICK = T.StructType(
    [
        T.StructField("tick_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("repeated_hour", T.StringType(), True),
        T.StructField("hb_north", T.DoubleType(), True),
        T.StructField("lz_north", T.DoubleType(), True),
        T.StructField("lz_houston", T.DoubleType(), True),
        T.StructField("lz_south", T.DoubleType(), True),
        T.StructField("lz_west", T.DoubleType(), True),
        T.StructField("system_lambda", T.DoubleType(), True),
        T.StructField("rtorpa", T.DoubleType(), True),
        T.StructField("rtoffpa", T.DoubleType(), True),
        T.StructField("rtordpa", T.DoubleType(), True),
        T.StructField("rtolcap", T.DoubleType(), True),
        T.StructField("rtoffcap", T.DoubleType(), True),
    ]
)

SETTLEMENT = T.StructType(
    [
        T.StructField("delivery_date", T.StringType(), True),
        T.StructField("delivery_hour", T.IntegerType(), True),
        T.StructField("delivery_interval", T.IntegerType(), True),
        T.StructField("repeated_hour", T.StringType(), True),
        T.StructField("point_name", T.StringType(), True),
        T.StructField("point_type", T.StringType(), True),
        T.StructField("price", T.DoubleType(), True),
    ]
)

LOLP = T.StructType(
    [
        T.StructField("season", T.StringType(), True),
        T.StructField("start_date", T.StringType(), True),
        T.StructField("end_date", T.StringType(), True),
        T.StructField("start_hour", T.IntegerType(), True),
        T.StructField("end_hour", T.IntegerType(), True),
        T.StructField("lolp_mu", T.DoubleType(), True),
        T.StructField("lolp_sigma", T.DoubleType(), True),
    ]
)

PRICE = T.StructType(
    [
        T.StructField("tick_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("point", T.StringType(), True),
        T.StructField("lmp", T.DoubleType(), True),
    ]
)

TICK_COLUMNS = [f.name for f in TICK.fields]
