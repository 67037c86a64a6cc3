"""Explicit schemas for every table (no inference anywhere)."""

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("userId", T.LongType(), False),
    T.StructField("movieId", T.LongType(), False),
    T.StructField("rating", T.DoubleType(), False),
    T.StructField("timestamp", T.LongType(), False),
])

MOVIES = T.StructType([
    T.StructField("movieId", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("genres", T.StringType(), True),
])

TAGS = T.StructType([
    T.StructField("userId", T.LongType(), False),
    T.StructField("movieId", T.LongType(), False),
    T.StructField("tag", T.StringType(), True),
    T.StructField("timestamp", T.LongType(), False),
])

FACTORS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("bias", T.DoubleType(), True),
    T.StructField("features", T.ArrayType(T.FloatType()), True),
])

TUNING_RESULTS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("n_factors", T.LongType(), True),
    T.StructField("n_epochs", T.LongType(), True),
    T.StructField("lr_all", T.DoubleType(), True),
    T.StructField("reg_all", T.DoubleType(), True),
    T.StructField("val_rmse", T.DoubleType(), True),
    T.StructField("val_mae", T.DoubleType(), True),
    T.StructField("training_time", T.DoubleType(), True),
])

COMPARISON = T.StructType([
    T.StructField("algorithm", T.StringType(), False),
    T.StructField("val_rmse", T.DoubleType(), True),
    T.StructField("val_mae", T.DoubleType(), True),
    T.StructField("test_rmse", T.DoubleType(), True),
    T.StructField("test_mae", T.DoubleType(), True),
    T.StructField("training_time", T.DoubleType(), True),
])

PREDICTION_LOG = T.StructType([
    T.StructField("model_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("movie_id", T.LongType(), False),
    T.StructField("predicted", T.DoubleType(), False),
    T.StructField("actual", T.DoubleType(), True),
])

REQUEST_LOG = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("n", T.LongType(), False),
    T.StructField("experiment_group", T.StringType(), False),
    T.StructField("is_error", T.BooleanType(), False),
    T.StructField("latency_ms", T.DoubleType(), True),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_name", T.StringType(), True),
    T.StructField("start_time", T.TimestampNTZType(), True),
    T.StructField("status", T.StringType(), True),
])

RUN_PARAMS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

RUN_METRICS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("step", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
])

RUN_TAGS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])
