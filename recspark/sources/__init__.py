from recspark.sources.files import (
    read_ratings, read_movies, read_tags, read_splits, write_splits,
    write_table, read_table, read_tuning_results,
)
from recspark.sources.testdata import (
    load_table, ratings_view, raw_interactions_view, movies_view,
    item_factors_view, user_factors_view, prediction_log_view, request_log_view,
    global_mean,
)

__all__ = [
    "read_ratings", "read_movies", "read_tags", "read_splits", "write_splits",
    "write_table", "read_table", "read_tuning_results",
    "load_table", "ratings_view", "raw_interactions_view", "movies_view",
    "item_factors_view", "user_factors_view", "prediction_log_view",
    "request_log_view", "global_mean",
]
