from recspark.streaming.monitor_stream import (
    degradation_stream, latency_ema_stream, latest_windows, request_classification_stream,
    request_metrics_stream, session_stream, time_chunks, write_time_ordered,
)

__all__ = ["degradation_stream", "latency_ema_stream", "latest_windows",
           "request_classification_stream", "request_metrics_stream", "session_stream", "time_chunks",
           "write_time_ordered"]
