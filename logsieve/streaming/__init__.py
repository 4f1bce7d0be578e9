"""Live log analysis on Structured Streaming."""

from .live import (  # noqa: F401
    alerts,
    event_time_for_streams,
    open_window_features,
    read_log_stream,
    row_severity,
    score_batches,
    window_features_stream,
)
from .sequences import carried_sequences, file_sequences, score_lines, score_sequences  # noqa: F401
