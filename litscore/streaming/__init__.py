"""The alert queue as a stream."""

from litscore.streaming.alerts import (
    pending_messages,
    redrive_unhandled,
    score_alert_stream,
    write_density,
)

__all__ = ["pending_messages", "redrive_unhandled", "score_alert_stream", "write_density"]
