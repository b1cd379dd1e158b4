"""Event logs as streams."""

from .events import capped_once, capped_to, daily_counts, daily_people, event_stream, late_rows, log_to, mirror_to, run_once

__all__ = ["capped_once", "capped_to", "daily_counts", "daily_people", "event_stream", "late_rows", "log_to", "mirror_to", "run_once"]
