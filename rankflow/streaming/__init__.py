"""Structured Streaming jobs."""

from rankflow.streaming.follow import (
    arrivals,
    first_wait_seconds,
    follow_lines,
    follow_rank_stats,
    gate_late,
    open_table,
    require_all,
    require_complete,
    run_to_table,
    seen_once,
    stats_to_table,
    stripped_lines,
    watch_jobs,
)

__all__ = [
    "arrivals",
    "first_wait_seconds",
    "follow_lines",
    "follow_rank_stats",
    "gate_late",
    "open_table",
    "require_all",
    "require_complete",
    "run_to_table",
    "seen_once",
    "stats_to_table",
    "stripped_lines",
    "watch_jobs",
]
