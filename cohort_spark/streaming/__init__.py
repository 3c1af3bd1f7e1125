"""Structured Streaming jobs (T1 request scoring, T2 drift monitoring)."""

from .jobs import (drift_windows, late_rows, psi_of_windows, publish_snapshot, reference_shares, run_drift_monitor, run_scoring,
                   scoring_stream, windowed_bin_counts)

__all__ = ["drift_windows", "late_rows", "psi_of_windows", "publish_snapshot", "reference_shares", "run_drift_monitor", "run_scoring",
           "scoring_stream", "windowed_bin_counts"]
