"""Tallymark: model-evaluation analytics as Spark jobs.

Score prediction tables, roll quality, latency, throughput and cost up per
model and dataset, rank models, mine parameter trials, compare A/B variants,
classify error logs and watch telemetry.  Every operator takes DataFrames and
returns a DataFrame.
"""

from tallymark.session import build_session, ensure_checkpoint_dir, scratch_path

__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path"]
