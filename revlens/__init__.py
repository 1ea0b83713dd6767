"""revlens — subscription-revenue analytics written as plain Spark DataFrame plans.

Layout:
  sources/    feed readers (CSV/parquet) and the mapping of the driver tables to feeds
  functions/  Column-level expressions (status rules, floor-day arithmetic, rounding, text)
  operators/  DataFrame -> DataFrame building blocks (cleaning, rollups, joins, cohort, forecast)
  plans/      the named query catalogue and its DuckDB oracle statements
"""

from revlens.session import DEFAULT_AS_OF, build_session, ensure_checkpoint_dir

__all__ = ["DEFAULT_AS_OF", "build_session", "ensure_checkpoint_dir"]
