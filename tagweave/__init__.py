"""tagweave: Spark-native text features, semi-supervised tagging and text analytics.

Every operator is a function over DataFrames or Columns; the heavy work is
joins, aggregations, windows and higher-order array expressions that Catalyst
plans and Tungsten runs. See README.md for the operator map.
"""

from tagweave.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
