"""strata: layered data assembly, synchronisation and checking on PySpark.

Every public operator takes DataFrames / Columns and returns a DataFrame or
Column built from built-in Spark expressions, so Catalyst can push filters
and prune columns and whole-stage codegen covers the hot path.
"""

from strata.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
