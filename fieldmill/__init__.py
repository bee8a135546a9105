"""fieldmill: map loosely structured tables onto fixed target layouts with Spark.

Every row-level rule is a native Spark ``Column`` expression; table-level
operators (reports, lookups, decisions) are DataFrame joins and aggregates.
"""

from fieldmill.session import build_session, checkpoint_dir, scratch_path, stable

__all__ = ["build_session", "checkpoint_dir", "scratch_path", "stable"]
