"""plumbline: score review packages against gold labels and check the case pools, on Spark."""

from plumbline.session import build_session, read_table, work_dir

__all__ = ["build_session", "read_table", "work_dir"]
