"""plaudit: review analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) and keeps
no driver-side state; the plans are left to Catalyst and AQE.
"""

from plaudit.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
