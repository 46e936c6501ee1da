"""panelkit — Spark-native operators for entity × year panel analytics.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``); nothing is collected to the driver inside an operator.
"""

from panelkit.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
