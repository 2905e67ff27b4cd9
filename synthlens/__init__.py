"""synthlens: judging synthetic session records against real ones, on Spark.

Every operator is a function from DataFrame(s) to a DataFrame built from
public PySpark APIs; see ``synthlens.operators`` for the catalogue.
"""

from synthlens.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
