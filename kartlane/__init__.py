"""kartlane — retail star-schema analytics and demand forecasting on Spark.

Every operator is a function from lazy DataFrames to a lazy DataFrame; nothing
is collected to the driver except bounded, tiny summaries (a handful of
scalars or a <=10x10 Gram matrix), and those places say so.
"""

from kartlane.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
