"""headroom — capacity-planning analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (plus explicit parameters such as
``as_of``) to a DataFrame.  Nothing is collected to the driver; all work is
expressed with Spark SQL column expressions so Catalyst can push filters and
prune columns down to the Parquet scans.
"""

from headroom.session import get_spark

__all__ = ["get_spark"]
