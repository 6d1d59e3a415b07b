"""archtrail: dependency-graph and activity analytics as PySpark DataFrame jobs.

Every public operator takes and returns DataFrames with declared column names.
Nothing here knows whether rows came from a source tree or from parquet tables.
"""

__version__ = "0.1.0"
