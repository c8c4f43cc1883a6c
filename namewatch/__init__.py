"""namewatch: measuring invented package names in model-written code, on Spark.

Response tables (or streams) in; mention tables, registry joins and recurrence metrics
out. Every operator is a ``DataFrame -> DataFrame`` function or a ``Column`` builder.
"""

__version__ = "0.1.0"
