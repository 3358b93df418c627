"""tabsmith: table work for machine-learning datasets, written as Spark DataFrame plans.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``) and stays lazy; nothing is pulled through the driver except
small, size-bounded values (quantile boundaries, a handful of scalars).
"""

__version__ = "0.1.0"
