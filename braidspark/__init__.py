"""Alignment-file analytics and corpus preparation on Apache Spark.

The alignment engine (``braidspark.api``) and the training-data operators
(``braidspark.llm``) are independent: nothing outside ``llm`` imports it.
"""

__version__ = "0.1.0"
