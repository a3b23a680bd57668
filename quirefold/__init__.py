"""quirefold: document analytics on Spark.

Sub-packages
------------
functions   column expressions and small Arrow functions
operators   DataFrame in, DataFrame out
sources     readers and inline fixtures
plans       named queries and their SQL twins
streaming   Structured Streaming forms of the staged work queue
"""

__version__ = "0.1.0"
