"""Spark-native analytics for machining-vibration signals.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a ``Column`` expression) built on the public
Spark DataFrame, SQL, ML and Structured Streaming APIs.
"""

__version__ = "0.1.0"
