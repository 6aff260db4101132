"""corvane: a PySpark-native index, search and audit engine for source code and text.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; Arrow-batched Python is used only where Spark has no expression.
"""
