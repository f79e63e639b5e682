"""Irregular, multi-source measurement series on Spark.

Every operator is a function from DataFrame to DataFrame; nothing runs until the caller writes or
collects the result.  See README.md for the layout and the scale rules.
"""
