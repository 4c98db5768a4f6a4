"""Wear-diary analytics as Spark DataFrame operators.

Each operator takes DataFrames in the schemas of ``wearlog.schema`` and returns a
lazy DataFrame, so a report is an ordinary Spark job that Catalyst plans as a whole.
"""

from wearlog.schema import category_dim

__all__ = ["category_dim"]
