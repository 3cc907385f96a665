"""Vectorised Python functions that are built when they are used: a schema string needs a session to be read."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F


def vectorised(schema: str) -> Callable:
    """A pandas UDF of the decorated function."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap
