"""Pandas UDFs that are made when they are used, so that modules can be imported without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
