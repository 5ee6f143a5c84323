"""Vectorised Python functions that are declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(returns: str) -> Callable:
    """Makes a function of pandas Series a column function; the pandas UDF is made when it is first applied."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list = []

        @functools.wraps(f)
        def apply(*columns: Column | str) -> Column:
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        return apply

    return wrap
