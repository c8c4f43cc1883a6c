"""Column builders (``text``) and the expression cache they share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import SparkContext

_CACHE: dict[tuple, Any] = {}


def cached_column(key: str, build: Callable[[], Any]) -> Any:
    """Build a (large, input-independent) Column once per SparkContext.

    Columns made of column names, literals and lambdas do not depend on the DataFrame
    they are applied to, so the Python-side construction cost (many JVM round trips for
    higher-order functions) is paid once instead of per query."""
    sc = SparkContext._active_spark_context
    ident = (key, sc.applicationId if sc is not None else None)
    if ident not in _CACHE:
        _CACHE[ident] = build()
    return _CACHE[ident]
