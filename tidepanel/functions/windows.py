"""The two windows that the panel's operators share; made when asked for, as Spark needs a session for them."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def by_date() -> WindowSpec:
    """A ticker's rows in the order of their dates."""
    return Window.partitionBy("ticker").orderBy("date")


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker")
