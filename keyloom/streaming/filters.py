"""A condition as a stateless filter of a stream: the wide plan needs no join, so no watermark either."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.compiler import Compiler
from ..plans.conditions import Condition
from ..sources.catalog import IndexSet


def matching(stream: DataFrame, identity: str, condition: Condition) -> DataFrame:
    """Rows of ``stream`` (one an identity) that match; all their columns."""
    c = Compiler(IndexSet.from_table(stream, identity, unique=True))
    if not c.can_be_wide(condition):
        raise ValueError("only conditions over the stream's own columns can be asked of a stream")
    return stream.where(c.test(condition))
