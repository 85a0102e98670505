"""Functions that SQL can call by name once ``register`` has run in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.retrieval import chunks


class ChunkText:
    """chunk_text(text [, size]): start and chunk of each passage of a text; a null text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("chunk_text takes a string")
        if size is not None and (not size.isConstantExpression or not size.value or int(size.value) < 1):
            raise ValueError("the size of chunk_text is a positive constant")
        return AnalyzeResult(StructType().add("start", LongType()).add("chunk", StringType()))

    def eval(self, text: str | None, size: int = 650) -> Iterator[tuple[int, str]]:
        yield from ((int(start), chunk) for start, chunk in (chunks(text, int(size)) if text else ()))


def register(spark: SparkSession) -> None:
    """Makes ``chunk_text`` known to the session's catalog. A row's text is cut in the task that reads it; nothing is shuffled."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
