"""Token windows as a table function that SQL calls: ``SELECT * FROM pack_windows(TABLE(units) PARTITION BY doc_id ORDER BY (ordinal), 10000, 1500)``.

Units come one by one, in order, and only the open window's are held, so a document of any length takes the memory of a window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .enrichment import OVERLAP_TOKENS, WINDOW_TOKENS

NEEDED = ("doc_id", "ordinal", "unit_id", "tokens")


@udtf
class PackWindows:
    """(doc_id, window, members, tokens) of units (doc_id, ordinal, unit_id, tokens): the rule of enrichment.pack_windows().

    Arguments: the table, partitioned by doc_id and ordered by ordinal, and whole numbers for size and overlap.
    """

    def __init__(self) -> None:
        self.doc, self.held, self.total, self.window, self.size, self.overlap, self.new = None, deque(), 0, 0, WINDOW_TOKENS, OVERLAP_TOKENS, False

    @staticmethod
    def analyze(units: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not units.isTable:
            raise ValueError("pack_windows takes a table: TABLE(units) PARTITION BY doc_id ORDER BY ordinal")
        kinds = {f.name: f.dataType for f in units.dataType.fields}
        if missing := [c for c in NEEDED if c not in kinds]:
            raise ValueError(f"pack_windows misses columns: {', '.join(missing)}")
        for name, a in (("size", size), ("overlap", overlap)):
            if a is not None and not (a.isConstantExpression and isinstance(a.value, int) and a.value >= 0):
                raise ValueError(f"{name} must be a whole number, not a column")
        return AnalyzeResult(StructType([StructField("doc_id", kinds["doc_id"]), StructField("window", IntegerType()), StructField("members", ArrayType(StringType())), StructField("tokens", LongType())]))

    def eval(self, unit: Row, size: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> Iterator[tuple]:
        self.doc, self.size, self.overlap = unit["doc_id"], size, overlap
        n = int(unit["tokens"])
        if self.new and self.total + n > size:
            yield self._flushed()
            while self.total > overlap:
                self.total -= self.held.popleft()[1]
        self.held.append((None if unit["unit_id"] is None else str(unit["unit_id"]), n))
        self.total, self.new = self.total + n, True

    def _flushed(self) -> tuple:
        self.window += 1
        return self.doc, self.window - 1, [u for u, _ in self.held], self.total

    def terminate(self) -> Iterator[tuple]:
        if self.new:
            yield self._flushed()


def register(spark: SparkSession) -> None:
    """Make pack_windows known to SQL."""
    spark.udtf.register("pack_windows", PackWindows)
