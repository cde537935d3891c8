"""Token counts and token boundaries by a given tokenizer. What a tokenizer is to the library: two methods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


class TokenCounter(Protocol):
    def count(self, text: str) -> int:
        """Number of tokens."""

    def starts(self, text: str) -> list[int]:
        """Characters at which tokens begin, in rising order."""


class FixedWidth:
    """Tokens of four characters: what token_estimate() counts by, with boundaries."""

    def __init__(self, width: int = 4):
        self.width = width

    def count(self, text: str) -> int:
        return max(1, len(text) // self.width) if text else 0

    def starts(self, text: str) -> list[int]:
        return list(range(0, len(text), self.width))


class FileTokenizer:
    """A tokenizer file of the optional tokenizers library. A token that begins inside a character's bytes begins at no boundary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> list[int]:
        out, end = [], 0
        for a, b in self.tokenizer.encode(text, add_special_tokens=False).offsets:
            if a >= end and b > a:
                out.append(a)
            end = max(end, b)
        return out


def with_token_counts(df: DataFrame, counter: Callable[[], TokenCounter], column: str = "text", out: str = "tokens") -> DataFrame:
    """df with the number of tokens of a text column, 0 for null; ``counter`` makes the tokenizer, once in each task."""
    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    place = df.columns.index(column)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ready = counter()
        for batch in batches:
            n = pa.array([ready.count(t) if t else 0 for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=schema.names)

    return df.mapInArrow(work, schema)
