"""Operator 9: token counts of whole texts, by rank-synchronous array merging.

Rows: one per document row. A null text counts as an empty one (0 bytes, 0
tokens). Special strings inside a text count as one token each, as the
tokenizer library does by default. No row is cut, whatever its length: words
are what is remembered, not texts. Repeated rows give repeated results, null
ids stay null, and an empty table gives an empty one. Columns besides the two
named ones are not read, so others may clash with the output's names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas.llm.bpe import TokenCounter


def count_tokens(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, rows: int = 256
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; rows are counted in slices of `rows`."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(1).to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
