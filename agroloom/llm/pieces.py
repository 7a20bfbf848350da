"""SentencePiece encoding and decoding by a table of distinct chunks.

White space becomes a marker, and no piece of the vocabulary goes on past one, so a text is a row of marked words that
are segmented apart (:class:`agroloom.llm.tokenization.PieceEncoder` checks this of the model). A task segments each
distinct marked word once, whatever number of texts and places it stands in, and puts the ids of a text together by
position from that table. Nothing is shuffled: words meet their ids in the task that read them. The table is bounded;
when it is full it starts anew, which costs time but no result.

Edge cases: null text counts as empty and gives no ids; texts of any length are encoded whole (a word without white
space is one chunk, which the library segments whole); rows that repeat a doc_id are encoded one by one; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from agroloom.llm.common import texts
from agroloom.llm.tokenization import piece_encoder

ROWS_OUT = 256


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, without begin and end ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                b = whole.slice(at, ROWS_OUT)
                ids = coder.encode(b.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``; null ids give null, no ids an empty text."""
    columns = [c for c in encoded.columns if c != text_col]
    at = columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                b = whole.slice(start, ROWS_OUT)
                held = b.column(at).to_pylist()
                found = iter(coder.decode([ids for ids in held if ids is not None]))
                out = [None if ids is None else next(found) for ids in held]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*columns, text_col])

    kept = encoded.select(*columns)
    return kept.mapInArrow(decoded, StructType([*kept.schema.fields, StructField(text_col, StringType())]))
