"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import giving_back, text_bytes
from .tokens import MEMO_WORDS, encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: sequence_id: 5 bits of bucket, 26 of input partition, 32 of place in the bucket
_BUCKET, _PARTITION = 58, 32


def piece_lengths(n: int, longest: int) -> list[int]:
    """Whole pieces of ``longest``, then the binary digits of the rest, large to small."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, longest: int = 4096, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Cuts each document's ids (with ``end_id`` after the last) into pieces of power-of-two length.

    Every piece is a sequence of its own: none crosses a document, none needs padding, and the sequences
    of one length form a bucket from which batches of equal shape are drawn.  ``sequence_id`` holds the
    bucket in its high bits, then the input partition and the place in it, so ids are unique and sort by
    bucket without a shuffle; ``ids`` holds little-endian unsigned 32-bit ids.

    ``memo_words`` bounds what a worker remembers (see ``tokens``).  ``longest`` must be a power of two.  A null or empty text is the end id alone.  Rows with equal ids
    are packed each on its own; a null id stays null.  An empty table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition = encoder(vocabulary, memo_words).encode, TaskContext.get().partitionId()
        places = [0] * 64
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(text_bytes(batch.column(1)))):
                raw, total, start = np.append(ids, end_id).astype("<u4").tobytes(), len(ids) + 1, 0
                for length in piece_lengths(total, longest):
                    part, bucket = raw[4 * start : 4 * (start + length)], length.bit_length() - 1
                    row = (doc, start, length, part, zlib.crc32(part), total, bucket << _BUCKET | partition << _PARTITION | places[bucket], 0)
                    for column, value in zip(out, row):
                        column.append(value)
                    places[bucket] += 1
                    start += length
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(giving_back(pack), PIECE_SCHEMA)
