"""Repeated substrings from an enhanced suffix array and its tree of common-prefix intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .passages import CHUNK_BYTES, NO_ID, Bucket, Bytes, chunk_table, gram_hashes, per_document, repeated_spans, rows_by_key

#: Stands for the byte before a stretch, which its bucket does not see.
_UNSEEN = 256


def _gram(window: int) -> int:
    """Anchors of up to 24 bytes: long enough to be rare, and windows of 50 still hold 27 of them."""
    return max(1, min(24, window // 2))


class SuffixArray:
    """Suffixes of several stretches that can begin a maximal repeat of ``least`` bytes or more.

    A suffix counts if its first ``least`` bytes occur elsewhere and what stands before differs among
    those occurrences (before a stretch's first byte anything may stand).  All others extend to the left
    with every occurrence, so their repeats are part of a longer one.

    ``twice`` lists the stretches that occur again as a whole.  The second occurrence stands for all
    further ones; its owner is numbered on from the stretches, and it adds the suffix at its first byte,
    the only one that the first occurrence does not have at the same place with the same byte before.
    """

    def __init__(self, stretches: list[bytes], least: int, twice: np.ndarray | None = None):
        sizes = np.array([len(s) for s in stretches], np.int64)
        text = np.frombuffer(b"".join(stretches), np.uint8)
        begins = np.cumsum(sizes) - sizes
        starts = sizes - least + 1
        owner = np.repeat(np.arange(len(sizes)), starts)
        inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        place = begins[owner] + inner
        stands_for = owner
        if twice is not None and len(twice):
            whole = twice[sizes[twice] >= least]
            owner = np.r_[owner, len(sizes) + np.flatnonzero(sizes[twice] >= least)]
            stands_for, inner, place = np.r_[stands_for, whole], np.r_[inner, np.zeros(len(whole), np.int64)], np.r_[place, begins[whole]]
        hashes = gram_hashes(text, least)[place] if len(place) else np.zeros(0, np.uint64)
        before = np.where(inner > 0, text[place - 1].astype(np.int64), _UNSEEN)
        order = np.argsort(hashes, kind="stable")
        cuts = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        if len(cuts):
            low, high = np.minimum.reduceat(before[order], cuts), np.maximum.reduceat(before[order], cuts)
            count = np.diff(np.r_[cuts, len(order)])
            wanted = (count > 1) & ((low != high) | (high == _UNSEEN))
            order = np.sort(order[np.repeat(wanted, count)])
        self.owner, self.inner, self.before = owner[order], inner[order], before[order]
        self._sort(text, place[order], (begins + sizes)[stands_for[order]] - place[order], least)

    def _sort(self, text: np.ndarray, place: np.ndarray, left: np.ndarray, least: int) -> None:
        """Puts the suffixes in order and finds the common prefix of each with the one before."""
        width = int(-(-max(left, default=least) // 8) * 8)
        grid = np.arange(width)
        rows = np.where(grid < left[:, None], np.r_[text, np.zeros(width, np.uint8)][place[:, None] + grid], 0).astype(np.uint8)
        words = rows.reshape(len(rows), width).view(">u8").astype(np.uint64)
        # a suffix that is a prefix of another comes first: its end counts as the smallest byte
        self.order = np.lexsort((left, *words.T[::-1])) if len(rows) else np.zeros(0, np.int64)
        rows, left = rows[self.order], left[self.order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width) if len(rows) > 1 else np.zeros(0, np.int64)
        self.common = np.minimum(common, np.minimum(left[1:], left[:-1]))

    def repeats(self, least: int, rank: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Maximal repeats (first, last, length, least rank): places ``first`` to ``last`` of ``order``.

        One scan with a stack gives the intervals of suffixes with a common prefix, inner before outer;
        an interval is a maximal repeat if the bytes before its occurrences differ.
        """
        if not len(self.order):
            return
        before, rank = self.before[self.order].tolist(), rank[self.order].tolist()
        # length of the common prefix, first place, least and greatest byte before, least rank
        stack: list[list[int]] = []
        for at, common in enumerate([*self.common.tolist(), 0]):
            byte, own = before[at], rank[at]
            open_ = [0, at, byte, byte, own]
            while stack and stack[-1][0] > common:
                top = stack.pop()
                top[2:] = [min(top[2], open_[2]), max(top[3], open_[3]), min(top[4], open_[4])]
                if top[2] != top[3] or top[3] == _UNSEEN:
                    yield top[1], at, top[0], top[4]
                open_ = [0, *top[1:]]
            if common < least:
                continue
            if stack and stack[-1][0] == common:
                top = stack[-1]
                top[2:] = [min(top[2], open_[2]), max(top[3], open_[3]), min(top[4], open_[4])]
            else:
                stack.append([common, *open_[1:]])


def earlier_repeats(b: Bucket, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of maximal repeats in places whose document is not the first that holds the repeat."""
    n = len(b.texts)
    first = np.full(n, NO_ID)
    np.minimum.at(first, b.text, b.doc)
    later = b.doc > first[b.text]
    twice = np.unique(b.text[later])
    array = SuffixArray(b.texts, window, twice)
    docs = np.concatenate([first, first[twice] + 1])[array.owner]
    groups = np.array(list(array.repeats(window, docs)), np.int64).reshape(-1, 4)
    longest = np.zeros(len(array.owner), np.int64)
    # blocks: nested groups list an occurrence once for each depth
    for block in np.array_split(groups, max(1, len(groups) // 4096)):
        size = block[:, 1] - block[:, 0] + 1
        at = array.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block[:, 0], size)]
        after = docs[at] > np.repeat(block[:, 3], size)
        np.maximum.at(longest, at[after], np.repeat(block[:, 2], size)[after])
    found = np.flatnonzero(longest)
    # an owner up to n is the first document with that text, one beyond stands for all others
    first_rows, a0, a1 = rows_by_key(b.text, np.flatnonzero(~later), n)
    other_rows, b0, b1 = rows_by_key(b.text, np.flatnonzero(later), n)
    rows = np.r_[first_rows, other_rows]
    low = np.r_[a0, len(first_rows) + b0[twice]][array.owner[found]]
    size = np.r_[a1, len(first_rows) + b1[twice]][array.owner[found]] - low
    places = rows[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
    start, length = (np.repeat(x, size) for x in (array.inner[found], longest[found]))
    return places, start, start + length


def _cut(text: bytes, spans: tuple[np.ndarray, np.ndarray], begin: int) -> bytes:
    kept, at = [], 0
    for a, b in zip(*(s.tolist() for s in spans)):
        kept.append(text[at : a - begin])
        at = b - begin
    return b"".join([*kept, text[at:]])


def repeated_substrings(docs: DataFrame, least: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Bytes of every document that lie in a ``least``-byte string which also starts in a document of smaller id.

    Strings are judged on the input and never cross documents.  Null texts are empty; documents without
    an id come after all others and are not earlier than each other, nor are rows that share an id.
    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def emit(c, whole, ends, spans) -> list[pa.RecordBatch]:
        begins = np.r_[0, ends[:-1]].tolist()
        kept = [hashlib.sha256(_cut(t, s, b)).hexdigest() for t, s, b in zip(c.texts, spans, begins)]
        columns = [
            pa.array(c.ids, mask=c.ids == NO_ID),
            pa.array([len(t) for t in c.texts], pa.int64()),
            pa.array([int((s[1] - s[0]).sum()) for s in spans], pa.int64()),
            pa.array([len(s[0]) for s in spans], pa.int64()),
            pa.array(kept, pa.string()),
        ]
        return [pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])]

    chunks = chunk_table(docs.select("doc_id", "text"), chunk_bytes)
    spans = repeated_spans(chunks, Bytes(), least, _gram(least), earlier_repeats)
    return per_document(chunks, spans, Bytes(), emit, schema)


def without_repeated_substrings(docs: DataFrame, least: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of ``docs``; texts lose what ``repeated_substrings`` marks.

    A character that is cut in two goes as a whole.  Documents of which nothing but white space is left
    go; those without marks keep their texts, null and empty texts included.  Repeated rows and rows
    without an id count as in ``repeated_substrings``; an empty table stays empty.
    """
    names, was_null = docs.columns, free_name(docs, "null_text")

    def emit(c, whole, ends, spans) -> list[pa.RecordBatch]:
        begins = np.r_[0, ends[:-1]].tolist()
        texts = [_cut(t, s, b).decode(errors="ignore") for t, s, b in zip(c.texts, spans, begins)]
        keep = [not len(s[0]) or bool(t.strip()) for t, s in zip(texts, spans)]
        rest = c.rest.combine_chunks()
        null = rest.column(was_null).to_pylist()
        columns = [pa.array([None if n else t for n, t in zip(null, texts)], pa.string()) if name == "text" else rest.column(name).combine_chunks() for name in names]
        return pa.Table.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    chunks = chunk_table(docs.withColumn(was_null, F.col("text").isNull()), chunk_bytes)
    spans = repeated_spans(chunks, Bytes(), least, _gram(least), earlier_repeats)
    return per_document(chunks, spans, Bytes(), emit, docs.schema)
