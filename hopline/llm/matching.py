"""Repeated word runs by matching statistics against suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .passages import CHUNK_BYTES, NO_ID, Bucket, Words, chunk_table, gram_hashes, per_document, repeated_spans, rows_by_key

#: Words after which a reference shard is closed: some 20 MB of automaton.
SHARD_WORDS = 20_000

_NEVER = (NO_ID, NO_ID)


class ReferenceShard(SuffixAutomaton):
    """The automaton of a shard's passages; each state knows the earliest place where its runs end."""

    def __init__(self, passages: list[tuple[tuple[int, int], list[bytes]]], window: int):
        """``passages``: the document and place of the first occurrence of each, and its words."""
        super().__init__()
        first: dict[int, tuple[int, int]] = {}
        for (doc, place), words in passages:
            for n, state in enumerate(self.add(words), 1):
                end = (doc, place + n)
                if end < first.get(state, _NEVER):
                    first[state] = end
        self.first = [first.get(s, _NEVER) for s in range(len(self.link))]
        falling = self.by_falling_length()
        for state in falling:
            if self.first[state] < self.first[self.link[state]]:
                self.first[self.link[state]] = self.first[state]
        # the earliest end of the last ``window`` words of a state's runs
        self.earliest = [_NEVER] * len(self.link)
        for state in reversed(falling):
            link = self.link[state]
            if self.length[state] >= window:
                self.earliest[state] = self.first[state] if self.length[link] < window else self.earliest[link]
        self.window = window

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, int]]]:
        """(number of words read, earliest end of the last ``window``) wherever the longest match has as many."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for n, word in enumerate(words, 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= self.window:
                yield n, self.earliest[state]


def _meeting(words: list[list[bytes]], window: int) -> np.ndarray:
    """Passages that may have a window in common with another one or twice: equal hashes tell."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = sizes - window + 1
    known: dict[bytes, int] = {}
    units = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(sizes)), starts)
    place = np.arange(starts.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(starts) + starts, starts)
    hashes = gram_hashes(units, window)[place] if len(place) else np.zeros(0, np.uint64)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return np.unique(owner[counts[inverse] > 1])


def _shards(passages: np.ndarray, words: list[list[bytes]], keys: np.ndarray) -> Iterator[np.ndarray]:
    """Passages dealt into shards of about ``SHARD_WORDS``; those of one key stay together."""
    passages = passages[np.argsort(keys[passages], kind="stable")]
    sizes = np.cumsum([len(words[p]) for p in passages])
    begin = 0
    for end in np.flatnonzero(np.r_[keys[passages][1:] != keys[passages][:-1], True][: len(passages)]) + 1:
        if sizes[end - 1] - (sizes[begin - 1] if begin else 0) >= SHARD_WORDS or end == len(passages):
            yield passages[begin:end]
            begin = end


def earlier_windows(b: Bucket, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that a shard holds at an earlier place.

    The reference is the bucket's distinct passages, each at its first place, in shards of those that
    share an anchor and so can share a window.  Every passage is streamed through its shard's automaton
    once; its first place compares the earliest end of each window with its own, and of its later places
    the whole stream is matched further up.  A passage that shares no window with another has a shard of
    its own, whose automaton is a chain: its later places match it from end to end, so none is built.
    """
    order = np.lexsort((b.begin, b.doc, b.text))
    fresh = np.r_[True, np.diff(b.text[order]) != 0]
    first = order[fresh][np.cumsum(fresh) - 1]
    later = np.zeros(len(order), bool)
    later[order] = (b.doc[order] != b.doc[first]) | (b.begin[order] != b.begin[first])
    words = [t.split(b" ") for t in b.texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = [np.flatnonzero(later)]
    low, high = [np.zeros(len(rows[0]), np.int64)], [sizes[b.text[rows[0]]]]
    own = order[fresh]
    same, x, y = rows_by_key(b.text, np.flatnonzero(~later), len(words))
    for shard in _shards(_meeting(words, window), words, b.codes):
        automaton = ReferenceShard([((int(b.doc[own[p]]), int(b.begin[own[p]])), words[p]) for p in shard.tolist()], window)
        for p in shard.tolist():
            at = (int(b.doc[own[p]]), int(b.begin[own[p]]))
            ends = np.array([n for n, earliest in automaton.stream(words[p]) if earliest < (at[0], at[1] + n)], np.int64)
            for row in same[x[p] : y[p]].tolist():
                rows.append(np.full(len(ends), row))
                low.append(ends - window)
                high.append(ends)
    return np.concatenate(rows), np.concatenate(low), np.concatenate(high)


def repeated_word_runs(docs: DataFrame, window: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Words of every document that lie in a run of ``window`` words which also starts earlier.

    Earlier: in a document of smaller id, or further up in the same one.  Shards are cut by content, not
    by document: a run's anchor names the one shard where all its occurrences are known, so each document
    streams only what that shard can hold, and no shard is sent to the whole corpus.  Null texts have no
    words; documents without an id come last and, like rows that share an id, count as one document's
    places.  Returns doc_id, n_words, n_removed and kept_sha256 of the kept words joined by one space.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def emit(c, flat, ends, spans) -> list[pa.RecordBatch]:
        sizes, removed, kept = [], [], []
        for a, b, (starts, stops) in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), spans):
            left, at = [], a
            for x, y in zip(starts.tolist(), stops.tolist()):
                left += flat[at:x]
                at = y
            left += flat[at:b]
            sizes.append(b - a)
            removed.append(b - a - len(left))
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
        columns = [pa.array(c.ids, mask=c.ids == NO_ID), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return [pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])]

    chunks = chunk_table(docs.select("doc_id", "text"), chunk_bytes)
    spans = repeated_spans(chunks, Words(), window, max(1, min(8, window // 2)), earlier_windows)
    return per_document(chunks, spans, Words(), emit, schema)
