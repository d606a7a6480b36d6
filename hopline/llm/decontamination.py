"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import free_name, giving_back, merge_runs, text_bytes, written

#: Bytes of item texts in one automaton, which then takes some 200 MB; more items are matched block by block.
BLOCK_BYTES = 2 << 20

#: Fixed by contract: what a word is made of (after A-Z became a-z): digits, a-z and all beyond ASCII.
WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_TO_SPACE = bytes(b if b in WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(b"[^ ]+")


def plain(text: bytes) -> bytes:
    """Lower-cased text with a space for every byte outside words; places stay the same."""
    return text.lower().translate(_TO_SPACE)


class ItemAutomaton(SuffixAutomaton):
    """The test items' words, with the items and windows that each state stands for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        super().__init__()
        self.window = window
        self.word_id: dict[bytes, int] = {}
        numbered = [(name, [self.word_id.setdefault(w, len(self.word_id)) for w in words]) for name, words in items if words]
        for _, words in numbered:
            self.add(words)
        self._annotate(numbered)
        self.shortest = min([window, *(len(words) for _, words in numbered)])

    def _annotate(self, items: list[tuple[str | None, list[int]]]) -> None:
        """For each state: the state of its runs' last ``window`` words, the items there, whole short items."""
        n = len(self.link)
        self.window_state = [-1] * n
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * n
        seen, owners = [-1] * n, [[] for _ in range(n)]
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for nth, (name, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.next[state][word]
                up = state
                while up > 0 and seen[up] != nth:
                    seen[up] = nth
                    if self.length[self.link[up]] < self.window <= self.length[up]:
                        owners[up].append(name)
                    up = self.link[up]
            if len(words) < self.window:
                ends.setdefault(state, []).append((len(words), name))
        for state in reversed(self.by_falling_length()):
            link = self.link[state]
            if self.length[state] >= self.window:
                self.window_state[state] = state if self.length[link] < self.window else self.window_state[link]
            self.short[state] = self.short[link] + tuple(sorted(ends.get(state, ()), key=lambda e: e[0]))
        self.owners = owners

    def match(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str | None]]:
        """Runs of hit words (starts, ends) and the items with a window among ``words``."""
        get = self.word_id.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].view(np.int8)))
        starts, ends, names = [], [], set()
        # a window holds words of the items only, so shorter runs of known words have none
        for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - first >= self.shortest:
                self._stream(ids[first:stop].tolist(), first, starts, ends, names)
        return *merge_runs(np.array(starts, np.int64), np.array(ends, np.int64)), names

    def _stream(self, ids: list[int], first: int, starts: list[int], ends: list[int], names: set[str | None]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for place, word in enumerate(ids, first + 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                starts.append(place - window)
                ends.append(place)
                names.update(self.owners[self.window_state[state]])
            for size, name in self.short[state]:
                if size <= matched:
                    starts.append(place - size)
                    ends.append(place)
                    names.add(name)


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """Items with words, dealt into blocks of about ``BLOCK_BYTES`` of text; one block where they fit."""
    items = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("length(text) > 0")
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    if blocks < 2:
        return [items]
    return [items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {block}")) for block in range(blocks)]


def _automaton(items: DataFrame, window: int) -> ItemAutomaton:
    return ItemAutomaton([(r.item_id, plain(r.text.encode()).split()) for r in items.toLocalIterator()], window)


_SPANS = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _found(text: bytes, automaton: ItemAutomaton) -> dict:
    words = plain(text).split()
    starts, ends, names = automaton.match(words)
    return {"n_words": len(words), "spans": [{"from": a, "to": b} for a, b in zip(starts.tolist(), ends.tolist())], "items": sorted(x for x in names if x is not None)}


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int, name: str, then: Callable | None = None) -> DataFrame:
    """All columns of ``docs`` and, as ``name``, a struct of n_words, spans and items (see ``contaminated_spans``).

    ``then`` takes these batches and gives rows with the columns of ``docs``, in the same worker: a second
    Python operator would need workers of its own.
    """
    names = [*docs.columns, name]
    context, at, out_type = docs.sparkSession.sparkContext, docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, _FOUND)])

    def whole(run: Callable) -> tuple[Callable, T.StructType]:
        return (giving_back(lambda batches: then(run(batches))), docs.schema) if then else (giving_back(run), out_type)

    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        shared = context.broadcast(_automaton(blocks[0], window))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_found(t, shared.value) for t in text_bytes(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_FOUND)], names=names)

        return docs.mapInArrow(*whole(match))

    # rows are numbered and written, so each block's hits, which are written too, find their rows again
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    hits = []
    for block in blocks:
        shared = context.broadcast(_automaton(block, window))

        def match_block(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_found(t, shared.value) for t in text_bytes(batch.column(1))]
                hit = pa.array([bool(f["spans"]) for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_FOUND)], names=["row", "found"]).filter(hit)

        hits.append(written(numbered.select(F.col(row).alias("row"), "text").mapInArrow(giving_back(match_block), T.StructType([T.StructField("row", T.LongType()), T.StructField("found", _FOUND)])), "benchmark-hits"))
        shared.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    merged = every.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("found.spans")).alias(name), F.flatten(F.collect_list("found.items")).alias(f"{name}_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, spans, items = batch.columns
            found = []
            for text, some, own in zip(text_bytes(batch.column(at)), spans.to_pylist(), items.to_pylist()):
                starts, ends = merge_runs(*(np.array([x[k] for x in some or ()], np.int64) for k in ("from", "to")))
                found.append({"n_words": len(plain(text).split()), "spans": [{"from": a, "to": b} for a, b in zip(starts.tolist(), ends.tolist())], "items": sorted(set(own or ()))})
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW_FOUND)], names=names)

    return numbered.join(merged, row, "left").select(*docs.columns, name, f"{name}_items").mapInArrow(*whole(merge))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Streams every document through the automaton of the benchmark items' words.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  A window is
    ``window`` consecutive words of an item, or a whole shorter item.  The longest match that ends at
    each document word is tracked; where it covers a window, the window's words are hit.

    Item texts up to ``BLOCK_BYTES`` make one broadcast automaton; beyond, the items are dealt into
    blocks, one automaton exists at a time, and its hits are written before the next one.  Null texts
    have no words; an item without an id counts towards hits and is not listed.  Repeated documents are
    judged each on its own; an empty benchmark hits nothing, and an empty table gives an empty result.
    Other columns are not read.

    Returns doc_id, text, n_words, spans (maximal runs of hit words, [from, to)), items (sorted ids).
    """
    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return with_contamination(narrow, benchmark, window, "found").select("doc_id", "text", "found.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document; see ``contaminated_spans``."""
    found = contaminated_spans(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["to"] - s["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less its words [from, to) of each span, with all that stands between those words."""
    places = [m.span() for m in _WORD.finditer(plain(text))]
    kept, at = [], 0
    for first, stop in spans:
        kept.append(text[at : places[first][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, text[at:]])


def remove_benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.8) -> DataFrame:
    """All columns of ``docs``; texts lose their hit spans, and documents go whose words are hit beyond ``most_covered``.

    Documents without hits keep their texts byte for byte, null and empty texts included.  Repeated rows
    are treated alike; an empty benchmark changes nothing, an empty table stays empty.
    """
    names, name = docs.columns, free_name(docs, "found")
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, found = batch.columns
            keep, texts = [], []
            for text, raw, one in zip(columns[at], text_bytes(columns[at]), found.to_pylist()):
                spans = [(s["from"], s["to"]) for s in one["spans"]]
                hit = sum(b - a for a, b in spans)
                keep.append(hit <= most_covered * one["n_words"])
                texts.append(without_spans(raw, spans).decode() if hit else text.as_py())
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return with_contamination(docs, benchmark, window, name, clean)
