"""Passages that occur more than once, found without bringing all positions together.

A text is a sequence of units (bytes or words).  Every window of a fixed number of units names one of
its grams, the one of least hash (the leftmost of equals), as its anchor: equal windows name equal
anchors at equal places.  Consecutive windows mostly share one; the stretch of text that they cover
around it is some 70 bytes long.  Documents are packed into chunks, written once and bucketed by chunk
(``chunk_table``), and chunks and buckets of anchors talk twice:

1. a chunk sends the hashes of its anchors, each once, and hears which of them other chunks have;
2. for those, or such as two of its own places have, it sends the text of the stretch, each text once,
   with the places that hold it.  All occurrences of a window are then in one bucket, where a solver
   searches the stretches for windows that occur earlier elsewhere; what it does not find is not found.

Hashes only decide what is sent; equal means equal text.  An anchor in very many chunks would bring all
the different texts around it into one bucket: its windows are dealt by hashes of their own, and only
those that occur again are sent (``HOT_CHUNKS``).

Spans found come back to the chunks (``repeated_spans``).  A chunk sends a hash or a stretch once, however
many of its documents hold it, so a passage that is in a third of all documents costs its bucket one
row a chunk.  Buckets grow in number with the input, not in size; a task works through its buckets
one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, giving_back, merge_runs, text_bytes, written

#: Text bytes after which a chunk is closed.
CHUNK_BYTES = 2 << 20
#: Text bytes for which there is one bucket, and one task; a task holds one bucket at a time.
BUCKET_BYTES, TASK_BYTES = 6 << 20, 64 << 20
#: Tasks up to which their number grows with the input.
MOST_TASKS = 50_000
#: Chunks that have an anchor, beyond which its windows are dealt by hashes of their own.
HOT_CHUNKS = 4096
#: Stands for a document without an id: after all others.
NO_ID = 2**63 - 1
#: Window starts handled together: arrays that fit a core's cache.
BLOCK = 1 << 15

CHUNK_SCHEMA = "chunk long, ids binary, sizes binary, text binary, rest binary, n_bytes long"
ANSWER = "chunk long, bucket int, bits binary, more binary"


# --- chunks ------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    chunk: int
    ids: np.ndarray
    texts: list[bytes]
    rest: pa.Table | None


def chunk_table(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of about ``chunk_bytes`` of text with the ids and all other columns of their documents."""
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, nth, first = zstandard.ZstdCompressor(level=1).compress, 0, TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal nth
            table = pa.Table.from_batches(held).combine_chunks()
            texts = text_bytes(table.column(at).combine_chunks())
            ids = np.array(table.column(key).cast(pa.int64()).fill_null(NO_ID), np.int64)
            sink = pa.BufferOutputStream()
            rest = table.remove_column(at)
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_table(rest)
            whole = b"".join(texts)
            row = (first | nth, ids.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze(whole), squeeze(sink.getvalue().to_pybytes()), len(whole))
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            sizes = np.cumsum([len(t) for t in text_bytes(batch.column(at))])
            done = 0
            while done < batch.num_rows:
                before = int(sizes[done - 1]) if done else 0
                stop = min(batch.num_rows, int(np.searchsorted(sizes, before + chunk_bytes - size)) + 1)
                held.append(batch.slice(done, stop - done))
                size += int(sizes[stop - 1]) - before
                done = stop
                if size >= chunk_bytes:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()

    return bucketed(docs.mapInArrow(giving_back(pack), CHUNK_SCHEMA), "chunk", "chunks", _tasks(docs.sparkSession, _planned_bytes(docs)))


def _planned_bytes(docs: DataFrame) -> int:
    """What Spark expects ``docs`` to hold, known without a job; 0 where it can only guess."""
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 50 else 0


def _tasks(spark, n_bytes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-n_bytes // TASK_BYTES)))


def _chunks(batch: pa.RecordBatch, rest: bool = False) -> Iterator[Chunk]:
    loose = zstandard.ZstdDecompressor().decompress
    for row in range(batch.num_rows):
        chunk, ids, sizes, text, other = (batch.column(i)[row].as_py() for i in range(5))
        whole = loose(text)
        ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
        texts = [whole[a:b] for a, b in zip([0, *ends], ends)]
        yield Chunk(chunk, np.frombuffer(ids, np.int64), texts, pa.ipc.open_stream(loose(other)).read_all() if rest else None)


@dataclass(frozen=True)
class Bytes:
    """Units are bytes; ``sequence`` is one byte string, ``ends`` where its documents end."""

    def cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        return b"".join(texts), np.cumsum([len(t) for t in texts])

    def hashes(self, sequence: bytes) -> np.ndarray:
        return np.frombuffer(sequence, np.uint8)

    def stretch(self, sequence: bytes, start: int, end: int) -> bytes:
        return sequence[start:end]


@dataclass(frozen=True)
class Words:
    """Units are words between ASCII white space; ``sequence`` is their list."""

    def cut(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        words = [t.split() for t in texts]
        return [w for one in words for w in one], np.cumsum([len(w) for w in words])

    def hashes(self, sequence: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, sequence), np.uint64, len(sequence))

    def stretch(self, sequence: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(sequence[start:end])


# --- anchors -----------------------------------------------------------------------------------------

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _B
    h += right ^ (right >> np.uint64(29))
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def _longer(h: np.ndarray, have: int, size: int) -> np.ndarray:
    """Hashes of ``size`` units from those of ``have``; halves may overlap."""
    while have < size:
        step = min(have, size - have)
        h = _joined(h[:-step], h[step:])
        have += step
    return h


def _short_grams(units: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Hashes to start from: single units, or for bytes runs of 8, 4, 2 or 1 read as numbers."""
    have = 1
    if units.dtype == np.uint8:
        for kind in (np.uint16, np.uint32, np.uint64):
            if 2 * have > size:
                break
            units = units[:-have].astype(kind) | units[have:].astype(kind) << kind(8 * have)
            have *= 2
    h = (units.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    return h, have


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` units."""
    return _longer(*_short_grams(units, size), size) if len(units) >= size else np.zeros(0, np.uint64)


@dataclass
class Runs:
    """Runs of window starts that name the same anchor: first and last start, document, anchor."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray

    def take(self, rows: np.ndarray) -> Runs:
        return Runs(self.first[rows], self.last[rows], self.doc[rows], self.anchor[rows])

    def windows(self, units: np.ndarray, window: int) -> Runs:
        """Each window as a run of its own, with its own hash for an anchor."""
        size = self.last - self.first + 1
        start = np.arange(size.sum()) + np.repeat(self.first - np.cumsum(size) + size, size)
        own = [gram_hashes(units[a : b + window], window) for a, b in zip(self.first.tolist(), self.last.tolist())]
        return Runs(start, start, np.repeat(self.doc, size), np.concatenate([np.zeros(0, np.uint64), *own]) ^ _C)

    def with_more(self, more: Runs) -> Runs:
        return Runs(*(np.concatenate([getattr(self, f), getattr(more, f)]) for f in ("first", "last", "doc", "anchor")))


def anchor_runs(units: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Runs:
    n = len(units) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64))
    low = np.uint64(0xFFFFFFFF)
    anchor, key = np.empty(n, np.int64), np.empty(n, np.uint64)
    width = window - gram + 1
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        h = _longer(*_short_grams(units[at : stop + window - 1], gram), gram)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        place = (least & low).astype(np.int64)
        anchor[at:stop] = place + at
        key[at:stop] = h[place]
    sizes = np.diff(np.r_[0, ends])
    inside = np.arange(n) + window <= np.repeat(ends, sizes)[:n]
    change = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(inside & np.r_[True, change | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[change | ~inside[1:], True])
    return Runs(first, last, np.searchsorted(ends, first, "right"), key[first])


def _codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (28 bits), then 36 bits of the hash; chance agreement only sends a text in vain."""
    return (keys % np.uint64(buckets)) << np.uint64(36) | keys >> np.uint64(28)


def _same(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Runs of equal values: the value, begin and end."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(values)][: len(cuts)].tolist()


def _bucket_of(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(36)).astype(np.int64)


def _five(codes: np.ndarray) -> np.ndarray:
    """The low five bytes of each code, enough within a bucket."""
    return np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(low: bytes) -> np.ndarray:
    out = np.zeros((len(low) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


# --- exchanges between chunks and buckets ------------------------------------------------------------


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(answers: list[dict] | None, key: str, codes: np.ndarray) -> np.ndarray:
    """The flags that buckets sent back, in the order of the codes sent to them."""
    out = np.zeros(len(codes), bool)
    if answers:
        places = {bucket: (a, b) for bucket, a, b in zip(*_same(_bucket_of(codes)))}
        for one in answers:
            a, b = places[one["bucket"]]
            out[a:b] = np.unpackbits(np.frombuffer(one[key], np.uint8), count=b - a)
    return out


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Buckets of rows sorted by bucket, one at a time."""
    now, held = -1, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(tuple(row))
    if held:
        yield now, held


def _dealt(sent: DataFrame, tasks: int) -> DataFrame:
    """Rows of a bucket together, buckets dealt out in turn, so no task gets more of them than another."""
    return sent.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")


def _split(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1])


def _gathered(answers: DataFrame, label: str) -> DataFrame:
    return written(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "more")).alias("answers")), label)


def _told(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with the answers to each exchange; the chunks stay where they are, only answers move."""
    out = chunks
    for i, one in enumerate(answers):
        out = out.join(one.withColumnRenamed("answers", f"answers{i}").hint("shuffle_hash"), "chunk", "left")
    return out.select(*chunks.columns, *(f"answers{i}" for i in range(len(answers))))


@dataclass(frozen=True)
class Plan:
    """How units are cut and dealt."""

    units: Bytes | Words
    window: int
    gram: int
    buckets: int
    tasks: int
    hot_chunks: int

    def runs(self, c: Chunk) -> tuple[object, np.ndarray, np.ndarray, Runs]:
        sequence, ends = self.units.cut(c.texts)
        hashes = self.units.hashes(sequence)
        return sequence, ends, hashes, anchor_runs(hashes, ends, self.window, self.gram)

    def hot(self, r: Runs, answers: list[dict] | None) -> np.ndarray:
        """Runs whose anchor is in very many chunks."""
        known, inverse = np.unique(_codes(r.anchor, self.buckets), return_inverse=True)
        return _flags(answers, "more", known)[inverse]

    def shared(self, r: Runs, answers: list[dict] | None) -> np.ndarray:
        """Runs whose anchor occurs elsewhere, here or in another chunk."""
        known, inverse, counts = np.unique(_codes(r.anchor, self.buckets), return_inverse=True, return_counts=True)
        return (_flags(answers, "bits", known) | (counts > 1))[inverse]


def _exchange(chunks: DataFrame, plan: Plan, find: Callable[[Chunk, list], Runs], label: str) -> DataFrame:
    """Bits for the anchors of a chunk that another chunk has too; more: for those that very many have."""
    schema = "bucket int, chunk long, codes binary"
    n = len(chunks.columns)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, *told in zip(_chunks(batch), *(x.to_pylist() for x in batch.columns[6:n])):
                codes = np.unique(_codes(find(c, told).anchor, plan.buckets))
                low = _five(codes)
                yield _rows([(bucket, c.chunk, low[a:b].tobytes()) for bucket, a, b in zip(*_same(_bucket_of(codes)))], schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_bucket(batches):
            codes = _wide(b"".join(p[1] for p in parts))
            _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
            sizes = [len(p[1]) // 5 for p in parts]
            often = counts[inverse]
            yield _rows([(p[0], bucket, _bits(own > 1), _bits(own > plan.hot_chunks)) for p, own in zip(parts, _split(often, sizes)) if own.max(initial=0) > 1], ANSWER)

    return _gathered(_dealt(chunks.mapInArrow(giving_back(send), schema), plan.tasks).mapInArrow(giving_back(meet), ANSWER), label)


@dataclass
class Bucket:
    """The distinct stretches of a bucket with their anchors' codes, and all places that hold one: stretch, chunk, place there, document, place in it."""

    texts: list[bytes]
    codes: np.ndarray
    text: np.ndarray
    chunk: np.ndarray
    place: np.ndarray
    doc: np.ndarray
    begin: np.ndarray


#: Finds windows that occur earlier elsewhere: places (row of the bucket) and spans there (from, to), in units.
Solver = Callable[[Bucket, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

_squeeze, _loose = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _packed(texts: list[bytes], codes: np.ndarray, place: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> bytes:
    """Distinct texts and their codes, and the places of each."""
    known: dict[bytes, int] = {}
    text = np.array([known.setdefault(t, len(known)) for t in texts], np.int32)
    sizes, code = np.fromiter(map(len, known), np.int32, len(known)), np.empty(len(known), np.uint64)
    code[text] = codes
    head = np.array([len(known), len(texts)], np.int64)
    return _squeeze(b"".join([x.tobytes() for x in (head, sizes, code, text, place.astype(np.int32), doc, begin.astype(np.int32))] + list(known)))


def _unpacked(parts: list[tuple[int, bytes]]) -> Bucket:
    known: dict[bytes, int] = {}
    found, codes = [], []
    for chunk, packed in parts:
        raw = _loose(packed)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at, columns = 16, []
        for count, kind in ((n, np.int32), (n, np.uint64), (m, np.int32), (m, np.int32), (m, np.int64), (m, np.int32)):
            columns.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
            at += count * np.dtype(kind).itemsize
        sizes, code, text, place, doc, begin = columns
        stops = (at + np.cumsum(sizes)).tolist()
        names = np.array([known.setdefault(raw[x:y], len(known)) for x, y in zip([at, *stops], stops)], np.int64)
        found.append((names[text], np.full(m, chunk), place, doc, begin))
        codes.append((names, code))
    code = np.empty(len(known), np.int64)
    for names, own in codes:
        code[names] = own
    return Bucket(list(known), code, *(np.concatenate(x) for x in zip(*found)))


def rows_by_key(key: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows`` ordered by their keys below ``n``, and where each key's rows begin and end."""
    order = np.argsort(key[rows], kind="stable")
    edges = np.searchsorted(key[rows][order], np.arange(n + 1))
    return rows[order], edges[:-1], edges[1:]


def repeated_spans(chunks: DataFrame, units, window: int, gram: int, solve: Solver) -> DataFrame:
    """chunk, starts, ends: lists of spans, in units of the chunk, that the solver finds."""
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = _tasks(spark, total)
    plan = Plan(units, window, gram, max(tasks, -(-total // BUCKET_BYTES)), tasks, HOT_CHUNKS)
    shared = _exchange(chunks, plan, lambda c, _: plan.runs(c)[3], "shared-anchors")
    told = [shared]
    has_hot = F.exists("answers", lambda a: F.length(F.replace(F.hex(a["more"]), F.lit("0"), F.lit(""))) > 0)

    def hot_windows(c: Chunk, answers: list) -> Runs:
        _, _, hashes, r = plan.runs(c)
        return r.take(np.flatnonzero(plan.hot(r, answers[0]))).windows(hashes, window)

    if shared.where(has_hot).head(1):
        told.append(_exchange(_told(chunks, shared), plan, hot_windows, "shared-windows"))
    schema = "bucket int, chunk long, starts binary, ends binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, *answers in zip(_chunks(batch), *(x.to_pylist() for x in batch.columns[6:])):
                sequence, ends, hashes, r = plan.runs(c)
                keep = plan.shared(r, answers[0])
                if len(answers) > 1:
                    hot = plan.hot(r, answers[0])
                    single = r.take(np.flatnonzero(hot)).windows(hashes, window)
                    r = r.take(np.flatnonzero(keep & ~hot)).with_more(single.take(np.flatnonzero(plan.shared(single, answers[1]))))
                else:
                    r = r.take(np.flatnonzero(keep))
                codes = _codes(r.anchor, plan.buckets)
                order = np.argsort(codes, kind="stable")
                codes, r = codes[order], r.take(order)
                begin, doc = r.first - np.r_[0, ends][r.doc], c.ids[r.doc]
                texts = [units.stretch(sequence, x, y) for x, y in zip(r.first.tolist(), (r.last + window).tolist())]
                yield _rows([(bucket, c.chunk, _packed(texts[a:b], codes[a:b], r.first[a:b], doc[a:b], begin[a:b]), b"") for bucket, a, b in zip(*_same(_bucket_of(codes)))], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_bucket(batches):
            b = _unpacked([p[:2] for p in parts])
            place, low, high = solve(b, window)
            order = np.argsort(b.chunk[place], kind="stable")
            place, low, high = place[order], low[order], high[order]
            out = []
            for chunk, x, y in zip(*_same(b.chunk[place])):
                starts = b.place[place[x:y]]
                starts, stops = merge_runs(starts + low[x:y], starts + high[x:y])
                out.append((chunk, starts.tobytes(), stops.tobytes()))
            yield _rows(out, "chunk long, starts binary, ends binary")

    sent = _told(chunks, *told).mapInArrow(giving_back(send), schema)
    found = _dealt(sent, plan.tasks).mapInArrow(giving_back(search), "chunk long, starts binary, ends binary")
    return written(found.groupBy("chunk").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")), "spans")


def per_document(chunks: DataFrame, spans: DataFrame, units, emit: Callable, schema) -> DataFrame:
    """``emit(chunk, sequence, ends, spans)`` of every chunk, where spans[i] are the i-th document's runs in chunk units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, starts, stops in zip(_chunks(batch, rest=True), batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                sequence, ends = units.cut(c.texts)
                a, b = merge_runs(*(np.frombuffer(b"".join(x or []), np.int64) for x in (starts, stops)))
                # a run may pass from one document into the next where both ends are covered
                cuts = np.r_[0, ends][1:-1]
                inner = cuts[np.searchsorted(a, cuts, "left") != np.searchsorted(b, cuts, "right")] if len(a) else cuts[:0]
                a, b = np.unique(np.r_[a, inner]), np.unique(np.r_[b, inner])
                edges = np.searchsorted(np.searchsorted(ends, a, "right"), np.arange(len(ends) + 1))
                yield from emit(c, sequence, ends, [(a[x:y], b[x:y]) for x, y in zip(edges, edges[1:])])

    return chunks.join(spans.hint("shuffle_hash"), "chunk", "left").select(*chunks.columns, "starts", "ends").mapInArrow(giving_back(run), schema)
