"""Sorted-string-table shards of token ids.

A file holds entries in ascending key order:

    data blocks   entries: varint shared, varint unshared, varint value size, key rest, value;
                  ``shared`` counts the leading bytes taken from the key before; it is 0 at a block's start
    Bloom filter  bits, ``HASHES`` probes of each key
    block index   entries like those of a block; key: the block's first key, value: offset, size (two u64)
    footer        8 unsigned 64-bit little-endian numbers (``FOOTER``), then ``MAGIC``

A key is one byte (0: no id, 1: id) and the id, big-endian with its sign bit flipped, so byte order is
id order and rows without an id come first.  A value is the ids as little-endian unsigned integers of
the width that the footer names.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, scratch_path, text_bytes
from .tokens import encoder

MAGIC = b"HOPSST01"
FOOTER = struct.Struct("<8Q")  # Bloom offset, Bloom size, index offset, index size, entries, ids, id width, blocks
HASHES, BITS_PER_KEY = 7, 10
BLOCK_BYTES = 1 << 16
#: Text bytes of a shard at most, but for what documents that share an id have.
SHARD_BYTES = 64 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _entry(before: bytes, key: bytes, value: bytes) -> bytes:
    shared = 0
    while shared < min(len(before), len(key)) and before[shared] == key[shared]:
        shared += 1
    return _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value


def _entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(block):
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        at += rest
        yield key, block[at : at + size]
        at += size


def _probes(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh128_intdigest(key)
    return ((h + i * (h >> 64 | 1)) % bits for i in range(HASHES))


def write_table(sink, entries: Iterable[tuple[bytes, bytes]], width: int) -> tuple[int, int]:
    """Writes sorted entries as they come; holds one block, the index and the keys' Bloom hashes."""
    index: list[tuple[bytes, int, int]] = []
    block, first, before, offset, n_ids = bytearray(), b"", b"", 0, 0
    hashes = bytearray()

    def close() -> None:
        nonlocal offset
        if block:
            sink.write(bytes(block))
            index.append((first, offset, len(block)))
            offset += len(block)
            block.clear()

    for key, value in entries:
        if not block:
            first, before = key, b""
        block += _entry(before, key, value)
        before = key
        n_ids += len(value) // width
        hashes += xxhash.xxh128_digest(key)
        if len(block) >= BLOCK_BYTES:
            close()
    close()
    n = len(hashes) // 16
    bits = max(64, -(-n * BITS_PER_KEY // 8) * 8)
    bloom = np.zeros(bits, np.uint8)
    for i in range(n):
        h = int.from_bytes(hashes[16 * i : 16 * i + 16], "big")
        bloom[[(h + j * (h >> 64 | 1)) % bits for j in range(HASHES)]] = 1
    packed = np.packbits(bloom).tobytes()
    listing, before = bytearray(), b""
    for key, at, size in index:
        listing += _entry(before, key, struct.pack("<2Q", at, size))
        before = key
    sink.write(packed)
    sink.write(bytes(listing))
    sink.write(FOOTER.pack(offset, len(packed), offset + len(packed), len(listing), n, n_ids, width, len(index)) + MAGIC)
    return n, n_ids


class Table:
    """Reads one file: scan in key order, or look a key up by Bloom filter, index and one block."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = FOOTER.size + len(MAGIC)
        footer = self._at(end - tail, tail)
        if footer[FOOTER.size :] != MAGIC:
            raise ValueError("not a sorted-string table")
        bloom_at, bloom_size, index_at, index_size, self.entries, self.ids, self.width, _ = FOOTER.unpack(footer[: FOOTER.size])
        self.bloom = self._at(bloom_at, bloom_size)
        self.blocks = [(k, *struct.unpack("<2Q", v)) for k, v in _entries(self._at(index_at, index_size))]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, offset, size in self.blocks:
            for key, value in _entries(self._at(offset, size)):
                yield id_of(key), self._ids(value)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Values of all entries with this id, none if absent."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, 8 * len(self.bloom))):
            return []
        # equal keys may begin in the block before the first one that starts with the key
        at, found = max(0, bisect.bisect_left(self.blocks, (key,)) - 1), []
        while at < len(self.blocks) and self.blocks[at][0] <= key:
            found += [self._ids(v) for k, v in _entries(self._at(*self.blocks[at][1:])) if k == key]
            at += 1
        return found


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder that Spark names; it knows file, hdfs, s3 (s3a), gs and abfs."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def open_table(uri: str) -> Table:
    system, path = _filesystem(uri)
    return Table(system.open_input_file(path))


def key_ranges(docs: DataFrame, shards: int) -> list[int]:
    """At most ``shards`` - 1 ids that cut the table into ranges of nearly equal text bytes.

    Eight times as many ranges of nearly equal row counts are weighed, and neighbours put together.
    """
    if shards < 2:
        return []
    fine = 8 * shards
    found = docs.select(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 20 * fine).alias("cuts")).first()["cuts"]
    cuts = np.array(sorted(set(found or [])), np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1)
        for batch in batches:
            place = np.searchsorted(cuts, np.array(batch.column(0).fill_null(-(1 << 63)), np.int64), "right")
            total += np.bincount(place, np.array(batch.column(1), np.int64), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], names=["range", "size"])

    sizes = docs.selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) + 16 as long) size").mapInArrow(giving_back(weigh), "range long, size long")
    weight = np.zeros(len(cuts) + 1)
    for r in sizes.groupBy("range").agg(F.sum("size").alias("size")).collect():
        weight[r.range] = r.size
    upto = np.cumsum(weight)
    ends = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return cuts[np.unique(ends[ends < len(cuts)])].tolist()


def write_token_tables(docs: DataFrame, vocabulary: str, end_id: int, shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Encodes all texts and writes one sorted table per id range to the shared folder.

    Returns (shard, uri, entries, ids) of the files, in ascending id order: as many rows as shards.  Ids
    of a text are followed by ``end_id``; a null or empty text is ``end_id`` alone.  Rows with equal ids
    stay apart, ordered by their texts' checksums; rows without an id come first.  Each task writes under
    a name of its own, and only files whose task is reported complete are listed, so repeated or lost
    tasks leave nothing in the result.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    if shards is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    cuts = key_ranges(rows, shards)
    folder = scratch_path(spark, "token-tables")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        small = enc.small and end_id < 1 << 16
        for batch in batches:
            docs_ = batch.column(0)
            found = [np.append(i, end_id).astype("<u2" if small else "<u4").tobytes() for i in enc.encode(text_bytes(batch.column(1)))]
            shard = np.searchsorted(np.array(cuts, np.int64), np.array(docs_.fill_null(-(1 << 63)), np.int64), "right")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), docs_, pa.array(found, pa.binary()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([2 if small else 4] * len(found), pa.int32())], names=["shard", "doc_id", "ids", "tie", "width"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        done: list[tuple[int, str, int, int]] = []

        def rows_() -> Iterator[tuple[int, int | None, bytes, int]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist())

        stream = rows_()
        ahead = next(stream, None)
        while ahead is not None:
            shard, width = ahead[0], ahead[3]
            name = f"{shard:06d}-{uuid.uuid4().hex}.sst"

            def run() -> Iterator[tuple[bytes, bytes]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    yield key_of(ahead[1]), ahead[2]
                    ahead = next(stream, None)

            with system.open_output_stream(f"{root}/{name}") as sink:
                done.append((shard, f"{folder}/{name}", *write_table(sink, run(), width)))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "uri", "entries", "ids"])

    encoded = rows.mapInArrow(giving_back(encode), "shard int, doc_id long, ids binary, tie long, width int")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie")
    return sorted(tuple(r) for r in dealt.mapInArrow(giving_back(write), "shard int, uri string, entries long, ids long").collect())


def read_token_tables(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all entries before), n_tokens, ids_crc32, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    base, listing = 0, []
    for _, uri, _, ids in files:
        listing.append((uri, base))
        base += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, held = [], 0
                for doc_id, ids in open_table(uri).scan():
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                    start += len(ids)
                    held += len(raw)
                    if held > 1 << 23:
                        yield _batch(out)
                        out, held = [], 0
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    if not listing:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(listing, "uri string, start long").repartition(len(listing)).mapInArrow(giving_back(read), schema)
