"""Sharding, packing and token tables: laws, exact round trips, odd inputs."""

from __future__ import annotations

import io
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hopline.llm import tables
from hopline.llm.common import default_vocabulary
from hopline.llm.packing import pack_documents, piece_lengths
from hopline.llm.sharding import balanced_shards
from hopline.llm.tables import Table, key_of, open_table, read_token_tables, write_table, write_token_tables
from hopline.llm.tokens import encoder


def ids_of(text):
    return encoder(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_memo_gives_the_tokenizer_s_ids(odd):
    texts = [t or "" for _, t in odd[:4]] + ["Straße ÀÉ l'été I'm isn't 123 ㎏ ΑΣ x y a\x1cb <|endoftext|> word,$$$ (x)", "İI ſ K Å é ́"]
    got = encoder(default_vocabulary()).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [ids_of(t) for t in texts]
    assert encoder(default_vocabulary()).encode([]) == []


@pytest.mark.parametrize("extra", [False, True])
def test_shards_are_contiguous_balanced_and_gapless(make, odd, prose, extra):
    rows = odd + [(i, prose(i, 5 + i % 90)) for i in range(100, 400)] + [(500, "same text")] * 150
    got = balanced_shards(make(rows, extra), 7).orderBy("row_number").collect()
    assert len(got) == len(rows)
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert [r.row_number for r in got] == list(range(len(rows)))
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and [r.shard for r in got] == sorted(r.shard for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
    for shard, some in held.items():
        assert [r.slot for r in some] == list(range(len(some)))
        assert abs(sum(r["size"] for r in some) - sum(sizes) / 7) <= 2 * max(sizes)


def test_shards_of_nothing(make):
    assert balanced_shards(make([]), 4).count() == 0


def test_piece_lengths_are_powers_that_add_up():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        pieces = piece_lengths(n, 4096)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 4096 for p in pieces)


def test_packing_restores_every_document(make, odd):
    got = pack_documents(make(odd, True), default_vocabulary(), 2, 64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    docs = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
    for i, t in odd:
        if i is not None and i != 5:
            want = ids_of(t) + [2]
            assert [x for _, ids, _ in docs[i] for x in ids] == want and docs[i][0][2] == len(want)
    assert len(docs[5]) == 2 * len(docs[6])
    with pytest.raises(ValueError):
        pack_documents(make(odd), default_vocabulary(), 2, 100)
    assert pack_documents(make([]), default_vocabulary(), 2).count() == 0


def test_table_file_scan_lookup_and_blocks(monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_BYTES", 64)
    entries = sorted((key_of(i), np.arange(n, dtype="<u2").tobytes()) for i, n in [(None, 2), (-5, 1), (3, 40), (3, 0), (7, 3), (2**62, 9)] + [(i, i % 5) for i in range(100, 300)])
    sink = io.BytesIO()
    assert write_table(sink, entries, 2)[0] == len(entries)

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    t = Table(Source(sink.getvalue()))
    assert [(key_of(i), v.tobytes()) for i, v in t.scan()] == entries and len(t.blocks) > 3
    assert sorted(len(v) for v in t.lookup(3)) == [0, 40] and [len(v) for v in t.lookup(None)] == [2]
    assert t.lookup(4) == [] and [len(v) for v in t.lookup(199)] == [4]
    with pytest.raises(ValueError):
        Table(Source(b"x" * 200))


def test_token_tables_round_trip(spark, make, odd, prose):
    rows = odd + [(i, prose(i, 30)) for i in range(20, 80)]
    files = write_token_tables(make(rows, True), default_vocabulary(), 1, 4)
    assert sum(f[2] for f in files) == len(rows)
    got = sorted(read_token_tables(spark, files).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start and zlib.crc32(r.ids) == r.ids_crc32
        start += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got[:2]] == [None, None]
    by_id = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got}
    for i, t in rows:
        if i is not None:
            assert by_id[i] == ids_of(t) + [1]
    shard = next(open_table(f[1]) for f in files if any(i == 50 for i, _ in open_table(f[1]).scan()))
    assert shard.lookup(50)[0].tolist() == ids_of(prose(50, 30)) + [1]
    assert read_token_tables(spark, write_token_tables(make([]), default_vocabulary(), 1, 4)).count() == 0


def test_shards_are_cut_by_bytes(spark, make, prose):
    rows = [(i, prose(i, 400 if i < 40 else 10)) for i in range(400)]
    size = {i: len(t) + 16 for i, t in rows}
    cuts = tables.key_ranges(make(rows), 5)
    assert cuts == sorted(cuts) and len(cuts) == 4
    shares = np.bincount(np.searchsorted(cuts, list(size), "right"), list(size.values()), 5)
    assert shares.max() < 2 * shares.mean()  # one in eight of the rows are one range at least
    assert len({f[0] for f in write_token_tables(make(rows), default_vocabulary(), 1, 5)}) == 5
    assert tables.key_ranges(make([(3, "x"), (3, "y")]), 4) in ([], [3]) and tables.key_ranges(make([]), 4) == []
