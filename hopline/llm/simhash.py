"""SimHash near-duplicates: Golay-code keys of fingerprint segments, join, verify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, giving_back, shuffled, text_bytes, written
from .components import connected_components
from .golay import LENGTH, nearby_codewords

#: Fingerprints in a bucket up to which all its pairs are compared; larger ones go by shared neighbours.
PAIRS_UP_TO = 24
#: Rows up to which a table of ids is broadcast (8 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Fingerprints that one task expands into keys, some 130 rows each, and tasks up to which it holds.
KEYED_ROWS, KEYED_TASKS = 8192, 20_000

_SEEDS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, joined by spaces; of the whole text if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, stops[: n - 1]].tolist()
    ends = (stops[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)


def majority_bits(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits a lane, each set if over half the hashes have it; lanes after the first mix the hashes anew."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        mixed = hashes
        if lane:
            mixed = (hashes ^ (hashes >> np.uint64(31))) * _SEEDS[lane]
            mixed = mixed ^ (mixed >> np.uint64(29))
        bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of up to 255 rows fit a byte, which adds fastest
        cuts = np.arange(0, len(bits), 255)
        count = np.add.reduceat(bits, cuts, axis=0).astype(np.int64).sum(0)
        out[lane] = np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint f0 of every whole text.

    A-Z become a-z; words are cut at ASCII white space.  Null and empty texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority_bits(shingle_hashes(t.lower().split(), shingle))[0] for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "f0"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(giving_back(run), "doc_id long, f0 long")


def segment_keys(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of 64-bit fingerprints such that any two that differ in 2 bits or fewer share a key.

    The fingerprint is cut into three segments.  Two errors leave one segment clean, and the next one
    has two at most: the key is the clean segment and a Golay codeword index near the next.
    """
    f = fingerprint.astype(np.uint64)
    parts = [(f >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in ((0, 22), (22, 21), (43, 21))]
    rows, keys = [], []
    for i in range(3):
        near = nearby_codewords(parts[(i + 1) % 3])
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(np.int64(i) << 34 | parts[i][row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(table: DataFrame, columns: list[str], keys, carried: int = 1) -> DataFrame:
    """Rows (key, the first ``carried`` columns) of the keys that ``keys`` gives for the other columns.

    ``table`` is a written one; its few bytes would be read by few tasks, each making very many keys.
    """
    first = columns[:carried]
    tasks = min(KEYED_TASKS, max(1, -(-table.count() // KEYED_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = keys(*(np.array(c, np.int64) for c in batch.columns[carried:]))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(row)) for c in batch.columns[:carried])], names=["key", *first])

    return table.select(*columns).repartition(tasks, first[0]).mapInArrow(giving_back(run), ", ".join(f"{c} long" for c in ["key", *first]))


def differing_bits(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_fingerprints(prints: DataFrame) -> DataFrame:
    """``prints`` (f0, distinct) to links (a, b) that connect all fingerprints at distance 2 or less.

    Pairs of a bucket are compared where it holds ``PAIRS_UP_TO`` or fewer.  For the rest, every
    fingerprint is dealt to itself and its 64 neighbours: those that meet at one place are all within
    distance 2 of each other, any two within 2 meet somewhere, and at most 65 can meet, so a star links
    them without looking at pairs.
    """
    keyed = _keyed(prints.withColumn("f", F.col("f0")), ["f", "f0"], segment_keys)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(shuffled(sizes), "key"), "golay-buckets")
    few = shared.where(f"n <= {PAIRS_UP_TO}").select("key", F.col("f").alias("a"))
    pairs = few.join(shuffled(few.select("key", F.col("a").alias("b"))), "key").where("a < b").where(differing_bits("a", "b") <= 2).select("a", "b")
    crowded = shared.where(f"n > {PAIRS_UP_TO}").select("f").distinct()
    places = F.array(F.col("f"), *(F.col("f").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)))
    met = crowded.select("f", F.explode(places).alias("place")).groupBy("place").agg(F.collect_set("f").alias("fs")).where(F.size("fs") > 1)
    stars = met.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id that links
    reach.  Everything after the fingerprints works on distinct ones, so exact copies cost one.  Null
    and empty texts have fingerprint zero and link like any other; rows without an id get a component
    and name none unless all its rows lack one; repeated rows are each returned.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    least = rows.groupBy("f0").agg(F.min("doc_id").alias("least_id"))
    prints = written(least, "distinct-fingerprints")
    roots = connected_components(near_fingerprints(prints)).selectExpr("id as f0", "root")
    placed = prints.join(shuffled(roots), "f0", "left").select("f0", "least_id", F.coalesce("root", "f0").alias("root"))
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # one row per fingerprint, written so that the join below shuffles it plainly and a hot one can be split
    final = written(placed.join(shuffled(named), "root").select("f0", "component_id"), "fingerprint-components")
    return rows.join(shuffled(final), "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by shingle similarity -----------------------------------------------------------

LANES, PAIRS = 4, 5
#: Hash classes of shingles that a document's counts are kept for.
CLASSES = 256
#: Documents of a bucket up to which its pairs are listed; in larger ones blocks of so many are compared in memory.
LISTED, BLOCK = 6, 128

_PRINT = ["doc_id", "length", *(f"f{i}" for i in range(LANES)), *(f"s{i}" for i in range(PAIRS)), "counts"]
_PRINT_TYPES = ", ".join(f"{n} binary" if n == "counts" else f"{n} long" for n in _PRINT)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(seed + 1)) * _SEEDS[1 + seed % 3]
    h ^= h >> np.uint64(29)
    h *= _SEEDS[1 + (seed + 1) % 3]
    return h ^ (h >> np.uint64(32))


def near_copy_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, length, f0-f3, s0-s4 and counts of every text.

    ``length`` is the number of distinct shingles and ``counts`` how many are in each of 256 classes of
    their hashes (one byte, 255 for more).  f0-f3 are a 256-bit fingerprint of the word pairs, finer than
    the shingles compared, so near copies lie closer; s0-s4 are the least hashes of the word pairs.
    """

    def one(words: list[bytes]) -> tuple:
        whole, pairs = np.unique(shingle_hashes(words, shingle)), shingle_hashes(words, 2)
        counts = np.minimum(np.bincount((whole & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)
        least = np.array([_mixed(pairs, p).min() if len(pairs) else 0 for p in range(PAIRS)], np.uint64)
        return (len(whole), *majority_bits(pairs, LANES).view(np.int64).tolist(), *least.view(np.int64).tolist(), counts.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(one(t.lower().split()) for t in text_bytes(batch.column(1))))) or [[]] * (len(_PRINT) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary() if n == "counts" else pa.int64()) for n, c in zip(_PRINT[1:], found))], names=_PRINT)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(giving_back(run), _PRINT_TYPES)


def _codewords(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """Of each of ten 23-bit segments the Golay codewords nearby, up to six, -1 for none."""
    bits = np.unpackbits(np.stack(lanes, 1).astype(np.int64).view(np.uint8).reshape(len(lanes[0]), -1), axis=1, bitorder="little")
    weights = (1 << np.arange(LENGTH)).astype(np.int64)
    return [nearby_codewords(bits[:, LENGTH * s : LENGTH * (s + 1)].astype(np.int64) @ weights) for s in range(2 * PAIRS)]


def _key(pair: int, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (_mixed((np.int64(pair) << 24 | a << 12 | b).astype(np.uint64), pair) ^ _mixed(salt.astype(np.int64).view(np.uint64), pair + 1)).view(np.int64)


def paired_segment_keys(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): of each pair of segments, every two codewords near them, with the pair's least hash.

    Texts that are 0.8 alike agree in a least hash of word pairs with odds of nine in ten, chance ones
    hardly ever: buckets stay small however many documents there are.
    """
    lanes, salts = list(columns[:LANES]), columns[LANES:]
    near, rows, keys = _codewords(lanes), [], []
    for p in range(PAIRS):
        a, b = near[2 * p][:, :, None], near[2 * p + 1][:, None, :]
        row, i, j = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(_key(p, near[2 * p][row, i], near[2 * p + 1][row, j], salts[p][row]))
    return np.concatenate(rows), np.concatenate(keys)


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row i of ``x`` and row j of ``y`` have a codeword in common."""
    out = np.zeros((len(x), len(y)), bool)
    for c in x.T:
        for d in y.T:
            out |= (c[:, None] == d) & (d >= 0)
    return out


def first_common_pair(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The first pair of segments for which documents i of ``x`` and j of ``y`` have a key in common; -1 for none."""
    near_x, near_y = _codewords(x[:LANES]), _codewords(y[:LANES])
    first = np.full((len(x[0]), len(y[0])), -1)
    for p in range(PAIRS):
        same = (x[LANES + p][:, None] == y[LANES + p]) & (first < 0)
        for segment in (2 * p, 2 * p + 1):
            if same.any():
                same &= _meet(near_x[segment], near_y[segment])
        first[same] = p
    return first


def may_reach(similarity: float, length_x: np.ndarray, counts_x: np.ndarray, length_y: np.ndarray, counts_y: np.ndarray) -> np.ndarray:
    """Whether documents i and j can be that similar: they have no more in common than class by class.

    A bound, not an estimate: a pair that it rules out is less similar.  Counts of 255 may be more, so
    they bound nothing.
    """
    common = np.zeros((len(length_x), len(length_y)), np.int64)
    for begin in range(0, CLASSES, 64):
        common += np.minimum(counts_x[:, None, begin : begin + 64], counts_y[None, :, begin : begin + 64]).sum(2, dtype=np.int64)
    full = (counts_x == 255).any(1)[:, None] | (counts_y == 255).any(1)
    least = np.minimum(length_x[:, None], length_y)
    common = np.where(full, least, np.minimum(common, least))
    return common >= similarity * (length_x[:, None] + length_y - common)


def few_or_shuffled(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if it has few rows; else for a shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled(ids)


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its sorted distinct shingle hashes, for the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.lower().split(), shingle)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(few_or_shuffled(ids), "doc_id", "left_semi").mapInArrow(giving_back(run), "doc_id long, hashes binary").groupBy("doc_id").agg(F.min("hashes").alias("hashes"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least the Jaccard ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            # one pair at a time: sets of long texts are large
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(shuffled(sets.selectExpr("doc_id as a", "hashes as x")), "a").join(shuffled(sets.selectExpr("doc_id as b", "hashes as y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(giving_back(run), "a long, b long")


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are as similar as asked."""
    pairs = written(pairs.select("a", "b").distinct(), "near-copy-pairs")
    involved = pairs.selectExpr("a as doc_id").union(pairs.selectExpr("b as doc_id")).distinct()
    sets = written(shingle_sets(texts, involved, shingle), "shingle-sets")
    return written(_similar(pairs, sets, similarity), "near-copy-links")


def _counts(docs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """length and counts of each document, for ``may_reach``."""
    return np.array([d["length"] for d in docs], np.int64), np.frombuffer(b"".join(d["counts"] for d in docs), np.uint8).reshape(-1, CLASSES)


def _first_leaders(buckets: DataFrame) -> DataFrame:
    """a, doc_id, n: of the smallest documents of its buckets the one that a document shares most with."""
    met = buckets.where("doc_id <> least").groupBy("doc_id", "least").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    most = met.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("least")).alias("m"), "least", "n")).alias("most"))
    return most.select(F.col("most.least").alias("a"), "doc_id", "most.n")


def _other_leaders(buckets: DataFrame) -> DataFrame:
    """a, doc_id, n: documents with the smallest ones of their buckets that are not connected with them."""
    return buckets.where("comp <> least_comp").groupBy(F.col("least").alias("a"), "doc_id").agg(F.max("n").alias("n"))


def _star_pairs(led: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``led`` (a, doc_id, n: the size of a bucket) that may be similar.

    Those that a smallest document leads are looked at in blocks of bounded size.
    """
    led = led.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = led.join(shuffled(prints.select("doc_id", "length", "counts")), "doc_id").select("a", "blocks", F.expr("pmod(xxhash64(doc_id), blocks)").alias("block"), F.struct("doc_id", "length", "counts").alias("d"))
    blocks = met.groupBy("a", "blocks", "block").agg(F.collect_list("d").alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for first, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keep = may_reach(similarity, *_counts([first]), *_counts(docs))[0]
                b += [d["doc_id"] for d, k in zip(docs, keep) if k]
                a += [first["doc_id"]] * int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    leaders = prints.select(F.col("doc_id").alias("a"), F.struct("doc_id", "length", "counts").alias("first"))
    return blocks.join(shuffled(leaders), "a").select("first", "docs").mapInArrow(giving_back(run), "a long, b long")


def _listed_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components in small buckets that may be similar; a bucket's smallest document has been compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for docs in batch.column(0).to_pylist():
                docs = sorted(docs, key=lambda d: d["doc_id"])[1:]
                comp, ids = (np.array([d[f] for d in docs], np.int64) for f in ("comp", "doc_id"))
                keep = np.triu(comp[:, None] != comp, 1)
                if keep.any():
                    i, j = np.nonzero(keep & may_reach(similarity, *_counts(docs), *_counts(docs)))
                    a += ids[i].tolist()
                    b += ids[j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    groups = buckets.groupBy("key").agg(F.collect_list(F.struct("doc_id", "comp", "length", "counts")).alias("docs"))
    return groups.select("docs").mapInArrow(giving_back(run), "a long, b long")


def _block_pairs(prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components (``comp``) that have a key in common and may be similar.

    Documents meet by the least hash of each pair of segments, five rows a document.  Those outside the
    largest component there are compared with all that meet, block by block in memory: a pair becomes a
    row only if it has its first common key there and can reach the similarity.
    """
    fields = [c for c in _PRINT if c != "doc_id"]
    salts = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), F.col(f"s{p}").alias("salt")) for p in range(PAIRS)))).alias("g")
    met = prints.select("doc_id", "comp", *fields, salts).select("g.*", "doc_id", "comp", *fields)
    shares = met.groupBy("pair", "salt", "comp").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("pair", "salt").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    whole = met.join(shuffled(mixed.select("pair", "salt", "n", F.col("most.comp").alias("largest"))), ["pair", "salt"])
    whole = whole.select("pair", "salt", F.expr(f"pmod(xxhash64(doc_id), cast(ceil(n / {BLOCK}) as int))").alias("block"), F.struct("doc_id", "comp", (F.col("comp") != F.col("largest")).alias("odd"), *fields).alias("d"))
    blocks = whole.groupBy("pair", "salt", "block").agg(F.collect_list("d").alias("ys"))
    odd = whole.where("d.odd").groupBy("pair", "salt", F.col("block").alias("odd_block")).agg(F.collect_list("d").alias("xs"))
    numbers = ["doc_id", "comp", *fields[:-1]]

    def columns(docs: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        got = {f: np.array([d[f] for d in docs], np.int64) for f in numbers}
        return got, np.frombuffer(b"".join(d["counts"] for d in docs), np.uint8).reshape(-1, CLASSES), np.array([d["odd"] for d in docs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (x, x_counts, _), (y, y_counts, y_odd) = columns(batch.column(1)[row].as_py()), columns(batch.column(2)[row].as_py())
                keep = (x["comp"][:, None] != y["comp"]) & ((x["doc_id"][:, None] < y["doc_id"]) | ~y_odd)
                if keep.any():
                    keep &= may_reach(similarity, x["length"], x_counts, y["length"], y_counts)
                if keep.any():
                    keep &= first_common_pair(*([d[f] for f in numbers[3:]] for d in (x, y))) == batch.column(0)[row].as_py()
                i, j = np.nonzero(keep)
                p, q = x["doc_id"][i], y["doc_id"][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return odd.join(shuffled(blocks), ["pair", "salt"]).select("pair", "xs", "ys").mapInArrow(giving_back(run), "a long, b long")


def _with_components(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` with ``comp``, the smallest id that ``links`` reach from a document."""
    known = connected_components(links).select(F.col("id").alias("doc_id"), "root")
    return prints.join(shuffled(known), "doc_id", "left").select(*_PRINT, F.coalesce("root", "doc_id").alias("comp"))


def near_copy_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and group, the smallest doc_id that links reach, of every document that is linked to another one.

    Equal texts link.  Different ones link if their sets of ``shingle``-word shingles have at least the
    Jaccard ``similarity`` and their SimHash fingerprints a key in common (``paired_segment_keys``); keys
    are a filter, which misses few pairs at the threshold (see README).  Groups are the components of all
    links, so they hang on the texts and ids alone.

    Buckets are led by their smallest document.  First every document is compared with one leader, the
    one it shares most buckets with.  What is then connected needs no further comparison: of a group of
    copies, however large, each is compared with a few.  Buckets of one component end here; in the others
    documents are compared with leaders that they are not connected with, and then all pairs that are
    not connected yet, in small buckets at once, in large ones block by block.  A bound on what two documents can have in common goes first, in memory; only pairs that it
    does not rule out become rows, and only their texts' shingles are fetched.

    Null texts link to nothing, texts without words to equal ones.  Rows without an id are left out; rows
    that share an id are one document, with the text of least hash or set.  An empty table has no groups.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("h0"), F.crc32("text").alias("h1"), F.length("text").alias("h2"))
    firsts = written(hashed.groupBy("h0", "h1", "h2").agg(F.min("doc_id").alias("first")), "distinct-texts")
    copies = written(hashed.join(shuffled(firsts), ["h0", "h1", "h2"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "exact-copies")
    prints = near_copy_prints(texts, shingle).where("length > 0").join(shuffled(firsts.selectExpr("first as doc_id").distinct()), "doc_id", "left_semi")
    prints = written(prints.groupBy("doc_id").agg(F.min(F.struct(*_PRINT[1:])).alias("p")).select("doc_id", "p.*"), "near-copy-prints")
    looked_at = [c for c in _PRINT[1:] if c not in ("length", "counts")]
    keyed = _keyed(prints, ["doc_id", *looked_at], paired_segment_keys)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    buckets = written(keyed.join(shuffled(sizes), "key"), "near-copy-buckets")
    links = _verified(texts, _star_pairs(_first_leaders(buckets), prints, similarity), shingle, similarity)
    met = written(_with_components(prints.join(shuffled(buckets.select("doc_id").distinct()), "doc_id", "left_semi"), links), "near-copy-met")
    keyed = _keyed(met, ["doc_id", "comp", *looked_at], paired_segment_keys, 2)
    least = F.min(F.struct("doc_id", "comp"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), least["doc_id"].alias("least"), least["comp"].alias("least_comp"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    buckets = written(keyed.join(shuffled(sizes.where("low < high").drop("low", "high")), "key"), "near-copy-mixed")
    links = links.unionByName(_verified(texts, _star_pairs(_other_leaders(buckets), met, similarity), shingle, similarity))
    met = written(_with_components(met.drop("comp").join(shuffled(buckets.where("n > 2").select("doc_id").distinct()), "doc_id", "left_semi"), links), "near-copy-open")
    small = buckets.where(F.col("n").between(3, LISTED)).select("key", "doc_id").join(shuffled(met.select("doc_id", "comp", "length", "counts")), "doc_id")
    large = met.join(shuffled(buckets.where(F.col("n") > LISTED).select("doc_id").distinct()), "doc_id", "left_semi")
    pairs = _listed_pairs(small, similarity).unionByName(_block_pairs(large, similarity))
    more = _verified(texts, pairs, shingle, similarity)
    return connected_components(copies.unionByName(links).unionByName(more)).select(F.col("id").alias("doc_id"), F.col("root").alias("group"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """All columns of the documents that stay: of each group the one with the smallest id (see ``near_copy_groups``).

    Rows without an id and null texts stay; rows that share an id go or stay together.
    """
    gone = written(near_copy_groups(docs, shingle, similarity).where("doc_id <> group").select("doc_id"), "near-copies-gone")
    ids = few_or_shuffled(gone.select(F.col("doc_id").alias(free_name(docs, "gone"))))
    return docs.join(ids, docs["doc_id"].cast("long") == ids[ids.columns[0]], "left_anti")
