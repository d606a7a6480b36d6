"""Deduplication against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from hopline.llm import components, matching, passages, simhash, suffixes
from hopline.llm.components import connected_components
from hopline.llm.golay import nearby_codewords
from hopline.llm.matching import repeated_word_runs
from hopline.llm.suffixes import SuffixArray, repeated_substrings, without_repeated_substrings


@pytest.fixture(scope="module")
def copies(prose, odd):
    """Texts with shared passages, exact and near copies, and a run that repeats inside one text."""
    base = [prose(100 + i, 60) for i in range(12)]
    passage = prose(999, 40)
    rows = [(20 + i, t) for i, t in enumerate(base)]
    rows += [(40 + i, f"{base[i]} {passage} {prose(200 + i, 20)}") for i in range(8)]
    rows += [(60, passage), (61, base[3]), (62, base[3]), (63, passage + " " + passage), (64, (prose(5, 3) + " ") * 60)]
    rows += [(70 + i, base[0].replace(base[0].split()[i], "changed", 1)) for i in range(10)]
    return odd + rows


def order(i):
    return 2**63 - 1 if i is None else i


def test_near_words_share_a_codeword():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        a, b = nearby_codewords(x), nearby_codewords(y)
        assert (((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))).all()


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {0} and {got[100 + i] for i in range(1, 30)} == {100} and len(got) == 69
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("pairs_up_to", [24, 1])
def test_simhash_components(make, copies, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    got = simhash.simhash_components(make(copies, True)).collect()
    prints = [(i, fingerprint(t)) for i, t in copies]
    assert len(got) == len(copies)
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for x, (_, f) in enumerate(prints):
            for y, (_, g) in enumerate(prints):
                if bin(f ^ g).count("1") <= 2 and label[y] < label[x]:
                    label[x], changed = label[y], True
    least = {}
    for (i, _), c in zip(prints, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((order(i), f"{f:016x}", order(least.get(c))) for (i, f), c in zip(prints, label))
    assert sorted((order(r.doc_id), r.fingerprint, order(r.component_id)) for r in got) == want


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_fingerprints(spark.createDataFrame([(p,) for p in signed], "f0 long"))
    got = dict(tuple(x) for x in connected_components(links).collect())
    label = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for x in signed:
            for y in signed:
                if bin((x ^ y) & (1 << 64) - 1).count("1") <= 2 and label[y] < label[x]:
                    label[x], changed = label[y], True
    assert {p: got.get(p, p) for p in signed} == label


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Least id of each document's component of texts that are equal or 0.8 alike; rows have one text an id."""
    texts = {i: t for i, t in rows if i is not None and t is not None}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and (texts[i] == texts[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return group


def test_one_of_each_group_of_near_copies_stays(make, copies):
    docs = make(copies, True)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    group = brute_groups(copies)
    assert {i for i in left if i is not None} == {i for i, g in group.items() if i == g} | {1}
    assert left.count(None) == 2 and left.count(5) == 2


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randint(0, 10**9)}" if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("listed, block", [(16, 128), (2, 4)])
def test_groups_are_the_components_of_all_links(make, prose, monkeypatch, listed, block):
    """A chain, a star of near copies with many pairs below the threshold, and pairs just above and below."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = [prose(4000 + i, 150) for i in range(6)]
    chain = [base[0]]
    for i in range(5):
        chain.append(chain[-1].replace(base[0].split()[20 * i + 10], f"new{i} word", 1).replace(base[0].split()[20 * i + 20], f"other{i} word", 1))
    rows = list(enumerate(chain)) + [(100 + i, edited(base[1], i, 0.03)) for i in range(60)]
    rows += [(300 + i, edited(base[2 + i % 4], 50 + i, 0.01 + 0.002 * (i % 6))) for i in range(40)]
    got = dict(tuple(r) for r in simhash.near_copy_groups(make(rows)).collect())
    want = brute_groups(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want
    assert 1 < len({want[100 + i] for i in range(60)}) and want[5] == 0 and len(shingle_set(chain[0]) & shingle_set(chain[5])) < 0.8 * len(shingle_set(chain[0]) | shingle_set(chain[5]))


def test_a_copy_is_first_compared_with_one_leader(make, prose, monkeypatch):
    led, compare = [], simhash._star_pairs
    monkeypatch.setattr(simhash, "_star_pairs", lambda pairs, *rest: led.append(pairs.count()) or compare(pairs, *rest))
    words = prose(4100, 400).split()
    rows = [(i, " ".join([*words[: 9 * i], f"new{i}", *words[9 * i + 1 :]])) for i in range(40)]
    assert {r["group"] for r in simhash.near_copy_groups(make(rows)).collect()} == {0}
    assert 0 < led[0] < 40 and led[1] < 40


def test_spark_chooses_no_broadcast_by_what_it_expects(make, copies, monkeypatch):
    """Small tables, of which it would broadcast every one; only ids that were counted may be marked for it."""
    plans, write = [], simhash.written
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    for module in (simhash, components):
        monkeypatch.setattr(module, "written", lambda df, label: plans.append((label, df._jdf.queryExecution().sparkPlan().toString())) or write(df, label))
    for found in (simhash.drop_near_copies(make(copies)), simhash.simhash_components(make(copies))):
        write(found, "found")
        plans.append(("found", found._jdf.queryExecution().sparkPlan().toString()))
    assert {"near-copy-buckets", "near-copy-mixed", "golay-buckets", "stars"} <= {label for label, _ in plans}
    assert [label for label, plan in plans if "Broadcast" in plan] == []
    assert sum("SortMergeJoin" in plan for _, plan in plans) > 10


def test_the_bound_rules_out_only_what_is_less_similar():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 400, n)) for n in (1, 30, 200, 300, 390, 5000)] + [np.arange(256 * 300)]
    counts = np.stack([np.minimum(np.bincount(x % 256, minlength=256), 255).astype(np.uint8) for x in sets])
    length = np.array([len(x) for x in sets])
    for similarity in (0.1, 0.5, 0.8):
        may = simhash.may_reach(similarity, length, counts, length, counts)
        alike = [[len(np.intersect1d(x, y)) >= similarity * len(np.union1d(x, y)) for y in sets] for x in sets]
        assert not (np.array(alike) & ~may).any()


def brute_bytes(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            g = b[s : s + least]
            first[g] = min(order(i), first.get(g, order(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < order(i):
                cover[s] += 1
                cover[s + least] -= 1
        on = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~on])
        out.append((i, len(b), int(on.sum()), int((np.diff(np.r_[0, on.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def small(rows):
    """The very long texts shortened for brute force: 100,000 windows are enough."""
    return [(i, t[:60_000] if t and len(t) > 60_000 else t) for i, t in rows]


@pytest.mark.parametrize("chunk_bytes", [600, 1 << 21])
def test_repeated_substrings(make, copies, chunk_bytes):
    rows = small(copies)
    got = repeated_substrings(make(rows, True).repartition(3), 50, chunk_bytes).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (order(r[0]), r[1:])) == brute_bytes(rows, 50)


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_letters(make, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(40)]
    got = repeated_substrings(make(rows), 10, 200).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: (order(x[0]), x[1:])) == brute_bytes(rows, 10)


def test_maximal_repeats_have_all_occurrences():
    texts = [b"xxabcdefgyy", b"zzabcdefgww", b"qqabcdekk"]
    array = SuffixArray(texts, 4)
    found = set()
    for first, last, length, _ in array.repeats(4, np.zeros(len(array.owner), np.int64)):
        at = array.order[first : last + 1]
        string = {texts[array.owner[i]][array.inner[i] : array.inner[i] + length] for i in at}
        assert len(string) == 1
        found.add((string.pop(), tuple(sorted(array.owner[at].tolist()))))
    assert found == {(b"abcdefg", (0, 1)), (b"abcde", (0, 1, 2))}
    assert list(SuffixArray([], 4).repeats(4, np.zeros(0, np.int64))) == []


def test_texts_without_repeated_passages_keep_their_columns(make, copies):
    docs = make(copies, True)
    got = without_repeated_substrings(docs, 100, 2000)
    assert got.columns == docs.columns
    text = {}
    for r in got.collect():
        text.setdefault(r.doc_id, r.text)
    assert text[20] == dict(copies)[20] and 61 not in text and 62 not in text and text[1] is None and text[2] == ""


def brute_words(rows, window):
    first = {}
    listed = [(order(i), (t or "").encode().split()) for i, t in rows]
    for i, w in listed:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min((i, s), first.get(k, (i, s)))
    out = []
    for (i, _), (o, w) in zip(rows, listed):
        on = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (o, s):
                on[s : s + window] = True
        kept = b" ".join(x for x, z in zip(w, on) if not z)
        out.append((i, len(w), int(on.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


@pytest.mark.parametrize("chunk_bytes", [600, 1 << 21])
def test_repeated_word_runs(make, copies, chunk_bytes):
    rows = small(copies)
    got = repeated_word_runs(make(rows, True).repartition(3), 20, chunk_bytes).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (order(r[0]), r[1:])) == brute_words(rows, 20)


@pytest.mark.parametrize("seed", range(3))
def test_word_runs_of_few_words(make, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(("a", "b", "cc")) for _ in range(r.randint(0, 40)))) for i in range(30)]
    got = repeated_word_runs(make(rows), 6, 150).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: (order(x[0]), x[1:])) == brute_words(rows, 6)


def test_hot_anchors_are_dealt_by_windows(make, copies, monkeypatch):
    monkeypatch.setattr(passages, "HOT_CHUNKS", 1)
    rows = small(copies)
    got = repeated_substrings(make(rows, True).repartition(3), 50, 600).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (order(r[0]), r[1:])) == brute_bytes(rows, 50)
    got = repeated_word_runs(make(rows, True).repartition(3), 20, 600).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (order(r[0]), r[1:])) == brute_words(rows, 20)


def test_what_the_solver_does_not_find_stays(make, copies, monkeypatch):
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(suffixes, "earlier_repeats", lambda b, window: (none, none, none))
    monkeypatch.setattr(matching, "earlier_windows", lambda b, window: (none, none, none))
    assert not repeated_substrings(make(copies)).where("n_removed > 0").head(1)
    assert not repeated_word_runs(make(copies)).where("n_removed > 0").head(1)


def test_nothing_in_nothing_out(make):
    assert repeated_substrings(make([])).count() == 0 and repeated_word_runs(make([])).count() == 0
    assert simhash.simhash_components(make([])).count() == 0 and simhash.drop_near_copies(make([])).count() == 0
