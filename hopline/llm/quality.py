"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_bytes, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims", "n_ends", "n_stutters")

_SPACE, _SYMBOL, _UPPER, _LETTER, _EXCLAIM, _END, _LEAD = (np.zeros(256, np.int64) for _ in range(7))
_SPACE[list(b" \t\n\v\f\r")] = 1
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_EXCLAIM[list(b"!?")] = 1
_END[list(b".!?")] = 1
_LEAD[:] = 1
_LEAD[0x80:0xC0] = 0  # continuation bytes start no code point
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text: its words that lie in a 5-word window which the text holds twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    total, out = int(sizes.sum()), np.zeros(len(words), np.int64)
    if total < 5:
        return out
    hashes = np.fromiter((hash(w) for one in words for w in one), np.int64, total).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    n = total - 4
    key = owner[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i, mix in enumerate(_MIX):
        turned = (hashes[i : n + i] ^ (hashes[i : n + i] >> np.uint64(29))) * mix
        key = key * np.uint64(0x100000001B3) + (turned ^ (turned >> np.uint64(32)))
    within = np.flatnonzero(owner[:n] == owner[4:])
    order = within[np.argsort(key[within], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    mark = np.zeros(total + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + 5, -1)
    return np.bincount(owner[np.cumsum(mark)[:total] > 0], minlength=len(words))


def text_counts(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of ``COUNTS`` for each text."""
    words = [t.split() for t in texts]
    # a byte more for each text keeps the sums' places apart
    whole = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]

    def total(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[whole], starts) if len(texts) else np.zeros(0, np.int64)

    spaces = total(_SPACE) - 1
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    ends = [sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in one) for one in lines]
    columns = (
        [len(w) for w in words],
        total(_LEAD) - 1 - spaces,
        total(_SYMBOL),
        [len(x) - len(set(x)) for x in lines],
        repeated_words(words),
        [len(x) for x in lines],
        total(_UPPER),
        total(_LETTER),
        total(_EXCLAIM),
        ends,
        [sum(map(bytes.__eq__, w, w[1:])) for w in words],
    )
    return [np.asarray(c, np.int64) for c in columns]


def count_table(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every whole text; a null text counts as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, text_counts(text_bytes(batch.column(1))))], names=["doc_id", *COUNTS])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(giving_back(count), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def votes() -> dict[str, Column]:
    """1: good, 0: bad, null: abstains."""

    def ratio(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    words, repeats, ends = F.col("n_words"), ratio("n_repeat_words", "n_words"), ratio("n_ends", "n_lines")
    symbols, density = ratio("n_symbols", "n_words"), ratio("n_symbols", "word_chars")
    mean, capitals, shouts, stutters = ratio("word_chars", "n_words"), ratio("n_upper", "n_letters"), ratio("n_exclaims", "n_words"), ratio("n_stutters", "n_words")
    return {
        "symbols": vote(symbols < 0.02, symbols > 0.1),
        "symbol_density": vote(density < 0.005, density > 0.05),
        "repeated_lines": vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 3), ratio("n_dup_lines", "n_lines") > 0.3),
        "repeated_words": vote(repeats < 0.01, repeats > 0.1),
        "stutter": vote(stutters < 0.05, stutters > 0.2),
        "word_length": vote(mean.between(4.4, 6.5), (mean < 3.5) | (mean > 7)),
        "capitals": vote(capitals < 0.1, capitals > 0.4),
        "shouting": vote(shouts < 0.02, shouts > 0.2),
        "length": vote(words >= 100, words < 15),
        "sentences": vote(ends > 0.97, ends < 0.9),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good texts and, for each rule, the chance that a vote on a good text is good
    and that a vote on a bad text is bad.  A few made-up votes keep the chances off 0 and 1 and tie the
    classes to their names.
    """
    if not patterns:
        return 0.5, []
    n = np.array([c for _, c in patterns], float)
    v = np.array([[np.nan if x is None else x for x in p] for p, _ in patterns], float)
    voted, good = ~np.isnan(v), np.nan_to_num(v)
    share, right_good, right_bad = 0.7, np.full(v.shape[1], 0.9), np.full(v.shape[1], 0.6)
    for _ in range(rounds):
        up = np.where(voted, np.where(good > 0, np.log(right_good / (1 - right_bad)), np.log((1 - right_good) / right_bad)), 0).sum(1)
        q = 1 / (1 + np.exp(-np.clip(up + math.log(share / (1 - share)), -500, 500)))
        w1, w0 = (n * q)[:, None] * voted, (n * (1 - q))[:, None] * voted
        made = 0.002 * n.sum() + 1
        old = np.r_[share, right_good, right_bad]
        right_good = ((w1 * good).sum(0) + 0.95 * made) / (w1.sum(0) + made)
        right_bad = ((w0 * (1 - good)).sum(0) + 0.5 * made) / (w0.sum(0) + made)
        share = float(np.clip(((n * q).sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        if np.abs(old - np.r_[share, right_good, right_bad]).max() < 1e-7:
            break
    return share, list(zip(right_good.tolist(), right_bad.tolist()))


def quality_posterior(counts: DataFrame) -> DataFrame:
    """``counts`` with ``quality``: the chance that the text is good, given all votes.

    The rules' accuracies come from the counts of vote patterns over all rows; there are at most
    3 to the number of rules of these, whatever the input.
    """
    rules = votes()
    patterns = counts.groupBy(*(r.alias(k) for k, r in rules.items())).count().collect()
    # sorted: sums of floats must not hang on the order in which tasks end
    share, chances = estimate(sorted(((tuple(p)[:-1], p["count"]) for p in patterns), key=lambda x: str(x[0])))
    logit = F.lit(math.log(share / (1 - share)))
    for rule, (g, b) in zip(rules.values(), chances):
        logit = logit + F.when(rule == 1, math.log(g / (1 - b))).when(rule == 0, math.log((1 - g) / b)).otherwise(0.0)
    return counts.withColumn("quality", 1 / (1 + F.exp(-logit)))


def quality_report(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Base counts of every document and whether it stays.

    A text fails outright with under 10 words or over 20 % of them in repeated 5-word windows; any other
    stays if its posterior quality is ``least`` or more.  Null texts have no words and fail.  Repeated
    rows are judged alike; an empty table gives an empty result.
    """
    judged = quality_posterior(written(count_table(docs), "quality-counts"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"), "quality")
