"""Toxicity score: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, shuffled, written

#: The most labelled rows of either class that the model is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000

#: Insults known before any label is seen.
SEED_INSULTS = frozenset("idiot moron stupid dumb loser pathetic worthless disgusting scum trash clown garbage fool jerk filth vermin imbecile cretin".split())
#: Second-person pronouns of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti vos vous votre toi ton ta usted ustedes du dich dir dein deine euch ihr sie".split())

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$*#!|]+[^\W\d_]+")
_UNMASK = str.maketrans("013457@$!|", "oieastasil")
_MASK = re.compile(r"[^\W\d_][0-9@$*#!|]")
_STEMS = (4, 5, 6)

FEATURES = ("insult share", "insults", "strongest insult", "insult weight a word", "seed insult share", "near second person", "second-person share", "capital share", "exclamation share", "punctuation share", "masked insults", "masked share", "stretched share", "words")


#: Marks counted as punctuation.
MARKS = b".,;:!?*#$%&|\"'"

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True


@cache
def _cased() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: upper case, letter (a word character, but no digit or underscore)."""
    points = range(0x110000)
    return np.fromiter((chr(i).isupper() for i in points), bool, len(points)), np.fromiter((chr(i).isalnum() and _WORD.fullmatch(chr(i)) is not None for i in points), bool, len(points))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _stretched(points: np.ndarray) -> int:
    """Letters that stand three times in a row; six in a row count twice."""
    if len(points) < 3:
        return 0
    third = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]))
    if not len(third):
        return 0
    third = third[_cased()[1][points[third]]]
    cuts = np.flatnonzero(np.r_[True, np.diff(third) > 1])
    return int(((np.diff(np.r_[cuts, len(third)]) + 2) // 3).sum()) if len(third) else 0


def terms(text: str) -> tuple[set[str], set[str]]:
    """Distinct words of a text, and their stems, each marked by a dash."""
    words = set(_WORD.findall(text.lower()))
    return words, {f"{w[:n]}-" for w in words for n in _STEMS if len(w) >= n}


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: list[tuple[str, int, int, int]], toxic: int, clean: int, most: int = 5000) -> Lexicon:
        """Words and stems found mostly in toxic texts, with the logarithm of their odds.

        ``counts``: each term with the toxic and the clean texts that have it and, for a stem, the longer
        words of toxic texts that begin so; ``toxic`` and ``clean``: all such texts.
        """
        n1, n0 = max(1, toxic), max(1, clean)
        # two deviations below the count: a few toxic texts that share a rare word prove nothing
        odds = {t: math.log((max(0.0, c - 2 * math.sqrt(c)) + 0.1) / (n1 + 0.2)) - math.log((d + 0.1) / (n0 + 0.2)) for t, c, d, _ in counts if c >= max(5, 0.015 * n1)}
        forms = {t: f for t, _, _, f in counts}
        # a stem of one or two words says no more than these words, but would catch others
        strong = sorted((t for t, o in odds.items() if o >= 3 and (t[-1] != "-" or forms[t] > 2)), key=lambda t: (-odds[t], t))[:most]
        return cls({t: odds[t] for t in strong if t[-1] != "-"} | {w: odds.get(w, 3.0) for w in SEED_INSULTS}, {t[:-1]: odds[t] for t in strong if t[-1] == "-"})

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in _STEMS:
            if len(word) >= n and (stem := self.stems.get(word[:n], 0.0)) > found:
                found = stem
        return found

    def features(self, text: str, memo: dict[str, float]) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        n = len(words) or 1
        hits, second = [], 0
        for at, word in enumerate(words):
            weight = memo.get(word)
            if weight is None:
                if len(memo) > 200_000:
                    memo.clear()
                # the sign tells second-person words, which are no insults
                weight = memo[word] = -1.0 if word in SECOND_PERSON and not self.weight(word) else self.weight(word)
            if weight > 0:
                hits.append((at, weight))
                second += word in SECOND_PERSON
            elif weight:
                second += 1
        near = sum(1 for at, _ in hits if not SECOND_PERSON.isdisjoint(words[max(0, at - 4) : at + 5]))
        masked = _MASKED.findall(low) if _MASK.search(low) else []
        weights = [w for _, w in hits]
        chars = len(text) or 1
        return [
            len(hits) / n,
            len(hits),
            max(weights, default=0.0),
            sum(weights) / n,
            sum(1 for at, _ in hits if words[at] in SEED_INSULTS) / n,
            near / n,
            second / n,
            int(_cased()[0][_points(text)].sum()) / chars,
            text.count("!") / chars,
            int(_MARK[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].sum()) / chars,
            sum(1 for m in masked if self.weight(m.translate(_UNMASK)) > 0),
            len(masked) / n,
            _stretched(_points(low)) / n,
            math.log1p(len(words)),
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        memo: dict[str, float] = {}
        return np.array([self.features(t, memo) for t in texts], float).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Logistic loss, histogram splits, trees of a fixed depth held as arrays."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 8.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, at = self._grow(binned, cuts, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][at]
        return self

    def _grow(self, binned, cuts, grad, hess):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(grad), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, 0)
            if len(rows):
                g, h = grad[rows].sum(), hess[rows].sum()
                for f, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.penalty) + (g - gl) ** 2 / (h - hl + self.penalty) - g**2 / (h + self.penalty)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        b = int(gain.argmax())
                        best = (gain[b], f, c[b], b)
            feature[node], cut[node] = best[1], best[2]
            right = binned[rows, best[1]] > best[3] if best[2] < np.inf else np.zeros(len(rows), bool)
            at[rows] = 2 * node + 1 + right
        leaf = at - inner
        g, h = (np.bincount(leaf, v, inner + 1) for v in (grad, hess))
        return (feature, cut, -self.rate * g / (h + self.penalty)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and the non-decreasing probabilities there."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # total, weight, first, last
    for m, t, w in zip(margin[order], y[order], weight[order]):
        if blocks and blocks[-1][3] == m:
            last = blocks.pop()
            blocks.append([last[0] + t * w, last[1] + w, last[2], m])
        else:
            blocks.append([t * w, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.repeat([b[0] / b[1] for b in blocks], 2)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees
    levels: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(self.lexicon.matrix(texts)), *self.levels), 0.0, 1.0)


#: Parts of the sample; each is described and judged by what the others teach.
FOLDS = 5


def term_counts(sample: DataFrame, least: int) -> list:
    """term, forms and, by label and fold, the texts of ``sample`` (text, toxic, fold) that have each term.

    Counted by the tasks; terms in fewer than ``least`` toxic texts stay there.  ``forms``: the distinct
    longer words of toxic texts with a stem, and how many of them only one fold has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                words, stems = terms(text)
                held.update((t, toxic, fold) for t in words | stems)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(held.values(), pa.int64())], names=["term", "toxic", "fold", "n"])

    counts = written(sample.select("text", "toxic", "fold").mapInArrow(giving_back(count), "term string, toxic int, fold int, n long"), "term-counts")
    pick = lambda toxic, fold: F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold), F.col("n")).otherwise(0))
    by_term = counts.groupBy("term").agg(F.array(*(pick(1, f) for f in range(FOLDS))).alias("bad"), F.array(*(pick(0, f) for f in range(FOLDS))).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("total")).where(F.col("total") >= least)
    words = counts.where("toxic = 1 and not endswith(term, '-')").groupBy("term").agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    stems = words.select(F.explode(F.array(*(F.when(F.length("term") > n, F.concat(F.left("term", F.lit(n)), F.lit("-"))) for n in _STEMS))).alias("stem"), "low", "high").where("stem is not null")
    forms = stems.groupBy(F.col("stem").alias("term")).agg(F.count("*").alias("forms"), F.array(*(F.sum(((F.col("low") == f) & (F.col("high") == f)).cast("long")) for f in range(FOLDS))).alias("only"))
    return by_term.join(shuffled(forms), "term", "left").select("term", "bad", "good", F.coalesce("forms", F.lit(0)).alias("forms"), F.coalesce("only", F.array(*[F.lit(0).cast("long")] * FOLDS)).alias("only")).collect()


def lexicon(counts: list, sizes: dict[tuple[int, int], int], without: int | None = None) -> Lexicon:
    """From ``term_counts`` and the number of texts by (label, fold), leaving one fold out."""
    folds = [f for f in range(FOLDS) if f != without]
    listed = [(r.term, sum(r.bad[f] for f in folds), sum(r.good[f] for f in folds), r.forms - (r.only[without] if without is not None else 0)) for r in counts]
    return Lexicon.of(listed, *(sum(sizes.get((label, f), 0) for f in folds) for label in (1, 0)))


def fit(sample: DataFrame, totals: dict[int, int]) -> ToxicityModel | None:
    """Every row of ``sample`` (text, toxic, fold) serves the lexicon, the trees and the calibration, but never describes itself.

    A row's features come from a lexicon of the other folds, and its margin for the calibration from
    trees of the other folds; the model that is kept has the lexicon and the trees of all rows.  Texts
    stay on the executors: the driver sees counts of frequent terms and one row of numbers a text.
    """
    sizes = {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    bad = {f: sizes.get((1, f), 0) for f in range(FOLDS)}
    if not sum(bad.values()) or sum(bad.values()) == sum(sizes.values()):
        return None
    least = sum(bad.values()) - max(bad.values())
    counts = term_counts(sample, max(5, math.ceil(0.015 * least)))
    shared = sample.sparkSession.sparkContext.broadcast([lexicon(counts, sizes, f) for f in range(FOLDS)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, fold = (c.to_pylist() for c in batch.columns)
            memos: list[dict[str, float]] = [{} for _ in range(FOLDS)]
            rows = [shared.value[f].features(t, memos[f]) for t, f in zip(texts, fold)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    # sorted: sums of floats must not hang on the order in which tasks end
    rows = sorted(sample.select("text", "toxic", "fold").mapInArrow(giving_back(describe), "toxic int, fold int, x array<double>").collect(), key=lambda r: (r.fold, r.toxic, r.x))
    x, toxic, fold = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), np.array([r.fold for r in rows])
    weight = np.array([totals[r.toxic] / sum(n for (label, _), n in sizes.items() if label == r.toxic) for r in rows])
    weight /= weight.mean()
    margin = np.zeros(len(rows))
    for one in range(FOLDS):
        own, rest = fold == one, fold != one
        margin[own] = BoostedTrees().fit(x[rest], toxic[rest], weight[rest]).margin(x[own]) if rest.any() else 0.0
    return ToxicityModel(lexicon(counts, sizes), BoostedTrees().fit(x, toxic, weight), isotonic(margin, toxic, weight))


def held_out_column(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel | float:
    """Fits on at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled, not held-out rows, those of the smallest hash.

    Rows count by the share of their class in all such rows, so calibration follows the real mix.
    Without rows of both classes there is nothing to learn: the share of toxic labels is returned.
    """
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out_column()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TOXIC).unionAll(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_CLEAN))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null")
    # the sample is bounded, so its ids are broadcast
    sample = written(texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", F.expr(f"cast(pmod(xxhash64(doc_id, 'fold'), {FOLDS}) as int)").alias("fold")), "labelled-texts")
    return fit(sample, totals) or totals.get(1, 0) / max(1, sum(totals.values()))


def score_column(docs: DataFrame, model: ToxicityModel | float, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, as ``name``; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = shared.value.score(texts) if isinstance(shared.value, ToxicityModel) else np.full(len(texts), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(giving_back(score), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only text enters a score; a null text scores as an empty one.  Rows without an id are scored and count
    as not held out; repeated rows score alike; extra columns are not read.  An empty table gives an empty
    result; without labels of both classes every text scores their share of toxic ones, or 0.
    """
    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    scored = score_column(narrow, train(narrow, labels))
    return scored.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
