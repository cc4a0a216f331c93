"""Toxicity scores by weak supervision.

Voters look at a document and vote toxic, clean, or abstain: lexicons (a fixed list of insults, and words and word
beginnings that stand out in toxic training rows) and patterns (capitals, exclamation marks, repeated words). The
given label is one more voter. A generative label model estimates by expectation maximisation how often each voter
votes what on toxic and on clean documents, and how far voters err together; voters that repeat each other share
their weight. The posteriors it gives train a linear classifier over the words and word beginnings, which scores
every document.

Everything is fitted on a sample of the labelled training rows of at most ``SAMPLE`` documents; documents go
through the fitted model in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import cut, small_batches, text_of

#: Bounds of the fit: sampled labelled rows, features of the classifier, voters found in the training rows.
SAMPLE, FEATURES, MINED = 12_000, 20_000, 60
#: Lengths of the word beginnings that are features beside whole words; how often they occur makes further features.
PREFIXES, TIMES = (4, 5, 6), (2, 3)
#: Standard errors by which a feature's log-odds must stand above zero to be used.
SIGNIFICANT = 3.0
#: Accuracy of the given labels as a voter.
LABEL = 0.97

# fixed values: a small list of insults
INSULTS = frozenset("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())

_WORD = re.compile(r"[^\W\d_]+")
_ABSTAIN, _CLEAN, _TOXIC = 0, 1, 2


def word_counts(text: str) -> Counter[str]:
    """Lower-case words and how often each occurs."""
    return Counter(_WORD.findall(text.lower()))


def features(words: Counter[str]) -> set[str]:
    """Words, their beginnings with a mark that keeps them apart from words, and beginnings that occur more than once."""
    starts: Counter[str] = Counter()
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                starts[w[:k]] += n
    out = {*words, *(f"{w}-" for w in starts)}
    for k in TIMES:
        out.update([f"{w}-{k}" for w, n in starts.items() if n >= k])
        out.update([f"{w}+{k}" for w, n in words.items() if n >= k])
    return out


def patterns(text: str) -> list[int]:
    """Votes of the patterns: exclamation marks, capitals, words that repeat the one before."""
    letters, words = sum(map(str.isalpha, text)), text.lower().split()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        _TOXIC if text.count("!") >= 3 else _ABSTAIN,
        _TOXIC if letters > 20 and 2 * sum(map(str.isupper, text)) > letters else _ABSTAIN,
        _TOXIC if len(words) > 10 and repeats > 0.3 * len(words) else _ABSTAIN,
    ]


@dataclass
class LabelModel:
    """Class-conditional vote probabilities with a weight for each voter."""

    prior: float
    log_odds: np.ndarray  # voters x votes
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior)) + (self.weights * self.log_odds[np.arange(votes.shape[1]), votes]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, anchor: float | None = None, rounds: int = 12) -> LabelModel:
    """Expectation maximisation from a first guess of the posteriors; ``votes`` is documents x voters.

    To abstain is no evidence. With ``anchor``, the first voter's accuracy is known and stays as given, which keeps
    the classes from drifting to another split that the voters agree on.
    """
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (_ABSTAIN, _CLEAN, _TOXIC)], axis=-1).astype(float)
    post, model = start, None
    for _ in range(rounds):
        prior = float(np.clip((post.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4))
        on = (np.einsum("d,dvk->vk", post, onehot) + 0.1) / (post.sum() + 0.3)
        off = (np.einsum("d,dvk->vk", 1 - post, onehot) + 0.1) / ((1 - post).sum() + 0.3)
        # correlation of what is left of the votes once the class is known
        fires = onehot[:, :, _TOXIC]
        left = fires - post[:, None] * on[:, _TOXIC] - (1 - post)[:, None] * off[:, _TOXIC]
        scale = left.std(axis=0) + 1e-9
        together = (left.T @ left) / n / np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        log_odds, weights = np.log(on / off), 1 / (1 + np.clip(together, 0, 1).sum(axis=1))
        log_odds[:, _ABSTAIN] = 0
        if anchor:
            log_odds[0, [_CLEAN, _TOXIC]] = math.log((1 - anchor) / anchor), math.log(anchor / (1 - anchor))
            weights[0] = 1
        model = LabelModel(prior, log_odds, weights)
        post = model.posterior(votes)
    return model


@dataclass
class Model:
    """A linear classifier over features."""

    bias: float
    weights: dict[str, float]

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in features(word_counts(text)) if f in self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(chosen: list[tuple[str, float]], rows: list[tuple[list[int], list[int], int]], rounds: int = 150, decay: float = 1e-3) -> Model:
    """The label model over the voters' votes on labelled rows, and the classifier on its posteriors.

    ``chosen`` has features with their log-odds, those that stand out most first; a row is the numbers of the chosen
    features that it has, its patterns' votes and its label. Rows of one class alone, or no rows, give a constant
    score near that class's share.
    """
    y = np.array([label for *_, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(math.log(share / (1 - share)), {})
    mined = range(min(MINED, len(chosen)))
    strong = {i for i, (_, odds) in enumerate(chosen) if odds > 2.5}
    words = {i for i in strong if "-" not in chosen[i][0]}
    insults = {i for i, (f, _) in enumerate(chosen) if f in INSULTS}
    sets = [frozenset(numbers) for numbers, _, _ in rows]
    votes = []
    for s, (_, by_patterns, label) in zip(sets, rows, strict=True):
        lexicon = [_TOXIC if s & found else _CLEAN for found in (insults, words, strong - words)]
        votes.append([_TOXIC if label else _CLEAN, *lexicon, *by_patterns, *(_TOXIC if f in s else _ABSTAIN for f in mined)])
    votes = np.array(votes, dtype=np.int8)
    target = fit_label_model(votes, np.where(y > 0, LABEL, 1 - LABEL), LABEL).posterior(votes)

    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    feature = np.array([f for s in sets for f in s], dtype=np.int64)
    w, bias = np.zeros(len(chosen)), math.log((target.sum() + 1) / (len(target) - target.sum() + 1))
    moment, size, bias_moment, bias_size = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam over all rows
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[feature], len(target)), -30, 30)))
        gap = (p - target) / len(target) * 10
        slope = np.bincount(feature, gap[doc], len(w)) + decay * w
        moment, size = 0.9 * moment + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        w -= 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(size / (1 - 0.99**t)) + 1e-8)
        g = gap.sum()
        bias_moment, bias_size = 0.9 * bias_moment + 0.1 * g, 0.99 * bias_size + 0.01 * g * g
        bias -= 0.05 * (bias_moment / (1 - 0.9**t)) / (math.sqrt(bias_size / (1 - 0.99**t)) + 1e-8)
    return Model(float(bias), {f: float(w[i]) for i, (f, _) in enumerate(chosen) if abs(w[i]) > 1e-3})


def held_out(doc_id: Column) -> Column:
    """Rows from which no label is learned."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from a sample of at most about ``sample`` labelled rows that are not held out, chosen by a hash of the id.

    A null id or label teaches nothing; of several labels of one id the toxic one counts; each repeated row of a document
    is an example of its own, and a null text is an empty one. Without labels every score is one half.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample's bound is the bound of what is broadcast here
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    small_batches(docs.sparkSession)
    seen = cut(rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "CAST(toxic AS INT) AS toxic"))
    found = standing_out(seen)
    numbers = {f: i for i, (f, _) in enumerate(found)}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [sorted(numbers[f] for f in features(word_counts(t)) if f in numbers) for t in texts]
            cols = [batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array([patterns(t) for t in texts], pa.list_(pa.int32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "features", "patterns", "toxic"])

    kept = seen.mapInArrow(reduced, "doc_id long, features array<int>, patterns array<int>, toxic int").collect()
    return fit(found, [(f, p, y) for _, f, p, y in sorted((r.doc_id, r.features, r.patterns, r.toxic) for r in kept)])


def standing_out(sample: DataFrame, limit: int = FEATURES) -> list[tuple[str, float]]:
    """The features with their log-odds that toxic rows have most more often than clean ones, the surest first.

    Rows that have a feature are counted where they are read before anything is shuffled; at most ``limit`` features
    come back.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_of, toxic_of = Counter(), Counter()
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = features(word_counts(text))
                all_of.update(own)
                if toxic:
                    toxic_of.update(own)
            cols = [pa.array(list(all_of), pa.string()), pa.array(list(all_of.values()), pa.int64()), pa.array([toxic_of[f] for f in all_of], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["feature", "n", "a"])

    sizes = sample.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    counted = sample.mapInArrow(each, "feature string, n long, a long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a * (sizes[0] - sizes[1] + 1) / (b * (sizes[1] + 1)))
    strength = odds / F.sqrt(1 / a + 1 / b)
    best = counted.select("feature", odds.alias("odds"), strength.alias("strength")).where(F.col("strength") > SIGNIFICANT)
    return [(r.feature, r.odds) for r in best.orderBy(F.desc("strength"), "feature").limit(limit).collect()]


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``, the score of each text from 0 to 1; a null text scores as an empty one.

    Repeated rows each get a score; an empty table gives an empty result; a column of that name is replaced.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(text_of()))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score at least the threshold; all their columns stay as they are."""
    return score(docs, model, "__score").where(F.col("__score") < threshold).drop("__score")
