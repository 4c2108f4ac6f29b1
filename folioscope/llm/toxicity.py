"""Toxicity by non-negative positive-unlabelled learning.

Known: texts confirmed as toxic, and texts of which nothing is known, drawn from all documents whether they have a label or not. A linear classifier over the words (and word
beginnings) of a text minimises the class-prior-corrected risk: the loss of the positives, weighed by the prior, plus the loss of the unlabelled
as negatives less what the positives among them account for; where that difference is negative, the step goes back on it.
Features are chosen from sums by feature; the driver sees the chosen ones of each sampled text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.labelled import labelled_texts, sample_labels, text_scores
from folioscope.llm.shared import Scratch, crc_mod, text_batches, text_bytes

#: Confirmed toxic texts and texts of unknown class that training takes.
POSITIVES, UNLABELLED = 4000, 12_000
#: Features: those found in so many positives at least, the most telling ones.
LEAST, FEATURES, PREFIXES = 4, 256, (4, 5, 6)
STEPS, RATE, DECAY, BETA = 300, 0.1, 5e-4, 0.0

#: Words are runs of letters a-z (after lower-casing) and bytes of non-ASCII characters.
_TABLE = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features_of(text: bytes) -> np.ndarray:
    """Distinct words and their beginnings (marked by a dash), as sorted 32-bit numbers."""
    words = set(text.translate(_TABLE).split())
    words.update([w[:n] + b"-" for w in words for n in PREFIXES if len(w) > n])
    return np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)))


@dataclass
class Linear:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for i, t in enumerate(texts if len(self.features) else ()):
            z[i] += self.weights[np.isin(self.features, features_of(t), assume_unique=True)].sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, role, text -> in how many positives (p) and texts of unknown class (u) of the task each feature is."""
    found: list[list[np.ndarray]] = [[], []]

    def told() -> pa.RecordBatch:
        both = [np.unique(np.concatenate([np.zeros(0, np.uint32), *x]), return_counts=True) for x in found]
        names = np.union1d(both[0][0], both[1][0])
        counts = np.zeros((2, len(names)), np.int64)
        for k, (f, n) in enumerate(both):
            counts[k, np.searchsorted(names, f)] = n
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(counts[0]), pa.array(counts[1])], ["feature", "p", "u"])

    size = 0
    for batch in text_batches(batches):
        for role, text in zip(batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            f = features_of(text)
            size += len(f)
            for k in (0, 1):
                if role & (k + 1):
                    found[k].append(f)
        if size > 1 << 22:
            yield told()
            found, size = [[], []], 0
    yield told()


def choose(counts: DataFrame, positives: int, unlabelled: int, least: int = LEAST, most: int = FEATURES) -> np.ndarray:
    """Features of at least ``least`` positives that are likelier there than among the unlabelled; the most telling ones, by the G statistic. counts: feature, p, u."""
    sums = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= least)
    told = F.col("p") * F.log((F.col("p") / positives) / ((F.col("u") + 0.5) / (unlabelled + 1)))
    best = sums.withColumn("told", F.round(told, 9)).filter("told > 0").orderBy(F.desc("told"), "feature").limit(most).collect()
    return np.sort(np.array([r["feature"] for r in best], np.uint32))


Side = tuple[np.ndarray, np.ndarray, int]  # places of features, the text of each, number of texts


def side(texts: list[np.ndarray]) -> Side:
    return np.concatenate([np.zeros(0, np.int64), *texts]), np.repeat(np.arange(len(texts)), [len(x) for x in texts]), len(texts)


def risks(w: np.ndarray, bias: float, texts: Side) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Mean logistic loss of the texts as positives and as negatives, and the gradients of both (weights, then bias)."""
    ids, of, n = texts
    z = np.bincount(of, w[ids], n) + bias
    q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    slope = lambda x: np.append(np.bincount(ids, x[of], len(w)), x.sum())
    return np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean(), slope((q - 1) / n), slope(q / n)


def risk(w: np.ndarray, bias: float, positive: Side, unlabelled: Side, prior: float) -> tuple[float, np.ndarray]:
    """The class-prior-corrected risk and the step to take on it: its gradient, or, where the negatives' part is below -BETA, the way back up that part."""
    as_positive, as_negative, up, down = risks(w, bias, positive)
    _, unknown, _, unknown_down = risks(w, bias, unlabelled)
    rest, slope = unknown - prior * as_negative, unknown_down - prior * down
    return prior * as_positive + max(rest, 0.0), prior * up + slope if rest >= -BETA else -slope


def fit(features: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Linear:
    """Adam on the non-negative risk with logistic loss over all texts, weights held small. positive, unlabelled: the places of each text's features among the chosen ones."""
    bias = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    if not len(features) or not positive or not unlabelled:
        return Linear(features[:0], np.zeros(0), bias)
    sides, x = (side(positive), side(unlabelled)), np.append(np.zeros(len(features)), bias)
    mean, spread = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        _, g = risk(x[:-1], x[-1], *sides, prior)
        g[:-1] += DECAY * x[:-1]
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        x = x - RATE * (1 - 0.9 * t / steps) * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
    return Linear(features, x[:-1], float(x[-1]))


def _sets_of(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [np.packbits(np.isin(features, features_of(x), assume_unique=True)).tobytes() for x in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["role", "features"])

    return run


def drawn(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """((id, role), prior). role: 1 confirmed toxic, 2 of unknown class, 3 both; both sides go by a hash of the id. The unknown ones are drawn from all
    documents that aren't held out, labelled or not, and no label of theirs is used. The prior is the share of toxic rows among labelled ones."""
    confirmed, sizes = sample_labels(labels, crc_mod(labels[id_col], 4) != 2, id_col, label_col, positives)
    ids = df.select(df[id_col].alias("id")).filter(F.col("id").isNotNull() & (crc_mod(F.col("id"), 4) != 2)).distinct()
    unknown = ids.orderBy(F.xxhash64("id"), "id").limit(unlabelled).select("id", F.lit(2).alias("role"))
    both = unknown.unionByName(confirmed.filter("label = 1").select("id", F.lit(1).alias("role")))
    return both.groupBy("id").agg(F.sum("role").cast("int").alias("role")), sizes[1] / max(sizes[0] + sizes[1], 1)


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """Fit on the drawn texts. Of several rows with one id the least text is taken."""
    scratch = Scratch(df.sparkSession, "toxicity")
    roles, prior = drawn(df, labels, id_col, label_col, positives, unlabelled)
    if not prior:
        return Linear(np.zeros(0, np.uint32), np.zeros(0), -5.0)
    sample = scratch.save(labelled_texts(df, roles, id_col, text_col, "role"), "sample")
    sizes = sample.agg(F.count_if(F.col("role") != 2), F.count_if(F.col("role") != 1)).first()
    features = choose(sample.mapInArrow(_feature_counts, "feature long, p long, u long"), max(sizes[0], 1), sizes[1])
    got = sample.mapInArrow(_sets_of(features), "role int, features binary").collect()
    scratch.drop(sample)
    sides: tuple[list, list] = ([], [])
    for role, bits in sorted((r["role"], bytes(r["features"])) for r in got):  # the order of arrival must not matter
        own = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(features)])
        for k in (0, 1):
            if role & (k + 1):
                sides[k].append(own)
    return fit(features, *sides, prior=prior)


def toxicity_score(text: Column, model: Linear) -> Column:
    return text_scores(text, model.score, 4 << 20)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **sample) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2 (a null doc_id counts as the empty text, and has no label).
    Training takes POSITIVES confirmed texts and UNLABELLED texts of all documents at most, in the order of a hash of their ids.
    The score depends on the text alone; a null text is empty. Without a toxic label all scores are near 0.
    An empty table gives an empty result; other columns are ignored; equal texts have equal scores."""
    model = train(df, labels, id_col, text_col, label_col, **sample)
    rows = df.select(df[id_col].alias("doc_id"), (crc_mod(df[id_col], 4) == 2).alias("held_out"), toxicity_score(df[text_col], model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
