"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages (runs of words). Each passage is encoded from what its characters and words look like, in no
particular language: kinds of characters, lengths, capitals, repetition. A small network embeds passages; gated attention,
learned from the labels of whole documents, weighs them; the weighted mean gives the score. Training is plain numpy on the
driver, over a sample of labelled documents that is bounded by their number and by their passages: a document
is taken with all of its passages or not at all. Scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.labelled import labelled_texts, sample_labels, text_scores
from folioscope.llm.shared import Scratch, crc_mod, text_batches, text_bytes

PASSAGE_WORDS = 64
#: Of each class training takes so many labelled documents at most, with so many passages in all at most.
PER_CLASS, PASSAGES = 6000, 200_000
#: Longer texts are encoded in pieces of about so many bytes, cut between passages.
PIECE = 1 << 20
HIDDEN, GATE, EPOCHS, BATCH = 24, 12, 14, 64

#: Kinds of bytes: 0 white space, 1 line feed, 2 a-z, 3 A-Z, 4 digit, 5 other characters than ASCII, then ASCII punctuation by groups.
_GROUPS = [b".", b",", b";:", b"!", b"?", b"|", b"#$%&*", b"()[]{}<>", b"'\"`", b"-_", b"/\\@=+^~"]
_KIND = np.full(256, 6 + len(_GROUPS), np.uint8)
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 2, 3, 4, 5
for _i, _g in enumerate(_GROUPS):
    _KIND[list(_g)] = 6 + _i
KINDS = 7 + len(_GROUPS)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
WIDTH = KINDS + 16


def pieces(text: bytes, passage_words: int, limit: int) -> list[bytes]:
    """The text cut where passages begin, in pieces of about ``limit`` bytes."""
    if len(text) <= limit:
        return [text]
    inside = _KIND[np.frombuffer(text, np.uint8)] > 1
    opens = np.flatnonzero(np.diff(inside, prepend=False) & inside)[::passage_words]
    cuts = [0, *opens[np.flatnonzero(np.diff(opens // limit)) + 1].tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(texts: list[bytes], passage_words: int = PASSAGE_WORDS, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the number of passages of each text (one at least, all zero for a text without words)."""
    if all(len(t) <= limit for t in texts):
        return _encode(texts, passage_words)
    parts = [[_encode([p], passage_words)[0] for p in pieces(t, passage_words, limit)] for t in texts]
    return np.concatenate([x for own in parts for x in own]), np.array([sum(map(len, own)) for own in parts])


def _encode(texts: list[bytes], passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
    kind = _KIND[raw]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    text_end = np.cumsum(lengths)
    inside = kind > 1
    edge = np.diff(inside, prepend=False)
    start, end = np.flatnonzero(edge & inside), np.flatnonzero(edge & ~inside)  # each text ends in a line feed
    of = np.searchsorted(text_end, start, side="right")
    words = np.bincount(of, minlength=len(texts))
    first_word = np.cumsum(words) - words
    bags = np.maximum(1, -(-words // passage_words))
    first_bag = np.cumsum(bags) - bags
    out = np.zeros((int(bags.sum()), WIDTH), np.float32)
    if not len(start):
        return out, bags
    nth = np.arange(len(start)) - first_word[of]
    passage = first_bag[of] + nth // passage_words
    opens = np.flatnonzero(np.diff(passage, prepend=-1))  # word that opens each passage
    here = passage[opens]
    stop = np.minimum(np.append(start[opens][1:], len(raw)), text_end[of[opens]] - 1)  # up to the next passage, or to the text's end
    span, size = np.stack([start[opens], stop], axis=1).ravel(), (stop - start[opens]).astype(np.float32)
    for k in range(KINDS):
        out[here, k] = np.add.reduceat((kind == k).view(np.int8), span, dtype=np.int32)[::2] / size
    long = (end - start).astype(np.float32)
    n = np.diff(np.append(opens, len(start))).astype(np.float32)
    mean = lambda x: np.add.reduceat(x.astype(np.float32), opens) / n
    # equal words (with their case and marks) have equal hashes
    size_of = end - start
    begin = np.cumsum(size_of) - size_of
    offset = np.arange(int(size_of.sum())) - np.repeat(begin, size_of)
    hashes = np.add.reduceat(_POWERS[np.minimum(offset, 63)] * (raw[inside].astype(np.uint64) + np.uint64(1)), begin)
    same = lambda lag: np.append(np.zeros(lag, bool), (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])) if lag < len(hashes) else np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.add.reduceat(fresh.astype(np.float32), opens)  # sorted words stand in the order of passages
    head, tail = kind[start], kind[end - 1]
    capitals = np.add.reduceat((kind == 3).view(np.int8), start, dtype=np.int32)
    small = np.add.reduceat((kind == 2).view(np.int8), start, dtype=np.int32)
    stats = [
        np.log1p(n), mean(long), np.sqrt(np.maximum(mean(long**2) - mean(long) ** 2, 0)), np.log1p(np.maximum.reduceat(long, opens)), distinct / n, mean(same(1)), mean(same(1) | same(2) | same(3) | same(4)),
        mean(head == 3), mean((capitals > 0) & (small == 0)), mean(tail >= 6), mean((tail >= 6) & (head >= 6)), mean(long <= 2), mean(long >= 12), mean((capitals > 0) & (head != 3)), mean(tail == 6), mean(head == 4),
    ]
    for k, x in enumerate(stats):
        out[here, KINDS + k] = x
    return out, bags


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    shift: float

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        logit, _ = _forward(self.w, (x - self.mean) / self.scale, bags)
        return 1 / (1 + np.exp(-np.clip(logit + self.shift, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray):
    first = np.cumsum(bags) - bags
    h = np.tanh(x @ w["encode"] + w["encode0"])
    v, u = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-h @ w["gate"]))
    e = (v * u) @ w["weigh"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
    a = e / np.repeat(np.add.reduceat(e, first), bags)
    z = np.add.reduceat(a[:, None] * h, first)
    return z @ w["judge"] + w["judge0"][0], (h, v, u, a, z)


def _gradient(w, x, bags, y):
    logit, (h, v, u, a, z) = _forward(w, x, bags)
    p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    d = (p - y) / len(y)
    g = {"judge": z.T @ d, "judge0": np.array([d.sum()])}
    dz = np.repeat(np.outer(d, w["judge"]), bags, axis=0)
    dh = a[:, None] * dz
    da = (dz * h).sum(1)
    first = np.cumsum(bags) - bags
    de = a * (da - np.repeat(np.add.reduceat(a * da, first), bags))
    g["weigh"] = (v * u).T @ de
    dv, du = np.outer(de, w["weigh"]) * u * (1 - v**2), np.outer(de, w["weigh"]) * v * u * (1 - u)
    g["attend"], g["gate"] = h.T @ dv, h.T @ du
    dh = (dh + dv @ w["attend"].T + du @ w["gate"].T) * (1 - h**2)
    g["encode"], g["encode0"] = x.T @ dh, dh.sum(0)
    return g


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, sizes: dict[int, int], epochs: int = EPOCHS) -> Network:
    """Adam on bags of both classes in equal shares; the score is then shifted to the classes' share among all labelled rows."""
    rng = np.random.default_rng(7)
    if not len(y):
        return Network(np.zeros(WIDTH), np.ones(WIDTH), _weights(rng), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = ((x - mean) / scale).astype(np.float64)
    w = _weights(rng)
    first, m, s, step = np.cumsum(bags) - bags, {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    if min(map(len, sides)):
        for epoch in range(epochs):
            half = BATCH // 2
            rounds = max(1, max(map(len, sides)) // half)
            for _ in range(rounds):
                pick = np.concatenate([rng.choice(i, half) for i in sides])
                rows = np.concatenate([np.arange(first[i], first[i] + bags[i]) for i in pick])
                noise = rng.normal(0, 0.05, (len(rows), WIDTH))
                g, step = _gradient(w, x[rows] + noise, bags[pick], y[pick]), step + 1
                rate = 0.004 * (1 - 0.9 * epoch / epochs)
                for k in w:
                    g[k] = g[k] + 1e-4 * w[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    shift = float(np.log((sizes[1] + 1) / (sizes[0] + 1)))
    return Network(mean, scale, w, shift)


def _weights(rng) -> dict[str, np.ndarray]:
    one = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"encode": one(WIDTH, HIDDEN), "encode0": np.zeros(HIDDEN), "attend": one(HIDDEN, GATE), "gate": one(HIDDEN, GATE), "weigh": one(GATE), "judge": one(HIDDEN), "judge0": np.zeros(1)}


def _bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, limit=PIECE):
        x, bags = encode(text_bytes(batch.column(2)))
        parts = [p.tobytes() for p in np.split(x, np.cumsum(bags)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.int64()), pa.array(parts, pa.binary())], ["id", "label", "n", "bag"])


def fitting(rows: list[tuple], most: int) -> list:
    """Of (id, n) in order, the ids that fit: one that would go beyond ``most`` in all is passed over."""
    out, total = [], 0
    for key, n in rows:
        if total + n <= most:
            out.append(key)
            total += n
    return out


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = PER_CLASS, passages: int = PASSAGES) -> Network:
    """Fit on labelled rows that aren't held out. Of several rows with one id the least text is taken."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "quality")
    chosen, sizes = sample_labels(labels, crc_mod(labels[id_col], 5) != 0, id_col, label_col, per_class)
    rows = labelled_texts(df, chosen.select("id", "label"), id_col, text_col, "label")
    saved = scratch.save(rows.mapInArrow(_bags_of, f"id {dict(rows.dtypes)['id']}, label int, n long, bag binary"), "bags")
    taken = []
    for k in (0, 1):
        order = saved.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").select("id", "n").collect()  # per_class rows at most
        taken += fitting([tuple(r) for r in order], passages)
    some = F.broadcast(spark.createDataFrame([(i,) for i in taken], saved.select("id").schema))
    got = saved.join(some, "id").select("label", "bag").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["bag"])))  # the order of arrival must not matter
    parts = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in got]
    scratch.drop(saved)
    x = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([len(p) for p in parts], np.int64), np.array([r["label"] for r in got], float), sizes)


def quality_score(text: Column, network: Network) -> Column:
    return text_scores(text, lambda texts: network.score(*encode(texts)), PIECE)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0 (a null doc_id counts as the empty text, and has no label).
    The score depends on the text alone; a null text is empty. With no label, or labels of one class only, scores only tell
    the classes' shares. Training takes whole documents in the order of a hash of their ids, per_class of each label at most and as many as
    have PASSAGES passages in all. An empty table gives an empty result; other columns are ignored; equal texts have equal scores."""
    network = train(df, labels, id_col, text_col, label_col, per_class)
    rows = df.select(df[id_col].alias("doc_id"), (crc_mod(df[id_col], 5) == 0).alias("held_out"), quality_score(df[text_col], network).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
