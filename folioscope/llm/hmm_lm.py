"""Language-model scoring with a hidden Markov model.

Tokens are lower-cased words and one end token for each text. The most frequent words are symbols of their own; every other
word (and any unseen one) belongs to a class given by its first and last letters. A state emits
a symbol; within a class, a word has the share of its smoothed corpus count. So the
probability of a text is exact and proper over the learned words and one unseen word a class.

Baum-Welch: each task runs forward-backward over its texts and returns expected counts; Spark sums them, the driver
normalises. Every round goes over all training texts, each of them whole: the recursions go over many texts at once, step by step,
and a block of steps at a time; forward variables are kept where a block begins and computed again on the way back, so memory
follows the block and not the text. Scores are scaled forward recursions in double precision.
Counts of words beyond the dictionary that tasks hold are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, crc_mod, text_batches, text_bytes

#: Words with an emission of their own, classes of all others, hidden states, words whose counts tasks hold, Baum-Welch rounds.
FREQUENT, CLASSES, STATES, COUNTED, ROUNDS = 8192, 4096, 12, 131_072, 3
#: Tokens of a block of steps. Training texts of more than LONG tokens are gathered and go side by side, up to GATHERED tokens of them.
BLOCK, LONG, GATHERED = 1 << 16, 2048, 1 << 22
#: Pseudo-counts a state gets, spread as the corpus is.
PRIOR = 200.0
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def class_of(word: bytes, classes: int) -> int:
    return crc32(word[:2] + b"|" + word[-2:]) % classes


class Dictionary(dict):
    """Place of each counted word (the most frequent first), and the symbol of any word."""

    def __init__(self, words: list[bytes], frequent: int, classes: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.frequent, self.classes = frequent, classes
        self.symbol_at = np.array([*range(frequent), *(frequent + class_of(w, classes) for w in words[frequent:])], np.int32)

    def places(self, tokens: list[list[bytes]], total: int) -> np.ndarray:
        """-1 for words that aren't counted."""
        return np.fromiter((self.get(w, -1) for d in tokens for w in d), np.int32, total)

    def symbols(self, places: np.ndarray, others: list[bytes]) -> np.ndarray:
        """others: the words at places of -1, in order."""
        out = np.empty(len(places), np.int32)
        known = places >= 0
        out[known] = self.symbol_at[places[known]]
        out[~known] = [self.frequent + class_of(w, self.classes) for w in others]
        return out


def words_at(tokens: list[list[bytes]], first: np.ndarray, where: np.ndarray) -> list[bytes]:
    """The tokens at places counted through all texts."""
    doc = np.searchsorted(first, where, side="right") - 1
    return [tokens[d][j] for d, j in zip(doc.tolist(), (where - first[doc]).tolist(), strict=True)]


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


class Runs:
    """Token runs side by side, longest first: step t of all runs at once. In order of steps, tokens of step t begin at offsets[t]."""

    def __init__(self, lengths: np.ndarray):
        first = np.cumsum(lengths) - lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.first, self.lengths = first[self.order], lengths[self.order]
        self.active = np.searchsorted(-self.lengths, -np.arange(int(lengths.max(initial=0))), side="left")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])

    def blocks(self, tokens: int) -> list[tuple[int, int]]:
        """Ranges of steps with about so many tokens each, one step at least."""
        cuts = [0, *(np.flatnonzero(np.diff(self.offsets[:-1] // tokens)) + 1).tolist(), len(self.active)]
        return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def places(self, a: int, b: int) -> np.ndarray:
        """Where the tokens of steps a to b stand in the texts, in order of steps."""
        n = self.active[a:b]
        step = np.repeat(np.arange(a, b), n)
        return self.first[np.arange(len(step)) - np.repeat(self.offsets[a:b] - self.offsets[a], n)] + step


def _advance(emitted: np.ndarray, runs: Runs, a: int, b: int, model: Model, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Forward variables of steps a to b, and their scales. emitted: the tokens' emissions; alpha: of the step before."""
    alphas, scale, ones = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype), np.ones(emitted.shape[1], emitted.dtype)
    starts, sizes = (runs.offsets[a:b] - runs.offsets[a]).tolist(), runs.active[a:b].tolist()
    for o, n in zip(starts, sizes, strict=True):
        x = alphas[o : o + n]
        if alpha is None:
            x[:] = model.start
        else:
            np.matmul(alpha[:n], model.move, out=x)
        x *= emitted[o : o + n]
        s = np.matmul(x, ones, out=scale[o : o + n])
        x /= s[:, None]
        alpha = x
    return alphas, scale


def forward(symbols: np.ndarray, runs: Runs, model: Model, keep: bool, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray | None]:
    """Scale of each token (its probability given those before), and the scaled forward variables if asked for."""
    kind = model.emit.dtype
    scale, kept = np.ones(len(symbols), kind), np.empty((len(symbols), len(model.start)), kind) if keep else None
    alpha = None
    for a, b in runs.blocks(block):
        at = runs.places(a, b)
        alphas, scale[at] = _advance(model.emit[symbols[at]], runs, a, b, model, alpha)
        alpha = alphas[len(alphas) - runs.active[b - 1] :].copy()
        if keep:
            kept[at] = alphas
    return scale, kept


def expected(symbols: np.ndarray, lengths: np.ndarray, model: Model, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log likelihood, over whole runs."""
    runs, states = Runs(lengths), len(model.start)
    blocks, enters, alpha, like = runs.blocks(block), [], None, 0.0
    for a, b in blocks:
        enters.append(alpha)
        at = runs.places(a, b)
        emitted = model.emit[symbols[at]]
        alphas, scale = _advance(emitted, runs, a, b, model, alpha)
        alpha = alphas[len(alphas) - runs.active[b - 1] :].copy()
        like += float(np.log(scale.astype(np.float64)).sum())
    begun, moves, emissions, onward, back_move = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), None, model.move.T.copy()
    for (a, b), enter in zip(blocks[::-1], enters[::-1], strict=True):
        if b < len(runs.active):  # the last block's variables are still there
            at = runs.places(a, b)
            emitted = model.emit[symbols[at]]
            alphas, scale = _advance(emitted, runs, a, b, model, enter)
        emitted /= scale[:, None]
        betas = np.ones_like(alphas)
        starts, sizes = (runs.offsets[a:b] - runs.offsets[a]).tolist(), runs.active[a:b].tolist()
        for o, n in zip(starts[::-1], sizes[::-1], strict=True):
            if onward is not None:
                np.matmul(onward, back_move, out=betas[o : o + len(onward)])
            onward = emitted[o : o + n] * betas[o : o + n]
        emitted *= betas  # emission times beta over scale
        n0 = sizes[0]
        if enter is not None:
            moves += enter[:n0].T @ emitted[:n0]
        before = np.arange(n0, len(alphas)) - np.repeat(sizes[:-1], sizes[1:])  # the same run, a step earlier
        for lo in range(0, len(before), 1 << 17):
            moves += alphas[before[lo : lo + (1 << 17)]].T @ emitted[n0 + lo : n0 + lo + (1 << 17)]
        alphas *= betas
        if enter is None:
            begun = alphas[:n0].sum(0)
        ids = symbols[at]
        for k in range(states):
            emissions[:, k] += np.bincount(ids, alphas[:, k], len(emissions))
    return begun, model.move * moves, emissions, like


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    for batch in text_batches(batches):
        for text in text_bytes(batch.column(0)):
            found.update(tokens_of(text))
        if len(found) > 500_000:
            yield told()
            found.clear()
    yield told()


def _class_sums(frequent: list[bytes], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = set(frequent), np.zeros((classes, 2), np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in own:
                    sums[class_of(word, classes)] += n, 1
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(sums[:, 0], pa.int64()), pa.array(sums[:, 1], pa.int64())], ["c", "n", "words"])

    return run


def first_model(words: list[bytes], counts: np.ndarray, mass: np.ndarray, frequent: int, classes: int, states: int) -> Model:
    """States begin as clusters of symbols by the letters of their words (k-means on byte frequencies, driver-side: bounded by the dictionary)."""
    rng, n = np.random.default_rng(42), len(mass)
    letters, weight = np.zeros((n, 256)), np.zeros(n)
    for i, w in enumerate(words):
        s = i if i < frequent else frequent + class_of(w, classes)
        np.add.at(letters[s], np.frombuffer(w, np.uint8), counts[i])
        weight[s] += counts[i]
    letters = np.sqrt(letters / np.maximum(letters.sum(1, keepdims=True), 1))
    center = letters[rng.choice(n, states, p=mass / mass.sum(), replace=False)] if np.count_nonzero(mass) >= states else rng.random((states, 256))
    near = np.zeros(n, int)
    for _ in range(20):
        near = (letters @ center.T * 2 - (center**2).sum(1)).argmax(1)
        for k in range(states):
            if (w := weight * (near == k)).sum() > 0:
                center[k] = w @ letters / w.sum()
    tilt = np.where(near[:, None] == np.arange(states), 4.0, 0.4) * np.exp(rng.normal(0, 0.1, (n, states)))
    emit = mass[:, None] * tilt
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _encode(words: list[bytes], frequent: int, classes: int):
    """Symbols of all texts, a row for each slice; long texts of several slices share rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(words, frequent, classes)
        kind = np.uint16 if frequent + classes <= 1 << 16 else np.int32
        row = lambda symbols, lengths: pa.RecordBatch.from_arrays([pa.array([symbols.astype(kind).tobytes()], pa.binary()), pa.array([np.asarray(lengths, np.int64).tobytes()], pa.binary())], ["symbols", "lengths"])
        gathered: list[np.ndarray] = []
        for batch in text_batches(batches, limit=3 << 20):
            docs = [tokens_of(x) for x in text_bytes(batch.column(0))]
            sizes = np.array([len(d) for d in docs], np.int64)
            places = known.places(docs, int(sizes.sum()))
            symbols = known.symbols(places, words_at(docs, np.cumsum(sizes) - sizes, np.flatnonzero(places < 0))).astype(kind)
            of_long = np.repeat(sizes > LONG, sizes)
            if not of_long.all():
                yield row(symbols[~of_long], sizes[sizes <= LONG])
            for text in np.split(symbols[of_long], np.cumsum(sizes[sizes > LONG])[:-1]) if of_long.any() else ():
                gathered.append(text)
                if sum(map(len, gathered)) > GATHERED:
                    yield row(np.concatenate(gathered), [len(x) for x in gathered])
                    gathered = []
        if gathered:
            yield row(np.concatenate(gathered), [len(x) for x in gathered])

    return run


def _round(model: Model):
    small = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, states = small.emit.shape
        total = np.zeros((n + states + 2, states))
        for batch in batches:
            for symbols, lengths in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(symbols.as_buffer(), np.uint16 if n <= 1 << 16 else np.int32)
                start, moves, emissions, like = expected(ids, np.frombuffer(lengths.as_buffer(), np.int64), small)
                total[:n] += emissions
                total[n:-2] += moves
                total[-2] += start
                total[-1, 0] += like
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k].astype(np.float32), pa.float32()) for k in range(states))], ["row", *(f"c{k}" for k in range(states))])

    return run


def train(df: DataFrame, scratch: Scratch, frequent: int, classes: int, states: int, counted: int, rounds: int) -> tuple[DataFrame, list[bytes], np.ndarray, np.ndarray, int, int, Model, list[float]]:
    """df: the training texts in column text. The counts of words beyond the dictionary (table), the dictionary and its counts, mass by symbol, N, V, the model and its log likelihoods."""
    counts = df.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    # the dictionary: words of the highest count buckets, as many as fit; so its size is bounded and no partition sends its own best ones
    bucket = F.floor(F.log2(F.col("n")) * 32).cast("int")
    left, cut = counted, 1 << 20
    for r in counts.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["b"]
    top = sorted((-r["n"], bytes(r["word"])) for r in counts.filter(bucket >= cut).collect())
    words, of = [w for _, w in top], np.array([-k for k, _ in top], np.int64)
    frequent = min(frequent, len(words))
    mass = np.ones(frequent + classes)
    mass[:frequent] += of[:frequent]
    for r in counts.mapInArrow(_class_sums(words[:frequent], classes), "c int, n long, words long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        mass[frequent + r["c"]] += r["n"] + r["words"]
    model, told = first_model(words, of, mass, frequent, classes, states), []
    encoded = scratch.save(df.select("text").mapInArrow(_encode(words, frequent, classes), "symbols binary, lengths binary"), "encoded")
    prior = PRIOR * mass / mass.sum()
    for _ in range(rounds if n else 0):
        sums = encoded.mapInArrow(_round(model), "row int, " + ", ".join(f"c{k} float" for k in range(states)))
        got = sums.groupBy("row").agg(*(F.sum(F.col(f"c{k}").cast("double")).alias(f"c{k}") for k in range(states))).collect()
        total = np.zeros((frequent + classes + states + 2, states))
        for r in got:
            total[r["row"]] = r[1:]
        emit = total[: frequent + classes] + prior[:, None]
        move = total[frequent + classes : -2] + 1.0
        start = total[-2] + 1.0
        told.append(float(total[-1, 0]))
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    scratch.drop(encoded)
    return counts.filter(bucket < cut), words, of, mass, n, v, model, told


def _score(words: list[bytes], counts: np.ndarray, mass: np.ndarray, classes: int, n: int, v: int, model: Model):
    frequent = len(mass) - classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = Dictionary(words, frequent, classes)
        log_count = np.append(np.log10(counts + 1.0), 0.0)
        log_mass = np.log10(mass)
        log_mass[:frequent] = 0
        in_class = np.append(np.arange(len(words)) >= frequent, False)
        rid = TaskContext.get().partitionId() << 33
        for batch in text_batches(batches):
            docs = [tokens_of(x) for x in text_bytes(batch.column(2))]
            lengths = np.array([len(d) for d in docs], np.int64)
            total = int(lengths.sum())
            first = np.cumsum(lengths) - lengths
            at = known.places(docs, total)
            rare = np.flatnonzero(at < 0)
            flat = words_at(docs, first, rare)
            ids = known.symbols(at, flat)
            scale, _ = forward(ids, Runs(lengths), model, False)
            by_doc = lambda x: np.add.reduceat(x, first)
            base = by_doc(log_count[at]) - lengths * np.log10(n + v + 1.0)
            score = by_doc(np.log10(scale) + np.where(in_class[at], log_count[at], 0.0) - log_mass[ids])
            ends = np.searchsorted(rare, first + lengths)
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + len(docs)), pa.int64()), batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(by_doc((at >= 0).astype(np.int64)), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), left],
                ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )
            rid += len(docs)

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES, states: int = STATES, counted: int = COUNTED, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out of training (a null doc_id counts as the empty text).
    base_score: log10 of the smoothed unigram model; score: log10 of the hidden Markov model. A null text is empty: its
    one token is the end. Without any training row all words are unseen. An empty table gives an empty result;
    other columns are ignored. Equal texts have equal scores up to the rounding of sums."""
    scratch = Scratch(df.sparkSession, "hmm")
    text = F.coalesce(df[text_col], F.lit("")).alias("text")
    held = crc_mod(df[id_col], 7) == 2
    counts, words, of, mass, n, v, model, _ = train(df.filter(~held).select(text), scratch, frequent, classes, states, counted, rounds)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), held.alias("held_out"), text)
    rows = rows.mapInArrow(_score(words, of, mass, classes, n, v, model), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>")
    rows = scratch.save(rows, "rows")
    found = rows.select("rid", F.explode("rare").alias("word")).join(counts, "word")
    found = found.groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("log"))
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return rows.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
