"""Language identification with hyperdimensional profiles.

Each letter (and the gap between words) has a random vector of +1 and -1 that follows from its code point alone. A trigram's vector
binds its letters, each permuted by its place; a text's vector bundles (sums) its trigrams. A language's
prototype bundles the texts labelled with it, and a text belongs to the prototype at the largest cosine.
What all prototypes have in common tells nothing about the language; their mean is taken off before cosines are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import bound_batches, crc_mod, fresh, text_batches

DIMENSIONS, ORDER, SEED = 1024, 3, 20_011
NO_LANGUAGE = "und"
#: Bytes of text that are bundled at once.
SLICE = 2 << 20
#: Direct tables are used for up to so many letter trigrams, sorting beyond.
TABLE = 1 << 22


_KNOWN: dict = {}


def _letter(code: int, dims: int) -> np.ndarray:
    if (code, dims) not in _KNOWN:
        _KNOWN[code, dims] = np.random.default_rng([SEED, code]).integers(0, 2, dims, np.int8) * 2 - 1
    return _KNOWN[code, dims]


def _bmp_letters() -> np.ndarray:
    if "bmp" not in _KNOWN:
        _KNOWN["bmp"] = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _KNOWN["bmp"]


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased letters, each run of other characters (and each text's border) as one 0, and the text of each."""
    texts = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = _bmp_letters()[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]).tolist():
        letter[codes == c] = chr(c).isalpha()
    owner = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), np.append(lengths + 1, 1))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # a gap stays at its first character
    return np.where(letter[keep], codes[keep], 0).astype(np.uint32), owner[keep]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (rows of three code points); for each trigram read, its number and its text."""
    codes, owner = letter_runs(texts)
    if len(codes) < ORDER:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    alphabet = np.flatnonzero(np.bincount(codes)).astype(np.uint32)  # at most 0x110000 code points
    place = np.zeros(int(alphabet[-1]) + 1, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    k, ids = len(alphabet), place[codes]
    middle = np.flatnonzero(codes[1:-1] != 0)  # a trigram with a gap in its middle spans two words
    of = owner[1:-1][middle]
    if k**3 <= TABLE:
        key = (ids[middle] * np.int32(k) + ids[middle + 1]) * np.int32(k) + ids[middle + 2]
        seen = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.zeros(k**3, np.int32)
        number[seen] = np.arange(len(seen))
        at = number[key]
    else:
        seen, at = np.unique((ids[middle].astype(np.int64) * k + ids[middle + 1]) * k + ids[middle + 2], return_inverse=True)
    return np.stack([alphabet[seen // (k * k)], alphabet[seen // k % k], alphabet[seen % k]], axis=1), at, of


def pieces(texts: list[str], limit: int = SLICE) -> tuple[list[str], np.ndarray]:
    """Texts cut into pieces of about ``limit`` characters between words, where no trigram is lost or made, and the text of each piece."""
    if all(len(t) <= limit for t in texts):
        return texts, np.arange(len(texts))
    out, owner = [], []
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            cut = at + limit
            while cut < len(text) and text[cut].isalpha():
                cut += 1
            out.append(text[at:cut])
            owner.append(k)
            at = max(cut, 1)
    return out, np.array(owner)


def bind(grams: np.ndarray, dims: int) -> np.ndarray:
    """One vector a trigram."""
    letters, at = np.unique(grams, return_inverse=True)
    table = np.stack([_letter(int(c), dims) for c in letters]) if len(letters) else np.zeros((0, dims), np.int8)
    at = at.reshape(grams.shape)
    out = np.ones((len(grams), dims), np.int8)
    for place in range(ORDER):
        out *= np.roll(table, ORDER - 1 - place, axis=1)[at[:, place]]
    return out.astype(np.float32)


def bundle(texts: list[str], dims: int, limit: int = SLICE) -> np.ndarray:
    """One vector a text: the sum of its trigrams' vectors."""
    parts, owner = pieces(texts, limit)
    if len(parts) > len(texts):
        out = np.zeros((len(texts), dims), np.float32)
        for part, k in zip(parts, owner.tolist(), strict=True):
            out[k] += bundle([part], dims, len(part))[0]
        return out
    grams, at, of = trigrams(texts)
    vectors = bind(grams, dims)
    out = np.zeros((len(texts), dims), np.float32)
    step = max(1, (1 << 21) // max(len(grams), 1))
    for a in range(0, len(texts), step):
        lo, hi = np.searchsorted(of, [a, a + step])
        n = min(step, len(texts) - a)
        counts = np.bincount((of[lo:hi] - a).astype(np.int64) * len(grams) + at[lo:hi], minlength=n * len(grams)).astype(np.float32)
        out[a : a + n] = counts.reshape(n, len(grams)) @ vectors
    return out


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _bundle_labels(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_batches(batches, limit=SLICE):
            texts, langs = _texts(batch.column(0)), batch.column(1).to_pylist()
            names, number = np.unique(np.array(langs, object), return_inverse=True)
            if len(texts) == 1 and len(texts[0]) > SLICE:  # a long text has a slice of its own
                x = bundle(texts, dims)[0].astype(np.float64)
                letters = sum(len(trigrams([p])[1]) for p in pieces(texts)[0])
                sums[names[0]] = sums.get(names[0], 0) + x / max(letters, 1)
                continue
            grams, at, of = trigrams(texts)
            if not len(grams):
                continue
            vectors, share = bind(grams, dims), 1 / np.maximum(np.bincount(of, minlength=len(texts)), 1)
            for i, lang in enumerate(names.tolist()):
                own = number[of] == i
                weights = np.bincount(at[own], share[of[own]], len(grams)).astype(np.float32)
                sums[lang] = sums.get(lang, 0) + (weights @ vectors).astype(np.float64)
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(range(dims), pa.int32()), pa.array(x, pa.float64())], ["lang", "dim", "x"])

    return run


def learn_prototypes(df: DataFrame, text_col: str = "text", label_col: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each label that isn't null, from all rows of df; each text weighs the same. One row per label and dimension comes to the driver."""
    bound_batches(df.sparkSession)
    rows = df.filter(df[label_col].isNotNull() & df[text_col].isNotNull()).select(df[text_col].alias("text"), df[label_col].cast("string").alias("lang"))
    sums = rows.mapInArrow(_bundle_labels(dims), "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["x"]
    return dict(sorted(out.items()))


def predict(text: Column, prototypes: dict[str, np.ndarray], dims: int = DIMENSIONS) -> Column:
    """struct<lang string, score double, cosine double>. score: the share of the best language in the softmax of ten times the cosines; cosine: the
    text's cosine with that language's whole prototype. Ties go to the first language in code point order. Texts without a letter (null too) have ``und`` and 0."""
    names = list(prototypes)
    if names:
        whole = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]).astype(np.float32)
        mean = whole.mean(0) if len(names) > 1 else np.zeros(dims, np.float32)
        own = whole - mean
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    else:
        whole = own = mean = np.zeros((0, dims), np.float32)

    @F.arrow_udf("struct<lang: string, score: double, cosine: double>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores, cosines = [], [], []
            for part in text_batches(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=SLICE):
                texts = _texts(part.column(0))
                x = bundle(texts, dims)
                size = np.linalg.norm(x, axis=1)
                unit = x / np.maximum(size, 1e-12)[:, None]
                if not names:
                    langs += [NO_LANGUAGE] * len(texts)
                    scores += [0.0] * len(texts)
                    cosines += [0.0] * len(texts)
                    continue
                off = unit - mean if len(names) > 1 else unit
                cos = (off @ own.T) / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(1)
                e = np.exp(10 * (cos - cos.max(1, keepdims=True)))
                none = size == 0
                langs += [NO_LANGUAGE if z else names[b] for z, b in zip(none.tolist(), best.tolist(), strict=True)]
                scores += np.where(none, 0.0, 1 / e.sum(1)).tolist()
                cosines += np.where(none, 0.0, (unit * whole[best]).sum(1)).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64())], ["lang", "score", "cosine"])

    return judge(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", dims: int = DIMENSIONS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, cosine.

    Prototypes are learned from rows whose crc32(doc_id as text) mod 3 is not 1 (a null doc_id counts as the empty text) and whose
    label isn't null. Predictions see the text only. Without any labelled row all texts are ``und``.
    An empty table gives an empty result; other columns are ignored; equal texts have equal results."""
    held = crc_mod(df[id_col], 3) == 1
    prototypes = learn_prototypes(df.filter(~held), text_col, label_col, dims)
    rows = df.select(df[id_col].alias("doc_id"), held.alias("held_out"), predict(df[text_col], prototypes, dims).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.cosine").alias("cosine"))


def keep_known_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least_cosine: float = 0.05, certain: int = 60, dims: int = DIMENSIONS) -> DataFrame:
    """The rows whose text has a language: not ``und``, and not so far from every prototype (cosine under least_cosine) that chance would give it. Texts of less than ``certain``
    letters are too short for that test and stay if they have a letter. All columns stay, under whatever names.

    Prototypes are learned as in identify. Null and empty texts go; rows repeated as a whole stay or go together. Without any labelled row nothing has a language. An empty table gives an empty result."""
    held = crc_mod(df[id_col], 3) == 1
    prototypes = learn_prototypes(df.filter(~held), text_col, label_col, dims)
    name = fresh(df, "language")
    letters = F.regexp_count(F.coalesce(df[text_col], F.lit("")), F.lit(r"\p{L}"))
    rows = df.withColumn(name, predict(df[text_col], prototypes, dims))
    told = rows[name]
    return rows.filter((told["lang"] != NO_LANGUAGE) & ((told["cosine"] >= least_cosine) | (letters < certain))).drop(name)
