"""Methods against plain versions of themselves: whole-text Baum-Welch, gradients, hyperdimensional profiles, page differencing."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hmm_lm, html_extract, language_id, quality, toxicity


def plain_counts(texts, model):
    """Expected counts from unscaled recursions in logarithms, one text at a time."""
    k = len(model.start)
    with np.errstate(divide="ignore"):
        start, move, emit = np.log(model.start), np.log(model.move), np.log(model.emit)
    begun, moves, emissions, like = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    for s in texts:
        a = [start + emit[s[0]]]
        for x in s[1:]:
            a.append(np.logaddexp.reduce(a[-1][:, None] + move, axis=0) + emit[x])
        b = [np.zeros(k)]
        for x in s[:0:-1]:
            b.append(np.logaddexp.reduce(move + emit[x] + b[-1], axis=1))
        b.reverse()
        total = np.logaddexp.reduce(a[-1])
        like += total
        begun += np.exp(a[0] + b[0] - total)
        for t, x in enumerate(s):
            emissions[x] += np.exp(a[t] + b[t] - total)
            if t:
                moves += np.exp(a[t - 1][:, None] + move + emit[x] + b[t] - total)
    return begun, moves, emissions, like


def random_model(rng, states, symbols):
    move, start, emit = rng.random((states, states)), rng.random(states), rng.random((symbols, states))
    return hmm_lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 16])
def test_hmm_counts_of_whole_texts(block):
    rng = np.random.default_rng(5)
    model = random_model(rng, 3, 9)
    texts = [rng.integers(0, 9, n) for n in (700, 1, 333, 333, 2, 40)]
    got = hmm_lm.expected(np.concatenate(texts), np.array([len(t) for t in texts]), model, block)
    for x, y in zip(got, plain_counts(texts, model), strict=True):
        assert np.allclose(x, y, rtol=1e-9)
    scale, alpha = hmm_lm.forward(np.concatenate(texts), hmm_lm.Runs(np.array([len(t) for t in texts])), model, True, block)
    assert np.isclose(np.log(scale).sum(), got[3]) and np.allclose(alpha.sum(1), 1)


def test_hmm_trains_on_whole_texts():
    import pyarrow as pa

    texts = ["a b c " * 2000, "a", "b " * 5000, ""]
    words = [b"a", b"b", b"c", b""]
    rows = [r for b in hmm_lm._encode(words, 4, 4)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]
    lengths = [np.frombuffer(r["lengths"], np.int64).tolist() for r in rows]
    assert sorted(sum(lengths, [])) == [1, 2, 5001, 6001]
    assert all(len(r["symbols"]) == 2 * sum(n) for r, n in zip(rows, lengths, strict=True))


def test_hmm_training_is_baum_welch(spark):
    """One round over a small table equals a round of the plain recursions."""
    from folioscope.llm.shared import Scratch

    texts = ["the cat sat " * 120, "a dog ran", "the dog sat", "cat " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    _, words, _, mass, _, _, first, _ = hmm_lm.train(df, Scratch(spark, "t"), 10, 4, 3, 100, 0)
    _, _, _, _, _, _, after, told = hmm_lm.train(df, Scratch(spark, "t"), 10, 4, 3, 100, 1)
    place = {w: k for k, w in enumerate(words)}
    begun, moves, emissions, like = plain_counts([[place[w] for w in hmm_lm.tokens_of(t.encode())] for t in texts], first)
    emit = emissions + hmm_lm.PRIOR * (mass / mass.sum())[:, None]
    assert np.allclose(after.start, (begun + 1) / (begun + 1).sum(), rtol=1e-4) and np.isclose(told[0], like, rtol=1e-5)
    assert np.allclose(after.move, (moves + 1) / (moves + 1).sum(1, keepdims=True), rtol=1e-4) and np.allclose(after.emit, emit / emit.sum(0), rtol=1e-4)


def test_attention_gradient():
    rng = np.random.default_rng(3)
    w, bags, y = quality._weights(rng), np.array([3, 1, 5, 2]), np.array([1.0, 0.0, 1.0, 0.0])
    x = rng.normal(size=(bags.sum(), quality.WIDTH))

    def loss(w):
        logit, _ = quality._forward(w, x, bags)
        return (np.logaddexp(0, logit) - y * logit).mean()

    g = quality._gradient(w, x, bags, y)
    for name, value in w.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(5)]:
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                sides.append(loss(moved))
            assert np.isclose((sides[0] - sides[1]) / 2e-5, g[name][at], rtol=1e-4, atol=1e-8)


def test_attention_weighs_passages():
    """The score is the judge's value of the attention-weighted mean, computed here bag by bag."""
    rng = np.random.default_rng(8)
    w, bags = quality._weights(rng), np.array([4, 1, 6])
    x = rng.normal(size=(bags.sum(), quality.WIDTH))
    got, _ = quality._forward(w, x, bags)
    for bag, z in zip(np.split(x, np.cumsum(bags)[:-1]), got, strict=True):
        h = [np.tanh(p @ w["encode"] + w["encode0"]) for p in bag]
        e = np.exp([(np.tanh(v @ w["attend"]) / (1 + np.exp(-v @ w["gate"]))) @ w["weigh"] for v in h])
        assert np.isclose(z, sum(a * v for a, v in zip(e / e.sum(), h, strict=True)) @ w["judge"] + w["judge0"][0])


def test_long_texts_are_encoded_whole():
    rng = random.Random(6)
    long = " ".join(rng.choice(["Word", "a", "12", "x,", "\n", "ü"]) for _ in range(9000)).encode()
    texts = [long, b"", b"short text", b"  " + long[:999]]
    whole, bags = quality.encode(texts, limit=1 << 30)
    for limit in (300, 5000):
        parts, own = quality.encode(texts, limit=limit)
        assert np.array_equal(bags, own) and np.allclose(whole, parts, atol=1e-6)
    assert np.array_equal(quality.encode([long])[0], quality.encode([b"x", long, b"   y"])[0][1:-1])  # neighbours don't matter
    assert quality.fitting([("a", 5), ("b", 9), ("c", 4), ("d", 1)], 10) == ["a", "c", "d"]


def test_non_negative_risk():
    rng = np.random.default_rng(2)
    sets = lambda n: [np.flatnonzero(rng.random(6) < 0.4) for _ in range(n)]
    pos, unl, prior = toxicity.side(sets(20)), toxicity.side(sets(50)), 0.2
    w = rng.normal(size=6)
    value, g = toxicity.risk(w, -0.3, pos, unl, prior)
    a = lambda texts: np.array([w[texts[0][texts[1] == i]].sum() - 0.3 for i in range(texts[2])])
    soft = lambda z: np.log1p(np.exp(z)).mean()
    assert np.isclose(value, prior * soft(-a(pos)) + max(0.0, soft(a(unl)) - prior * soft(a(pos))))
    for k in range(7):
        sides = []
        for step in (1e-6, -1e-6):
            x = np.append(w, -0.3)
            x[k] += step
            sides.append(toxicity.risk(x[:-1], x[-1], pos, unl, prior)[0])
        assert np.isclose((sides[0] - sides[1]) / 2e-6, g[k], rtol=1e-4, atol=1e-8)
    w = np.full(6, 50.0)  # the negatives' part is below zero: the step goes back up it
    high, none = toxicity.side([np.arange(6)] * 4), toxicity.side([np.arange(0)] * 4)
    value, g = toxicity.risk(w, -40.0, high, none, 0.5)
    assert np.isclose(value, 0.5 * np.log1p(np.exp(-260.0))) and np.allclose(g[:-1], 0.5 * toxicity.risks(w, -40.0, high)[3][:-1])


def test_unlabelled_texts_come_from_all_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    roles, prior = toxicity.drawn(docs, labels, "doc_id", "toxic", 100, 1000)
    got = {r.id: r.role for r in roles.collect()}
    assert set(got) == set(range(400)) - held
    assert {i for i, r in got.items() if r & 1} == set(range(10)) - held
    assert np.isclose(prior, len(set(range(10)) - held) / len(set(range(40)) - held))
    few, _ = toxicity.drawn(docs, labels, "doc_id", "toxic", 3, 50)
    count = Counter(r.role for r in few.collect())
    assert count[1] + count[3] == 3 and count[2] + count[3] == 50


def plain_bundle(text, dims):
    letters = [c if c.isalpha() else None for c in f" {text.lower()} "]
    runs = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
    total = np.zeros(dims)
    for k in range(1, len(runs) - 1):
        if runs[k]:
            bound = np.ones(dims)
            for place, c in enumerate(runs[k - 1 : k + 2]):
                bound *= np.roll(language_id._letter(ord(c) if c else 0, dims), 2 - place)
            total += bound
    return total


def test_language_against_plain_profiles(spark):
    dims, rng = 256, random.Random(9)
    words = {"en": "the and of that with stone river".split(), "de": "der und das nicht über straße".split(), "fr": "les être dans où garçon que".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(random.Random(1).choices(list(words), k=60))]
    rows += [(100, None, "en"), (101, "12 ?", "de"), (102, "Ünd 1 dàs", None), (103, "x", "fr"), (104, "𝒳𝒴 ok", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), dims=dims).collect()}
    sums = {}
    for i, text, lang in rows:
        x = plain_bundle(text or "", dims)
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang and x.any():
            sums[lang] = sums.get(lang, 0) + x / sum(c.isalpha() for c in text.lower())  # each letter is the middle of one trigram
    names = sorted(sums)
    whole = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    own = whole - whole.mean(0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    for i, text, _ in rows:
        x = plain_bundle(text or "", dims)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        off = x / np.linalg.norm(x) - whole.mean(0)
        cos = own @ off / np.linalg.norm(off)
        e = np.exp(10 * (cos - cos.max()))
        assert np.isclose(got[i].score, 1 / e.sum(), atol=1e-4)
        assert got[i].lang_pred == names[int(cos.argmax())] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-4


def pages_of(rng, hosts=3):
    """Pages of several hosts, each line at most once a page and always in the same order, so that a longest common subsequence is unique."""
    rows, page = [], 0
    for h in range(hosts):
        frame = [f"h{h} frame {k}" for k in range(4)]
        for p in rng.sample(range(1000), 21):  # all in one block
            lines = [(x, "div") for x in frame if rng.random() < 0.7] + [(f"h{h} own {p} {k}", rng.choice(["div", "article"])) for k in range(rng.randint(0, 4))]
            lines += [(f"h{h} passage {k}", rng.choice(["div", "article", "nav"])) for k in range(6) if rng.random() < 0.2]
            rows.append((page, f"http://h{h}.example/{rng.choice(['a', 'ab', 'b/c'])}/{p}", lines))
            page += 1
    return rows


def plain_extract(rows, differ=True):
    parsed = [(*html_extract.host_and_path(url), lines, page) for page, url, lines in rows]
    out = {}
    for host, path, lines, page in parsed:
        own = [p for p in parsed if p[0] == host]
        frequent = {t for t in {x for p in own for x, _ in p[2]} if 2 * sum(any(t == x for x, _ in p[2]) for p in own) >= len(own)}
        quoted = {t for t in {x for p in own for x, _ in p[2]} if 2 * sum(any(t == x and tag == "article" for x, tag in p[2]) for p in own) < len(own)}
        order = sorted(own, key=lambda p: (p[1],))
        at = next(k for k, p in enumerate(order) if p[3] == page)
        shared = set()
        for _, _, k in sorted((-html_extract._prefix(p[1], path), abs(k - at), k) for k, p in enumerate(order) if k != at):
            theirs = {x for x, _ in order[k][2]}
            text = [x for x, tag in lines if tag != "nav" and x not in frequent]
            if sum(x in theirs for x in text) <= html_extract.COPY * len(text):
                shared = {x for x, _ in lines if x in theirs}
                break
        gone = {x for x, tag in lines if x in shared and not (tag == "article" and x in quoted)} if differ else set()
        out[page] = " ".join(x for x, tag in lines if x not in gone and tag != "nav")
    return out


def test_pages_against_plain_differencing(spark):
    rows = pages_of(random.Random(12))
    html = [(page, url, "".join(f"<{tag}>{x}</{tag}>" for x, tag in lines)) for page, url, lines in rows]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(html, "page_id long, url string, html string").repartition(4)).collect()}
    want = plain_extract(rows)
    assert {k: r.text for k, r in got.items()} == want
    without = plain_extract(rows, differ=False)  # mark-up alone gives other texts on most pages
    assert sum(want[k] != without[k] for k in want) > len(want) / 2
    assert sum(r.n_shared for r in got.values()) > 2 * sum(r.n_marked for r in got.values())


def test_copies_are_passed_over(spark):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(40))
    page = menu + "<div>First own of %s</div><div>Second own of %s</div>"
    rows = [(k, f"http://h.example/{k:02}", page % (("one", "one") if k < 80 else (k, k))) for k in range(85)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"First own of {x} Second own of {x}" for k in range(85) for x in ["one" if k < 80 else k]}


def test_broken_and_long_pages_take_linear_time():
    began = time.time()
    for bad in ('<a "' * 100_000, "<" * 300_000, "<p x='" * 100_000, "<script>" * 100_000, "<!--" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, '<a href="x>' * 100_000, "</a><b>" * 100_000):
        html_extract.page_lines(bad)
    assert time.time() - began < 20
    assert html_extract.page_lines('<p title="a > b">one</p><p x="open>two') == [("one", 0), ("two", 0)]
    lines = html_extract.page_lines("".join(f"<p>line {k}</p>" for k in range(50_000)))
    assert len(lines) == 50_000 and lines[-1] == ("line 49999", 0)


def test_halved_common_lines():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in "ab")
        whole, parts = html_extract.common_lines(a, b), html_extract.common_lines(a, b, 30)
        rest = iter(b)
        assert len(whole) == len(parts) and parts == sorted(set(parts)) and all(any(x == y for y in rest) for x in (a[i] for i in parts))


def test_extra_columns_and_clashes(spark):
    rows = spark.createDataFrame([(1, "http://h/1", "<p>a</p>"), (1, "http://h/1", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string")
    clash = rows.select("*", *(F.lit("x").alias(c) for c in ("host", "path", "whole", "shared", "lines", "kinds", "h", "w", "text")))
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(clash).collect()) == [(0, ""), (1, "a"), (1, "a")]


def test_long_texts_in_language_pieces():
    rng = random.Random(11)
    long = "".join(rng.choice(["wort ", "être, ", "niño", "x1 ", "über\n", "ABC"]) for _ in range(3000))
    texts = [long, "", "short text", "abc" * 500]
    whole = language_id.bundle(texts, 64)
    for limit in (1, 50, 999):
        parts, owner = language_id.pieces(texts, limit)
        assert ["".join(p for p, k in zip(parts, owner, strict=True) if k == i) for i in range(4)] == texts
        assert np.allclose(language_id.bundle(texts, 64, limit), whole, atol=1e-3)


def test_suffix_stretches_and_crowds(spark):
    """Long texts in stretches give all strings; crowds of contexts are split, down to whole strings, and lose nothing."""
    from folioscope.llm import suffix_dedup

    rng = random.Random(21)
    text = bytes(rng.choice(b"abcd ") for _ in range(5000))
    for stretch in (10_000, 700, 64):
        doc, begin, end, h, _ = suffix_dedup.contexts_of([text, b"", text[:30]], 40, 12, stretch)
        starts = [s for b, e in zip(begin.tolist(), end.tolist(), strict=True) for s in range(b, e - 39)]
        assert sorted(starts) == list(range(len(text) - 39)) and not doc.any()
    part = bytes(rng.choice(b"abcdefgh") for _ in range(70))
    for at, width in ((20, 12), (0, 12), (28, 12), (10, 39), (15, 40)):
        strings = [s for s in range(len(part) - 39) if s <= at and s + 40 >= at + width]
        whole = part[strings[0] : strings[-1] + 40]
        own = at - strings[0]
        found = [(b + s, whole[b + s : b + s + 40]) for b, e, a, w in suffix_dedup.halves(whole, own, width, 40) for s in range(e - b - 39) if s <= a and s + 40 >= a + w]
        assert sorted(found) == [(s, whole[s : s + 40]) for s in range(len(whole) - 39)]


def test_suffix_crowd_of_ten_thousand(spark):
    """Ten thousand different texts around one passage: the passage goes from all of them, in parts where texts agree beyond it."""
    from folioscope.llm import suffix_dedup

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = word(60)
    rows = [(i, f"{word(50)} {i % 7} {passage} {i % 11} {word(50)}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, length=40, gram=12, crowd=1000).collect()}
    counts = Counter()
    for _, t in rows:
        b = t.encode()
        counts.update({b[k : k + 40] for k in range(len(b) - 39)})
    for i, t in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - 39):
            if counts[b[k : k + 40]] > 1:
                gone |= set(range(k, k + 40))
        assert got[i] == (len(gone), sum(k - 1 not in gone for k in gone))


def test_suffix_copies_are_compared_by_bytes(spark):
    """Stretches that hashes call equal are compared, and where they differ it is told."""
    import pyarrow as pa

    from folioscope.llm import suffix_dedup

    kinds = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.binary())]))
    batch = lambda bytes_: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b"some text here"]), pa.array([[(5 << 32) + 9]]), pa.array([[{"at": 5, "bytes": bytes_}]], kinds)], ["doc_id", "text_key", "text", "spans", "checks"])
    out = next(suffix_dedup._remove(iter([batch(b"text")])))
    assert out.column(5).to_pylist() == ["some  here"] and out.column(2).to_pylist() == [4]
    assert out.column(6).to_pylist() == [True] and next(suffix_dedup._remove(iter([batch(b"tent")]))).column(6).to_pylist() == [False]
    first = (5, 10 << 32 | 50)
    places = [(1, 1, 5, 10 << 32 | 50), (1, 1, 9, 20 << 32 | 60), (2, 1, 9, 40 << 32 | 80), (3, 1, 9, 300 << 32 | 340)]
    copies = spark.createDataFrame([(*p, first) for p in places], "h long, g long, rid long, span long, first struct<rid:long,span:long>")
    told = {(r.rid, r.trid, r.delta, r.b, r.e) for r in suffix_dedup._stretches(copies).collect()}
    assert (9, 5, 10, 20, 60) in told and all(b < e for *_, b, e in told)


def test_suffix_equal_hashes_of_different_stretches(spark, monkeypatch):
    """Hashes that tell nothing apart, for the first seed: the result is that of honest ones."""
    import random

    from folioscope.llm import suffix_dedup

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(30))
    rows = [(k, f"{' '.join(word() for _ in range(20))} {passage[: 60 + 20 * (k % 5)]} {' '.join(word() for _ in range(20))}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    run = lambda: sorted(map(tuple, suffix_dedup.remove_repeats(docs, length=40, gram=12).collect()))
    want, honest, seeds = run(), suffix_dedup.contexts, []

    def blind(raw, ends, length, gram, seed=0):
        *places, g, anchor = honest(raw, ends, length, gram, seed)
        return *places, g * np.uint64(seed > 0), anchor

    contexts = suffix_dedup._contexts_of
    monkeypatch.setattr(suffix_dedup, "contexts", blind)
    monkeypatch.setattr(suffix_dedup, "_contexts_of", lambda length, gram, seed: (seeds.append(seed), contexts(length, gram, seed))[1])
    assert run() == want and seeds == [0, 1] and sum(r[2] for r in want) > 0
