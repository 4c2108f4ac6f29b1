"""Each operator against a plain Python version, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from folioscope.llm import decontam, exact_dedup, hmm_lm, html_extract, language_id, mixing, quality, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string, name string, `a.b` int"


def make_rows():
    rng = random.Random(4)
    words = ["the", "and", "Baum", "haus", "être", "niño", "tion", "river", "stone", "x1", "über", "café"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [None, "", "   ", "A", "a", "Ab cd", "aB CD", "123 456", passage, passage.upper(), say(3000), say(40) + " " + passage + "\n" + say(30), passage + " " + say(5), "Ä", "ä"]
    texts += [say(rng.randint(1, 120)) for _ in range(30)]
    texts += [texts[20], texts[20], texts[21] + " stone", say(40) + " " + passage]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None, ""]), 0, "r", "h", "n", 1) for i, t in enumerate(texts)]
    rows.append((None, "null id", "en", "s1", None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    rows += [rows[8], rows[8], rows[-1]]  # rows repeated as a whole
    rows.append((8, "same id, other text", "en", "s1", 0, "r", "h", "n", 1))
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return lower(text).encode().split()


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


@pytest.mark.parametrize(("block", "mask"), [(8192, -1), (7, 3)])
def test_exact(docs, none, block, mask):
    got = exact_dedup.exact_groups(docs, block_bytes=block, hash_mask=mask).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(lower(r[1]), []).append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(r[0], keep[t := lower(r[1])], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in ROWS]
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_filter(docs):
    got = exact_dedup.drop_exact_copies(docs).collect()
    assert Counter(lower(r.text) for r in got) == Counter({lower(r[1]): 1 for r in ROWS})
    assert got[0].asDict().keys() == docs.first().asDict().keys()


def test_language(docs, none):
    got = language_id.identify(docs).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in ROWS:
        by_text.setdefault(r[0], set()).add(r[1])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if len(by_text[r.doc_id]) == 1:
            text = next(iter(by_text[r.doc_id])) or ""
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
            assert r.lang_pred in ("en", "de", "und")
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.filter("lang is null")).collect()} == {"und"}


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [(r.lang_pred, lang[r.doc_id]) for r in language_id.identify(docs).collect() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert language_id.keep_known_languages(docs).count() >= 0.99 * len(lang)


def test_hyperdimensional_vectors():
    import numpy as np

    x = language_id.bundle(["aba", "aba aba", "", "xyz"], 2048)
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cos(x[0], x[1]) > 0.9 and abs(cos(x[0], x[3])) < 0.2 and not x[2].any()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "t") for i in range(40)] + [(3, 0, 0, "t"), (None, 1, 1, "t"), (4, None, None, "t")], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("operator", "modulus", "out"), [(quality, 5, 0), (toxicity, 4, 2)])
def test_classifiers_on_odd_rows(docs, none, labels, operator, modulus, out):
    got = operator.classify(docs, labels).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % modulus == out)
    empty = {r.score for r in operator.classify(docs.filter("text is null or text = ''"), labels).collect()}
    assert len(empty) == 1
    assert operator.classify(none, labels).count() == 0
    assert operator.classify(docs, labels.filter("false")).count() == len(ROWS)


@pytest.mark.parametrize(("operator", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifier_accuracy(spark, operator, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in operator.classify(docs, labels).filter("held_out").collect() if r.doc_id in truth]
    for side in (0, 1):
        own = [p == t for p, t in got if t == side]
        assert sum(own) / len(own) > least


def test_hmm_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    move, start, emit = rng.random((3, 3)), rng.random(3), rng.random((5, 3))
    model = hmm_lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    runs = [[0, 1, 2, 3], [4], [2, 2]]
    want = []
    for s in runs:
        total = 0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for k in range(1, len(s)):
                p *= model.move[path[k - 1], path[k]] * model.emit[s[k], path[k]]
            total += p
        want.append(math.log(total))
    lengths = np.array([len(s) for s in runs])
    scale, _ = hmm_lm.forward(np.concatenate(runs), hmm_lm.Runs(lengths), model, False)
    assert np.allclose([np.log(x).sum() for x in np.split(scale, np.cumsum(lengths)[:-1])], want)
    begin, moves, emissions, like = hmm_lm.expected(np.concatenate(runs), lengths, model)
    assert np.isclose(begin.sum(), 3) and np.isclose(moves.sum(), 4) and np.isclose(emissions.sum(), 7) and np.isclose(like, sum(want))


def test_hmm_base_counts_and_gain(docs, none):
    got = hmm_lm.score_texts(docs, frequent=5, classes=4, states=3, counted=8).collect()
    tokens = lambda t: [*words_of(t), b""]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = Counter(w for r in ROWS if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in ROWS:
        t = tokens(r[1])
        want[r[0], held(r[0]), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm_lm.score_texts(none).count() == 0
    assert hmm_lm.score_texts(docs.filter("doc_id is null")).count() > 0


def test_hmm_learns(spark, sf):
    got = hmm_lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet"), frequent=500, classes=200, states=6).collect()
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_hmm_is_proper():
    """Over all words of one token the probabilities sum to at most one: known words, and one unseen word a class."""
    import numpy as np

    words, counts = [b"a", b"bb", b"cc", b"dd", b""], np.array([5, 4, 3, 2, 6])
    frequent, classes = 2, 3
    mass = np.ones(frequent + classes)
    mass[:2] += counts[:2]
    for w, c in zip(words[2:], counts[2:], strict=True):
        mass[frequent + hmm_lm.class_of(w, classes)] += c + 1
    model = hmm_lm.first_model(words, counts, mass, frequent, classes, 2)
    assert np.allclose(model.emit.sum(0), 1)
    share = [model.emit[i].sum() / 2 for i in range(2)] + [model.emit[2 + hmm_lm.class_of(w, classes)].sum() / 2 * (c + 1) / mass[2 + hmm_lm.class_of(w, classes)] for w, c in zip(words[2:], counts[2:], strict=True)]
    share += [model.emit[2 + k].sum() / 2 / mass[2 + k] for k in range(classes)]
    assert np.isclose(sum(share), 1)


def fingerprint(text, n=3):
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def groups_of(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("bits", [3, 8])
def test_simhash(docs, none, bits):
    got = simhash.near_groups(docs, max_bits=bits).collect()
    prints = {fingerprint(r[1]) for r in ROWS}
    root = groups_of(prints, bits)
    least = {}
    for r in ROWS:
        k = root[fingerprint(r[1])]
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = [(r[0], fingerprint(r[1]), least[root[fingerprint(r[1])]]) for r in ROWS]
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], want)
    assert simhash.near_groups(none).count() == 0
    left = simhash.drop_near_copies(docs, max_bits=bits).collect()
    assert len(left) == len(set(root.values()))


def test_simhash_links_of_dense_prints(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    got = {frozenset((r.u % (1 << 64), r.v % (1 << 64))) for r in simhash.links(table, simhash.make_plan(table, 3), 3).collect()}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert got == want and len(want) > 300


def test_thresholds_follow_costs():
    cost, t = simhash.allocate([1e6, 10.0, 10.0], [[0.5] * 21] * 3, 100, 1)
    assert sum(t) == 1 and t[0] == -1 and cost > 0


def test_components(spark):
    from folioscope.llm.components import components
    from folioscope.llm.shared import Scratch

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (101, 101), (7, 8), (300, 200)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200, **{500 + k: 500 for k in range(60)}}


def test_html(spark):
    site = '<html><head><title>t</title><style>p{}</style></head><body><div>Our Site</div><nav><a href="/">Home</a></nav>%s<div>Copyright us</div><form>Name <input></form></body></html>'
    page = '<body><header>Head</header><nav>Menu</nav><article><h1>The&nbsp;title</h1><p>Some <b>bold</b>\n text &amp; more<br>next</p><div class="comments"><p>I agree</p></div><script>var a="</p>";</script></article><aside>Side</aside></body>'
    rows = [
        (1, "http://h.example/z/1", page), (2, "http://h.example/a/2", site % "<p>First own line</p><p>Common words</p>"), (3, "http://h.example/a/3?x=1", site % "<p>Second own line</p>"),
        (4, None, None), (5, "http://other.example/", ""), (6, "http://h.example/b", site % "<p>Third</p>"), (6, "http://h.example/b", site % "<p>Third</p>"), (None, "::bad", "plain   text"),
    ]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash"))).collect()
    found = [(r.page_id, r.text) for r in got]
    same(found, [(1, "The title Some bold text & more next"), (2, "First own line Common words"), (3, "Second own line"), (4, ""), (5, ""), (6, "Third"), (6, "Third"), (None, "plain text")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differences_article_pages(spark):
    page = "<body><div>Card of the shop</div><article><p>%s</p><p>Subscribe now</p><p>%s</p></article><div>Own card %d</div></body>"
    quote = "A passage that others quote too"
    rows = [(k, f"http://h.example/{k}", page % (f"Own line {k}", quote if k in (2, 3) else f"Other line {k}", k)) for k in range(8)] + [(50, "http://other.example/", f"<article><p>{quote}</p></article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"Own line {k} {quote if k in (2, 3) else f'Other line {k}'} Own card {k}" for k in range(8)}, 50: quote}


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:  # share out, cap, share out the rest
        rest = total - sum(3 * sizes[s] for s in capped)
        weight = sum(weights[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weights[s] > 3 * sizes[s] * weight}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / weight for s in names}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    by_hash = Counter()
    for r in ROWS:
        by_hash[r[3], r[0]] += len((r[1] or "").encode().split())
    for (s, _), n in by_hash.items():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    same(got, mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(none).count() == 0 and mixing.take_mix(none).count() == 0
    assert Counter(r.doc_id for r in mixing.take_mix(docs).collect()) == Counter(r.doc_id for r in got if r.copies)


BENCH = [(1, "the AND baum; haus"), (2, "river stone x1 über café the and baum haus être niño tion"), (3, None), (4, ""), (5, "123"), (5, "456 nothing"), (None, "null id"), (7, "zz yy xx")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def bench_words(text):
    out, word = [], ""
    for c in [*lower(text), " "]:
        if c.isascii() and not c.isdigit() and not ("a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_contamination(docs, none, bench, limit):
    rows = [*ROWS, *((900 + k, "x " + (t or "") + " the and", None, None, 0, "", "", "", 0) for k, (_, t) in enumerate(BENCH))]
    table = docs.sparkSession.createDataFrame(rows, SCHEMA).repartition(3)
    want = []
    for r in rows:
        w, hit, items = bench_words(r[1]), set(), set()
        for item, text in BENCH:
            b = bench_words(text)
            for k in range(max(1, len(b) - 9)) if b else ():
                p = b[k : k + 10]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        items.add(str(item if item is not None else ""))
        want.append((r[0], len(w), sorted(hit), sorted(items)))
    got = decontam.contamination(table, bench, block_bytes=limit).collect()
    same([(r.doc_id, r.n_words, [k for a, b in zip(r.starts, r.ends, strict=True) for k in range(a, b)], list(r["items"])) for r in got], want)
    assert decontam.contamination(none, bench).count() == 0
    assert not any(r["items"] for r in decontam.contamination(docs, bench.filter("false")).collect())
    assert decontam.drop_contaminated(table, bench, block_bytes=limit).count() == sum(not items for *_, items in want)


def test_near_terms(spark):
    from folioscope.llm.shared import Scratch

    docs = spark.createDataFrame([(1, "a b c d a"), (2, "c x x x x a"), (3, "a"), (4, "c b a")], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in decontam.search_near(decontam.build_index(docs, Scratch(spark, "t")), [("q", "a c")], 3).collect()}
    assert got == {(1, 0, 3), (1, 2, 5), (4, 0, 3)}


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix(docs, none, crowd):
    length = 40
    got = suffix_dedup.remove_repeats(docs, length=length, gram=12, crowd=crowd, with_text=True).collect()
    counts = Counter()
    for r in ROWS:
        t = (r[1] or "").encode()
        counts.update(t[k : k + length] for k in range(len(t) - length + 1))
    want = []
    for r in ROWS:
        t = (r[1] or "").encode()
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((r[0], len(t), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) for r in got], want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_array():
    import numpy as np

    from folioscope.llm.suffix_array import suffix_array

    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 30))]
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
