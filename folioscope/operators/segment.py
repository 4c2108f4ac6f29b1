"""Words of text that isn't separated by blanks: a segmenter over weighted words, and the words themselves, found in the texts.

Segmenting: all words of the dictionary that a run of Han characters contains make up a graph; the path of the highest summed weight is found from the end of the run
(a character that no word covers is a word of its own, at less than the least weight). Runs of other letters and digits are one word each.

Finding words: a run of characters is a word where its parts occur together more often than by chance, however it is cut in two (cohesion), and where many different characters stand before
and after it (freedom). Both come from counts of short runs, summed by Spark over all texts."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators.work import bound_batches, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a dictionary that may be sent to every task.
MOST_WORDS = 1_000_000
_RUNS = re.compile(r"([一-鿿]+)|[^\W一-鿿]+")

# Words that say nothing about a topic.
STOPWORDS = (
    "的", "了", "和", "是", "在", "与", "及", "为", "对", "将", "于", "等", "及其", "以及", "有关", "进行", "通过", "根据", "关于", "其中", "一个", "一种", "我们", "你们",
    "他们", "本", "该", "此", "其", "各", "并", "或", "而", "文件", "内容", "数据", "信息", "图片", "名称", "下载", "正文", "标题", "附件", "记录", "资料",
    "url", "html", "http", "https", "www", "cn", "com", "stats", "ndsj", "jpg", "jpeg", "png", "pdf", "docx", "txt", "xlsx", "gov", "sj", "the", "of", "and", "to", "in", "for",
    "on", "with", "at", "from",
    "通知", "办法", "规定", "方案", "实施", "管理", "首页", "登录", "注册", "搜索", "导航", "菜单", "栏目", "专题", "互动", "服务", "公开", "知识", "网页", "网站", "版权", "版权所有", "联系", "联系方式",
    "地址", "电话", "邮箱", "传真", "邮编", "微信", "微博", "手机版", "扫一扫", "分享", "打印", "查看", "点击", "阅读", "更多", "详情",
    "返回", "上一页", "下一页", "来源", "作者", "记者", "通讯员", "发布者", "发布时间", "原文链接", "站内搜索", "信息公开", "友情链接", "网站地图",
)
# End of fixed values.


class Segmenter:
    """words: each with a positive count or weight; their logarithms are added along a path, as shares of the sum."""

    def __init__(self, words: Mapping[str, float]):
        total = math.log(sum(words.values()) or 1)
        self.weights = {w: math.log(n) - total for w, n in words.items() if w and n > 0}
        self.least = min(self.weights.values(), default=0.0) - 1
        # a trie in one table: each beginning of a word
        self.begins = {w[:k] for w in self.weights for k in range(1, len(w) + 1)}

    def han(self, run: str) -> list[str]:
        """The best path through a run. Of equal paths the one that begins with the longer word."""
        n = len(run)
        best = [0.0] * (n + 1)
        step = [0] * n
        for i in range(n - 1, -1, -1):
            score, to = self.weights.get(run[i], self.least) + best[i + 1], i + 1
            k = i + 1
            while k <= n and run[i:k] in self.begins:
                own = self.weights.get(run[i:k])
                if own is not None and own + best[k] >= score:
                    score, to = own + best[k], k
                k += 1
            best[i], step[i] = score, to
        out, i = [], 0
        while i < n:
            out.append(run[i : step[i]])
            i = step[i]
        return out

    def cut(self, text: str) -> list[str]:
        out: list[str] = []
        for found in _RUNS.finditer(text):
            out += self.han(found[0]) if found[1] else [found[0]]
        return out


def segmented(text: Column, words: Mapping[str, float]) -> Column:
    """All words of a text, in order: marks and white space separate, and are left out. A null text has none."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary of {len(words)} words; at most {MOST_WORDS} are sent to every task")
    words, made = dict(words), []

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Segmenter(words))
        return pa.array([made[0].cut(x or "") for x in column.to_pylist()], pa.list_(pa.string()))

    return run(text)


def han_tokens(words: Mapping[str, float], stopwords: Iterable[str] = STOPWORDS) -> Callable[[Column], Column]:
    """A function of a text column, for ``tokens`` of TF-IDF and the classifier: words of two characters or more, in lower case, with a Han or Latin letter, that aren't stop words."""
    stop = F.array(*map(F.lit, stopwords or ("",)))

    def tokens(text: Column) -> Column:
        found = segmented(F.lower(t.normalize(text)), words)
        return F.filter(found, lambda w: (F.length(w) >= 2) & w.rlike(r"[a-z]|" + t.HAN) & ~F.array_contains(stop, w))

    return tokens


#: Characters of text whose runs are counted at once.
AT_ONCE = 1 << 22


def _counted(most: int):
    """Rows of texts -> (gram, n) of some megabytes of text at a time. A gram is a number: its characters' places in the batch's alphabet, in which 0 is a line end."""

    def piece(texts: list[str]) -> Iterator[pa.RecordBatch]:
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        han = (points >= 0x4E00) & (points <= 0x9FFF)
        if not han.any():
            return
        near = han.copy()  # of what isn't a Han character, only line ends beside one matter
        near[1:] |= han[:-1]
        near[:-1] |= han[1:]
        # between two runs that one character parts, it is both the end of the first and the begin of the second
        points, han = np.where(han, points, 0)[near], han[near]
        alphabet = np.concatenate([np.array([0], np.uint32), np.unique(points[han])])
        at, size = np.searchsorted(alphabet, points).astype(np.int64), len(alphabet)
        base, based, high = alphabet[:, None], 1, size  # the characters of the numbers' first part, how many these are, and a bound of all numbers
        codes, inner = at, np.ones(len(at), bool)
        for k in range(1, most + 1):
            if k > 1:
                if len(codes) < 2:
                    return
                if high > (1 << 62) // size:  # numbered anew, so that the next character fits
                    own, codes = np.unique(codes, return_inverse=True)
                    base, based, high = letters(own, base, based, k - 1, alphabet), k - 1, len(own)
                codes, high = codes[:-1] * size + at[k - 1 :], high * size
                inner = inner[:-1] & han[k - 2 : -1] if k > 2 else inner[:-1]
            good = han if k == 1 else (han[:-1] | han[1:]) if k == 2 else inner
            some = codes[good]
            if high <= 4 * len(some):
                n = np.bincount(some, minlength=0)
                own = np.flatnonzero(n)
                n = n[own]
            else:
                own, n = np.unique(some, return_counts=True)
            if len(own):
                told = np.where((c := letters(own, base, based, k, alphabet)) == 0, ord("\n"), c).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(told).view(f"<U{k}").ravel().tolist(), pa.string()), pa.array(n.astype(np.int64))], ["gram", "n"])

    def letters(own: np.ndarray, base: np.ndarray, based: int, k: int, alphabet: np.ndarray) -> np.ndarray:
        out, left = np.empty((len(own), k), np.uint32), own.copy()
        for j in range(k - 1, based - 1, -1):
            left, last = np.divmod(left, len(alphabet))
            out[:, j] = alphabet[last]
        out[:, :based] = base[left]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kept.append(text or "")
                size += len(kept[-1])
                if size >= AT_ONCE:
                    yield from piece(kept)
                    kept, size = [], 0
        yield from piece(kept)

    return run


def grams(df: DataFrame, text: str, most: int) -> DataFrame:
    """(gram, n): how often each run of 1 to ``most`` Han characters occurs, summed where it is read before it is shuffled. The two ends of a run of Han characters count as a character
    of their own, a line end, in longer grams."""
    bound_batches(df.sparkSession)
    return df.select(F.col(text) if isinstance(text, str) else text).mapInArrow(_counted(most), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discover_words(df: DataFrame, text: str, longest: int = 4, least: int = 5, cohesion: float = 3.0, freedom: float = 0.5) -> DataFrame:
    """(word, n, cohesion, freedom) of runs of 2 to ``longest`` Han characters that occur ``least`` times or more. cohesion: ln of how many times as often as by chance its two parts meet, at the
    worst cut; freedom: the entropy of the characters before or after it, whichever is less. Texts without Han characters, null ones too, have no words."""
    counts = settled(grams(df, text, longest + 1))  # once: it is read six times below
    inner = counts.filter((F.length("gram") <= longest) & ~F.contains("gram", F.lit("\n")))
    total = inner.filter(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    words = inner.filter((F.length("gram") >= 2) & (F.col("n") >= least))
    cuts = words.select(F.col("gram").alias("word"), "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("head"), F.substring("word", F.col("k") + 1, F.lit(longest)).alias("tail"))
    part = lambda c: inner.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    bound = cuts.join(part("head"), "head").join(part("tail"), "tail").join(F.broadcast(total))  # one row
    bound = bound.groupBy("word", "n").agg(F.min(F.log(F.col("n").cast("double") * F.col("total") / (F.col("n_head") * F.col("n_tail")))).alias("cohesion"))
    bound = bound.filter(F.col("cohesion") >= cohesion)
    longer = counts.filter(F.length("gram") >= 3)
    # each gram is its own first character before the rest, and its own last one after it
    before = longer.select(F.expr("substring(gram, 2)").alias("word"), F.lit("before").alias("side"), "n").filter("NOT contains(word, '\n')")
    after = longer.select(F.expr("substring(gram, 1, length(gram) - 1)").alias("word"), F.lit("after").alias("side"), "n").filter("NOT contains(word, '\n')")
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    free = before.unionByName(after).groupBy("word", "side").agg(entropy.alias("h")).groupBy("word").agg(F.min("h").alias("freedom"), F.count(F.lit(1)).alias("sides"))
    out = bound.join(free, "word").filter((F.col("sides") == 2) & (F.col("freedom") >= freedom))
    return out.select("word", "n", "cohesion", "freedom")


def dictionary(words: DataFrame, word: str = "word", weight: str = "n") -> dict[str, float]:
    """The words and their weights, for the segmenter; their number is checked before they come to the driver."""
    n = words.count()
    if n > MOST_WORDS:
        raise ValueError(f"{n} words; a segmenter's dictionary has at most {MOST_WORDS}")
    return {r[0]: float(r[1]) for r in words.select(word, weight).collect()}
