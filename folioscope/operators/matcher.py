"""All words of many rules in one pass over a text.

The rules' words go into one Aho-Corasick automaton, which each task makes once from the list that it is sent. A text is read through once, however many words
there are, and gives the set of words it contains; what a rule needs of it (how many of its words are in title, body and prior, and which) comes back as one array, in the order of the rules.
The rest of the scorer stays an expression (rules.py), so both ways of finding words give the same scores."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.work import bound_batches

if TYPE_CHECKING:
    from folioscope.operators.rules import Rule

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FOUND = "array<struct<a:int,b:int,c:int,told:array<string>,specific:boolean>>"


class Words:
    """An automaton over words in lower case; several words may be the same in lower case."""

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self.numbers: dict[str, int] = {}
        for w in words:
            if w:
                self.numbers.setdefault(w.lower(), len(self.numbers))
        self.automaton = ahocorasick.Automaton()
        for w, k in self.numbers.items():
            self.automaton.add_word(w, k)
        if self.numbers:
            self.automaton.make_automaton()

    def within(self, text: str | None) -> set[int]:
        """Numbers of the words that the text, in lower case, contains; overlapping ones and words within words too."""
        return {k for _, k in self.automaton.iter(text)} if text and self.numbers else set()


def words_of(rule: Rule) -> tuple[list[str], list[str], list[str]]:
    """The distinct words that a rule looks for in title, body and prior."""
    prior = rule.prior_words if rule.prior_words is not None else (*rule.title_words, *rule.body_words)
    return tuple([w for w in dict.fromkeys(part) if w] for part in (rule.title_words, rule.body_words, prior))


class RuleWords:
    """What texts have of each rule's words. rules: of each its words (words_of), how many of them are evidence, and its generic words."""

    def __init__(self, rules: Sequence[tuple[tuple[list[str], list[str], list[str]], tuple[int, int, int], tuple[str, ...]]]):
        self.parts, self.limits = [words for words, _, _ in rules], [limits for _, limits, _ in rules]
        self.generic = [frozenset(generic) for _, _, generic in rules]
        self.words = Words(w for parts in self.parts for part in parts for w in part)
        # for title, body and prior: in which rules a word is, and where in their lists
        self.uses: list[dict[int, list[tuple[int, int]]]] = [{}, {}, {}]
        for rule, parts in enumerate(self.parts):
            for k, part in enumerate(parts):
                for at, w in enumerate(part):
                    self.uses[k].setdefault(self.words.numbers[w.lower()], []).append((rule, at))

    def found(self, texts: Sequence[str | None]) -> dict[int, tuple[list[str], list[str], list[str]]]:
        """By rule, for those with any: its words in title, body and prior, in the rule's order."""
        places: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for k, text in enumerate(texts):
            for word in self.words.within(text):
                for rule, at in self.uses[k].get(word, ()):
                    places.setdefault(rule, ([], [], []))[k].append(at)
        return {rule: tuple([own[at] for at in sorted(ats)] for own, ats in zip(self.parts[rule], parts, strict=True)) for rule, parts in places.items()}


def match_rules(rules: Sequence[Rule], title: Column, body: Column, prior: Column) -> Column:
    """For each rule, in order: a, b, c, how many of its distinct words are in title, body and prior (whatever their case); told, the first of them as the rule's evidence has it; specific,
    whether one in title or body is none of its generic ones. A null text contains nothing."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        bound_batches(spark)
    told_of = [(words_of(r), tuple(r.evidence), tuple(r.generic)) for r in rules]
    made: list[RuleWords] = []  # in a task: made by its first batch

    @F.arrow_udf(_FOUND)
    def run(title: pa.Array, body: pa.Array, prior: pa.Array) -> pa.Array:
        if not made:
            made.append(RuleWords(told_of))
        own, n = made[0], len(told_of)
        counts = np.zeros((3, len(title), n), np.int32)
        specific = np.zeros((len(title), n), bool)
        sizes = np.zeros(len(title) * n, np.int32)
        told: list[str] = []
        for row, texts in enumerate(zip(title.to_pylist(), body.to_pylist(), prior.to_pylist(), strict=True)):
            for rule, parts in sorted(own.found(texts).items()):
                counts[:, row, rule] = [len(p) for p in parts]
                words = list(dict.fromkeys(w for p, most in zip(parts, own.limits[rule], strict=True) for w in p[:most]))
                sizes[row * n + rule] = len(words)
                told += words
                specific[row, rule] = any(w not in own.generic[rule] for p in parts[:2] for w in p)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(told, pa.string()))
        each = pa.StructArray.from_arrays([*(pa.array(c.ravel()) for c in counts), lists, pa.array(specific.ravel())], ["a", "b", "c", "told", "specific"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(title) + 1) * n, pa.int32()), each)

    # called non-deterministic so that it stays a step of its own: merged into what is built on it, it would stand within a lambda, where Spark can't run it
    return run.asNondeterministic()(F.lower(title), F.lower(body), F.lower(prior))
