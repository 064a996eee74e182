"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon (words, and stems that begin words) is learned from a bounded sample of labelled rows. Its trie is
intersected with the automaton of all strings within some edits; the product's deterministic states are made when a
text first needs them. A hit weighs by how much oftener its term stands in toxic texts than in others;
its context window weakens it where it is quoted or reported and strengthens it where someone is addressed.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import crc_of_id, slices

WORD = re.compile(r"\w+")
#: Constant; exact words; misspelled ones; stems (sum, from three on, per 100 words, logarithm, that times the length's).
FEATURES = 8
#: Labelled rows of each label that are learned from, at most, and terms of the lexicon (but for words that short stems explain).
TOXIC_ROWS, OTHER_ROWS, TERMS = 1_500, 4_500, 400
#: Shortest stem; words from which one edit, and two, are allowed.
STEM, ONE_EDIT, TWO_EDITS = 4, 5, 9
#: As anything may follow a stem, it needs a letter more for the same edits.
STEM_MORE = 1
#: Words of a toxic text that the lexicon should explain.
ENOUGH = 4
#: Context window in words, and the factors of hits that are quoted or reported, and of hits near an address.
WINDOW, QUOTED, ADDRESSED = 5, 0.3, 1.2
REPORTING = frozenset("said says wrote writes quote quoted quotes called calling term word reported dit écrit mot sagte schrieb wort nannte dijo escribió palabra".split())
ADDRESS = frozenset("you your yours du dich dir dein tu te toi vous votre tú ti usted".split())
QUOTES = "\"“”«»„"


@dataclass
class Model:
    """terms: (text, is a stem); strength of each, 0 to 1, as it is and misspelled; coefficients of ``features``;
    others: beginnings near a stem that stand in other texts, so that they are no misspelling of it."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    strength: list[float] = field(default_factory=list)
    misspelled: list[float] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [-2.0] + [0.0] * (FEATURES - 1))
    others: list[str] = field(default_factory=list)


def allowed(term: str, stem: bool) -> int:
    n = len(term) - STEM_MORE if stem else len(term)
    return 0 if n < ONE_EDIT else 1 if n < TWO_EDITS else 2


class Matcher:
    """The lexicon's trie times the Levenshtein automaton. A state is the set of trie nodes that the letters read so
    far may stand for, each with the fewest edits; states and their moves are kept once made."""

    DEAD = 0

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.words: list[list[int]] = [[]]
        self.stems: list[list[int]] = [[]]
        self.limit = [0]
        for i, (text, stem) in enumerate(terms):
            node = 0
            most = allowed(text, stem)
            self.limit[0] = max(self.limit[0], most)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.words.append([])
                    self.stems.append([])
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], most)
            (self.stems if stem else self.words)[node].append(i)
        self.most = [allowed(*t) for t in terms]
        self.sets: list[dict[int, int]] = [{}]
        #: Stems that the letters read so far begin with, each with the fewest edits.
        self.begun: list[tuple[tuple[int, int], ...]] = [()]
        self.known: dict[tuple, int] = {(frozenset(), ()): self.DEAD}
        self.moves: dict[tuple[int, str], int] = {}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.start = self._state(self._skip({0: 0}), ())
        begins = tuple(t for t, stem in terms if stem) or ("\0",)
        #: Words that a stem begins: they count where they are misspelled, else the stem does.
        self.explained = {i for i, (t, stem) in enumerate(terms) if not stem and t.startswith(begins)}

    def _skip(self, nodes: dict[int, int]) -> dict[int, int]:
        """Also the nodes reached by leaving out letters of a term."""
        stack = list(nodes.items())
        while stack:
            node, e = stack.pop()
            if nodes.get(node, 9) < e:
                continue
            for to in self.children[node].values():
                if e + 1 <= self.limit[to] and e + 1 < nodes.get(to, 9):
                    nodes[to] = e + 1
                    stack.append((to, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int], begun: tuple[tuple[int, int], ...]) -> int:
        key = (frozenset(nodes.items()), begun)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(nodes)
            self.begun.append(begun)
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        def reach(node: int, e: int) -> None:
            if e <= self.limit[node] and e < out.get(node, 9):
                out[node] = e
        begun = dict(self.begun[state])
        for node, e in self.sets[state].items():
            reach(node, e + 1)
            for letter, to in self.children[node].items():
                reach(to, e if letter == c else e + 1)
        self._skip(out)
        for node, e in out.items():
            for t in self.stems[node]:
                if e <= self.most[t] and e < begun.get(t, 9):
                    begun[t] = e
        got = self._state(out, tuple(sorted(begun.items())))
        self.moves[state, c] = got
        return got

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, distance) of every lexicon term that the word is, or begins with; of a stem the distance to the
        closest beginning."""
        state, moves = self.start, self.moves
        for c in word:
            to = moves.get((state, c))
            state = self._move(state, c) if to is None else to
            if state == self.DEAD:
                return ()
        if state not in self.ends:
            hits = {t: e for node, e in self.sets[state].items() for t in self.words[node] if e <= self.most[t]}
            hits |= dict(self.begun[state])
            self.ends[state] = tuple(sorted(hits.items()))
        return self.ends[state]


def context(words: list[str], at: int, text: str, span: tuple[int, int]) -> float:
    """Factor of a hit from the words around it."""
    near = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
    before, after = text[max(0, span[0] - 60) : span[0]], text[span[1] : span[1] + 60]
    quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) and sum(before.count(q) for q in QUOTES) % 2 == 1
    if quoted or not REPORTING.isdisjoint(near):
        return QUOTED
    return ADDRESSED if not ADDRESS.isdisjoint(near) else 1.0


def hits_of(model: Model, matcher: Matcher, word: str) -> tuple[tuple[int, int], ...]:
    """The matcher's hits, less stems that seem misspelled by a beginning of the model's ``others``."""
    m = matcher.match(word)
    if m and any(d and model.terms[t][1] for t, d in m) and word.startswith(tuple(model.others)):
        return tuple((t, d) for t, d in m if not (d and model.terms[t][1]))
    return m


def features(model: Model, matcher: Matcher, text: str | None) -> list[float]:
    """What the odds are a linear function of, by the whole text: hits in their contexts, and how dense they are."""
    exact = misspelled = stems = 0.0
    n = 0
    if text:
        lowered = text.lower()
        found = WORD.findall(lowered)
        n = len(found)
        hits = {w: m for w in set(found) if (m := hits_of(model, matcher, w))}
        if hits:
            for at, m in enumerate(WORD.finditer(lowered)):
                if m.group() in hits:
                    factor = context(found, at, lowered, m.span())
                    own = hits[m.group()]
                    begun = [(d, t) for t, d in own if model.terms[t][1]]
                    plain = any(d == 0 for d, _ in begun)
                    whole = [(d, t) for t, d in own if not model.terms[t][1] and not (plain and t in matcher.explained)]
                    if whole:
                        d, t = min(whole)
                        if d == 0:
                            exact += factor * model.strength[t]
                        else:
                            misspelled += factor * max(model.misspelled[t] for d, t in whole)
                    else:
                        stems += factor * max(model.misspelled[t] if d else model.strength[t] for d, t in begun)
    log = math.log1p(stems)
    return [1.0, min(exact, 4.0), min(misspelled, 4.0), min(stems, 8.0), float(stems >= 2.5), min(10.0, 100 * stems / (n + 20)), log, log * math.log1p(n) / 5]


def score(model: Model, matcher: Matcher, text: str | None) -> float:
    """Probability of the label."""
    odds = sum(a * b for a, b in zip(model.coefficients, features(model, matcher, text)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _different(texts: list[str]) -> list[tuple[str, set[str]]]:
    """Texts and their words, without further near copies: those that share the three smallest hashes of their words."""
    out, seen = [], set()
    for t in texts:
        words = set(map(sys.intern, WORD.findall(t.lower())))
        mark = tuple(sorted(map(xxhash.xxh64_intdigest, words))[:3])
        if mark not in seen:
            seen.add(mark)
            out.append((t, words))
    return out


def _terms_of(words: set[str], known: set[str] | None = None) -> dict[str, int]:
    """Words, and stems marked by a star, with the number of a text's different words that they explain (ENOUGH at most)."""
    out: dict[str, int] = {}
    for w in words:
        if len(w) >= 3 and not w.isdigit():
            for t in (w, *(w[:k] + "*" for k in range(STEM, len(w) + 1))):
                if known is None or t in known:
                    out[t] = min(ENOUGH, out.get(t, 0) + 1)
    return out


def learn(toxic: list[str], other: list[str], prior: float) -> Model:
    """Lexicon, strengths and coefficients. Terms are picked greedily by the words that they newly explain in toxic
    texts (up to ENOUGH words of each text), less thrice those that they touch in others; further words follow that are
    frequent in toxic texts and all but missing elsewhere."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    pos, neg = _different(toxic), _different(other)
    if not pos or not neg:
        return Model(coefficients=[math.log(prior / (1 - prior))] + [0.0] * (FEATURES - 1))
    counts, against = Counter(), Counter()
    for _, w in pos:
        counts.update(_terms_of(w))
    least = max(4, len(pos) // 150)
    frequent = {t for t, n in counts.items() if n >= least}
    counts = Counter({t: counts[t] for t in frequent})
    for _, w in neg:
        against.update(_terms_of(w, frequent))
    share = len(pos) / len(neg)
    usable = {t for t in frequent if counts[t] > 6 * share * against[t]}
    where: dict[str, list[tuple[int, int]]] = {t: [] for t in usable}
    for i, (_, w) in enumerate(pos):
        for t, n in _terms_of(w, usable).items():
            where[t].append((i, n))
    chosen: list[str] = []
    need = [ENOUGH] * len(pos)
    heap = sorted(usable, key=lambda t: (-(counts[t] - 3 * share * against[t]), t))
    while len(chosen) < TERMS:
        # of equally good terms a word is narrower than a stem, and a longer term than a shorter one
        best, most = "", (least - 0.5, False, 0)
        for t in heap:
            if counts[t] - 3 * share * against[t] < most[0]:
                break
            gain = (sum(min(n, need[i]) for i, n in where[t]) - 3 * share * against[t], not t.endswith("*"), len(t))
            if t.endswith("*"):  # a stem must explain clearly more than its words do
                gain = (0.85 * gain[0], *gain[1:])
            if gain > most:
                best, most = t, gain
        if not best:
            break
        chosen.append(best)
        root = best.rstrip("*")
        # what the choice explains already, and stems of it that explain little more
        heap = [t for t in heap if t != best and not (best.endswith("*") and t.startswith(root)) and not (t.endswith("*") and (root + "*").startswith(t[:-1]) and counts[t] < 1.5 * counts[best])]
        for i, n in where[best]:
            need[i] = max(0, need[i] - n)
    begun = tuple(t[:-1] for t in chosen if t.endswith("*")) or ("\0",)
    sure = [t for t in heap if not t.endswith("*") and t not in chosen and counts[t] >= max(12, least) and counts[t] > 40 * share * against[t]]
    # a word that a chosen stem explains needs no entry of its own, but where the stem is too short for edits
    chosen = [t for t in [*chosen, *sure][:TERMS] if t.endswith("*") or not t.startswith(begun)]
    short = tuple(t[:-1] for t in chosen if t.endswith("*") and not allowed(t[:-1], True)) or ("\0",)
    chosen += sorted(t for t in usable if not t.endswith("*") and t.startswith(short) and allowed(t, False) and t not in chosen)
    terms = [(t[:-1], True) if t.endswith("*") else (t, False) for t in chosen]
    logs = [math.log((counts[t] + 0.5) / (len(pos) + 1)) - math.log((against[t] + 0.5) / (len(neg) + 1)) for t in chosen]
    strength = [max(0.1, min(1.0, x / max(logs))) for x in logs]
    matcher = Matcher(terms)
    # a neighbour that stands in other texts anyway is no misspelling: of a word it weakens all, as they are few, of a
    # stem only those that begin like it
    near, others = Counter(), set()
    for _, w in neg:
        own = {(t, d, x) for x in w for t, d in matcher.match(x) if d}
        near.update({t for t, _, _ in own if not terms[t][1]})
        others |= {next(x[:k] for k in range(1, len(x) + 1) if (t, d) in matcher.match(x[:k])) for t, d, x in own if terms[t][1]}
    model = Model(terms, strength, [s * max(0.0, 1 - near[i] / (1 + 0.002 * len(neg))) for i, s in enumerate(strength)], others=sorted(others))
    x = np.array([features(model, matcher, t) for t, _ in [*pos, *neg]])
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    # misspellings are rare among labelled texts: as if some toxic ones had each kind of hit alone
    extra = np.zeros((2, FEATURES))
    extra[:, 0] = 1
    extra[0, 1] = extra[1, 2] = 1
    times = max(5, len(pos) // 20)
    x, y = np.concatenate([x, np.repeat(extra, times, axis=0)]), np.concatenate([y, np.ones(2 * times)])
    coefficients = logistic(x, y)
    coefficients[0] += math.log(prior / (1 - prior)) - math.log(len(pos) / len(neg))
    return Model(terms, model.strength, model.misspelled, coefficients.tolist(), model.others)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most TOXIC_ROWS and OTHER_ROWS labelled rows (those of the smallest id hashes) where ``usable``,
    over the labels' columns, holds. The share of toxic labels is counted over all of them."""
    good = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in good.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = None
    for toxic, most in ((True, TOXIC_ROWS), (False, OTHER_ROWS)):
        part = good.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(most)
        first = part if first is None else first.unionByName(part)
    # bounded by TOXIC_ROWS + OTHER_ROWS rows
    chosen = F.broadcast(first.dropDuplicates(["id"]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").where("text is not null").dropDuplicates(["id", "text"]).select("id", "text", "toxic")
    n = sum(counts.values())
    prior = counts.get(True, 0) / n if n else 0.01

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[0], r[1]))
        model = learn([t for _, t, bad in got if bad], [t for _, t, bad in got if not bad], prior)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([model.terms, model.strength, model.misspelled, model.coefficients, model.others])], pa.string())], ["model"])

    # the sample is learned from in one task, so that the driver needn't hold it
    found = rows.repartition(1).mapInArrow(run, "model string").collect()
    terms, strength, misspelled, coefficients, others = json.loads(found[0]["model"]) if found else ([], [], [], learn([], [], prior).coefficients, [])
    return Model([(t, stem) for t, stem in terms], strength, misspelled, coefficients, others)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row by its whole text alone; a null or empty text has the score of a text without hits.
    Repeated rows and null ids each give a row; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(model, matcher, x) for x in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    place = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for b in slices(batches, names[place]):
            keep = [score(model, matcher, x) < threshold for x in b.column(place).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract of op6 over the whole ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = rate(docs, fit(docs, labels, crc_of_id(F.col("doc_id")) % 5 != 0))
    return out.select(F.col("id").alias("doc_id"), (crc_of_id(F.col("id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
