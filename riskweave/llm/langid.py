"""Language identification by cross-parsing entropy.

Per language a suffix automaton of some labelled text recognises all its substrings. A text is cut into the longest
phrases that occur in a language's text; the fewer phrases it needs, normalised by both lengths, the closer it is. The
automata of all languages advance together over many texts at once, one symbol per step.

Symbols are lower-case letters; each run of anything else is one gap. Texts longer than BLOCK symbols are parsed block
by block, whole; a phrase ends with its block, for every language alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import crc_of_id, slices

#: Labelled rows per language that are looked at, symbols taken from one row, and symbols per automaton.
ROWS, PER_ROW, SYMBOLS = 64, 1_000, 24_000
BLOCK = 2_048
#: Letters with a symbol of their own; all others share one.
LETTERS = 120
NONE = "und"
_MISS = 1 << 30


class Alphabet:
    """Code points to symbols: 0 gap, 1 any other letter, then the training texts' most frequent letters."""

    def __init__(self, texts: list[str]) -> None:
        n = Counter(c for t in texts for c in t.lower() if c.isalpha())
        self.letters = [c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.size = len(self.letters) + 2
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def symbols(self, points: np.ndarray) -> np.ndarray:
        if self.table is None:
            own = {c: i + 2 for i, c in enumerate(self.letters)}
            self.table = np.array([own.get(chr(i).lower()[:1], 1) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint8)
        return self.table[points]


def _collapse(symbols: np.ndarray) -> np.ndarray:
    """One gap for each run of gaps."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all substrings; -1: none. State 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out = np.full((len(following), size), -1, np.int32)
    for s, to in enumerate(following):
        for c, t in to.items():
            out[s, c] = t
    return out


class Model:
    """All languages' automata in one table. An entry is the next state's row offset; the MISS bit says that a phrase
    ended before this symbol. Each language has a state of its own from which every symbol begins a phrase."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        self.alphabet = Alphabet([t for x in texts.values() for t in x])
        a, parts, base = self.alphabet.size, [], 0
        self.begin, self.weight = [], []
        for language in self.languages:
            symbols = np.concatenate([np.zeros(1, np.uint8), *(np.append(_collapse(self.alphabet.symbols(_points(t)))[:PER_ROW], 0).astype(np.uint8) for t in texts[language])])[:SYMBOLS]
            moves = suffix_automaton(symbols.tolist(), a)
            dead = len(moves)
            again = np.where(moves[0] >= 0, moves[0], dead)
            full = np.where(moves >= 0, (base + moves) * a, (base + again)[None] * a | _MISS)
            parts += [full, ((base + again) * a | _MISS)[None]]
            self.begin.append((base + dead) * a)
            self.weight.append(np.log2(max(2, len(symbols))))
            base += dead + 1
        self.table = np.concatenate(parts).astype(np.int32).reshape(-1) if parts else np.zeros(0, np.int32)
        if base * a >= _MISS:
            raise ValueError("the automata are too large: take fewer symbols per language")

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases [language, text] that each text [start, end) of ``symbols`` needs."""
        sizes = ends - starts
        blocks = np.maximum(1, -(-sizes // BLOCK))
        owner = np.repeat(np.arange(len(sizes)), blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + k * BLOCK
        left = np.minimum(BLOCK, ends[owner] - at)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        state = np.repeat(np.array(self.begin, np.int32)[:, None], len(at), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = len(at)
        for t in range(int(left[0]) if len(left) else 0):
            while active and left[active - 1] <= t:
                active -= 1
            got = self.table[state[:, :active] + symbols[at[:active] + t].astype(np.int32)]
            count[:, :active] += got >> 30
            state[:, :active] = got & (_MISS - 1)
        out = np.zeros((len(self.languages), len(sizes)), np.int64)
        for i in range(len(self.languages)):
            np.add.at(out[i], owner[order], count[i])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        joined = "\n".join(x or "" for x in texts) + "\n"
        lengths = np.fromiter((len(x or "") for x in texts), np.int64, len(texts))
        raw = self.alphabet.symbols(_points(joined))
        cuts = np.concatenate([[0], np.cumsum(lengths + 1)])
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        keep[cuts[:-1][lengths > 0]] = True
        moved = np.concatenate([[0], np.cumsum(keep)])
        starts, ends = moved[cuts[:-1]], moved[cuts[:-1] + lengths]
        letters = np.concatenate([[0], np.cumsum(raw != 0)])
        some = letters[cuts[:-1] + lengths] > letters[cuts[:-1]]
        if not self.languages:
            return [NONE] * len(texts), [0.0] * len(texts)
        need = self.phrases(raw[keep], starts, ends) * np.array(self.weight)[:, None] / np.maximum(1, ends - starts)
        best = need.argmin(axis=0)
        ordered = np.sort(need, axis=0)
        score = ordered[1] / np.maximum(1e-12, ordered[0] + ordered[1]) if len(need) > 1 else np.ones(len(texts))
        return [self.languages[b] if s else NONE for b, s in zip(best, some)], [float(x) if s else 0.0 for x, s in zip(score, some)]


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most ROWS rows per language (those of the smallest id hashes) where ``usable`` holds and text
    and language aren't null; whole rows are read, PER_ROW symbols of each and SYMBOLS of a language are taken."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= ROWS)
    chosen = {(r["lang"], r["id"]): (r["h"], str(r["id"])) for r in first.collect()}  # ROWS per language
    found = docs.where(F.col(id_col).isin(sorted({i for _, i in chosen if i is not None}))).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.substring(F.col(text_col).cast("string"), 1, 16 * PER_ROW).alias("text"))
    texts: dict[str, list[tuple]] = {}
    for r in found.collect():
        if (r["lang"], r["id"]) in chosen and r["text"]:
            texts.setdefault(r["lang"], []).append((chosen[r["lang"], r["id"]], r["text"]))
    return Model({lang: [t for _, t in sorted(x)][:ROWS] for lang, x in texts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) per row by its whole text alone. A null text, or one without a letter, is ``und`` with score 0;
    equal needs go to the language first in the alphabet; repeated rows and null ids each give a row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some MB per language, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, score = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Contract of op5 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs, crc_of_id(F.col("doc_id")) % 3 != 1))
    return out.select(F.col("id").alias("doc_id"), (crc_of_id(F.col("id")) % 3 == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
