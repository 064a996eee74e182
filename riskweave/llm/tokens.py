"""Token ids of whole Arrow slices, exactly as the ``tokenizers`` library gives them.

The word vocabulary's normalizer and splitter are simple enough to run over all characters of a slice at once: code
points are classed and lower-cased by table, words are cut where classes change, and equal words are found by a 64-bit
hash, so that the library encodes each different word once per worker. Texts with characters for which that isn't
known to be equal (outside the classed ranges, or special tokens in the text) go through the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from riskweave.llm.shared import Rolling

LIMIT = 0x2060
SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Different words whose ids a worker keeps; beyond it starts anew.
WORDS_KEPT = 250_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    classes, lower = np.full(LIMIT + 1, UNSAFE, np.uint8), np.arange(LIMIT + 1, dtype=np.uint32)
    for cp in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        c = chr(cp)
        if len(c.lower()) != 1 or ord(c.lower()) >= LIMIT or unicodedata.normalize("NFC", c) != c:
            continue
        lower[cp] = ord(c.lower())
        kind = unicodedata.category(c)[0]
        classes[cp] = SPACE if c.isspace() else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return classes, lower


def _byte_symbols() -> dict[int, int]:
    """The byte-level splitter's symbol of each byte: itself if printable, else the next code point from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """``ids(texts)`` gives all ids of some texts in one array, and where each text's ids begin and end in it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": SPLIT} and parts[-1].get("type") == "ByteLevel" and spec["model"].get("dropout") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.symbols = _byte_symbols()
        self.classes, self.lower = _tables()
        self.rolling = Rolling(20240607, LIMIT + 1)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        model = self.library.model
        for h, word in zip(hashes, words):
            # the splitter's byte symbols, then the library's own merges
            ids = [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]
            slot = len(self.slots)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            if slot >= len(self.begin):
                self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[slot], self.length[slot] = self.used, len(ids)
            self.used += len(ids)
            self.slots[h] = slot

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._library(texts)
        slow = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        joined, points, ends = self._points(["" if i in slow else t for i, t in enumerate(texts)])
        unsafe = np.concatenate([[0], np.cumsum(self.classes[np.minimum(points, LIMIT)] == UNSAFE)])
        starts = np.concatenate([[0], ends[:-1] + 1])
        if (odd := np.nonzero(unsafe[ends] > unsafe[starts])[0]).size:
            slow |= set(odd.tolist())
            joined, points, ends = self._points(["" if i in slow else t for i, t in enumerate(texts)])
            starts = np.concatenate([[0], ends[:-1] + 1])
        flat, at = self._by_word(joined, points, starts)
        if slow:
            some = sorted(slow)
            extra, cuts = self._library([texts[i] for i in some])
            place = {i: k for k, i in enumerate(some)}
            parts = [extra[cuts[place[i]] : cuts[place[i] + 1]] if i in place else flat[at[i] : at[i + 1]] for i in range(len(texts))]
            flat, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return flat, at

    @staticmethod
    def _points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n\n\n"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum(lengths + 1) - 1

    def _by_word(self, joined: str, points: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, low = self.classes[points], self.lower[points]
        before = np.concatenate([np.zeros(1, np.uint8), kinds[:-1]])
        first = (kinds != SPACE) & ((kinds != before) | (kinds == NUMBER))
        mark = np.nonzero((low == 39) & (before != OTHER))[0]
        if mark.size:  # 's 't 'm 'd 're 've 'll are words where an apostrophe begins a word
            one, two = low[mark + 1], low[mark + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            first[mark[short | long] + 1] = False
            for where in (mark[short] + 2, mark[long & ~short] + 3):
                first[where] = kinds[where] != SPACE
        cuts = np.nonzero(first | (kinds == SPACE))[0]
        begins = np.nonzero(first[cuts])[0]
        s, e = cuts[begins], cuts[np.minimum(begins + 1, len(cuts) - 1)]
        hashes = self.rolling.of(self.rolling.prefix(low), s, e)
        different, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) > WORDS_KEPT:
            self._forget()
        keys = different.tolist()
        if new := [i for i, h in enumerate(keys) if h not in self.slots]:
            lowered = joined.lower()
            at = example[new]
            self._learn([keys[i] for i in new], [lowered[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())])
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[which]
        lengths = self.length[slots]
        out = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.begin[slots] - out[:-1], lengths) + np.arange(out[-1])]
        return ids, np.concatenate([out[np.searchsorted(s, text_starts)], out[-1:]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
