"""Byte-pair encoding by rank-synchronous merging of ragged arrays.

A batch of pre-tokens is one flat array of symbol ids with segment bounds. In
every round each sequence finds its pair of lowest rank and merges all places
of it at once; finished sequences leave the arrays. Merging all places of one
rank together equals the usual one-by-one order, as a pair that holds a merged
symbol always ranks after the merge that made it (checked on loading).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Unicode's White_Space characters.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run without white space and the space before it, or white space; the finer pattern never crosses such a chunk.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The pre-token pattern of the byte-level vocabulary.
FINE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.int64(1) << 40


@lru_cache(1)
def unassigned() -> tuple[re.Pattern, re.Pattern]:
    """Characters of the basic plane that are unassigned here, and all beyond it."""
    out = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cn"]
    return re.compile(f"[{re.escape(''.join(out))}]"), re.compile("[\U00010000-\U0010ffff]")


def of_newer_unicode(text: str) -> bool:
    """Whether a text holds a character that Python's Unicode version lacks: other libraries may call it a letter."""
    if text.isascii():
        return False
    basic, beyond = unassigned()
    return basic.search(text) is not None or any(unicodedata.category(c) == "Cn" for c in set(beyond.findall(text)))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of UTF-8 pre-tokens after all merges."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = {}
        for rank, (a, b) in enumerate(pairs):
            if max(born.get(a, -1), born.get(b, -1)) >= rank:
                raise ValueError("a merge uses a symbol that a later merge makes")
            born.setdefault(a + b, rank)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each byte string."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return out
        sym = self.of_byte[np.frombuffer(b"".join([words[i] for i in live]), dtype=np.uint8)]
        seg = np.repeat(np.arange(len(live)), sizes[live])
        ids = live
        while len(sym):
            # Ranks of neighbours; the last symbol of a sequence has none.
            rank = np.full(len(sym), NONE)
            rank[:-1] = np.where(seg[:-1] == seg[1:], self.rank(sym[:-1], sym[1:]), NONE)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            lengths = np.diff(np.r_[starts, len(sym)])
            if done.any():
                out[ids[done]] = lengths[done]
                stay = np.repeat(~done, lengths)
                sym, rank = sym[stay], rank[stay]
                lengths, best, ids = lengths[~done], best[~done], ids[~done]
                if not len(sym):
                    break
            seg = np.repeat(np.arange(len(ids)), lengths)
            hit = rank == best[seg]
            # Of places that overlap (a pair of two equal symbols), every second one from the left.
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, seg = sym[keep], seg[keep]
        return out


class Remembered:
    """Values of many keys: known ones are looked up, new ones computed together, and kept while there is room."""

    def __init__(self, compute: Callable[[list], Iterable], bound: int, longest: int = 200) -> None:
        self.compute, self.bound, self.longest, self.seen, self.extra = compute, bound, longest, {}, []

    def learn(self, rows: list[list]) -> Callable:
        """Make the values of all keys of these rows known; returns the lookup, good until the next call."""
        seen = self.seen
        for k in self.extra:
            del seen[k]
        self.extra = []  # should computing fail
        full = len(seen) >= self.bound
        new = list({k for keys in rows for k in keys if k not in seen})
        seen.update(zip(new, self.compute(new), strict=True))
        self.extra = new if full else [k for k in new if len(k) > self.longest]
        return seen.__getitem__


class TokenCounter:
    """Token counts of whole texts.

    A text is split at single spaces; a chunk and the space before it hold
    whole pre-tokens unless a space stands between other white space, in which
    case the slower pattern splits that text. Texts with characters that are
    newer than Python's Unicode version are split by the library's own
    pre-tokenizer. Counts of chunks and of words are remembered up to a bound.
    """

    #: A space between white space (or before the end): splitting there would part a run.
    RUN = re.compile(f"[{SPACE}] (?![^{SPACE}])")

    def __init__(self, path: str, remember: int = 150_000) -> None:
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level vocabularies without a normalizer are counted here")
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.fine = regex.compile(FINE, flags=regex.V1)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.words = Remembered(self.of_words, remember)
        self.plain = Remembered(self.of_chunks, remember)
        self.spaced = Remembered(lambda cs: self.of_chunks([" " + c for c in cs]), remember)

    def of_words(self, words: list[str]) -> list[int]:
        return self.merger.counts([w.encode() for w in words]).tolist()

    def of_chunks(self, chunks: list[str]) -> list[int]:
        cut = [[c] if c.isalpha() else self.fine.findall(c) for c in chunks]
        get = self.words.learn(cut)
        return [sum(map(get, ws)) for ws in cut]

    def count(self, texts: list[str]) -> list[int]:
        total, plain, spaced, owner = [0] * len(texts), [], [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and (n := len(self.special.findall(text))):
                total[i] += n  # each special string is one token
                parts = self.special.split(text)
            for part in parts:
                if of_newer_unicode(part):
                    words = [part[a:z] for _, (a, z) in self.library.pre_tokenize_str(part)]
                    total[i] += sum(map(self.words.learn([words]), words))
                    continue
                owner.append(i)
                if self.RUN.search(part):
                    plain.append(CHUNK.findall(part))
                    spaced.append([])
                else:
                    first, *rest = part.split(" ")
                    plain.append([first] if first else [])
                    spaced.append(rest)
        for memory, rows in ((self.plain, plain), (self.spaced, spaced)):
            get = memory.learn(rows)
            for i, keys in zip(owner, rows, strict=True):
                total[i] += sum(map(get, keys))
        return total
