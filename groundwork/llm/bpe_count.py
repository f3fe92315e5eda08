"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays of symbols. In each round every sequence
applies its lowest-rank pair everywhere it occurs, all sequences at once; sequences
without a known pair leave. The symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import compress
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import map_texts

_CONTROL = re.compile("[\x1c-\x1f]")
NONE = np.iinfo(np.int32).max
#: Cached words per Python worker.
CACHE = 100_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Tokens of words; a word that is not known counts as 0 and is noted in ``missed``.

    When one half of ``CACHE`` is full, the other, of words not met since, is dropped.
    """

    def __init__(self):
        self.older: dict[str, int] = {}
        self.missed: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            self.missed.append(word)
            return 0
        self[word] = n
        return n

    def turn(self) -> None:
        if len(self) > CACHE // 2:
            self.older = dict(self)
            self.clear()


class TokenCounter:
    """Counts the tokens of texts for a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.mark = commonprefix([t["content"] for t in spec["added_tokens"]])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.space = regex.compile(r"\s+")
        self.cache = Words()
        # ranks of two bytes: the first one inside a word, the second one inside (0 to 255) or at its end (256 to 511)
        self.byte_ranks = self.pair_rank(np.repeat(self.first, 512), np.tile(np.concatenate([self.first, self.last]), 256))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE).astype(np.int32)

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word; words are not empty and have no line feeds."""
        raw = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        breaks = raw == 10
        seq, ends = np.cumsum(breaks)[~breaks], np.nonzero(breaks)[0] - np.arange(1, len(words) + 1)
        raw = raw[~breaks]
        syms = self.first[raw]
        syms[ends] = self.last[raw[ends]]
        counts = np.ones(len(words), np.int64)
        ranks = np.full(len(syms), NONE, np.int32)
        inner = np.nonzero(seq[:-1] == seq[1:])[0]
        second = raw.astype(np.int64)
        second[ends] += 256
        ranks[inner] = self.byte_ranks[second[inner + 1] + 512 * raw[inner].astype(np.int64)]
        while len(syms):
            new = np.concatenate([[True], seq[1:] != seq[:-1]])
            starts = np.nonzero(new)[0]
            low = np.minimum.reduceat(ranks, starts)
            length = np.diff(np.append(starts, len(syms)))
            done = low == NONE
            counts[seq[starts[done]]] = length[done]
            if done.any():
                stay = np.repeat(~done, length)
                syms, seq, ranks, low, length = syms[stay], seq[stay], ranks[stay], low[~done], length[~done]
                if not len(syms):
                    break
            hit = ranks == np.repeat(low, length)
            at = np.nonzero(hit)[0]
            if (np.diff(at) == 1).any():  # a pair of equal symbols in a run: every other one
                run = np.concatenate([[True], np.diff(at) != 1])
                head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            syms[at] = self.made[ranks[at]]
            keep = np.ones(len(syms), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            syms, seq, ranks = syms[keep], seq[keep], ranks[keep]
            now = place[at]
            changed = np.zeros(len(syms), bool)
            changed[now] = True
            changed[np.maximum(now - 1, 0)] = True
            stale = np.nonzero(changed)[0]
            ranks[stale] = NONE
            stale = stale[stale < len(syms) - 1]
            stale = stale[seq[stale] == seq[stale + 1]]
            ranks[stale] = self.pair_rank(syms[stale], syms[stale + 1])
        return counts

    def words(self, text: str) -> list[str]:
        """Lower-case runs between white space: pre-tokens never cross white space, so these are counted one by one."""
        # letter by letter, as the vocabulary's own lower-casing: no rule for a sigma at a word's end
        text = "".join(c.lower() for c in unicodedata.normalize("NFC", text)) if "\u03a3" in text else text.lower()
        # str.split() also splits at four control characters that the vocabulary keeps
        return text.split() if not _CONTROL.search(text) else self.space.split(text)

    def learn(self, fresh: list[str]) -> None:
        """Count the words that are not in the cache, which hold no white space."""
        fixed = "\n".join(fresh)
        if not fixed.isascii():  # a line feed composes with nothing
            fixed = unicodedata.normalize("NFC", fixed).lower()
        fixed = fixed.split("\n")
        whole = list(map(str.isalpha, fixed))  # letters only are one pre-token
        others = [w for w, one in zip(fixed, whole) if not one]
        parts = self.lines.findall("\n".join(others))
        inner = set(parts) - {"\n"}
        known = {w: self.cache[w] for w in inner.intersection(self.cache) if w.isascii()}
        distinct = list(inner.union(compress(fixed, whole)).difference(known))
        if distinct:
            known.update(zip(distinct, self.merge_counts(distinct).tolist()))
        known["\n"] = -1
        n = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        sums = iter(np.bincount(np.cumsum(n < 0), np.maximum(n, 0), len(others)).astype(np.int64).tolist())
        self.cache.update(zip(fresh, [known[w] if one else next(sums) for w, one in zip(fixed, whole)]))

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        cache, step = self.cache, 200  # texts at a time, so that lists and arrays of words stay small
        for i in range(0, len(texts), step):
            cache.turn()
            known, ends = [], []
            for text in texts[i : i + step]:
                text = text or ""
                n, at, found = 0, 0, []
                if self.special and self.mark in text:
                    for m in self.special.finditer(text):
                        n += 1
                        found += self.words(text[at : m.start()])
                        at = m.end()
                known.append(n + sum(map(cache.__getitem__, found + self.words(text[at:]) if at else self.words(text))))
                ends.append(len(cache.missed))
            missed, cache.missed = cache.missed, []
            if missed:
                self.learn(list(set(missed)))
            late = list(map(cache.__getitem__, missed))
            out += [n + sum(late[a:b]) for n, a, b in zip(known, [0, *ends], ends)]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    Null and empty texts have no bytes and no tokens. A special token's string inside a
    text counts as that one token. Whole texts are counted, whatever their length.
    Letters that are newer than Python's Unicode tables may be split in another way than
    by the library.
    Repeated rows and null ids are rows like any other; an empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def run(texts: list) -> list[pa.Array]:
        return [pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counter(path).counts(texts), pa.int64())]

    return map_texts(docs, run, "n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
