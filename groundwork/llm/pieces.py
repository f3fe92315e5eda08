"""Exact encoding and decoding for merge-type SentencePiece models by backtracking.

An Aho-Corasick automaton finds the longest piece at every place. Pieces are taken
greedily; a piece may follow another only if re-merging the two texts gives just these
two pieces. When no shorter prefix fits either, the last piece is taken back and the
place is marked in a bitfield of failed positions, so each place fails once at most.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from groundwork.llm.common import map_texts

codecs.register_error("each", lambda e: ("\ufffd" * (e.end - e.start), e.end))  # a sign for every byte that is no letter's

SPACE = "▁"
#: Cached chunks and checked pairs per Python worker; each is emptied when it is full.
CACHE, PAIRS = 300_000, 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encodes and decodes as the library does for a model whose normaliser only marks spaces."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.score = [model.get_score(i) for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.hidden = frozenset(i for i in range(size) if model.is_control(i))
        self.unknown = model.unk_id()
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        # a piece that merging its own letters does not give never stands in a result
        usable = [i for i in plain if self.merge(self.piece[i]) == [i]]
        own = {self.piece[i]: i for i in usable}
        # order of merging: a better score first; the seam check below needs children before parents
        rank = {v: k for k, v in enumerate(sorted({self.score[i] for i in plain}, reverse=True))}
        self.order = {p: rank[self.score[i]] for p, i in self.id.items()}
        self.split = {p: self.last_merge(p) for p in own if len(p) > 1}
        self.steady = frozenset(i for p, i in own.items() if all(self.order[p] > self.order[x] for x in self.split.get(p, ()) if len(x) > 1))
        self.prefix = {i: next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1) for p, i in own.items()}
        self.size = [len(p) for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for p, i in own.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        # no merge crosses a place where no piece has these two signs next to each other: a text is cut before
        # space marks, and between a letter and a mark that follows no letter in any piece
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in own):
            raise ValueError("pieces that cross word starts are not supported")
        letter = r"[^\W\d_]"
        free = set("!\"#$%&()*+,-./:;<=>?@[]^`{|}~") - {p[m.end()] for p in own for m in re.finditer(f"{letter}(?=.)", p, re.S)}
        line = "\n" if not any("\n" in p for p in own) else ""
        ahead = f"(?![{''.join(map(re.escape, sorted(free)))}])" if free else ""
        other = rf"(?:[\W\d_](?<![{SPACE}{line}]))"
        self.chunks = re.compile((f"{line}+|" if line else "") + f"{SPACE}*+(?:{letter}++{ahead}|{other})*+(?:{letter}++)?")
        self.text = {i: p.replace(SPACE, " ") for p, i in own.items()}
        self.cache: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # chunks that decode to something else than they are
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Best-score-first merging of a short text of known letters, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def last_merge(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge made a usable piece."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.order.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def spine(self, piece: str, side: int) -> list[str]:
        """What stands at the piece's end (side 1) or start (side 0), from the piece down to one letter."""
        out = [piece]
        while len(piece) > 1:
            piece = self.split[piece][side]
            out.append(piece)
        return out

    def fits(self, left: int, right: int) -> bool:
        """Does merging the two texts together give just these two pieces?"""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.seam_holds(a, b) if left in self.steady and right in self.steady else self.merge(a + b) == [left, right]
        return known

    def seam_holds(self, a: str, b: str) -> bool:
        """Re-merge along the seam only: the parts next to it grow in merge order, and no merge across may come first."""
        order = self.order
        x, y = self.spine(a, 1), self.spine(b, 0)
        i, j = len(x) - 1, len(y) - 1
        while True:
            grow_x, grow_y = order[x[i - 1]] if i else 1 << 30, order[y[j - 1]] if j else 1 << 30
            across = order.get(x[i] + y[j], 1 << 30)
            # equal ranks: what lies further left goes first
            if across < grow_x and across <= grow_y and across < 1 << 30:
                return False
            if not i and not j:
                return True
            if grow_x <= grow_y:
                i -= 1
            else:
                j -= 1

    def known_run(self, longest: list[int], at: int, stop: int) -> list[int]:
        """Pieces of the letters in [at, stop), all of which are known."""
        out: list[int] = []
        size, prefix, pairs = self.size, self.prefix, self.pairs
        failed = None  # bitfield, made when the first place fails
        pos, token, last = at, longest[at], -1
        while True:
            end = pos + size[token]
            if end <= stop and (failed is None or not failed[end - at >> 3] >> (end - at & 7) & 1):
                ok = last < 0 or pairs.get(last << 32 | token)
                if ok is None:
                    ok = self.fits(last, token)
                if ok:
                    out.append(token)
                    if end == stop:
                        return out
                    pos, last, token = end, token, longest[end]
                    continue
            token_shorter = prefix[token]
            if token_shorter >= 0:
                token = token_shorter
                continue
            if failed is None:
                failed = bytearray((stop - at) // 8 + 1)
            failed[pos - at >> 3] |= 1 << (pos - at & 7)
            token = out.pop()
            pos -= size[token]
            last = out[-1] if out else -1

    def longest_pieces(self, text: str) -> list[int]:
        """The longest piece that starts at each place, -1 for an unknown letter."""
        longest, size = [-1] * len(text), self.size
        for end, token in self.automaton.iter(text):
            longest[end - size[token] + 1] = token  # matches come by end, so the last is the longest
        return longest

    def chunk_ids(self, text: str, longest: list[int], at: int, end: int) -> list[int]:
        """Ids of text[at:end]; a letter that the model lacks is its bytes."""
        if at < end and -1 not in longest[at:end]:
            return self.known_run(longest, at, end)
        out: list[int] = []
        while at < end:
            stop = at
            while stop < end and longest[stop] >= 0:
                stop += 1
            if stop > at:
                out += self.known_run(longest, at, stop)
            if stop < end:
                out += [self.byte_id[b] for b in text[stop].encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]
            at = stop + 1
        return out

    def learn(self, fresh: list[str]) -> None:
        """Encode the chunks that are not in the cache, and decode each once to see that it comes back."""
        together = "".join(fresh)
        longest = self.longest_pieces(together)
        at = 0
        for chunk in fresh:
            end = at + len(chunk)
            # a piece that reaches into the next chunk is cut to this one by known_run
            ids = self.chunk_ids(together, longest, at, end)
            at = end
            self.cache[chunk] = array("I", ids).tobytes()
            if (back := self.spell(ids)) != chunk.replace(SPACE, " "):
                self.odd[chunk] = back

    def coded(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids (little-endian, without begin and end) and the text that they decode to."""
        if not text:
            return b"", ""
        found = self.chunks.findall(SPACE + text.replace(" ", SPACE))
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
            self.odd.clear()
        if fresh := set(found).difference(cache):
            self.learn(list(fresh))
        body = b"".join([cache[c] for c in found])
        odd = self.odd
        spelled = "".join([odd.get(c, c) for c in found]) if odd and not odd.keys().isdisjoint(found) else "".join(found)
        return body, spelled.replace(SPACE, " ").removeprefix(" ")

    def encode(self, text: str | None) -> list[int]:
        return [self.begin, *np.frombuffer(self.coded(text)[0], "<u4").tolist(), self.end]

    def spell(self, ids: list[int]) -> str:
        """Text of ids, with a space for each mark; runs of byte pieces are read as UTF-8."""
        try:
            return "".join(map(self.text.__getitem__, ids))
        except KeyError:
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "each"))
                run = bytearray()
            if i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.piece[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "each"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids: without control pieces and without the space mark of the first piece."""
        ids = [i for i in ids if i not in self.hidden]
        text = self.spell(ids)
        return text[1:] if ids and self.piece[ids[0]].startswith(SPACE) else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row.

    Ids include begin and end. Null and empty texts have these two ids and decode to
    nothing. Letters the model lacks are encoded as bytes. Whole texts are encoded; words
    between spaces are encoded once per worker, as no merge crosses a word's start.
    Repeated rows and null ids are rows like any other; an empty table gives an empty result.
    """
    path = model or default_model()

    def run(texts: list) -> list[pa.Array]:
        c = codec(path)
        first, last = (np.array([i], "<u4").tobytes() for i in (c.begin, c.end))
        n, ids_sha, text_sha = [], [], []
        for text in texts:
            body, spelled = c.coded(text)
            ids = first + body + last
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(spelled.encode("utf-8", "surrogatepass")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]

    return map_texts(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
