r"""Personal data with a semi-Markov conditional random field.

Base patterns give the certain spans. Beside them a field looks at whole segments of tokens: a
text is cut into segments, each outside or one entity of a type, and the cut with the highest
sum of scores is taken. A segment's score comes from features of the whole span: its pattern of
digits, letters and signs, checksums, the signs and words around it. An entity is bounded (18
tokens on one line), so a dynamic program over ends chooses boundaries and types together; it is exact,
because a segment that scores below what an adjacent entity could add is on no best cut.

Tokens are runs of letters and digits or single signs. Features come from prefix sums over the
tokens of many texts at once. The field is fitted on made-up lines (seeded), once on the driver.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groundwork.llm.common import map_texts

#: Kinds of the base patterns, then those that the field alone finds.
KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "iban", "ssn")
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that starts inside a run of digits would also start with the run
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = str.maketrans("", "", " ().-+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and domain: what stands between one @ and the next is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end(), "email"
        end = max(end, found.end() if found else at + 1)
        at = text.find("@", max(at + 1, end))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start."""
    out = list(emails(text))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].translate(_NO_DIGITS)) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_NO_DIGITS)) <= 15]
    return out


# --- tokens of many texts -------------------------------------------------------------------

#: Texts are looked at together up to so many code points; tokens of an entity at most.
TOGETHER, LONGEST = 300_000, 18
_SIGNS = ".-/()+:@[]_"
#: Words that stand before data of a type, and those that stand before other numbers.
LEXICON = (
    "mail email e contact kontakt contacto courriel correo write reach".split(),
    "ip ipv host server address addr client ping ssh gateway dns peer router".split(),
    "card visa mastercard amex credit debit karte kreditkarte carte tarjeta cc".split(),
    "tel telephone phone mobile cell fax call telefon handy mobil ruf telefono movil llame appelez whatsapp dial".split(),
    "iban account konto compte cuenta bank sepa bic".split(),
    "ssn social security insurance".split(),
    "date time on since until from version v release rev ver born year rfc build page pages pp line lines section".split(),
    "isbn issn doi order invoice id no nr ref part serial sku article lot total sum amount price hash sha commit uuid offset size key code number range mac".split(),
)
_WORD_CLASS = {w: k for k, words in enumerate(LEXICON, 1) for w in words}


class Tokens:
    """Arrays over the tokens of texts that stand one after another, with prefix sums of what spans are judged by."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer((t + "\n").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        code = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        self.base = np.cumsum([0, *map(len, raw)])
        self.string = "".join(t + "\n" for t in texts)
        lower, upper, digit = ((code >= ord(a)) & (code <= ord(z)) for a, z in ("az", "AZ", "09"))
        other = (code >= 0xC0) & ((code < 0x2000) | (code > 0x303F))
        white = ((code >= 9) & (code <= 13)) | ((code >= 28) & (code <= 32)) | (code == 0x85) | (code == 0xA0) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x3000)
        word = lower | upper | digit | other
        sign = ~word & ~white
        first, last = sign | word, sign | word
        first[1:] &= sign[1:] | ~word[:-1]
        last[:-1] &= sign[:-1] | ~word[1:]
        self.start, self.end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        per = lambda member: (lambda c: c[self.end] - c[self.start])(total(member))
        self.n = len(self.start)
        size = self.end - self.start
        self.digits, up, lo, ot = per(digit), per(upper), per(lower), per(other)
        self.letters = up + lo + ot
        self.sign = np.where(sign[self.start], code[self.start], 0) if self.n else np.zeros(0, np.uint32)
        self.line = total(code == 10)[self.start]
        gap = np.full(self.n, 9, np.int64)  # white space before the token; 9 at the start of a line
        gap[1:] = np.where(self.line[1:] == self.line[:-1], np.minimum(self.start[1:] - self.end[:-1], 8), 9)
        self.gap = gap
        hexes = per(((code >= 97) & (code <= 102)) | ((code >= 65) & (code <= 70)) | digit)
        self.hex = (hexes == size) & (size <= 4) & (self.sign == 0)
        self.numeric = (self.digits == size) & (self.sign == 0)
        lead = np.minimum(code[self.start] - 48, 9) if self.n else np.zeros(0, np.int64)
        self.lead = np.where(self.numeric, lead, 10).astype(np.int64)
        value = np.zeros(self.n, np.int64)
        for k in range(3):  # value of runs of three digits at most
            here = self.numeric & (size <= 3) & (k < size)
            value[here] = value[here] * 10 + code[self.start[here] + k] - 48
        self.small = self.numeric & (size <= 3) & (value <= 255)
        low = np.where(upper, code + 32, code)
        self.word = np.zeros(self.n, np.int64)
        short = np.nonzero((self.letters == size) & (size <= 11) & (self.sign == 0) & (self.near_data(digit, code)))[0]
        for k in short.tolist():
            self.word[k] = _WORD_CLASS.get(self.string[self.start[k] : self.end[k]].lower(), 0)
        spelled = lambda w: (size == len(w)) & np.all([low[np.minimum(self.start + k, len(low) - 1)] == ord(c) for k, c in enumerate(w)], axis=0)
        shift = lambda x, d: np.roll(x, d) & (0 <= np.arange(self.n) - d) & (np.arange(self.n) - d < self.n)
        at, dot = (spelled("at"), spelled("dot")) if self.n else (np.zeros(0, bool),) * 2
        dots = total(dot)
        framed = shift(np.isin(self.sign, [40, 91, 123, 60]), 1) & shift(np.isin(self.sign, [41, 93, 125, 62]), -1)
        self.at = (self.sign == 64) | at & (framed | (dots[np.minimum(np.arange(self.n) + 12, self.n)] > dots[:-1]))
        tight = shift(gap == 0, -1) & shift(self.sign == 0, -1)  # before a word or number that is glued on
        self.dot = (self.sign == 46) & (gap == 0) & tight | dot
        # shape of a token: 1 to 30 runs of digits, 31 to 46 letters, 47 to 62 both, 64 and on signs
        case = np.where(ot > 0, 2, np.where(up == size, 1, 0))
        mixed = (self.digits > 0) & (self.letters > 0)
        shape = np.where(self.sign > 0, 64 + np.minimum(self.sign, 128), np.where(self.numeric, np.minimum(size, 30), np.where(mixed, 47 + np.minimum(size, 12), 31 + case * 5 + np.minimum(size, 5) - 1)))
        self.shape = shape.astype(np.int64)
        odd, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, odd)]))
            self.undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, back)]))
            mix = lambda x: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            sums = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
            self.shapes = sums(mix(self.shape) * power[:-1])
            self.gaps = sums((np.minimum(gap, 2) + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) * power[:-1])
        self.sums = {
            "digits": total(self.digits), "letters": total(self.letters), "upper": total(up), "wide": total(gap > 1), "spaces": total(gap > 0), "numbers": total(self.numeric), "small": total(self.small),
            "hex": total(self.hex), "words": total(self.sign == 0), "mixed": total(mixed), "at": total(self.at), "dot": total(self.dot), "dotted": total(dot), "odd": total((self.sign > 0) & ~np.isin(self.sign, [ord(c) for c in _SIGNS])),
            **{c: total(self.sign == ord(c)) for c in _SIGNS},
        }

    def near_data(self, digit: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Tokens that have a digit or an @ within 60 code points behind them: only there words matter."""
        mark = np.concatenate([[0], np.cumsum(digit | (code == 64))])
        return mark[np.minimum(self.end + 60, len(code))] > mark[self.start]

    def count(self, what: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sum over the tokens i to j, both included."""
        return self.sums[what][j + 1] - self.sums[what][i]


def candidates(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of every segment that may be an entity, by text order.

    Numbers: 7 to 19 digits without letters; addresses of hexadecimal groups with two colons at
    least; an account number of 15 to 34 letters and digits that begins with two capitals and
    two digits; a sign or word "at" followed by a dot or the word "dot".
    """
    left, right = [], []
    if t.n:
        index = np.arange(t.n)
        ahead = np.minimum(index + LONGEST, t.n) - 1
        digits, colons, ats = (t.count(w, index, ahead) for w in ("digits", ":", "at"))
        number = (t.numeric | np.isin(t.sign, [40, 43, 91])) & (digits >= 7)
        group = (t.hex | (t.sign == 58)) & (colons >= 2)
        account = (t.sign == 0) & (t.digits >= 2) & (t.letters >= 2) & (digits >= 8) | (t.letters == 2) & (t.digits == 0) & (digits >= 10)
        local = (t.sign == 0) & (ats > 0) & (t.count("dot", index, ahead) > 0)
        starts = np.nonzero(number | group | account | local)[0]
        closing = np.isin(t.sign, [41, 93, 125, 62])
        ends = np.concatenate([[False], t.dot[:-1]]) | np.concatenate([[False, False], t.dot[:-2]])[: t.n] & np.concatenate([[False], closing[:-1]])  # behind a dot
        for d in range(LONGEST):
            i = starts[starts + d < t.n]
            j = i + d
            one_line = t.sums["wide"][j + 1] == t.sums["wide"][i + 1]
            i, j = i[one_line], j[one_line]
            n, letters, odd = t.count("digits", i, j), t.count("letters", i, j), t.count("odd", i, j)
            nums = number[i] & t.numeric[j] & (n >= 7) & (n <= 19) & (letters == 0) & (odd == 0)
            glued = t.sums["spaces"][j + 1] == t.sums["spaces"][i + 1]
            words = t.count("words", i, j)
            hexes = group[i] & (t.hex[j] | (t.sign[j] == 58)) & glued & (t.count(":", i, j) >= 2) & (t.count("hex", i, j) + t.count(":", i, j) == d + 1) & (n + letters >= 3)
            ibans = account[i] & (t.sign[j] == 0) & (words + t.count("-", i, j) == d + 1) & (n + letters >= 15) & (n + letters <= 34) & (n >= 8)
            mails = local[i] & (t.sign[j] == 0) & (t.letters[j] >= 2) & (t.digits[j] == 0) & ends[j] & (t.count("at", i, j) == 1) & ~t.at[i] & ~t.at[j] & (t.count("dot", i, j) > 0)
            keep = nums | hexes | ibans | mails
            left.append(i[keep])
            right.append(j[keep])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    order = np.lexsort((j, i))
    return i[order], j[order]


def mod97(text: str) -> bool:
    """The checksum of an account number."""
    bare = "".join(c for c in text.upper() if c.isascii() and c.isalnum())
    return bare[:2].isalpha() and bare[2:4].isdigit() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


PATTERNS = 1 << 14
#: Values of each feature group.
GROUPS = (PATTERNS, PATTERNS, 40, 40 * 12, 1 << 12, 40 * 3, 5 * 5 * 3, 40 * 3, 130 * 11, 130 * 6, 9 * 8, 9 * 130, 4 * 4 * 6 * 4, 12 * 6, 6 * 8, 12 * 12 * 4, 12 * 40, 4 * 5, 1)
OFFSETS = np.concatenate([[0], np.cumsum(GROUPS)])


def features(t: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of the features of whole spans: groups x segments."""
    count = {w: t.count(w, i, j) for w in t.sums}
    n, size = np.minimum(count["digits"], 39), j - i + 1
    with np.errstate(over="ignore"):
        own = (t.shapes[j + 1] - t.shapes[i]) * t.undo[i]
        gaps = (t.gaps[j + 1] - t.gaps[i + 1]) * t.undo[i]
        pattern = own ^ (gaps * np.uint64(3))
        pattern = (pattern ^ (pattern >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pattern = ((pattern ^ (pattern >> np.uint64(32))) % np.uint64(PATTERNS)).astype(np.int64)
    signs = sum((count[c] > 0).astype(np.int64) << k for k, c in enumerate(_SIGNS)) + ((t.sums["spaces"][j + 1] > t.sums["spaces"][i + 1]).astype(np.int64) << len(_SIGNS))
    check, sum97 = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in np.nonzero((n >= 13) & (count["letters"] == 0))[0].tolist():
        digits = [c for c in t.string[t.start[i[k]] : t.end[j[k]]] if "0" <= c <= "9"]
        check[k] = 1 + luhn("".join(digits))
    for k in np.nonzero((count["letters"] >= 2) & (count["at"] == 0) & (count[":"] == 0) & (count["digits"] + count["letters"] >= 15))[0].tolist():
        sum97[k] = 1 + mod97(t.string[t.start[i[k]] : t.end[j[k]]])
    before, after = np.maximum(i - 1, 0), np.minimum(j + 1, t.n - 1)
    has_before, has_after = (i > 0) & (t.gap[i] < 9), (j + 1 < t.n) & (t.gap[after] < 9)
    side = lambda k: np.where(t.sign[k] > 0, np.minimum(t.sign[k], 128), np.where(t.numeric[k], 0, np.where(t.digits[k] > 0, 1, 2))).astype(np.int64)
    prev = np.where(has_before, np.where(t.gap[i] == 0, side(before), 3 + np.minimum(side(before), 2)), 6)
    nxt = np.where(has_after, np.where(t.gap[after] == 0, side(after), 3 + np.minimum(side(after), 2)), 6)
    beyond = np.minimum(j + 2, t.n - 1)
    then = np.where((j + 2 < t.n) & (t.gap[beyond] == 0) & (t.gap[after] == 0), np.where(t.numeric[beyond], 1, np.where(t.sign[beyond] > 0, 3, 2)), 0)
    earlier = np.maximum(i - 2, 0)
    then_left = np.where((i > 1) & (t.gap[i] == 0) & (t.gap[before] == 0), np.where(t.numeric[earlier], 1, np.where(t.sign[earlier] > 0, 3, 2)), 0)
    named = np.zeros(len(i), np.int64)
    for back in range(6, 0, -1):
        k = np.maximum(i - back, 0)
        here = (i - back >= 0) & (t.line[k] == t.line[i]) & (t.word[k] > 0)
        named = np.where(here, t.word[k], named)
    spelled, dotted = count["at"] - count["@"], t.count("dotted", i, j)
    mail = np.where(count["at"] == 0, 0, np.where(count["@"] > 0, 1, np.where(count["["] + count["("] > 0, 2, 3)))
    dots = np.where(count["."] > 0, 1, 0) + 2 * (count["dot"] > count["."])
    third = np.minimum(j + 2, t.n - 1)
    goes_on = (has_after & (t.dot[after] | np.isin(t.sign[after], [40, 91, 123, 60]) & t.dot[third])) + 2 * (has_before & (t.dot[before] | (t.gap[i] == 0) & (t.sign[before] > 0) & (t.sign[before] != 34)))
    goes_on = np.where(count["at"] > 0, goes_on, 0)
    begin, end = np.searchsorted(t.line, t.line[i]), np.searchsorted(t.line, t.line[i], side="right") - 1
    crowd = np.searchsorted([1, 2, 4, 7, 12], t.count("numbers", begin, end) - count["numbers"])
    first, last = t.shape[i], t.shape[j]
    coarse = ((np.minimum(first, 127) * 131 + np.minimum(last, 127)) * 67 + np.minimum(n, 20)) * 4099 + signs
    parts = np.minimum(count["numbers"], 11)
    groups = [
        pattern,
        coarse % PATTERNS,
        n,
        n * 12 + parts,
        signs,
        n * 3 + check,
        np.minimum(count["."], 4) * 15 + np.minimum(count["numbers"], 4) * 3 + np.where(count["small"] == count["numbers"], 2, (count["small"] > 0).astype(int)),
        np.minimum(count["letters"], 39) * 3 + sum97,
        prev * 11 + np.minimum(n // 2, 10),
        nxt * 6 + then,
        named * 8 + np.searchsorted([1, 7, 9, 10, 12, 13, 16], n, side="right"),
        named * 130 + np.minimum(prev, 129),
        ((mail * 4 + dots) * 6 + np.minimum(t.letters[j], 5)) * 4 + goes_on,
        np.minimum(count[":"], 11) * 6 + np.minimum(count["hex"], 5) * (count[":"] > 0),
        crowd * 8 + np.minimum(parts, 7),
        (t.lead[i] * 12 + np.minimum(np.where(t.numeric[i], t.digits[i], 11), 11)) * 4 + then_left,
        np.minimum(count[":"], 11) * 40 + np.minimum(count["digits"] + count["letters"], 39) * (count[":"] > 1),
        mail * 5 + np.clip(count["words"] - spelled - dotted - count["at"] - count["dot"] + 1, 0, 4),
        np.zeros(len(i), np.int64),
    ]
    return np.array([g + o for g, o in zip(groups, OFFSETS)], np.int32).reshape(len(groups), len(i))


# --- the field -------------------------------------------------------------------------------


class Field:
    """Weights of features by type, what two entities side by side add, and ``caution``, taken from each entity."""

    def __init__(self, weights: np.ndarray, beside: float, caution: float = 0.0):
        self.weights, self.beside, self.caution = weights.astype(np.float32), beside, caution

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Segments x types over outside."""
        out = np.zeros((found.shape[1], len(TYPES)), np.float32)
        for row in found:
            out += self.weights[row]
        return out - self.caution

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Entities of the best cut of each text."""
        out: list[list[Span]] = []
        for group in together(texts):
            tokens = Tokens(group)
            found: list[list[Span]] = [[] for _ in group]
            i, j = candidates(tokens)
            if len(i):
                score = self.scores(features(tokens, i, j))
                kind, best = score.argmax(axis=1), score.max(axis=1)
                live = np.nonzero(best > -max(self.beside, 0.0))[0]
                for k in best_cut(i[live], j[live] + 1, best[live], self.beside):
                    k = live[k]
                    start, end = int(tokens.start[i[k]]), int(tokens.end[j[k]])
                    text = int(np.searchsorted(tokens.base, start, side="right")) - 1
                    found[text].append((start - int(tokens.base[text]), end - int(tokens.base[text]), TYPES[kind[k]]))
            out += found
        return out

    def all_spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans; and those with the field's spans that lie in none of them, by kind, then start."""
        texts = [t or "" for t in texts]
        out = []
        for text, more in zip(texts, self.spans(texts)):
            base = base_spans(text)
            if more and base:
                starts, reach = [], []
                for start, end, _ in sorted(base):
                    starts.append(start)
                    reach.append(max(end, reach[-1] if reach else 0))
                more = [s for s in more if not (k := bisect_left(starts, s[0] + 1)) or reach[k - 1] < s[1]]
            out.append((base, sorted(base + more, key=lambda s: (TYPES.index(s[2]), s[:2]))))
        return out


def best_cut(start: np.ndarray, end: np.ndarray, score: np.ndarray, beside: float) -> list[int]:
    """Indices of the entities of the best cut, in order; tokens outside score 0."""
    order = np.lexsort((start, end)).tolist()
    ends: list[int] = []  # ends of entities so far, and for each the best cut of all up to there and of those that end there
    upto: list[tuple[float, tuple | None]] = []
    exact: list[tuple[float, tuple | None]] = []
    for k in order:
        s, e, own = int(start[k]), int(end[k]), float(score[k])
        at = bisect_left(ends, s)
        value, path = upto[at - 1] if at else (0.0, None)
        if at < len(ends) and ends[at] == s:
            before, other = exact[at]
            if before + beside > value:
                value, path = before + beside, other
        here = (value + own, (k, path))
        if not ends or ends[-1] < e:
            ends.append(e)
            upto.append(upto[-1] if upto else (0.0, None))
            exact.append((-np.inf, None))
        if here[0] > exact[-1][0]:
            exact[-1] = here
        if here[0] > upto[-1][0]:
            upto[-1] = here
    chosen, path = [], upto[-1][1] if upto else None
    while path:
        chosen.append(path[0])
        path = path[1]
    return chosen[::-1]


# --- what the field is fitted on ---------------------------------------------------------------

_COMMON = "the of a in and to for is with by as was from that it or be this are an on not have were which will can all one has been their more if when who two may other new some".split()


def _digits(r: random.Random, pattern: str) -> str:
    """The pattern with a random digit for each d, one from 1 to 9 for each D and a random hexadecimal digit for each h."""
    return re.sub("[dDh]", lambda m: r.choice({"d": "0123456789", "D": "123456789", "h": "0123456789abcdef"}[m[0]]), pattern)


def _word(r: random.Random) -> str:
    if r.random() < 0.5:
        return r.choice(_COMMON)
    w = "".join(r.choice("bcdfglmnprstv") + r.choice("aeiouéü" if r.random() < 0.1 else "aeiou") for _ in range(r.randrange(1, 5)))
    return w.capitalize() if r.random() < 0.15 else w


def _card(r: random.Random) -> str:
    pattern = r.choice(["dddd dddd dddd dddd", "dddddddddddddddd", "dddd-dddd-dddd-dddd", "dddd.dddd.dddd.dddd", "dddd_dddd_dddd_dddd", "dddd/dddd/dddd/dddd", "dddd dddddd ddddd", "dddd-dddddd-ddddd", "ddddddddddddddd", "dddd dddddd dddd"])
    made = r.choice("3456") + _digits(r, pattern[1:])
    return next(m for c in "0123456789" if luhn((m := made[:-1] + c).translate(str.maketrans("", "", " -._/"))))


def _account(r: random.Random) -> str:
    head, bare = r.choice("DE GB FR ES NL CH IT AT PL BE".split()), _digits(r, "d" * r.choice([11, 14, 16, 18, 20, 23]))
    if r.random() < 0.4:
        bare = "".join(r.choice("ABCDEKLMNRSTW") for _ in range(4)) + bare[4:]
    check = 98 - int("".join(str(int(c, 36)) for c in bare + head + "00")) % 97
    made = f"{head}{check:02}{bare}"
    return " ".join(made[k : k + 4] for k in range(0, len(made), 4)) if r.random() < 0.6 else made


def _address(r: random.Random) -> str:
    part = lambda: str(r.randrange(256))
    group = lambda: _digits(r, "h" * r.choice([1, 2, 3, 4, 4, 4])).lstrip("0") or "0"
    groups = [group() for _ in range(8)]
    k = r.randrange(1, 6)
    return r.choice([".".join(part() for _ in range(4)), "[.]".join(part() for _ in range(4)), ":".join(groups), "2001:db8:" + ":".join(groups[2:]), f"{':'.join(groups[:k])}::{':'.join(groups[k + 2 :])}", f"fe80::{group()}:{group()}"])


def _mail(r: random.Random) -> str:
    name = r.choice([_word(r).lower(), f"{_word(r)}.{_word(r)}".lower(), _word(r).lower() + _digits(r, "dd"), f"{_word(r)}_{_word(r)}".lower()])
    host, end = r.choice([_word(r).lower(), f"{r.choice(['mail', 'müller', 'büro'])}.{_word(r)}".lower()]), r.choice("com org net de fr io edu".split())
    left, right = r.choice([("[", "]"), ("(", ")"), ("{", "}"), ("<", ">")])
    gap, word = r.choice(["", " "]), r.choice(["at", "AT"])
    dot = f"{gap}{left}dot{right}{gap}" if r.random() < 0.6 else "."
    return r.choice([f"{name}@{host}.{end}", f"{name}{gap}{left}{word}{right}{gap}{host.replace('.', dot)}{dot}{end}", f"{name.replace('.', ' dot ')} at {host.replace('.', ' dot ')} dot {end}", f"{name} @ {host}.{end}", f"{name}é@{host}.{end}"])


#: Forms of phone numbers that are plain by themselves, and those that only words around them tell.
_PLAIN = ["(Ddd) ddd-dddd", "Ddd-ddd-dddd", "1-Ddd-ddd-dddd", "+D (Ddd) ddd-dddd", "+DD Ddd ddddddd", "+DD (0) Ddd dddddd", "+DDdddddddddd", "00DD Ddd ddddddd", "0D dd dd dd dd", "(0Ddd) dddddd", "1 (Ddd) ddd-dddd"]
_TOLD = ["Ddd.ddd.dddd", "Ddd ddd dddd", "0Ddd ddddddd", "0Ddd/dddddd", "0Dddd dddddd", "DDd-dddd", "0Ddddddddd", "Ddd ddddddd"]
_NUMBERS = [
    "20dd-0D-1d", "1d.0D.20dd", "1d/0D/20dd", "20dd0D1d", "20dd-0D-1dT1d:2d:3d", "20dd-0D-1d 1d:2d:3d", "20dd-0D-1d 1d:2d:3d.ddddddZ", "[1d/0D/20dd:1d:2d:3d +0d00]", "1d:2d:3d", "1d:2d:3d,ddd", "19dd-20dd", "D.d.d", "10.0.19ddd.Dddd", "D.Dd.0-Ddd", "v20dd.Dd.Dd", "Ddddd.Dddd.D", "20dd.0D.0D.0D.Dddd",
    "978-D-Dd-dddddd-d", "978Dddddddddd", "Dddd-dddd", "0.dddddddddddd", "-0.dddddddd", "D.dddddddddddddd", "D.ddddddde+0d", "Dd.dddddd Dd.dddddd", "Dd.dddd, -Dd.dddd", "Ddd Ddd Ddd Ddd", "Dd Ddd Ddd", "D,ddd,ddd.dd", "D.ddd.ddd,dd", "Ddd-ddd", "Dd-dddd-dd", "Ddddd-dddd", "Dd-Dddd-Dd-D", "Ddddddd", "Ddddddddd", "17dddddddd", "17ddddddddddd", "Dddddddddddddddddddd",
    "000000000000", "01010101", "0101010101010101", "0001 0010 0100 1000", "hhhhhhhh-hhhh-4hhh-ahhh-hhhhhhhhhhhh", "hh:hh:hh:hh:hh:hh", "hh hh hh hh hh hh hh hh", "0xhhhhhhhh", "hhhhhhhhhhhhhhhh", "#hhhhhh", "D::D", "[::D]", "D:Dd:Dd:D", "Dd:Dd", "a::b::c", "std::map::at", "x::before", "face::bead", "abc::def::add", "D/D/D", "/20dd/0D/1d/", "Dd/Dd/Dd/Dd", "Dd-CV-1d-Ddddd", "Dd-ddd-dd-dd-dddd",
    "ORD-20dd-00ddddd", "DdxDd", "(Dddddddd)", "(Ddddd, Ddddd)", "[Ddd, Ddd, Ddd]", "Ddd+Ddd-Ddd", "Ddddd-Ddddd", "D-D-D-D-D-D-D-D", "1.2.3.4.5.6.7.8", "D.D.D.D.D", "1.3.6.1.4.1.Dddd.Dd", "2.5.29.Dd.Dd.Dd.D", "Ddd(Dd):Ddd-Ddd (20dd)", "Ddd(Ddd) Ddd.Ddd", "+Ddd", "+Dd.ddd -Dd.ddd", "+0d00", "+Ddd,Dd -Ddd,Dd", "@@ -Ddd,Dd +Ddd,Dd @@", "(+Ddd -Dd)", "f(Ddd) = Ddd.dddd", "Ddd / Ddd / Dddd", "RFC D.D (Ddd) Dddd", "AB12 CDEF GH34 IJ56 KL", "ISO8859 UTF16 CP12dd MIME12dd", "E1 E2 E3 E4 E5 E6 E7 E8 E9 AB12 CD34", "ABCDEF0123456789ABCDEF", "SN12dd34dd56dd78dd",
]
_ATS = ["look at the end. Then", "meet at noon. The dot is", "@property", "@media (max-width: Dddpx)", "root@host:", "at example.com", "a dot at D.d and", "git@host", "@param x.y", "A @ B.T", "matmul at (D, D) dot", "x@y", "@app.route"]


def _entity(r: random.Random, kind: str) -> tuple[str, bool]:
    """An entity, and whether it needs a word that tells its type."""
    if kind == "phone":
        told = r.random() < 0.4
        return _digits(r, r.choice(_TOLD if told else _PLAIN)), told
    if kind == "card":
        made = _card(r)
        return made, sum(c.isdigit() for c in made) < 15
    if kind == "ssn":
        return _digits(r, r.choice(["Ddd-dd-dddd", "Ddd dd dddd", "Ddd-dd-dddd"])), True
    return {"ip": _address, "email": _mail, "iban": _account}[kind](r), False


def examples(seed: int, n: int, clean: float = 0.45) -> list[tuple[str, list[Span]]]:
    """Made-up texts of one to four lines with their entities; a share of them has none."""
    r, out = random.Random(seed), []
    lexicon = {k: LEXICON[TYPES.index(k) if k not in ("card", "phone") else {"card": 2, "phone": 3}[k]] for k in TYPES}
    for _ in range(n):
        bare, text, spans = r.random() < clean, "", []
        for _ in range(r.randrange(1, 5)):
            line = ""
            for _ in range(r.choice([1, 1, 2, 2, 3, 6])):
                line += " ".join(_word(r) for _ in range(r.choice([0, 1, 2, 4, 8])))
                line += r.choice([" ", " ", " ", ": ", ", ", " = ", "=", " (", ' "', "\t", ". ", "; ", "|", " | ", "  ", "# "]) if line or r.random() < 0.3 else ""
                if not bare and r.random() < 0.6:
                    kind = r.choice(TYPES)
                    made, told = _entity(r, kind)
                    if told or r.random() < 0.5:
                        cue = r.choice(lexicon[kind])
                        line += (cue.capitalize() if r.random() < 0.4 else cue.upper() if r.random() < 0.1 else cue) + r.choice([": ", " ", "=", ":", " is ", " no. ", " - ", ' "'])
                    spans.append((len(text) + len(line), len(text) + len(line) + len(made), kind))
                    line += made + r.choice(["", "", ".", ",", ")", '"', ";", " |", "!"])
                elif r.random() < 0.6:
                    if r.random() < 0.3:
                        line += r.choice(LEXICON[r.choice([6, 7, 7])]) + r.choice([" ", ": ", "=", " #"])
                    line += _digits(r, r.choice(_NUMBERS)) if r.random() < 0.9 else _digits(r, r.choice(_ATS))
                    line += r.choice(["", "", ".", ",", ")", '"', ";", " |", "!", "kg", "%"])
                elif r.random() < 0.25:
                    sep = r.choice([" ", ", ", "\t", " | ", ",", "; ", "  "])
                    line += sep.join(_digits(r, r.choice(["D", "Dd", "Ddd", "Dddd", "D.dd", "Ddddd", "0.ddd", "-D.d"])) for _ in range(r.randrange(3, 14)))
                line += " "
            text += line.rstrip(" ") + "\n"
        out.append((text, spans))
    return out


def fit(rows: list[tuple[str, list[Span]]], rounds: int = 60, decay: float = 3e-4, rate: float = 0.25) -> Field:
    """Weights of the highest likelihood of the rows' cuts, by adaptive steps over all rows.

    Forward and backward sums run over ends of segments, for all texts side by side.
    """
    texts = [t for t, _ in rows]
    t = Tokens(texts)
    i, j = candidates(t)
    found = features(t, i, j)
    first = np.searchsorted(t.start, t.base[:-1])  # first token of each text
    text = np.searchsorted(t.base, t.start[i], side="right") - 1
    s, e = i - first[text], j + 1 - first[text]
    size = np.diff(np.append(first, t.n))
    place = {(int(k), int(t.start[a] - t.base[k]), int(t.end[b] - t.base[k])): c for c, (k, a, b) in enumerate(zip(text, i, j))}
    gold = np.zeros((len(i), len(TYPES)))
    for k, (_, spans) in enumerate(rows):
        for start, end, kind in spans:
            if (k, start, end) in place:
                gold[place[k, start, end], TYPES.index(kind)] = 1
    by_end, by_start = ([np.nonzero(x == p)[0] for p in range(int(size.max()) + 1)] for x in (e, s))
    n, longest = len(texts), int(size.max())
    w = np.zeros((OFFSETS[-1], len(TYPES)))
    moved = np.full_like(w, 1e-8)
    flat = found.ravel()
    used = np.unique(flat)
    local = np.searchsorted(used, found)
    w, moved = w[used], moved[used]
    beside, low = -1.0, -1e30
    for _ in range(rounds):
        score = np.zeros((len(i), len(TYPES)))
        for row in local:
            score += w[row]
        own = np.logaddexp.reduce(score, axis=1)
        out_, ent = np.full((longest + 1, n), low), np.full((longest + 1, n), low)  # the last token outside, the last token of an entity
        out_[0] = 0
        for p in range(1, longest + 1):
            out_[p] = np.logaddexp(out_[p - 1], ent[p - 1])
            c = by_end[p]
            if len(c):
                np.logaddexp.at(ent[p], text[c], np.logaddexp(out_[s[c], text[c]], ent[s[c], text[c]] + beside) + own[c])
        total = np.logaddexp(out_, ent)[size, np.arange(n)]
        b_out, b_ent = np.full((longest + 1, n), low), np.full((longest + 1, n), low)
        b_out[size, np.arange(n)] = b_ent[size, np.arange(n)] = 0
        for p in range(longest - 1, -1, -1):
            inner = p < size
            onward = b_out[p + 1]
            more = np.full(n, low)
            c = by_start[p]
            if len(c):
                np.logaddexp.at(more, text[c], own[c] + b_ent[e[c], text[c]])
            b_out[p] = np.where(inner, np.logaddexp(onward, more), b_out[p])
            b_ent[p] = np.where(inner, np.logaddexp(onward, more + beside), b_ent[p])
        reach = np.logaddexp(out_[s, text], ent[s, text] + beside) + b_ent[e, text] - total[text]
        gap = np.exp(np.minimum(score + reach[:, None], 0)) - gold
        slope = np.stack([np.bincount(local.ravel(), np.tile(gap[:, k], len(local)), len(used)) for k in range(len(TYPES))], axis=1)
        slope += decay * n * w
        moved += slope**2
        w -= rate * slope / np.sqrt(moved)
    weights = np.zeros((OFFSETS[-1], len(TYPES)))
    weights[used] = w
    return Field(weights, beside)


@lru_cache(maxsize=1)
def field(seed: int = 12, n: int = 1200) -> Field:
    """The fitted field. ``caution`` is such that no entity is seen in other made-up texts that have none."""
    made = fit(examples(seed, n))
    clean = [text for text, _ in examples(seed + 1, 2 * n, clean=1.0)]
    t = Tokens(clean)
    i, j = candidates(t)
    made.caution = float(np.clip(made.scores(features(t, i, j)).max(initial=0.0), 0.0, 6.0))
    return made


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, tagger: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text.

    Spans are kind:start:end in code points, by kind, then start; the field's kinds iban and ssn
    come last, and its spans of the base kinds stand among the base spans. Null and empty texts
    have none. Repeated rows give repeated rows, and other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    tagger = tagger or field()

    def columns(texts: list[str | None]) -> list[pa.Array]:
        found = tagger.all_spans(texts)
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        return [*counts, pa.array([digest(base) for base, _ in found], pa.string()), pa.array([joined(every) for _, every in found], pa.string())]

    return map_texts(docs, columns, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def together(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group
