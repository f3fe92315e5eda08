r"""Secret scans with a linear-chain conditional random field.

Base patterns give the certain spans. Beside them every token of a text is tagged begin,
inside or outside of a secret from its shape, the part it stands in, the neighbouring
words and features of the whole text; the whole text is decoded at once by Viterbi, with
a start and an end step. A token is a run of letters and digits or a single sign; a secret
holds no white space, so a token after white space is never inside.

Features are computed from arrays of code points and Viterbi from max-plus products of
blocks of steps, so no token is handled by itself in Python.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groundwork.llm.common import map_texts

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that name a credential, found inside longer words too if they have five letters or more.
CREDENTIAL = "auth authorization bearer basic credential key secret token password passwd passphrase passcode pwd pass private access session cookie client signature jwt pin login".split()

OUT, BEGIN, INSIDE = 0, 1, 2
#: Texts are decoded together up to so many code points.
TOGETHER = 300_000
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# kinds of code points
_WHITE, _LOWER, _UPPER, _DIGIT, _OTHER, _SIGN = range(6)
_KIND = np.full(129, _SIGN, np.int8)  # 128 stands for all that is not ASCII
_KIND[[*range(9, 14), *range(28, 33)]], _KIND[128] = _WHITE, _OTHER
_KIND[97:123], _KIND[65:91], _KIND[48:58] = _LOWER, _UPPER, _DIGIT
_VOWEL, _RARE, _BREAK = (np.isin(np.arange(129), np.frombuffer(signs, np.uint8)) for signs in (b"aeiouyAEIOUY", b"jkqvwxyzJKQVWXYZ", b"=:\"'`()[]{}<>,;|"))
_SIZES = np.array([1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48])


def _size(n: np.ndarray) -> np.ndarray:
    """Size class of a length, 0 to 14."""
    return np.searchsorted(_SIZES, n, side="right")


def _share(part: np.ndarray, whole: np.ndarray, steps: int) -> np.ndarray:
    """part / whole in ``steps`` classes; 0 if there is no whole."""
    return np.minimum(part * steps // np.maximum(whole, 1), steps - 1)


def _runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(member.astype(np.int8), prepend=0, append=0)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def text_features(low: bytes) -> int:
    """Features of the whole text, shared by its tokens: signs of code, settings, many lines."""
    signs = sum(low.count(c) > 0 for c in (b"{", b"};", b"=>", b"import ", b"export ", b"def ", b"#!/"))
    lines, settings = low.count(b"\n") + 1, low.count(b"=") + low.count(b": ")
    return (min(signs, 2) * 3 + int(np.searchsorted([1, 6], settings))) * 3 + int(np.searchsorted([2, 9], lines))


class Tokens:
    """Tokens of texts that stand one after another: start, end, glued to the token before, first and last of a text, and the indices of their features (groups x tokens)."""

    #: Between two texts: more lines than a word's context crosses.
    GAP = "\n\n\n"

    #: Number of values of each feature group.
    GROUPS = (40 * 15, 41 * 41 * 2, 41 * 41 * 2, 16 * 15 * 2, 6 * 15 * 4, 8 * 15 * 2, 6 * 5 * 2 * 15, 8 * 3 * 16, 8 * 15 * 6, 26 * 6, 26 * 3 * 6, 27 * 6 * 2, 4 * 6 * 6, 7 * 6 * 15)
    OFFSETS = np.concatenate([[0], np.cumsum(GROUPS)])

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in texts]
        gap = np.full(len(self.GAP), 10, np.uint32)
        code = np.concatenate([part for x in raw for part in (x, gap)]) if raw else gap
        code = np.minimum(code, 128).astype(np.uint8)
        self.base = np.cumsum([0, *(len(x) + len(gap) for x in raw)])  # where each text begins
        kind = _KIND[code]
        solid, sign = kind != _WHITE, kind == _SIGN
        word = solid & ~sign
        firsts, lasts = sign | word, sign | word
        firsts[1:] &= sign[1:] | ~word[:-1]
        lasts[:-1] &= sign[:-1] | ~word[1:]
        self.start, self.end = np.nonzero(firsts)[0].astype(np.int32), np.nonzero(lasts)[0].astype(np.int32) + 1
        n = len(self.start)
        self.text = np.searchsorted(self.base, self.start, side="right") - 1
        self.first, self.last, self.glued = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
        if n:
            self.first[1:] = self.last[:-1] = self.text[1:] != self.text[:-1]
            self.glued[1:] = self.start[1:] == self.end[:-1]
            self.features = self._features(code, kind)

    def _features(self, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        start, end = self.start, self.end
        total = lambda member: np.concatenate([[0], np.cumsum(member, dtype=np.int32)])
        lower, upper, digit, other, vowel, rare = (total(m) for m in (kind == _LOWER, kind == _UPPER, kind == _DIGIT, kind == _OTHER, _VOWEL[code], _RARE[code]))
        turn = total(np.concatenate([[False], (kind[1:] != kind[:-1])]))
        of = lambda sums, a, b: sums.take(b) - sums.take(a)
        n = end - start
        lo, up, di, ot = (of(c, start, end) for c in (lower, upper, digit, other))
        letters, sign = lo + up, kind[start] == _SIGN
        # shapes: 0 lower, 1 capitalised, 2 upper, 3 mixed case, 4 digits, 5 to 7 letters with digits (lower, upper, mixed), 8 beyond ASCII, 9 and on signs
        signs = np.searchsorted(np.nonzero(_KIND == _SIGN)[0], code[start]).astype(np.int32) % 31
        case = np.where(up == 0, 0, np.where(lo == 0, 2, np.where((up == 1) & (kind[start] == _UPPER), 1, 3)))
        shape = np.where(sign, 9 + signs, np.where(ot > 0, 8, np.where(di == n, 4, np.where(di == 0, case, 5 + np.where(up == 0, 0, np.where(lo == 0, 1, 2))))))
        plain = (shape <= 2) & (n <= 24) & (5 * of(vowel, start, end) >= n) & (4 * of(vowel, start, end) <= 3 * n + 3) & (10 * of(rare, start, end) <= 3 * n + 7) | (shape == 8)
        # parts: runs without white space and marks that separate
        a, b = _runs((kind != _WHITE) & ~_BREAK[code])
        at = np.searchsorted(b, start, side="right")
        at = np.minimum(at, max(0, len(a) - 1))
        inside = (a[at] <= start) & (end <= b[at]) if len(a) else np.zeros(len(start), bool)
        if not len(a):
            a, b = np.zeros(1, int), np.zeros(1, int)
        long = b - a
        p_lo, p_up, p_di, p_vo, p_ra = (of(c, a, b) for c in (lower, upper, digit, vowel, rare))
        p_le, p_ot = p_lo + p_up, of(other, a, b)
        mask = (p_lo > 0) + 2 * (p_up > 0) + 4 * (p_di > 0) + 8 * (long > p_le + p_di + p_ot)
        wordy = np.bincount(at[inside], (n * plain)[inside], len(a)).astype(int)
        count = np.bincount(at[inside], minlength=len(a))
        p_plain = np.where(long > 0, _share(wordy, np.maximum(p_le + p_ot + p_di, 1), 5), 0) + (wordy > 0)  # 0 none to 5 nearly all
        turns = _share(of(turn, np.minimum(a + 1, b), b), long, 8)
        per = lambda x: np.where(inside, x[at], 0)
        size, m, pl = per(_size(long)), per(mask), per(p_plain)
        # credential words before and after
        low = np.where(kind == _UPPER, code + 32, code).tobytes()
        name = np.zeros(len(start), np.int32)
        for k, w in enumerate(CREDENTIAL, 1):
            needle, i = w.encode(), low.find(w.encode())
            found = []
            while i >= 0:
                found.append(i)
                i = low.find(needle, i + 1)
            if found:
                t = np.searchsorted(start, found, side="right") - 1
                whole = (start[t] == found) & (end[t] == np.array(found) + len(w)) | (len(w) >= 5)
                name[t[whole]] = k
        here = np.arange(len(start), dtype=np.int32)
        last = np.maximum.accumulate(np.where(name > 0, here, -1))
        line = total(code == 10)[start]
        near = (last >= 0) & (line - line[last] <= 1)
        gap = np.where(near, np.minimum(np.searchsorted([1, 2, 3, 4, 6, 10], here - last, side="right"), 6), 7)
        named = np.where(near & (here - last <= 9), name[last], 0)
        sets = total((code[start] == 61) | (code[start] == 58))
        sets = np.where(near, np.minimum(sets[here] - sets[np.maximum(last, 0)], 2), 0)
        ahead = np.concatenate([name[1:], [0]])
        ahead = np.where(ahead > 0, ahead, np.concatenate([name[2:], [0, 0]])[: len(name)])
        ahead[self.last] = 0
        shape = shape.astype(np.int32)
        prev, nxt = np.full(len(shape), 40, np.int32), np.full(len(shape), 40, np.int32)
        prev[1:], nxt[:-1] = shape[:-1], shape[1:]
        prev[self.first] = nxt[self.last] = 40
        whole = np.array([text_features(low[i:j]) for i, j in zip(self.base[:-1], self.base[1:])], np.int32)[self.text]
        glue, glue_next = self.glued.astype(int), np.concatenate([self.glued[1:], [False]]).astype(int)
        first = inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]])
        final = inside & np.concatenate([(at[:-1] != at[1:]) | ~inside[1:], [True]])
        isword = (~sign).astype(int)
        groups = [
            shape * 15 + _size(n),
            (prev * 41 + shape) * 2 + glue,
            (nxt * 41 + shape) * 2 + glue_next,
            (m * 15 + size) * 2 + isword,
            (pl * 15 + size) * 4 + per(_share(p_di, long, 4)),
            (per(turns) * 15 + size) * 2 + isword,
            ((per(_share(p_vo * 10, p_le * 7, 6)) * 5 + per(_share(p_ra, p_le, 5))) * 2 + per((p_di > 0).astype(int))) * 15 + size,
            (gap * 3 + sets) * 16 + m,
            (gap * 15 + size) * 6 + pl,
            named * 6 + pl,
            (named * 3 + sets) * 6 + per(np.minimum(count, 5)),
            (whole * 6 + pl) * 2 + isword,
            (first * 2 + final) * 36 + per(np.minimum(count, 5)) * 6 + pl,
            ((ahead > 0) * 3 + np.minimum(sign * 2 + plain, 2)) * 90 + pl * 15 + size,
        ]
        out = np.empty((len(groups), len(start)), np.int32)
        for row, group, offset in zip(out, groups, self.OFFSETS):
            np.add(group, offset, out=row, casting="unsafe")
        return out


def viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best tags of chains that stand one after another; ``first`` marks the first token of each.

    Steps are matrices of a max-plus product. Blocks of about the square root of the
    number of steps are multiplied side by side, the blocks' products are applied one
    after another, and the ways back are followed in the blocks again.
    """
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    step = np.where(first[:, None, None], end[:, None] + begin[None, :], move)
    step[0] = np.where(np.arange(3)[:, None] == 0, begin[None, :], -1e9)  # from a single state before all
    step = step + emit[:, None, :]
    width = int(np.ceil(n**0.5))
    blocks = -(-n // width)
    same = np.where(np.eye(3) > 0, 0.0, -1e9)
    step = np.concatenate([step, np.broadcast_to(same, (blocks * width - n, 3, 3))]).reshape(blocks, width, 3, 3)
    lanes = np.ascontiguousarray(step.transpose(1, 2, 3, 0))  # step of a block, from, to, block
    product = lanes[0]
    for k in range(1, width):
        product = np.maximum(np.maximum(product[:, 0, None] + lanes[k, 0], product[:, 1, None] + lanes[k, 1]), product[:, 2, None] + lanes[k, 2])
    product = product.transpose(2, 0, 1)
    at = np.empty((blocks, 3))
    now = np.array([0.0, -1e9, -1e9])
    for k in range(blocks):
        at[k] = now
        now = (now[:, None] + product[k]).max(axis=0)
    came = np.empty((blocks, width, 3), np.int8)
    for k in range(width):
        options = at[:, :, None] + step[:, k]
        came[:, k] = options.argmax(axis=1)
        at = options.max(axis=1)
    back = np.tile(np.arange(3), (blocks, 1))
    for k in range(width - 1, -1, -1):
        back = np.take_along_axis(came[:, k], back, axis=1)
    tag = int(np.argmax(now + end))
    last = np.empty(blocks, np.int64)
    for k in range(blocks - 1, -1, -1):
        last[k] = tag
        tag = int(back[k, tag])
    tags, rows = np.empty((blocks, width), np.int8), np.arange(blocks)
    for k in range(width - 1, -1, -1):
        tags[:, k] = last
        last = came[rows, k, last]
    return tags.reshape(-1)[:n]


_RUN, _PART, _CASE = re.compile(r"[A-Za-z0-9]{12,}"), re.compile(r"[0-9]+|[A-Za-z]+"), re.compile(r"[0-9]+|[A-Z]+|[a-z]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Credentials' names in some other languages.
FOREIGN = "ключ пароль 密码 パスワード κωδικός mot_de_passe passwort contraseña hasło şifre".split()
_CREDENTIALS = re.compile("|".join(w if len(w) >= 5 else rf"(?<![a-z]){w}(?![a-z])" for w in [*CREDENTIAL, *FOREIGN]))
#: A name stands so many code points before its secret, on the same line.
NAMED_WITHIN = 60


def holds(text: str, start: int, end: int) -> bool:
    """The exact check behind the field: a span that nothing names has to look drawn at random.

    Named is what a credential's word stands before on its line, and the password of an address. The others
    need a run of 12 letters and digits that change places three times, or one of 16 that changes
    its case at every second place or so; a UUID by itself is a mere id.
    """
    before = text[max(text.rfind("\n", 0, start) + 1, start - NAMED_WITHIN) : start]
    if _CREDENTIALS.search(before.lower()) or "://" in before and text[start - 1 : start] == ":" and text[end : end + 1] == "@":
        return True
    drawn = lambda run: len(_PART.findall(run)) >= 4 or len(run) >= 16 and 2.2 * len(_CASE.findall(run)) >= len(run)
    return not _UUID.fullmatch(text, start, end) and any(map(drawn, _RUN.findall(text, start, end)))


class Tagger:
    """Weights of the field: feature x tag, tag to tag, start and end. ``caution`` is taken from the score of each begin."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray, caution: float = 0.0):
        self.move, self.begin, self.end, self.caution = move, begin, end, caution
        over = (emit[:, 1:] - emit[:, :1]).astype(np.float32)  # begin and inside over outside, in one number
        self.over = np.ascontiguousarray(over).view(np.complex64).ravel()
        # the most that a begin or an inside token can gain over outside by the steps to and from it
        into, out = move - move[OUT, OUT], np.maximum(move[:, OUT] - move[OUT, OUT], 0)
        edge = np.maximum(begin - begin[OUT], 0).max() + np.maximum(end - end[OUT], 0).max()
        self.gain = [float(max(into[:, t].max(), 0) + out.max() + edge) for t in (BEGIN, INSIDE)]

    def scores(self, tokens: Tokens) -> np.ndarray:
        """begin and inside over outside: tokens x 2."""
        score = np.zeros(len(tokens.start), np.complex64)
        for feature in tokens.features:
            score += self.over.take(feature)
        score = score.view(np.float32).reshape(-1, 2).astype(float)
        score[:, 0] -= self.caution
        score[~tokens.glued, 1] = -1e6
        return score

    def tags(self, tokens: Tokens) -> np.ndarray:
        """Viterbi over the whole of each text.

        A secret lies in a run without white space. Where even the best begin of a run and
        all that its tokens might add stay below outside, the run is outside on the best
        path; such tokens, but for those next to others, are left out of the product.
        """
        n = len(tokens.start)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.scores(tokens)
        heads = np.nonzero(~tokens.glued)[0]
        more = np.maximum(np.maximum(score[:, 0] + self.gain[0], score[:, 1] + self.gain[1]), 0)
        open_ = (np.maximum.reduceat(score[:, 0], heads) + self.gain[0] > 0) | (np.maximum.reduceat(score[:, 0], heads) + self.gain[0] + np.add.reduceat(more, heads) > 0)
        live = np.repeat(open_, np.diff(np.append(heads, n)))
        keep = live | tokens.first | tokens.last
        keep[1:] |= live[:-1]
        keep[:-1] |= live[1:]
        emit = np.zeros((int(keep.sum()), 3))
        emit[:, 1:] = np.where(live[keep, None], score[keep], -1e6)
        tags[keep] = viterbi(emit, tokens.first[keep], self.move, self.begin, self.end)
        return tags

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans that the field tags as secrets, of each text."""
        out: list[list[Span]] = []
        for group in _together(texts):
            tokens, found = Tokens(group), [[] for _ in group]
            tags = self.tags(tokens)
            for i in np.nonzero(tags == BEGIN)[0].tolist():
                j = i
                while j + 1 < len(tags) and tags[j + 1] == INSIDE:
                    j += 1
                k = int(tokens.text[i])
                start, end = int(tokens.start[i] - tokens.base[k]), int(tokens.end[j] - tokens.base[k])
                if holds(group[k], start, end):
                    found[k].append((start, end, "crf"))
            out += found
        return out

    def all_spans(self, texts: list[str | None]) -> list[list[Span]]:
        """Base spans, and the field's spans that lie in none of them; the two may overlap."""
        texts = [t or "" for t in texts]
        out = []
        for text, more in zip(texts, self.spans(texts)):
            base = base_spans(text)
            if base and more:
                starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
                # of the base spans that start at a span's start or before, does any reach its end?
                more = [s for s in more if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[1]]
            out.append(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
        return out


def _together(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


#: What made-up words are made of.
SYLLABLES = "an er th ing on the re st ed sch ung ein ion que es la ment tre ou ci ver heit lich con ar en ti al le de ja mi so qu pf ze wa ky".split()
#: Names of credentials that programs give to variables, which hold none in their source.
_VARIABLES = "token tokens password passwd secret key keys auth session pass pwd credentials cookie login signature api_key secret_key access_token client_secret private_key passphrase".split()


def program_line(r: random.Random, made: Callable[[], str], talk: Callable[[int, int], str]) -> str:
    """A made-up line of a program, a query, a table or a licence: long names, paths, formats and rulers, and no secret."""
    draw = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    snake = lambda: r.choice(_VARIABLES) if r.random() < 0.15 else "_".join(made() for _ in range(r.choice([1, 1, 2, 3, 4])))
    camel = lambda: "".join(made().capitalize() for _ in range(r.choice([1, 2, 3, 4, 5]))) + r.choice(["", "", "", "Error", "XML", "HTTP", "2", "Base"])
    small = lambda: made() + "".join(made().capitalize() for _ in range(r.choice([1, 2, 3])))
    const = lambda: "_".join(made().upper() for _ in range(r.choice([1, 2, 3]))) + r.choice(["", "", "_8", "32", "2"])
    long = lambda: "".join(made() for _ in range(r.choice([2, 3, 4])))
    name = lambda: r.choice([snake, snake, snake, camel, small, const, long])()
    dotted = lambda: ".".join(r.choice([snake, snake, camel])() for _ in range(r.choice([2, 2, 3, 4])))
    path = lambda: r.choice(["/", "./", "", "../", "C:\\\\"]) + r.choice("/-").join(made() for _ in range(r.choice([2, 3, 4, 5]))) + r.choice(["", ".py", ".sql", ".html", ".c", "/", ".tar.gz", "-0.1.2"])
    url = lambda: r.choice(["http://", "https://", "git+https://"]) + r.choice(["www.", "docs.", "bugs.", ""]) + made() + r.choice([".org/", ".com/", ".net/"]) + "/".join(r.choice([made(), made().upper() + "-2.0", f"{made()}-{made()}", str(r.randint(1, 99999)), f"{made()}.html#{made()}-{made()}"]) for _ in range(r.choice([1, 2, 3])))
    locale = lambda: f"{draw('abcdefgh', 2)}_{draw('ABCDEFGH', 2)}.{r.choice(['ISO8859-1', 'ISO8859-15', 'UTF-8', 'utf8', 'KOI8-R', 'CP1251', 'eucJP'])}"
    date = lambda: r.choice([f"{r.randint(1, 31):02}-{r.choice('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split())}-{r.randint(1, 2030):04}", f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{draw('0123456789', 6)}"])
    mark = lambda: r.choice(["%s", "%-20s", "%(name)s", "{}", "{0!r:>10}", "{name}", "%r", "\\\\x00", "\\\\u0130", "[A-Za-z0-9_]+", "^[-+]?\\\\d+$", "$1", "&amp;", "<br/>", "0x1f", "0xFFFFFFFF", "1e-10"])
    number = lambda: r.choice([str(r.randint(0, 99)), str(r.randint(100, 10**9)), f"{r.random():.{r.randint(2, 15)}f}", f"0x{draw('0123456789abcdef', r.choice([2, 4, 8]))}", draw("0123456789", r.choice([11, 12, 13, 14])), f"{draw('0123456789', 2)}-{draw('0123456789', 3)}-{draw('0123456789', 2)}-{draw('0123456789', 4)}"])
    value = lambda: r.choice([name, name, dotted, number, number, path, url, locale, date, mark, lambda: f"{name()}({name()})", lambda: "None", lambda: f"{dotted()}({name()}={number()})", lambda: f"[{number()}:{number()}]", lambda: f"{made()}/{made()}-{made()}-{made()}", lambda: f"{made()}-{made()}-{made()}"])()
    quoted = lambda: r.choice("'\"") + r.choice([value, value, lambda: talk(1, 6), lambda: mark() + name() + mark()])() + r.choice("'\"")
    ruler = lambda: r.choice(["=", "=", "=", "-", "-", "#", "*", "~", "_", "=-", "+-", ". "]) * r.choice([r.randint(3, 30), r.randint(3, 30), r.randint(3, 90)])
    pad = "    " * r.choice([0, 0, 1, 1, 2, 3])
    return pad + r.choice([
        lambda: f"def {name()}({', '.join(name() + r.choice(['', '=None', ': str', f': {camel()} = None']) for _ in range(r.randint(0, 4)))}):",
        lambda: f"{name()} = {value()}", lambda: f"{r.choice(_VARIABLES)} = {r.choice([name, dotted])()}({name()})", lambda: f"{name()} = {quoted()}", lambda: f"{dotted()} = {dotted()}({quoted()}, {name()}={value()})", lambda: f"self.{snake()}={value()}",
        lambda: f"import {name()}, {dotted()}", lambda: f"from {dotted()} import {camel()}, {name()} as {name()}", lambda: f"class {camel()}({camel()}):", lambda: f"raise {camel()}({quoted()})", lambda: f"if {name()} is None and {dotted()} != {quoted()}:", lambda: f"return {dotted()}[{number()}], {quoted()}",
        lambda: f"{quoted()}: {quoted()},", lambda: f"{quoted()}: {value()},", lambda: ", ".join(quoted() for _ in range(r.randint(2, 8))), lambda: ", ".join(number() for _ in range(r.randint(2, 12))) + ",", lambda: f"'{locale().lower()}': '{locale()}',", lambda: " ".join(name() for _ in range(r.randint(2, 9))),
        lambda: f"#define {const()} {value()}", lambda: f"--{'-'.join(made() for _ in range(3))}={value()}", lambda: f"# {talk(2, 10)} `{dotted()}`", lambda: f":param {snake()}: {talk(2, 8)}", lambda: f"@{dotted()}({quoted()})", lambda: f"assert {name()}({value()}) == {value()}", lambda: f"{name()}={value()}&{name()}={number()}",
        lambda: f"SELECT {name()}, {dotted()} AS {name()} FROM {dotted()} WHERE {name()} = {quoted()} AND {name()} ~ {quoted()};", lambda: f"CREATE INDEX IF NOT EXISTS {snake()}_{snake()}_idx ON {dotted()} ({name()}, {name()});", lambda: f"ALTER TABLE {dotted()} ADD CONSTRAINT {snake()}_{snake()}_key UNIQUE ({name()});", lambda: f"-- {talk(1, 8)}: {value()} -> {value()}",
        lambda: ruler(), lambda: f"# {ruler()}", lambda: f"-- {ruler()}", lambda: f"/* {ruler()} */", lambda: f"{ruler()} {talk(1, 4)} {ruler()}", lambda: f"# === {talk(1, 4)} {'=' * r.randint(3, 60)}", lambda: "|" + "|".join(r.choice(["---", ":--", f" {value()} ", f" {talk(1, 3)} "]) for _ in range(r.randint(2, 6))) + "|",
        lambda: f"+{'-' * r.randint(3, 30)}+{'=' * r.randint(3, 30)}+", lambda: talk(4, 12).upper() + f" ({url()}).", lambda: f"{talk(2, 6)} <{url()}>",
    ])()


def examples(n: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts of several lines with the spans of their secrets."""
    r = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum, upper = lower.upper() + lower + digits, lower.upper() + digits
    b64 = alnum + "+/"
    common = "the of and to a in is that it for der die und den von zu de la le et les que el en y los por was with on est".split()
    draw = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    made = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 5)))
    word = lambda: r.choice(common) if r.random() < 0.45 else made() + (r.choice(["é", "ü", "ñ", ""]) if r.random() < 0.05 else "")
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    leet = lambda: "".join({"a": "4", "e": "3", "i": "1", "o": "0"}.get(c, c) if r.random() < 0.4 else c.upper() if r.random() < 0.15 else c for c in made() + made())
    strong = [
        lambda: draw(b64, r.randint(28, 90)) + "=" * r.randint(0, 2),
        lambda: draw(alnum, r.randint(20, 80)),
        lambda: draw(alnum + "-_", r.randint(24, 44)),
        lambda: f"{draw(lower, r.randint(2, 3))}_{r.choice(['live', 'test', 'prod'])}_{draw(alnum, r.randint(20, 30))}",
        lambda: f"{draw(lower, 3)}_{draw(alnum, 36)}",
        lambda: f"xoxb-{draw(digits, 12)}-{draw(alnum, 24)}",
        lambda: f"eyJ{draw(alnum, 20)}.eyJ{draw(alnum, 40)}.{draw(alnum + '-_', 32)}",
        lambda: draw(upper, r.randint(20, 32)),
        lambda: draw(digits + "ABCDEF", r.choice([32, 40, 56, 72])),
        lambda: draw(lower + digits, r.randint(24, 40)),
    ]
    weak = [
        lambda: draw(alnum, r.randint(10, 18)),
        lambda: draw(lower + digits, r.randint(10, 16)),
        lambda: draw(alnum + "!@#$%^&*", r.randint(9, 18)),
        lambda: draw(lower, r.randint(16, 40)),
        lambda: draw(lower + lower.upper(), r.randint(16, 40)),
        lambda: draw(digits, r.randint(12, 24)),
        lambda: "-".join(draw(signs, r.randint(4, 8)) for signs in [r.choice([upper, lower + digits])] * r.randint(3, 6)),
        lambda: f"{leet()}{r.randint(1, 9999)}{r.choice(['', '!', '?', '&', '#', '$x'])}{draw(alnum, r.randint(0, 5))}",
        lambda: f"{made()}{r.randint(1, 99)}{made()}{r.randint(1, 99)}{r.choice(['', '!', '!!', '@', '%'])}",
        lambda: f"{made().capitalize()}{r.choice('-_.!&')}{made().capitalize()}{r.choice('-_.!&')}{r.randint(10, 9999)}{r.choice(['', '!', '#', '?'])}{draw(alnum, r.choice([0, 0, 2, 4]))}",
    ]
    plain = [
        lambda: f"{made()}-{made()}-{r.randint(1, 99)}-{made()}",
        lambda: f"{made()}_{made()}_{made()}_{r.randint(0, 2030)}",
        lambda: f"{r.choice(['https://', 'http://', ''])}www.{made()}{made()}.com/{made()}/{r.randint(1, 9999)}/{made()}{r.choice(['', '.html', '?id=' + str(r.randint(1, 99999)), '#' + made()])}",
        lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z",
        lambda: f"{made()}.{r.randint(1, 99)}@{made()}{r.randint(1, 9)}.{made()}.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{made()}{made()}{made()}{made()}{made()}",
        lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{made()}.{r.randint(1, 9)}",
        lambda: f"/{made()}/{made()}/{made()}{r.randint(1, 20)}.{r.choice(['py', 'txt', 'jpg'])}",
        lambda: draw(digits, r.choice([4, 8, 10, 12, 13, 15, 16, 16, 16, 20])),
        lambda: " ".join(draw(digits, 4) for _ in range(4)),
        lambda: f"+{r.randint(1, 99)} ({draw(digits, 3)}) {draw(digits, 3)}-{draw(digits, 4)}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: f"{draw(lower.upper(), 2)}{draw(digits, r.randint(14, 22))}",
        lambda: "".join(w.capitalize() for w in (made(), made(), made())),
        lambda: f"{made().upper()}_{made().upper()}_{r.randint(1, 9)}",
        lambda: made() + draw("#*$%&", 1) * 3,
        lambda: r.choice("#*$%&-=~|") * r.randint(3, 40),
        lambda: f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}",
        lambda: f"{r.randint(1, 999)}.{draw(digits, 6)},{r.randint(1, 99)}",
        lambda: f"{made()}({made()}, {r.randint(0, 9)});",
        lambda: f"#{draw('0123456789abcdef', 6)}",
        lambda: draw(lower.upper(), r.randint(2, 9)),
        lambda: f"{r.choice(['true', 'false', 'none', 'required', 'disabled', 'changed', 'default', 'count', '****'])}",
    ]
    named = ["key", "secret_key", "secret", "auth", "Authorization: Bearer", "authorization: Basic", "client_secret", "pwd", "passwd", "password", "PASSWORD", "access_key", "private key", "session", "token", "api token", "db pass", "passphrase", "cookie", "login", "credential"]
    other = ["name", "path", "id", "see", "file", "user", "page", "size", "title", "url", "host", "version", "date", "mail", "phone", "card", "count", "address", "key", "session", "token", "pass", "login", "secret"]
    prefixes = ["", "", "", "DB_", "my ", "the ", "app.", "export ", "- ", '  "', "user ", "admin "]
    links = [" = ", "=", ": ", ":", " ", " is ", ' = "', "='", '": "', " => ", " -> ", " was ", " ist ", " es "]
    native = [w.capitalize() if r.random() < 0.3 else w for w in FOREIGN]
    out = []
    for k in range(n):
        text, spans = "", []
        if k % 5 < 2:  # programs, queries, tables and licences, nearly all without a secret
            for _ in range(r.choice([1, 2, 4, 8])):
                if r.random() < 0.04:
                    lead = r.choice(["", "    ", "self.", "export "]) + r.choice(named) + r.choice([" = '", '="', "=", ": "])
                    body = r.choice(strong + weak)()
                    spans.append((len(text) + len(lead), len(text) + len(lead) + len(body)))
                    text += lead + body
                    text += "\n"
                else:
                    text += program_line(r, made, some) + r.choice(["", "", ",", ";", ")", "\n"]) + "\n"
            out.append((text, spans))
            continue
        code = r.random() < 0.35
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            lead, tail = ("" if code and r.random() < 0.7 else some(0, 7)), ("" if code and r.random() < 0.7 else some(0, 7))
            lead += " " if lead else ""
            kind = r.random()
            end = r.choice(["", "", ".", " ", '"', ";", ",", "'", " #"])
            special = r.random()
            if special < 0.02:  # a password in an address
                body = r.choice(weak)().replace("@", "").replace("/", "").replace(":", "").replace("#", "")
                lead += f"{r.choice(['postgres', 'mysql', 'redis', 'amqp', 'mongodb+srv', 'https', 'ftp'])}://{made()}:"
                spans.append((len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += f"{lead}{body}@{made()}.{made()}{r.choice([':5432', '', '.com'])}/{made()} {tail}\n"
                continue
            if special < 0.03:  # the lines of a private key
                text += f"-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----\n"
                for _ in range(r.randint(1, 4)):
                    body = draw(b64, 64)
                    spans.append((len(text), len(text) + 64))
                    text += body + "\n"
                text += "-----END PRIVATE KEY-----\n"
                continue
            if special < 0.08:  # named in another script or language
                lead += r.choice(native) + r.choice([" = ", ": ", "=", " ist "])
                body = r.choice(strong + weak[:3])()
                spans.append((len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += f"{lead}{body} {tail}\n"
                continue
            if kind < 0.22 or kind < 0.45 and code:
                named_here = r.random() < 0.75
                body = r.choice(strong)() if not named_here or r.random() < 0.4 else r.choice(weak)()
                lead += r.choice(prefixes) + r.choice(named) + r.choice(links) if named_here else r.choice(["", '"', "(", "see "])
                spans.append((len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += f"{lead}{body}{end} {tail}\n"
            elif kind < 0.7:
                lead += r.choice(prefixes) + r.choice(other if r.random() < 0.6 else named) + r.choice(links) if r.random() < 0.5 else ""
                text += f"{lead}{r.choice(plain)()}{end} {tail}\n"
            else:
                talk = some(4, 16)
                if r.random() < 0.3:
                    talk += f" {r.choice(named)} {some(1, 6)}"
                text += f"{talk.capitalize()}{r.choice(['.', ',', '!', '', ' |'])}\n"
        out.append((text.rstrip("\n") if r.random() < 0.5 else text, spans))
    return out


@lru_cache(maxsize=1)
def train(n: int = 1000, steps: int = 50, decay: float = 1e-3, caution: float = 0.0) -> Tagger:
    """Conditional likelihood on ``examples`` by full-batch Adam, whole texts padded into one array."""
    made = [m for m in ((Tokens([t]), spans) for t, spans in examples(n)) if len(m[0].start)]
    made.sort(key=lambda m: len(m[0].start))
    size, groups = len(made[-1][0].start), len(Tokens.GROUPS)
    at = np.zeros((groups, size, len(made)), np.int32)  # steps before texts
    gold, real, bar = np.zeros((size, len(made)), np.int64), np.zeros((size, len(made)), bool), np.zeros((size, len(made)), bool)
    for k, (t, spans) in enumerate(made):
        m = len(t.start)
        at[:, :m, k], real[:m, k], bar[:m, k] = t.features, True, ~t.glued
        for a, b in spans:
            mine = np.nonzero((t.start >= a) & (t.end <= b))[0]
            gold[mine, k] = INSIDE
            gold[mine[:1], k] = BEGIN
    values, flat = int(Tokens.OFFSETS[-1]), at[:, real]
    params = [np.zeros((values, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(3)]  # emit, move, begin, end
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    may_move, may_begin = np.ones((3, 3)), np.ones(3)
    may_move[OUT, INSIDE] = may_begin[INSIDE] = 0
    one, both = np.eye(3)[gold] * real[..., None], (real[1:] & real[:-1])[..., None, None]
    final = real & ~np.concatenate([real[1:], np.zeros((1, len(made)), bool)])
    live = [int(row.argmax()) for row in real]  # texts are in order of length: the first one that is this long
    seen = (one[:-1][..., :, None] * one[1:][..., None, :] * both).sum(axis=(0, 1))
    for step in range(1, steps + 1):
        emit, move, begin, end = params
        score = np.zeros((flat.shape[1], 3))
        for row in flat:
            score += emit.take(row, axis=0)
        e = np.zeros((size, len(made), 3))
        e[real] = np.exp(score - score.max(axis=1, keepdims=True))
        e[bar, INSIDE] = 0
        m, b = np.exp(move) * may_move, np.exp(begin) * may_begin
        fore, back = np.zeros_like(e), np.zeros_like(e)  # each step scaled to sum 1
        fore[0] = b * e[0]
        fore[0] /= fore[0].sum(axis=1, keepdims=True)
        for k in range(1, size):
            now = (fore[k - 1, live[k] :] @ m) * e[k, live[k] :]
            fore[k, live[k] :] = now / now.sum(axis=1, keepdims=True)
        back[final] = np.exp(end)
        for k in range(size - 2, -1, -1):
            now = (e[k + 1, live[k + 1] :] * back[k + 1, live[k + 1] :]) @ m.T
            back[k, live[k + 1] :] = now / now.sum(axis=1, keepdims=True)
        p = fore * back
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        pair = fore[:-1, :, :, None] * m * (e * back)[1:, :, None, :] * both
        pair = (pair / np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)).sum(axis=(0, 1))
        d = (p - one)[real]
        grads = [np.stack([sum(np.bincount(row, d[:, k], values) for row in flat) for k in range(3)], axis=1)]
        grads += [pair - seen, (p[0] - one[0]).sum(axis=0), (p - one)[final].sum(axis=0)]
        for param, g, (m1, m2) in zip(params, grads, moments):
            g = g / len(made) + decay * param
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            param -= 0.12 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    emit, move, begin, end = params
    return Tagger(emit, np.where(may_move > 0, move, -1e4), np.where(may_begin > 0, begin, -1e4), end, caution)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf: one row per input row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Equal texts
    have equal spans; repeated rows and null ids are rows like any other; an empty table
    gives an empty result. Whole texts are scanned, whatever their length.
    """
    tagger = tagger or train()

    def run(texts: list) -> list[pa.Array]:
        found = tagger.all_spans(texts)
        counts = [pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64()) for kind in KINDS]
        base = [hashlib.sha256(written([s for s in spans if s[2] != "crf"]).encode()).hexdigest() for spans in found]
        return [*counts[:3], pa.array(base, pa.string()), pa.array([written(s) for s in found], pa.string()), counts[3]]

    return map_texts(docs, run, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")


def redacted(text: str | None, spans: list[Span], sign: str = "[SECRET]") -> str | None:
    """The text with every span replaced; spans that overlap are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    start, end = spans[0][:2]
    for s, e, _ in [*spans[1:], (len(text) + 1, len(text) + 1, "")]:
        if s < end:
            end = max(end, e)
            continue
        out += [text[at:start], sign]
        at, start, end = end, s, e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced and ``n_chars`` counted anew; null and empty texts stay."""
    tagger = tagger or train()
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            texts = [redacted(t, spans) for t, spans in zip(texts, tagger.all_spans(texts))]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
