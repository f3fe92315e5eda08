import glob
import hashlib
import itertools
import random
import re
import sysconfig
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import private, queries
from tests.llm.conftest import by_id

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def doubled(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    """The base patterns as they are written."""
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), m.end(), "email") for m in re.finditer(EMAIL, text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(CARD, text) if 16 <= len(bare(m)) <= 19 and doubled(bare(m))]
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(PHONE, text) if 8 <= len(bare(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a@.b-", max_size=25), st.text("12@.a", max_size=30), st.text("0125. -", max_size=60), st.text("+1 (2)-.3", max_size=40), st.text(max_size=20)))
def test_base_patterns(text):
    assert private.base_spans(text) == plain(text)


@given(st.text("0123456789", min_size=16, max_size=19))
def test_checksum(digits):
    assert private.luhn(digits) == doubled(digits)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 4), st.integers(-3, 6)), max_size=7), st.sampled_from([-2.0, 0.0, 1.5]))
def test_best_cut_is_the_best_of_all(segments, beside):
    start = np.array([s for s, _, _ in segments], int)
    end, score = start + np.array([n for _, n, _ in segments], int), np.array([float(x) for _, _, x in segments])

    def value(chosen):
        chosen = sorted(chosen, key=lambda k: start[k])
        if any(end[a] > start[b] for a, b in zip(chosen, chosen[1:])):
            return None
        return sum(score[k] for k in chosen) + beside * sum(end[a] == start[b] for a, b in zip(chosen, chosen[1:]))

    every = [value(c) for n in range(len(segments) + 1) for c in itertools.combinations(range(len(segments)), n)]
    assert value(private.best_cut(start, end, score, beside)) == pytest.approx(max(v for v in every if v is not None))


def test_likelihood_slopes_follow_the_sums():
    """Each round of steps on two texts raises the probability of their cuts: the field learns them by heart."""
    rows = [("call 0171 2345678 now\n", [(5, 17, "phone")]), ("order 0171 2345678 now\n", []), ("iban DE89 3704 0044 0532 0130 00\n", [(5, 32, "iban")])]
    learned = private.fit(rows, rounds=80, decay=1e-4)
    assert learned.spans([t for t, _ in rows]) == [spans for _, spans in rows]


def test_made_up_entities_it_has_not_seen():
    rows = private.examples(4242, 500)
    found = private.field().spans([t for t, _ in rows])
    gold, got = ({(k, *s) for k, spans in enumerate(x) for s in spans} for x in ([s for _, s in rows], found))
    assert len(gold & got) >= 0.9 * len(gold) and len(got - gold) <= 0.02 * len(got)
    clean = [t for t, _ in private.examples(777, 500, clean=1.0)]
    assert sum(map(len, private.field().spans(clean))) <= 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("Call me: (555) 123-4567, thanks", ("phone", "(555) 123-4567")),
        ("Tel. 030 1234567", ("phone", "030 1234567")),
        ("my card 3782 822463 10005 is new", ("card", "3782 822463 10005")),
        ("write to john.doe [at] example [dot] com please", ("email", "john.doe [at] example [dot] com")),
        ("IBAN: DE89 3704 0044 0532 0130 00", ("iban", "DE89 3704 0044 0532 0130 00")),
        ("host 2001:db8:85a3::8a2e:370:7334 is up", ("ip", "2001:db8:85a3::8a2e:370:7334")),
        ("SSN: 219-09-9999", ("ssn", "219-09-9999")),
    ],
)
def test_data_beyond_the_base_patterns(text, want):
    (spans,) = private.field().spans([text])
    assert [(k, text[a:b]) for a, b, k in spans] == [want]


def test_real_text_is_left_alone():
    """At most one span beyond the base patterns in a million characters of programs."""
    texts = [open(f, errors="replace").read() for f in sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))]
    more = sum(len(every) - len(base) for base, every in private.field().all_spans(texts))
    assert sum(map(len, texts)) > 3_000_000 and more <= sum(map(len, texts)) / 1e6


@pytest.mark.parametrize("text", ["@" * 200_000, "a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@b." * 60_000, "1 " * 100_000, "dot at " * 40_000, "[at] " * 40_000, "::" * 100_000, "+1 (555) 123-4567 " * 5_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    ((base, every),) = private.field().all_spans([text])
    assert time.time() - began < 30 and set(base) <= set(every)


def test_texts_alone_and_together_give_the_same():
    texts = [t for t, _ in private.examples(5, 60)]
    random.Random(1).shuffle(texts)
    assert private.field().spans(texts) == [private.field().spans([t])[0] for t in texts]


def test_query_on_a_whole_table(spark, data):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = by_id(queries.queries()["op12_private"](spark, data))
    assert set(got) == set(rows)
    for doc_id, text in rows.items():
        base, r = plain(text), got[doc_id]
        said = [f"{kind}:{a}:{b}" for a, b, kind in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in base) for k in private.KINDS]
        assert set(said) <= set(filter(None, r["spans"].split(",")))


def test_odd_rows_and_empty_tables(odd, empty, spark):
    got = [r for r in private.scan(odd).collect()]
    assert len(got) == odd.count() and all(r["spans"] == "" and r["n_email"] == 0 for r in got)
    text = "a@b.cd 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111 \U0001f600 é@f.g"
    (r,) = private.scan(spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, spans string")).collect()
    assert r["spans"] == private.joined(plain(text))
    assert private.scan(empty).count() == 0
