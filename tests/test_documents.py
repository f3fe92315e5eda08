import random
import re

import pytest
from pyspark.sql import functions as F

from groundwork.functions import notice_fields
from groundwork.operators import documents


def cut_by_lines(text, how):
    """Line by line: the line before which each piece begins, found from what earlier pieces have taken."""
    lines = text.split("\n")
    count = [sum(sum(c.isdigit() for c in m) >= how.digits for m in (x[0] for x in re.finditer(how.parcel, line))) for line in lines]
    if sum(count) <= 1 or sum(count) <= how.parcels and len(text) <= how.most:
        return [text]
    begins, taken = set(), 0
    for k, n in enumerate(count):
        if any((taken + t) % how.parcels == 0 for t in range(n)):
            first = k
            while first > 0 and count[first - 1] == 0 and re.fullmatch(how.owner, lines[first - 1].strip()):
                first -= 1
            begins.add(first)
        taken += n
    begins = sorted(begins)
    return ["\n".join(lines[a:b]) + ("\n" if b < len(lines) else "") for a, b in zip(begins, [*begins[1:], len(lines)])]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_those_of_a_plain_pass(seed):
    r = random.Random(seed)
    kinds = [lambda: "SMITH JOHN & MARY", lambda: "REV TRST 10-31-05", lambda: f"RP {r.randrange(10**7, 10**8)} LOT 1 $2,{r.randrange(100, 999)}.11", lambda: f"{r.randrange(10, 99)}-{r.randrange(1000, 9999)}-{r.randrange(10000, 99999)} TOWN",
             lambda: "", lambda: "lower case line", lambda: f"08.0208.000 and 21.457.110{r.randrange(9)} in one line", lambda: "phone 361-1710, $403.41"]
    text = "\n".join(r.choice(kinds)() for _ in range(r.randrange(0, 60)))
    how = documents.Cut(parcels=r.choice([1, 2, 5]), most=r.choice([0, 400, 10**6]))
    assert [text[a:b] for a, b in documents.bodies(text, how)] == cut_by_lines(text, how)


def test_every_parcel_is_in_one_piece_and_owners_stay_with_it(spark):
    record = "WALDRON JOSHUA {i} & CO\nRP 4125{i:04} SILVER CREEK $2,988.11\n\n"
    notice = "Notice of Expiration of Redemption\n" + "bid in 2019 " * 40 + "\n\n" + "".join(record.format(i=i) for i in range(40)) + "FAILURE TO REDEEM ends rights."
    text = "cover\n" + notice + notice.replace("4125", "5125")
    rows = [(1, text), (2, None), (3, "  "), (4, "no heading at all"), (4, "no heading at all")]
    out = documents.split_documents(spark.createDataFrame(rows, "doc int, text string"), "text", ["doc"]).collect()
    got = [r for r in out if r["doc"] == 1]
    assert [(r["notice"], r["piece"], r["parcels"]) for r in got] == [(n, k, p) for n in (0, 1) for k, p in enumerate((15, 15, 10))]
    assert all(r["body"].startswith("WALDRON") and text[r["start_at"] : r["end_at"]].strip() == r["body"] for r in got)
    assert all(r["context"].startswith("Notice") or r["context"].startswith("NOTICE") for r in got) and all("FAILURE TO REDEEM" in r["context"] for r in got)
    assert sorted(re.findall("RP ([0-9]+)", "".join(r["body"] for r in got))) == sorted(re.findall("RP ([0-9]+)", text))
    assert [(r["doc"], r["body"], r["context"]) for r in out if r["doc"] != 1] == [(4, "no heading at all", "")] * 2


TEXTS = {
    "DATE AND TIME OF SALE: 10:00AM on August 25, 2022": {"sale_day": "August 25, 2022", "sale_time": "10:00AM"},
    "sold at public auction. It was on June 1, 2025": {},  # another sentence
    "The AMOUNT DUE is unknown. Cost $5.00": {},
    "AMOUNT DUE AND CLAIMED TO BE DUE as of the date of notice, including taxes: $ 84,120.07": {"amount_due": "84,120.07"},
    "PARCEL ID 07.0126.000, Sheriff of Fillmore County": {"parcel_id": "07.0126.000", "county": "Fillmore"},
    "PARCEL IDENTITY 12345678": {},
    "redemption by the mortgagor, is 6 months from": {"redemption": "6 months"},
    "": {},
}


@pytest.mark.parametrize("text", TEXTS)
def test_facts_stand_as_written(spark, text):
    rows = notice_fields.facts(spark.createDataFrame([(text,), (None,)], "t string"), "t", []).collect()
    assert {r["field"]: r["fact"] for r in rows} == TEXTS[text]


def test_facts_that_are_not_in_the_text_are_held_back(spark):
    made_up = notice_fields.Field("x", "day", ("on",))
    row = spark.createDataFrame([("on May 1, 2020",)], "t string")
    assert row.select(notice_fields.fact(F.col("t"), made_up)).first()[0] == "May 1, 2020"


def test_a_pattern_is_computed_once(spark):
    rows = spark.createDataFrame([(1, "PID: 12-345-678. Redemption is six (6) months."), (2, None), (3, "rapid redemptions")], "k int, t string")
    out = notice_fields.facts(rows, "t", ["k"])
    assert sorted((r["k"], r["field"], r["fact"]) for r in out.collect()) == [(1, "parcel_id", "12-345-678"), (1, "redemption", "six (6) months")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(p) == 1 for f in notice_fields.FIELDS if f.kind == "period" for label in f.labels for p in notice_fields.patterns(f, label))
