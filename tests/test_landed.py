import datetime
import zipfile
from decimal import Decimal

import pytest

from groundwork.sources import certificates, portal, readers

PAGE = """<table><tr><td>Parcel ID:</td><td>74.35-44</td></tr><tr><td>In Bankruptcy</td><td> NO </td></tr><tr><td>Tax Exempt:</td><td>maybe</td></tr>
<tr><td>Name:</td><td>HOTEL &amp; SONS</td></tr><tr><td></td><td>DOWNTOWN LLC</td></tr><tr><td>City State Zip:</td><td>ROCHESTER MN 55902-1234</td></tr></table>
<div>Delinquent Taxes</div><table><tr><td>menu</td></tr></table>
<table><tr><th> Pay  Year</th><th>Base Taxes</th><th>Penalty</th><th>Total Amt Paid</th><th>Date Last Paid</th><th>Total Due</th></tr>
<tr><td>2025</td><td>$132,390.00</td><td></td><td>(12.50)</td><td>22-APR-26</td><td>$.00</td></tr><tr><td>2024</td><td>n/a</td></tr><tr><td>Total:</td><td>$9</td></tr></table>
<p>Current Taxes Due</p><table><tr><th>Pay Year</th><th>Total Due</th></tr><tr><td>2026<td>5<tr><td>2026<td>7.25</table>"""


@pytest.fixture
def pages(spark):
    rows = [(1, "743544", PAGE), (2, "9", PAGE), (3, "9", "<p>closed for maintenance</p>"), (4, None, None), (5, "1", "<table><tr><td>Name:</td><td>X</td></tr></table>")]
    return portal.parsed(spark.createDataFrame(rows, "page int, asked string, html string"), "html", ["page", "asked"])


def test_portal_page(pages):
    good, bad = portal.answered(pages, "asked")
    assert sorted((r["page"], r["reason"]) for r in bad.collect()) == [(2, "another parcel"), (3, "no table"), (4, "no table"), (5, "no parcel number")]
    lines = {(r["kind"], r["pay_year"], r["total_due"]): r for r in portal.tax_lines(good, ["page"]).collect()}
    assert len(lines) == 4
    first = lines["delinquent", 2025, Decimal("0.00")]
    assert (first["base_taxes"], first["penalty_due"], first["total_paid"], first["date_last_paid"]) == (Decimal("132390.00"), None, Decimal("-12.50"), datetime.date(2026, 4, 22))
    assert lines["delinquent", 2024, None]["base_taxes"] is None
    years = {(r["kind"], r["pay_year"]): r for r in portal.tax_years(portal.tax_lines(good, ["page"]), ["page"]).collect()}
    assert years["current", 2026]["total_due"] == Decimal("12.25") and [c["total_due"] for c in years["current", 2026]["cycles"]] == [Decimal("5.00"), Decimal("7.25")]
    (flags,) = portal.status_flags(good, ["page"]).collect()
    assert (flags["in_bankruptcy"], flags["is_tax_exempt"], flags["in_forfeiture"]) == (False, None, None)
    (owner,) = portal.owners(good, ["page"]).collect()
    assert tuple(owner)[1:] == ("HOTEL & SONS", "DOWNTOWN LLC", None, "ROCHESTER", "MN", "55902")


def test_last_heading_before_a_table():
    html = "<td>One<table><tr><td>a<table><tr><td>b</table></table>Two words<table><tr><td>c</table>"
    assert [(cells, section) for _, _, cells, section in readers.table_rows(html, ["One", "Two"])] == [(["b"], "One"), (["a"], "One"), (["c"], "Two")]


CERTIFICATE = """<?xml version="1.0" encoding="UTF-8"?>
<anyRoot><headerForm><crvNumberId> 17 </crvNumberId><countyCde>55</countyCde></headerForm>
<propertyForm><parcels><parcelId>R 1.02</parcelId></parcels><parcels><parcelId>7-¼</parcelId><primary>Y</primary></parcels><parcels><parcelId>R 1.02</parcelId></parcels><parcels><parcelId> </parcelId></parcels></propertyForm>
<salesAgreementForm><deedContractDate>2026-05-04T00:00:00-05:00</deedContractDate><totPurchaseAmt>250000.5</totPurchaseAmt></salesAgreementForm>
<buyersForm><individuals><firstName>Ann</firstName><lastName>Lee</lastName><email>a@b.c</email></individuals><organizations><organizationName>ACME</organizationName></organizations><individuals><lastName> </lastName></individuals></buyersForm></anyRoot>"""


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.xml", CERTIFICATE.encode("cp1252"))  # not in the encoding that it declares
        z.writestr("again.XML", CERTIFICATE.replace("<primary>Y</primary>", "").encode())
        z.writestr("cut.xml", CERTIFICATE[:400])
        z.writestr("none.xml", "<r><headerForm><crvNumberId>x1</crvNumberId></headerForm></r>")
        z.writestr("bare.xml", "<r><headerForm><crvNumberId>3</crvNumberId></headerForm><propertyForm/></r>")
        z.writestr("empty.xml", "")
        z.writestr("notes.txt", CERTIFICATE)
        z.writestr("stored.xml", "x" * 50)
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"x" * 50, b"y" * 50))  # its checksum is wrong now
    (tmp_path / "b.zip").write_bytes(b"no archive")
    texts = certificates.archive_texts(spark, str(tmp_path))
    rows, rejects = certificates.certificates(texts, ["member"])
    got = {(r["member"], r["parcel_id_raw"]): r for r in rows.collect()}
    assert set(got) == {(m, p) for m in ("good.xml", "again.XML") for p in ("R 1.02", "7-¼")}
    one = got["good.xml", "7-¼"]
    assert (one["crv_id"], one["parcel_norm"], one["primary_parcel"], one["deed_date"], one["purchase_amount"], one["buyers"], one["sellers"], one["government"]) == (17, "7", True, datetime.date(2026, 5, 4), Decimal("250000.50"), ["Ann Lee", "ACME"], [], None)
    assert not got["good.xml", "R 1.02"]["primary_parcel"] and got["again.XML", "R 1.02"]["primary_parcel"] and not got["again.XML", "7-¼"]["primary_parcel"]
    assert {(r["member"], r["reason"]) for r in rejects.collect()} == {("cut.xml", "no xml"), ("none.xml", "no certificate number"), ("bare.xml", "no parcel"), ("empty.xml", "no xml"), ("stored.xml", "broken member"), (None, "no archive")}


def test_a_certificate_is_parsed_once(spark):
    rows, rejects = certificates.certificates(spark.createDataFrame([("a", CERTIFICATE), ("b", None)], "member string, text string"), ["member"])
    for made in (rows, rejects):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert (rows.count(), [tuple(r) for r in rejects.collect()]) == (2, [("b", "no xml")])
