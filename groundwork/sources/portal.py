"""Pages of a county's tax portal: one page gives tax lines, status flags and owners, or a reject.

A page is parsed once (``parsed``) and stays one row; what is asked of it is answered by
functions of its array of table rows, so nothing is shuffled before amounts are summed. Write
the parsed pages to a table where several outputs are wanted.

Values stand as the portal writes them: blanks are null, and a flag that says neither yes nor no is
null. A page that does not repeat the parcel it was asked for is a reject, never a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import addresses, coerce
from groundwork.sources import readers

# Headings of the tables of tax lines, and the kind of their lines.
KINDS = {"Delinquent Taxes": "delinquent", "Current Taxes Due": "current"}
# Columns of a tax line and the names that portals give them.
AMOUNTS = {
    "base_taxes": ("base taxes",),
    "penalty_due": ("penalty due", "penalty"),
    "fees_due": ("fees due", "fees"),
    "interest_due": ("interest due", "interest"),
    "total_paid": ("total amnt paid", "total amt paid", "total amount paid"),
    "total_due": ("total due",),
}
# Labels of status flags.
FLAGS = {"in_forfeiture": "in forfeiture", "in_bankruptcy": "in bankruptcy", "has_confession": "confession of judgment", "is_tax_exempt": "tax exempt"}
# Labels of the parcel number and of the owner's lines.
PARCEL, OWNER, MAILING, CITY_LINE = ("parid", "parcel id", "parcel"), "name", "owner address", "city state zip"


def parsed(pages: DataFrame, html: str, carry: Sequence[str]) -> DataFrame:
    return readers.page_tables(pages, html, carry, list(KINDS))


def label(row: Column) -> Column:
    """First cell of a row in small letters, without the colon."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.get(row.cells, F.lit(0)), F.lit("")), r"[\s:]+$", "")))


def blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def value(row: Column) -> Column:
    return blank(F.get(row.cells, F.lit(1)))


def labelled(*names: str) -> Column:
    """Value of the page's last row that has one of the labels."""
    return value(F.try_element_at(F.filter("rows", lambda r: label(r).isin(*names)), F.lit(-1)))


def flag(text: Column) -> Column:
    said = F.lower(text)
    return F.when(said.isin("yes", "y", "true"), True).when(said.isin("no", "n", "false"), False)


def answered(pages: DataFrame, asked: str) -> tuple[DataFrame, DataFrame]:
    """Pages that repeat the parcel number ``asked`` for, and the others with the reason."""
    said = F.regexp_replace(F.coalesce(labelled(*PARCEL), F.lit("")), r"[^0-9A-Za-z]", "")
    want = F.regexp_replace(F.coalesce(F.col(asked).cast("string"), F.lit("")), r"[^0-9A-Za-z]", "")
    reason = F.when(F.coalesce(F.size("rows"), F.lit(0)) == 0, "no table").when(said == "", "no parcel number").when((want == "") | (said != want), "another parcel")
    marked = pages.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def tax_lines(pages: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``carry``, kind, pay_year, cycle, amounts and date_last_paid of every line that begins with a year, in the tables of ``KINDS``."""
    heads = F.map_from_entries(F.transform(F.filter("rows", lambda r: r.row_no == 0), lambda r: F.struct(r.table_no, F.transform(r.cells, lambda c: F.lower(blank(c))))))
    lines = F.filter("rows", lambda r: (r.row_no > 0) & r.section.isNotNull() & F.coalesce(F.get(r.cells, F.lit(0)).rlike(r"^\s*[0-9]{4}\s*$"), F.lit(False)))
    rows = pages.select(*carry, heads.alias("__heads"), F.explode(lines).alias("__r")).select(*carry, "__r.*", F.try_element_at("__heads", F.col("__r.table_no")).alias("__head"))
    rows = rows.filter(F.array_contains("__head", "pay year"))

    def named(names: Sequence[str]) -> Column:
        at = lambda name: F.array_position("__head", F.lit(name)).cast("int") - 1
        return F.coalesce(*[F.when(at(name) >= 0, blank(F.get("cells", at(name)))) for name in names])

    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    paid = named(("date last paid",))
    return rows.select(
        *carry,
        F.try_element_at(kinds, F.col("section")).alias("kind"),
        F.trim(F.get("cells", F.lit(0))).cast("int").alias("pay_year"),
        named(("cycle", "payment cycle")).alias("cycle"),
        *[coerce.money(named(names)).alias(out) for out, names in AMOUNTS.items()],
        F.coalesce(coerce.day_short_year(paid), coerce.day(paid)).alias("date_last_paid"),
    )


def tax_years(lines: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row for a parcel, kind and year: half-year lines are summed, and kept as they are in ``cycles``."""
    own = F.struct("cycle", *AMOUNTS, "date_last_paid")
    sums = [F.sum(c).cast("decimal(18,2)").alias(c) for c in AMOUNTS]
    return lines.groupBy(*carry, "kind", "pay_year").agg(*sums, F.max("date_last_paid").alias("date_last_paid"), F.array_sort(F.collect_list(own)).alias("cycles"))


def status_flags(pages: DataFrame, carry: Sequence[str]) -> DataFrame:
    return pages.select(*carry, *[flag(labelled(name)).alias(out) for out, name in FLAGS.items()])


def owners(pages: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Name, second name (the next line of the table, if its label is blank) and mailing address."""
    name = F.try_element_at(F.filter("rows", lambda r: (label(r) == OWNER) & value(r).isNotNull()), F.lit(-1))
    rows = pages.select(*carry, "rows", name.alias("__n"))
    next_line = F.get(F.filter("rows", lambda r: (r.table_no == F.col("__n.table_no")) & (r.row_no == F.col("__n.row_no") + 1)), F.lit(0))
    second = F.when(label(next_line) == "", value(next_line))
    place = addresses.city_state_zip(labelled(CITY_LINE))
    return rows.select(*carry, value(F.col("__n")).alias("owner_name"), second.alias("owner_name_2"), labelled(MAILING).alias("mailing_address"), place["city"].alias("city"), place["state"].alias("state"), place["zip"].alias("zip"))
