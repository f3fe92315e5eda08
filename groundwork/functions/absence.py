"""Is the owner elsewhere? Four rules of four publishers; they answer differently where something is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Upper case with single spaces; null if blank."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(text), r"\s+", " ")), F.lit(""))


def by_mailing(site: Column, mailing: Column) -> Column:
    """Absent if tax bills go to another street; without both streets not absent."""
    return F.coalesce(plain(site) != plain(mailing), F.lit(False))


def by_free_text(homestead: Column) -> Column:
    """'NON HOMESTEAD' is absent, 'FULL HOMESTEAD' is not; anything else is unknown."""
    said = plain(homestead)
    return F.when(said.contains("NON"), True).when(said.contains("HOMESTEAD"), False)


def by_assessor(homestead: Column) -> Column:
    """The assessor's own answer: no is absent; yes, full, fractional and partial are not; anything else is unknown."""
    said = plain(homestead)
    return F.when(said.startswith("N"), True).when(F.substring(said, 1, 1).isin("Y", "F", "P") | said.contains("HOMESTEAD"), False)


def by_flag_or_street(homestead: Column, mailing: Column, site: Column) -> Column:
    """A homestead is lived in; else another street tells; a flag alone that is not Y is absent; nothing at all is unknown."""
    said = plain(homestead)
    return F.when(said == "Y", False).otherwise(F.coalesce(plain(mailing) != plain(site), F.when(said.isNotNull(), True)))
