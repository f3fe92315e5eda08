"""Certificates of sale in landed archives of XML: one row for each parcel of a certificate.

An archive is unpacked where it lies; what is not an archive, not XML, has no certificate number or
no parcel is a reject with its reason. Text that is not in the encoding that it declares is
read as Windows-1252. Phones and mail addresses of the parties are not read.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import coerce

# Elements of a certificate.
PARTY = "individuals array<struct<firstName string, middleName string, lastName string, nameSuffix string>>, organizations array<struct<organizationName string>>"
SCHEMA = (
    "headerForm struct<crvNumberId string, countyCde string>, "
    "propertyForm struct<parcels array<struct<parcelId string, primary string>>>, "
    "salesAgreementForm struct<deedTypeCde string, deedContractDate string, financeType string, totPurchaseAmt string>, "
    "supplementaryForm struct<legalActionInd string, governmentInd string, relatedInd string, nonMarketPriceInd string>, "
    f"buyersForm struct<{PARTY}>, sellersForm struct<{PARTY}>, _corrupt_record string"
)


def archive_texts(spark: SparkSession, path: str, suffix: str = ".xml", fallback: str = "cp1252") -> DataFrame:
    """path, member, text, error of every member of the archives; an archive or a member that can't be read has an error and no text.

    An archive is the unit of work and has to fit in a task, its members are read one by one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*x: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in x], names=["path", "member", "text", "error"])

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield row(name, None, None, "no archive")
                    continue
                for member in archive.namelist():
                    if member.lower().endswith(suffix):
                        try:
                            raw = archive.read(member)
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError):
                            yield row(name, member, None, "broken member")
                            continue
                        try:
                            yield row(name, member, raw.decode("utf-8-sig"), None)
                        except UnicodeDecodeError:
                            yield row(name, member, raw.decode(fallback, "replace"), None)

    return files.mapInArrow(unpack, "path string, member string, text string, error string")


def yes_no(text: Column) -> Column:
    said = F.lower(F.trim(text))
    return F.when(said.isin("true", "y", "yes", "1"), True).when(said.isin("false", "n", "no", "0"), False)


def party_names(form: Column) -> Column:
    """Full names of persons, then names of organisations, in order; blanks are left out."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    people = F.transform(F.coalesce(form.individuals, F.array()), lambda p: F.concat_ws(" ", filled(p.firstName), filled(p.middleName), filled(p.lastName), filled(p.nameSuffix)))
    firms = F.transform(F.coalesce(form.organizations, F.array()), lambda o: F.coalesce(filled(o.organizationName), F.lit("")))
    return F.filter(F.concat(people, firms), lambda n: n != "")


def certificates(texts: DataFrame, carry: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): a row for each distinct parcel number of a certificate; rejects are ``carry`` and the reason.

    If no parcel is marked primary, the first is.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s*<\?xml[^>]*\?>", "")
    parsed = F.from_xml(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": "certificate"})
    # a list of one: what is asked of the parsed text, and the filters on it, would else parse it again
    read = texts.select(*carry, *(["error"] if "error" in texts.columns else []), F.explode_outer(F.array(parsed)).alias("x"))
    number = F.trim(F.col("x.headerForm.crvNumberId"))
    crv = F.when(number.rlike(r"^[0-9]+$"), number.try_cast("long"))
    listed = F.filter(F.transform(F.coalesce("x.propertyForm.parcels", F.array()), lambda p: F.struct(F.nullif(F.trim(p.parcelId), F.lit("")).alias("pin"), F.coalesce(yes_no(p.primary), F.lit(False)).alias("primary"))), lambda p: p.pin.isNotNull())
    read = read.withColumn("crv_id", crv).withColumn("__all", listed)
    pins = F.transform("__all", lambda p: p.pin)
    read = read.withColumn("__parcels", F.filter("__all", lambda p, i: F.array_position(pins, p.pin) == i + 1))
    known = F.col("error") if "error" in read.columns else F.lit(None).cast("string")
    reason = F.coalesce(known, F.when(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull(), "no xml").when(F.col("crv_id").isNull(), "no certificate number").when(F.size("__parcels") == 0, "no parcel"))
    read = read.withColumn("reason", reason)
    some = F.exists("__parcels", lambda p: p.primary)
    sale, extra = F.col("x.salesAgreementForm"), F.col("x.supplementaryForm")
    rows = read.filter("reason is null").select(*carry, "crv_id", "x", some.alias("__some"), F.posexplode("__parcels").alias("__at", "__p")).select(
        *carry,
        "crv_id",
        F.trim("x.headerForm.countyCde").alias("county_code"),
        F.col("__p.pin").alias("parcel_id_raw"),
        F.nullif(F.regexp_replace("__p.pin", "[^0-9]", ""), F.lit("")).alias("parcel_norm"),
        F.when(F.col("__some"), F.col("__p.primary")).otherwise(F.col("__at") == 0).alias("primary_parcel"),
        F.trim(sale.deedTypeCde).alias("deed_type"),
        coerce.day_as_written(F.trim(sale.deedContractDate)).alias("deed_date"),
        F.trim(sale.financeType).alias("finance_type"),
        coerce.money(sale.totPurchaseAmt).alias("purchase_amount"),
        party_names(F.col("x.buyersForm")).alias("buyers"),
        party_names(F.col("x.sellersForm")).alias("sellers"),
        *[yes_no(extra[name]).alias(out) for out, name in (("legal_action", "legalActionInd"), ("government", "governmentInd"), ("related", "relatedInd"), ("non_market_price", "nonMarketPriceInd"))],
    )
    return rows, read.filter("reason is not null").select(*carry, "reason")
