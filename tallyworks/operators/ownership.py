"""Transactions of insiders from ownership forms, as XML or as the HTML that is made of it; both give the same rows.

The HTML is read from the cell grid of ``filing_index``: a table's two header rows
name the columns, so a row is mapped by them and footnote marks are taken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filing_index as X
from .documents import TRANSACTION_CODES

_VALUE = "struct<value: string>"
_DEAL = f"struct<transactionDate: {_VALUE}, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}>, ownershipNature: struct<directOrIndirectOwnership: {_VALUE}>>"
_OWNER = "struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, isOther: string, officerTitle: string>>"
SCHEMA = f"reportingOwner array<{_OWNER}>, nonDerivativeTransaction array<{_DEAL}>, nonDerivativeTable struct<nonDerivativeTransaction: array<{_DEAL}>>, derivativeTransaction array<{_DEAL}>, derivativeTable struct<derivativeTransaction: array<{_DEAL}>>"
#: How a role is named in XML, in HTML and in the result.
ROLES = (("isDirector", "director", "director"), ("isOfficer", "officer", "officer"), ("isTenPercentOwner", "10%", "ten_percent_owner"), ("isOther", "other", "other"))
COLUMNS = ("doc_id", "position", "owner", "role", "code", "kind", "shares", "price", "value", "ownership_form", "transaction_date")


def form_number(text: Column) -> Column:
    """The number of a cell without its currency sign and footnote marks."""
    bare = F.regexp_replace(text, r"\(\s*\d+\s*\)", "")
    return F.regexp_replace(F.regexp_extract(bare, r"-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+", 0), ",", "").try_cast("double")


def form_date(text: Column) -> Column:
    """A date written 2024-05-27 or 05/27/2024."""
    return F.coalesce(F.try_to_date(F.regexp_extract(text, r"\d{4}-\d\d-\d\d", 0)), F.try_to_date(F.regexp_extract(text, r"\d\d/\d\d/\d{4}", 0), "MM/dd/yyyy"))


def _finished(rows: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("code") == k, v) for k, v in TRANSACTION_CODES.items()], F.lit("Other/Unclassified"))
    return rows.withColumn("value", F.round(F.col("shares") * F.col("price"), 2)).withColumn("kind", label).select(*COLUMNS)


def xml_transactions(forms: DataFrame) -> DataFrame:
    """The transactions of forms (doc_id, body) that are XML; what is not whole has none."""
    plain = F.regexp_replace("body", r"(</?)[A-Za-z0-9]+:", "$1")
    read = forms.select("doc_id", F.from_xml(plain, SCHEMA, {"rowTag": "ownershipDocument", "mode": "PERMISSIVE"}).alias("x"))
    first = lambda *cs: F.coalesce(*[F.when(F.size(F.col(c)) > 0, F.col(c)) for c in cs])
    deals = first("x.nonDerivativeTransaction", "x.nonDerivativeTable.nonDerivativeTransaction", "x.derivativeTransaction", "x.derivativeTable.derivativeTransaction")
    relation = F.get("x.reportingOwner", 0)["reportingOwnerRelationship"]
    held = F.array(*[F.when(F.lower(F.trim(relation[flag])).isin("1", "true"), name) for flag, _, name in ROLES])
    role = F.coalesce(F.nullif(F.trim(relation["officerTitle"]), F.lit("")), F.nullif(F.array_join(held, ", "), F.lit("")))
    rows = read.select("doc_id", F.trim(F.get("x.reportingOwner", 0)["reportingOwnerId"]["rptOwnerName"]).alias("owner"), role.alias("role"), F.posexplode(deals).alias("position", "t"))
    return _finished(
        rows.select(
            "doc_id", "position", "owner", "role", F.upper(F.trim("t.transactionCoding.transactionCode")).alias("code"), form_number(F.col("t.transactionAmounts.transactionShares.value")).alias("shares"),
            form_number(F.col("t.transactionAmounts.transactionPricePerShare.value")).alias("price"), F.nullif(F.trim("t.ownershipNature.directOrIndirectOwnership.value"), F.lit("")).alias("ownership_form"), form_date(F.col("t.transactionDate.value")).alias("transaction_date"),
        ).where("code is not null and shares is not null")
    )


def _place(texts: Column, pattern: str) -> Column:
    return F.get(F.filter(F.transform(texts, lambda t, i: F.when(t.rlike(pattern), i)), lambda i: i.isNotNull()), 0)


def html_transactions(forms: DataFrame) -> DataFrame:
    """The transactions of forms (doc_id, body) that are HTML: those of the first table of securities, the non-derivative ones first."""
    marked = X.marks(forms.select("doc_id", F.col("body").alias("html")))
    cells = X.table_cells(X.table_marks(marked))
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]).alias("texts"))
    table = Window.partitionBy("doc_id", "table_no")
    before = table.orderBy("row_no")
    told = F.lower(F.array_join("texts", " "))
    direct, derived = F.contains(told, F.lit("non-derivative securities")), F.contains(told, F.lit("derivative securities"))
    heads = F.exists("texts", lambda t: t.rlike("(?i)^code$")) & F.exists("texts", lambda t: t.rlike("(?i)^price"))
    sheet = F.min(F.when(direct, 0).when(derived, 1)).over(table)
    named = rows.withColumn("sheet", sheet).where("sheet is not null").select(
        "*",
        F.last(F.when(heads, F.col("texts")), ignorenulls=True).over(before).alias("low"),
        F.last(F.when(F.exists("texts", lambda t: t.rlike("(?i)transaction date")), F.col("texts")), ignorenulls=True).over(before).alias("high"),
    )
    low, high = F.col("low"), F.col("high")
    code_at, amount_at, price_at = (_place(low, p) for p in ("(?i)^code$", "(?i)^(amount|\\(a\\))", "(?i)^price"))
    at = lambda place: F.get("texts", place)
    price_place = F.coalesce(F.when(F.col("sheet") == 0, price_at), F.when(F.col("sheet") == 0, F.lit(7)).otherwise(F.lit(1)))
    form_place = F.when(F.col("sheet") == 0, price_place + 2).otherwise(F.lit(14))
    deals = named.select(
        "doc_id", "table_no", "row_no", "sheet", F.upper(F.trim(F.regexp_replace(at(F.coalesce(code_at, F.when(F.col("sheet") == 0, 3).otherwise(4))), r"\(\s*\d+\s*\)", ""))).alias("code"),
        form_number(at(F.coalesce(amount_at, F.when(F.col("sheet") == 0, 5).otherwise(6)))).alias("shares"), form_number(at(price_place)).alias("price"), F.nullif(at(form_place), F.lit("")).alias("ownership_form"),
        form_date(at(F.coalesce(_place(high, "(?i)transaction date"), F.when(F.col("sheet") == 0, 1).otherwise(2)))).alias("transaction_date"),
    ).where(F.col("code").rlike("^[A-Z]$") & F.col("shares").isNotNull())
    ranked = deals.withColumn("first", F.min(F.struct("sheet", "table_no")).over(Window.partitionBy("doc_id"))).where((F.col("table_no") == F.col("first.table_no")))
    placed = ranked.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")) - 1)
    owner = marked.where(F.col("href").rlike("(?i)[?&;]CIK=")).groupBy("doc_id").agg(X.plain(F.min_by("text", "at")).alias("owner"))
    crossed = F.filter(F.transform("texts", lambda t, i: F.when(F.upper(t) == "X", F.lower(F.get("texts", i + 1)))), lambda t: t.isNotNull())
    labels = rows.select("doc_id", F.explode(crossed).alias("label")).groupBy("doc_id").agg(F.collect_set("label").alias("labels"))  # the form's few boxes
    named_by = lambda word: F.exists("labels", lambda t: F.contains(t, F.lit(word)))
    held = F.array(*[F.when(named_by(word), name) for _, word, name in ROLES])
    roles = labels.select("doc_id", F.nullif(F.array_join(held, ", "), F.lit("")).alias("role"))
    return _finished(placed.join(owner, "doc_id", "left").join(roles, "doc_id", "left"))


def ownership_transactions(forms: DataFrame) -> DataFrame:
    """doc_id, position, owner, role, code, kind, shares, price, value, ownership_form and transaction_date of each transaction of forms (doc_id, body)."""
    is_xml = F.contains("body", F.lit("<ownershipDocument")) | F.col("body").rlike(r"<[A-Za-z0-9]+:ownershipDocument")
    return xml_transactions(forms.where(is_xml)).unionByName(html_transactions(forms.where(~is_xml)))
