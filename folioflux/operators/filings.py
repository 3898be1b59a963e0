"""Ownership filings: facts to percentages, filing selection and backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions import columns as C

# Element, context names and labels of ownership filings.
PERCENT_ELEMENT = "ShareholdingAsAPercentageOfTotalNumberOfShares"
CONTEXT_PATTERN = r"^(.+?)(?:_Context)?I$"
PROMOTER, PUBLIC, TOTAL = "shareholdingofpromoterandpromotergroup", "publicshareholding", "shareholdingpattern"
OTHER_HOLDERS = "sharesheldbynonpromoternonpublicshareholders"
OTHER_HOLDER_PARTS = ("employeebenefitstrusts", "custodianordrholder")
MUTUAL_FUNDS = "mutualfundsoruti"
DII_CONTEXTS = (MUTUAL_FUNDS, "banks", "financialinstitutionorbanks", "insurancecompanies", "otherfinancialinstitutions")
FPI_CATEGORY = r"^institutionsforeignportfolioinvestorcate?r?gory(one|two|three)$"
FPI_AGGREGATE = "institutionsforeignportfolioinvestor"
FII_LEGACY = r"foreigninstitutionalinvestors?"
DII_LABELS = ("mutual funds", "banks", "insurance companies", "other financial institutions")
PROMOTER_LABEL = "total shareholding of promoter and promoter group"
PUBLIC_LABEL = "(b)=(b)(1)+(b)(2)"
FPI_LABEL = r"foreign\s+portfolio\s+investors?\b(?:\s*category\s*(i{1,3}|1|2|3))?"
FII_LABEL = r"foreign\s+institutional\s+investors?\b"
FPI_CATEGORIES = {"fii_i": ("1", "i"), "fii_ii": ("2", "ii"), "fii_iii": ("3", "iii")}
SPLIT_TOLERANCE, WHOLE_TOLERANCE = 0.001, 0.01
EXCHANGE_SITE = "https://www.bseindia.com"


def xbrl_facts(documents: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """(keys, context, text, reason): every percentage element of XBRL documents, or one row with the reason for having none.

    A missing document, one that is no well-formed XML and one without percentage elements each keep a row, so no filing
    is lost on the way to its percentages.
    """
    schema = f"{PERCENT_ELEMENT} ARRAY<STRUCT<_contextRef: STRING, _VALUE: STRING>>, _corrupt STRING"
    # A byte order mark and white space may come before the document.
    text = F.regexp_replace(F.col(xml), r"^[\ufeff\s]+", "")
    parsed = documents.select(*keys, text.isNull().alias("_none"), F.from_xml(text, schema, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    reason = (F.when(F.col("_none"), "no_document").when(F.col("x._corrupt").isNotNull(), "not_well_formed")
              .when(F.coalesce(F.size(F.col(f"x.{PERCENT_ELEMENT}")), F.lit(0)) <= 0, "no_percentages"))
    facts = parsed.select(*keys, reason.alias("reason"), F.explode_outer(F.when(reason.isNull(), F.col(f"x.{PERCENT_ELEMENT}"))).alias("f"))
    return facts.select(*keys, F.col("f._contextRef").alias("context"), F.col("f._VALUE").alias("text"), "reason")


def context_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, pct, error): one value per category; conflicting duplicates and unreadable text are errors.

    What belongs to no category -- facts of other contexts, blank ones, and refused documents -- is one row without name,
    with the document's reason as its error.
    """
    text = F.regexp_replace(F.trim("text"), ",", "")
    usable = F.coalesce(F.col("context").rlike(CONTEXT_PATTERN) & (text != ""), F.lit(False))
    rows = facts.select(*keys, F.when(usable, F.lower(F.regexp_extract("context", CONTEXT_PATTERN, 1))).alias("name"),
                        F.when(usable, text.try_cast("double")).alias("v"), "reason")
    named = F.col("name").isNotNull()
    return rows.groupBy(*keys, "name").agg(
        F.min("v").alias("pct"), F.when(F.max("reason").isNotNull(), F.max("reason")).when(F.count_if(named & F.col("v").isNull()) > 0, "invalid_percentage")
        .when(F.min("v") != F.max("v"), "conflicting_percentages").alias("error"))


def xbrl_resolve(values: DataFrame, keys: list[str]) -> DataFrame:
    """Ownership percentages per filing, or the reason it was refused."""
    name, pct = F.col("name"), F.col("pct")

    def one(context: str) -> Column:
        return F.max(F.when(name == context, pct))
    category = name.rlike(FPI_CATEGORY)
    stats = values.groupBy(*keys).agg(
        F.max("error").alias("_error"), one(PROMOTER).alias("pr"), one(PUBLIC).alias("pu"), one(TOTAL).alias("total"),
        F.coalesce(one(OTHER_HOLDERS), F.sum(F.when(name.isin(*OTHER_HOLDER_PARTS), pct)), F.lit(0.0)).alias("other"),
        F.sum(F.when(category, pct)).alias("fpi"), one(FPI_AGGREGATE).alias("fpi_all"),
        F.min_by(F.when(name.rlike(FII_LEGACY), pct), F.when(name.rlike(FII_LEGACY), name)).alias("legacy"),
        F.coalesce(F.sum(F.when(name.isin(*DII_CONTEXTS), pct)), F.lit(0.0)).alias("dii"), one(MUTUAL_FUNDS).alias("mf"))
    zero = F.lit(0.0)
    split = F.coalesce("pu", zero) + F.coalesce("pr", "other")
    bad_total = F.col("total").isNotNull() & ~((F.abs(F.col("total") - 1) <= SPLIT_TOLERANCE) | F.col("total").between(99.0, 101.0))
    k = F.when(F.abs(F.coalesce("total", split) - 1) <= SPLIT_TOLERANCE, 100.0).otherwise(1.0)
    stats = stats.withColumn("_bad_total", bad_total).withColumn("_k", k)
    stats = stats.withColumns({c: F.col(c) * F.col("_k") for c in ("pr", "pu", "total", "other", "fpi", "fpi_all", "legacy", "dii", "mf")})
    whole = F.coalesce("total", F.lit(100.0))
    all_public = (F.abs(F.col("pu") - whole) <= WHOLE_TOLERANCE) | (F.abs(F.col("pu") + F.col("other") - whole) <= WHOLE_TOLERANCE)
    promoter = F.coalesce("pr", F.when(all_public, zero))
    out = {"promoter_pct": promoter, "fii_pct": F.coalesce("fpi", "fpi_all", "legacy", zero), "dii_pct": F.col("dii"),
           "public_pct": F.col("pu"), "mf_pct": F.col("mf")}
    rounded = {n: F.round(c, 4) for n, c in out.items()}
    outside = F.lit(False)
    for c in rounded.values():
        outside = outside | F.coalesce(~c.between(0.0, 100.0), F.lit(False))
    error = (F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_bad_total"), "unreadable_total")
             .when(promoter.isNull() | F.col("pu").isNull(), "no_aggregate_rows").when(outside, "outside_0_100"))
    return stats.select(*keys, error.alias("error"), *[F.when(error.isNull(), c).alias(n) for n, c in rounded.items()])


def row_percentages(tags: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, pct, error) from (keys, row_no, tag, text): tags on the total share count win."""
    tag = F.regexp_replace(F.lower("tag"), r"\s", "")
    text = F.regexp_replace(F.trim("text"), ",", "")
    rows = tags.filter(F.contains(tag, F.lit("shareholdingasapercentage")) & (text != "")).select(
        *keys, "row_no", F.contains(tag, F.lit("totalnumberofshares")).alias("p"), text.try_cast("double").alias("v"))
    stats = rows.groupBy(*keys, "row_no").agg(
        F.count_if(F.col("v").isNull()).alias("bad"), F.count_if("p").alias("np"),
        F.min(F.when(F.col("p"), F.col("v"))).alias("p0"), F.max(F.when(F.col("p"), F.col("v"))).alias("p1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    low, high = F.when(F.col("np") > 0, F.col("p0")).otherwise(F.col("v0")), F.when(F.col("np") > 0, F.col("p1")).otherwise(F.col("v1"))
    error = F.when(F.col("bad") > 0, "invalid_percentage").when(low != high, "ambiguous_percentage")
    return stats.select(*keys, "row_no", F.when(error.isNull(), low).alias("pct"), error.alias("error"))


def label_kind(label: Column) -> Column:
    """promoter, public, a DII label or an FII category of one normalised row label, else NULL."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(label, r"[()\-–—/,]", " "), r"\s+", " "))
    category = F.regexp_extract(flat, FPI_LABEL, 1)
    kind = F.lit("fii_aggregate")
    for name, marks in FPI_CATEGORIES.items():
        kind = F.when(category.isin(*marks), name).otherwise(kind)
    fii = F.when(flat.rlike(FII_LABEL), "fii_legacy").when(flat.rlike(FPI_LABEL), kind)
    return (F.when(label.startswith(PROMOTER_LABEL), "promoter")
            .when(F.regexp_replace(label, " ", "").startswith(PUBLIC_LABEL), "public")
            .when(label.isin(*DII_LABELS), F.concat(F.lit("dii_"), label)).otherwise(fii))


def table_resolve(labels: DataFrame, percentages: DataFrame, keys: list[str]) -> DataFrame:
    """Ownership percentages from labelled table rows: (keys, row_no, label) and row percentages."""
    text = F.trim(F.regexp_replace(F.lower(F.translate("label", " ", " ")), r"\s+", " "))
    rows = (labels.select(*keys, "row_no", label_kind(text).alias("kind")).filter(F.col("kind").isNotNull()).distinct()
            .join(percentages, [*keys, "row_no"], "left"))
    aggregate = F.col("kind").isin("promoter", "public")
    seen = rows.filter(aggregate | F.col("pct").isNotNull() | F.col("error").isNotNull()).groupBy(*keys, "kind").agg(
        F.min_by("pct", F.when(~aggregate, F.col("row_no"))).alias("first"), F.max_by(F.struct("pct"), "row_no").alias("last"),
        F.max("error").alias("error"))
    value = F.when(F.col("kind").isin("promoter", "public"), F.coalesce("last.pct", F.lit(0.0))).otherwise(F.col("first"))

    def one(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("_v")))
    stats = seen.withColumn("_v", value).groupBy(*keys).agg(
        F.max("error").alias("_error"), one("promoter").alias("promoter_pct"), one("public").alias("public_pct"),
        F.coalesce(F.sum(F.when(F.col("kind").isin("fii_i", "fii_ii", "fii_iii"), F.col("_v"))), one("fii_aggregate"), one("fii_legacy"), F.lit(0.0)).alias("fii_pct"),
        F.coalesce(F.sum(F.when(F.col("kind").startswith("dii_"), F.col("_v"))), F.lit(0.0)).alias("dii_pct"), one("dii_mutual funds").alias("mf_pct"))
    error = F.coalesce("_error", F.when(F.col("promoter_pct").isNull() | F.col("public_pct").isNull(), "no_aggregate_rows"))
    return stats.select(*keys, error.alias("error"), *[F.when(error.isNull(), F.round(c, 4)).alias(c) for c in
                                                       ("promoter_pct", "fii_pct", "dii_pct", "public_pct", "mf_pct")])


def newest_filings(rows: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return rows
    order = W.partitionBy("company").orderBy(F.desc("quarter_end"))
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).drop("_k")


def earliest_broadcasts(index: DataFrame, limit: int | None = 2) -> DataFrame:
    """First exchange's rule: per (company, quarter) the earliest broadcast, then the newest quarters."""
    quarter = F.try_to_timestamp(F.trim("date"), F.lit("d-MMM-yyyy")).cast("date")
    published = F.try_to_timestamp(F.regexp_replace(F.trim("broadcast"), r"\s+", " "), F.lit("d-MMM-yyyy H:mm:ss"))
    usable = index.filter(F.col("url").startswith("http")).select("company", quarter.alias("quarter_end"), published.alias("published"), "url")
    usable = usable.filter(F.col("quarter_end").isNotNull() & F.col("published").isNotNull())
    kept = usable.groupBy("company", "quarter_end").agg(F.min_by(F.struct("published", "url"), F.struct("published", "url")).alias("f"))
    out = kept.select("company", "quarter_end", F.col("f.url").alias("url"), C.filing_type_of("quarter_end").alias("filing_type"),
                      F.date_format("f.published", "yyyy-MM-dd'T'HH:mm").alias("published_at"))
    return newest_filings(out, limit)


def usable_attachments(index: DataFrame, limit: int | None = 2) -> DataFrame:
    """Second exchange's rule: per (company, quarter) the first usable row in index order."""
    quarter = F.substring("end_date", 1, 10).try_cast("date")
    usable = index.filter(F.coalesce(F.col("is_xbrl"), F.lit(False)) & F.col("attachment").isNotNull() & (F.col("attachment") != "")
                          & ~F.col("attachment").endswith("/")).withColumn("quarter_end", quarter).filter(F.col("quarter_end").isNotNull())
    first = F.struct(F.col("position"))
    kept = usable.groupBy("company", "quarter_end").agg(F.min_by(F.struct("attachment", "published_at"), first).alias("f"))
    out = kept.select("company", "quarter_end", F.concat(F.lit(EXCHANGE_SITE), "f.attachment").alias("url"),
                      C.filing_type_of("quarter_end").alias("filing_type"), F.col("f.published_at").alias("published_at"))
    return newest_filings(out, limit)


def filing_backlog(universe: DataFrame, filings: DataFrame, wanted: int = 1) -> DataFrame:
    """Securities still to fetch: fewer than ``wanted`` filings, or any without MF share or broadcast time."""
    complete = filings.groupBy("isin").agg(
        F.count(F.lit(1)).alias("n"), F.count("mf_pct").alias("m"), F.count("published_at").alias("p")).filter(
        (F.col("n") >= wanted) & (F.col("m") == F.col("n")) & (F.col("p") == F.col("n")))
    return universe.select("isin").distinct().join(complete, "isin", "left_anti")
