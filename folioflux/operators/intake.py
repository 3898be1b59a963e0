"""Monthly deliveries of the fund houses: problems of each folder and whether it is taken.

``folders``: (amc_name, report_month), every folder found. ``files``: (amc_name, report_month, file, archived, error),
its workbooks, whether each came out of an archive, and why it could not be read. ``sheets``: (amc_name, report_month,
file, sheet, scheme_title, n_rows), the scheme sheets read. ``named``: (amc_name, report_month, file, named_month), months
named above the portfolios. ``registry``: (position, amc_name, brands ARRAY, holdings_file), the houses in order; a house
whose archives hold other tables too names its workbooks of holdings by a pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions.classify import normalize_scheme_name
from folioflux.operators.normalize import normalise_text
from folioflux.sources.staging import cut

HOUSE = ["amc_name", "report_month"]
FILE = [*HOUSE, "file"]


def brand_owners(titles: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, owner): the house whose brand a title begins with, word by word; of several the first one registered.

    The brands are a trie spelled out as prefixes: every word prefix of a title looks up one brand, so the work of a
    title is its number of words, whatever the number of brands.
    """
    brands = registry.select("position", F.col("amc_name").alias("owner"), F.explode("brands").alias("_prefix"))
    words = F.filter(F.split(normalise_text(F.col("scheme_title")), " "), lambda w: w != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    rows = titles.filter(F.size(words) > 0).select(*keys, F.explode(prefixes).alias("_prefix"))
    return rows.join(brands, "_prefix").groupBy(*keys).agg(F.min_by("owner", "position").alias("owner"))


def _workbooks(folders: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """The workbooks that count, those of registered houses only, and for each house what its own rule leaves out."""
    rules = registry.select("amc_name", "holdings_file")
    rows = files.join(folders.select(*HOUSE).distinct(), HOUSE, "left_semi").join(rules, "amc_name")
    named = F.coalesce(F.rlike(F.lower("file"), F.col("holdings_file")), F.lit(False))
    return rows.withColumn("_named", named).withColumn("_rule", F.col("holdings_file").isNotNull()).drop("holdings_file")


def intake(folders: DataFrame, files: DataFrame, sheets: DataFrame, named: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems, verdicts).

    problems: (amc_name, report_month, problem, detail). verdicts: (amc_name, report_month, status, n_files, n_skipped,
    n_schemes, n_rows, problems): a folder is ``ok``, ``refused`` with its problems, or ``unknown``; a registered house
    without a folder in a month with deliveries is ``missing``. A workbook dated another month, unreadable or without
    scheme sheets takes no part in the other checks; one without sheets from an archive is only skipped. Files outside
    of any folder carry no house and are problems of the month.
    """
    folders = folders.select(*HOUSE).distinct()
    known = folders.join(registry.select("amc_name"), "amc_name", "left_semi")
    problem = lambda df, name, detail: df.select(*HOUSE, F.lit(name).alias("problem"), detail.alias("detail"))

    books = _workbooks(known, files, registry)
    ruled = books.groupBy(*HOUSE).agg(F.bool_or(F.col("_rule") & (F.col("_named") | F.col("archived"))).alias("_on"), F.bool_or("_named").alias("_any"))
    unnamed = ruled.filter(F.col("_on") & ~F.col("_any"))
    books = books.join(ruled.select(*HOUSE, "_on"), HOUSE).filter(~F.col("_on") | F.col("_named"))
    months = named.groupBy(*FILE).agg(F.bool_or(F.col("named_month") == F.col("report_month")).alias("_dated"), F.array_join(
        F.sort_array(F.collect_set("named_month")), ", ").alias("_months"))
    held = sheets.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_sheets"))
    books = books.join(held, FILE, "left").join(months, FILE, "left")
    empty = F.col("_sheets").isNull()
    fate = (F.when(F.col("error").isNotNull(), "unreadable_workbook").when(empty & F.col("archived"), "skipped").when(empty, "no_scheme_sheets")
            .when(~F.coalesce("_dated", F.lit(True)), "dated_another_month").otherwise("taken"))
    # Workbooks and accepted sheets feed most of the checks: computed once.
    books = cut(books.select(*FILE, "error", "_months", fate.alias("fate")))
    refused = books.filter(~F.col("fate").isin("taken", "skipped")).select(*HOUSE, F.col("fate").alias("problem"), F.concat_ws(
        ": ", "file", F.when(F.col("fate") == "unreadable_workbook", F.col("error")).when(F.col("fate") == "dated_another_month", F.col("_months"))).alias("detail"))

    taken = cut(sheets.join(books.filter("fate = 'taken'").select(*FILE), FILE, "left_semi"))
    place = F.concat("file", F.lit(" ["), "sheet", F.lit("]"))
    twice = taken.groupBy(*HOUSE, normalize_scheme_name("sheet").alias("_key")).agg(F.sort_array(F.collect_set(place)).alias("_places")) \
        .filter(F.size("_places") > 1)
    titles = taken.groupBy(*HOUSE, "sheet").agg(F.min_by("scheme_title", F.when(F.col("scheme_title").isNotNull(), F.col("file"))).alias("scheme_title"))
    owners = brand_owners(titles, registry, [*HOUSE, "sheet"]).filter(F.col("owner") != F.col("amc_name"))

    counts = books.groupBy(*HOUSE).agg(F.count_if(F.col("fate") != "skipped").alias("n_files"), F.count_if(F.col("fate") == "skipped").alias("n_skipped"))
    sizes = taken.groupBy(*HOUSE).agg(F.count_distinct("sheet").alias("n_schemes"), F.sum("n_rows").alias("n_rows"))
    found = (refused.unionByName(problem(twice, "scheme_in_two_files", F.array_join("_places", " and ")))
             .unionByName(problem(owners, "belongs_to_another_house", F.concat("sheet", F.lit(": "), "owner")))
             .unionByName(problem(unnamed, "no_holdings_workbook", F.lit(None).cast("string"))))
    found = cut(found)
    facts = known.join(counts, HOUSE, "left").join(sizes, HOUSE, "left").join(found.select(*HOUSE).distinct().withColumn("_found", F.lit(True)), HOUSE, "left")
    nothing = F.col("_found").isNull() & F.col("n_schemes").isNull()
    bare = F.col("n_files").isNull()
    found = (found.unionByName(problem(facts.filter(nothing & bare), "no_workbook", F.lit(None).cast("string")))
             .unionByName(problem(facts.filter(nothing & ~bare), "no_portfolio", F.lit(None).cast("string")))
             .unionByName(problem(folders.join(registry.select("amc_name"), "amc_name", "left_anti"), "unknown_house", F.lit(None).cast("string")))
             .unionByName(problem(files.filter(F.col("amc_name").isNull()), "file_outside_a_folder", F.col("file"))))

    lists = found.groupBy(*HOUSE).agg(F.sort_array(F.collect_list(F.struct("problem", "detail"))).alias("problems"),
                                      F.bool_or(F.col("problem") == "unknown_house").alias("_unknown"))
    numbers = ("n_files", "n_skipped", "n_schemes", "n_rows")
    verdicts = folders.join(facts.select(*HOUSE, *numbers), HOUSE, "left").join(lists, HOUSE, "left").select(
        *HOUSE, F.when(F.col("_unknown"), "unknown").when(F.col("problems").isNotNull(), "refused").otherwise("ok").alias("status"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers],
        F.coalesce("problems", F.array().cast(lists.schema["problems"].dataType)).alias("problems"))
    months_seen = folders.agg(F.collect_set("report_month")).scalar()   # a list of the calendar
    wanted = registry.select("amc_name").distinct().select("amc_name", F.explode(months_seen).alias("report_month"))
    absent = wanted.join(folders, HOUSE, "left_anti").select(
        *HOUSE, F.lit("missing").alias("status"), *[F.lit(0).cast("bigint").alias(n) for n in numbers],
        F.array().cast(lists.schema["problems"].dataType).alias("problems"))
    return found, verdicts.unionByName(absent)
