"""Scheme identity: stable ids for names that drift from month to month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflux.functions.classify import active_by_title, classify_scheme, normalize_scheme_name, squeeze_spaces
from folioflux.sources.staging import cut
from folioflux.sources.tables import RefusedInput


def backfill_identity(schemes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schemes with their key, and each scheme's own name as an alias."""
    keyed = schemes.withColumn("scheme_key", normalize_scheme_name("scheme_name"))
    aliases = keyed.select("scheme_id", F.col("scheme_name").alias("alias"), F.col("scheme_key").alias("alias_normalized"), F.lit("self").alias("source"))
    return keyed, aliases


def consecutive(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers from 1 in the given order: a range-partitioned sort, then the rows before each partition.

    The sorted rows are written once, so their places are fixed; the window runs over one row per partition.
    """
    placed = cut(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")).alias("_o"))
    return placed.withColumn("_p", part).join(before, "_p").select(*rows.columns, (F.col("_o") + place + 1).alias(out))


def resolve_schemes(names: DataFrame, schemes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(amc_name, raw_name, scheme_id, matched_by) for each distinct raw name.

    Exact name, then recorded alias, then normalised key; several matches on
    the deciding step are ambiguous and get no id. New names get ids above the
    stored maximum, ordered by house and key; numbering runs over new names only.
    """
    asked = names.select("amc_name", "raw_name", normalize_scheme_name("raw_name").alias("key")).distinct()
    exact = schemes.groupBy("amc_name", F.col("scheme_name").alias("raw_name")).agg(F.min("scheme_id").alias("_exact"))
    owned = aliases.join(schemes.select("scheme_id", "amc_name"), "scheme_id")

    def matches(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.groupBy("amc_name", F.col(key).alias("key")).agg(F.min("scheme_id").alias(out), F.count_distinct("scheme_id").alias(f"{out}_n"))
    joined = (asked.join(exact, ["amc_name", "raw_name"], "left").join(matches(owned, "alias_normalized", "_alias"), ["amc_name", "key"], "left")
              .join(matches(schemes, "scheme_key", "_key"), ["amc_name", "key"], "left"))
    how = (F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias_n") > 1, "ambiguous").when(F.col("_alias").isNotNull(), "alias")
           .when(F.col("_key_n") > 1, "ambiguous").when(F.col("_key").isNotNull(), "key").otherwise("new"))
    found = joined.withColumn("matched_by", how).withColumn("scheme_id", F.when(how != "ambiguous", F.coalesce("_exact", "_alias", "_key")))
    fresh = found.filter(F.col("matched_by") == "new").select("amc_name", "key").distinct()
    top = schemes.agg(F.max("scheme_id")).scalar()
    numbered = consecutive(fresh, ["amc_name", "key"], "_r").select("amc_name", "key", (top + F.col("_r")).alias("_new"))
    return (found.join(numbered, ["amc_name", "key"], "left")
            .select("amc_name", "raw_name", F.coalesce("scheme_id", F.when(F.col("matched_by") == "new", F.col("_new"))).alias("scheme_id"), "matched_by"))


def alias_clashes(proposed: DataFrame, schemes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Proposed (scheme_id, alias) with the reason each is refused, NULL when it may be recorded."""
    rows = proposed.join(schemes.select("scheme_id", "amc_name"), "scheme_id", "left").withColumn("alias_normalized", normalize_scheme_name("alias"))
    taken = (aliases.join(schemes.select("scheme_id", "amc_name"), "scheme_id")
             .groupBy("amc_name", "alias_normalized").agg(F.min("scheme_id").alias("_lo"), F.max("scheme_id").alias("_hi")))
    joined = rows.join(taken, ["amc_name", "alias_normalized"], "left")
    clash = (F.col("_lo") != F.col("scheme_id")) | (F.col("_hi") != F.col("scheme_id"))
    reason = (F.when(F.col("amc_name").isNull(), "unknown_scheme").when(F.col("alias_normalized") == "", "blank_alias")
              .when(F.coalesce(clash, F.lit(False)), "resolves_to_another_scheme"))
    return joined.select("scheme_id", "alias", "alias_normalized", reason.alias("refused"))


def list_schemes(schemes: DataFrame, aliases: DataFrame, scheme_months: DataFrame) -> DataFrame:
    """Each scheme with its other names and the months it holds (both short lists)."""
    other = aliases.join(schemes.select("scheme_id", "scheme_name"), "scheme_id").filter(F.col("alias") != F.col("scheme_name"))
    names = other.groupBy("scheme_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    months = scheme_months.groupBy("scheme_id").agg(F.sort_array(F.collect_set("report_month")).alias("months"))
    empty = F.array().cast("array<string>")
    return (schemes.select("scheme_id", "amc_name", "scheme_name", "scheme_key").join(names, "scheme_id", "left").join(months, "scheme_id", "left")
            .withColumn("aliases", F.coalesce("aliases", empty)).withColumn("months", F.coalesce("months", empty)))


def merge_problems(merges: DataFrame, schemes: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(source_id, target_id, reason, table_name, rows): why merges are refused; a merge without rows here may be done.

    Refused are a scheme merged into itself, unknown schemes, schemes of two houses, a source named twice or also a
    target, and rows that both sides hold for one key in any of ``tables`` (name -> frame and keys beside scheme_id).
    """
    house = schemes.select("scheme_id", "amc_name")
    pair = ["source_id", "target_id"]
    sides = (merges.join(house.withColumnsRenamed({"scheme_id": "source_id", "amc_name": "_a"}), "source_id", "left")
             .join(house.withColumnsRenamed({"scheme_id": "target_id", "amc_name": "_b"}), "target_id", "left"))
    named = merges.select(F.col("source_id").alias("_s"), F.lit(1).alias("_as")).unionByName(merges.select(F.col("target_id").alias("_s"), F.lit(0).alias("_as")))
    uses = named.groupBy("_s").agg(F.sum("_as").alias("_sources"), F.count(F.lit(1)).alias("_uses"))
    sides = sides.join(uses.withColumnRenamed("_s", "source_id"), "source_id")
    alone = F.col("source_id") == F.col("target_id")
    reason = (F.when(alone, "same_scheme").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_scheme")
              .when(F.col("_a") != F.col("_b"), "different_house").when((F.col("_sources") > 1) | (F.col("_uses") > F.col("_sources")), "named_again"))
    out = sides.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        *pair, "reason", F.lit(None).cast("string").alias("table_name"), F.lit(1).cast("bigint").alias("rows"))
    apart = merges.filter(F.col("source_id") != F.col("target_id"))
    for name, (table, keys) in tables.items():
        held = table.select("scheme_id", *keys)
        both = (apart.join(held.withColumnRenamed("scheme_id", "source_id"), "source_id")
                .join(held.withColumnRenamed("scheme_id", "target_id"), ["target_id", *keys])
                .groupBy(*pair).agg(F.count(F.lit(1)).alias("rows")))
        out = out.unionByName(both.select(*pair, F.lit("same_key_on_both").alias("reason"), F.lit(name).alias("table_name"), "rows"))
    return out


def merge_all(merges: DataFrame, schemes: DataFrame, aliases: DataFrame,
              tables: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Schemes without the sources, aliases with their names, and every table re-keyed; any problem refuses all of it."""
    problems = merge_problems(merges, schemes, tables).count()
    if problems:
        raise RefusedInput(f"{problems} problems; merge_problems lists them all")
    left = schemes.join(merges.select(F.col("source_id").alias("scheme_id")), "scheme_id", "left_anti").select(*schemes.columns)
    return left, merged_aliases(aliases, schemes, merges), {name: merge_schemes(table, merges) for name, (table, _) in tables.items()}


def merge_schemes(table: DataFrame, merges: DataFrame) -> DataFrame:
    """Re-key source ids to their target."""
    moved = table.join(merges.withColumnRenamed("source_id", "scheme_id"), "scheme_id", "left")
    return moved.withColumn("scheme_id", F.coalesce("target_id", "scheme_id")).drop("target_id").select(*table.columns)


def merged_aliases(aliases: DataFrame, schemes: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases after a merge: the source's names and aliases survive on the target."""
    names = (schemes.select("scheme_id", F.col("scheme_name").alias("alias")).unionByName(aliases.select("scheme_id", "alias"))
             .join(merges.withColumnRenamed("source_id", "scheme_id"), "scheme_id")
             .select(F.col("target_id").alias("scheme_id"), "alias", normalize_scheme_name("alias").alias("alias_normalized"), F.lit("merge").alias("source")))
    kept = aliases.select("scheme_id", "alias", "alias_normalized", "source").join(merges.select(F.col("source_id").alias("scheme_id")), "scheme_id", "left_anti")
    new = names.distinct().join(kept.select("scheme_id", "alias"), ["scheme_id", "alias"], "left_anti")
    return kept.unionByName(new)


def title_changes(schemes: DataFrame, titles: DataFrame) -> DataFrame:
    """Activity flags changed by a recorded title: (scheme_id, title, old_flag, new_flag)."""
    text = squeeze_spaces("title")
    rows = titles.select("scheme_id", text.alias("title")).filter((F.col("title") != "") & (F.col("title") != "nan"))
    joined = rows.join(schemes.select("scheme_id", F.col("is_active_equity").alias("old_flag")), "scheme_id").withColumn("new_flag", active_by_title("title"))
    return joined.filter(F.col("old_flag") != F.col("new_flag"))


def backfill_active_flag(schemes: DataFrame) -> DataFrame:
    """Flags where NULL; ``newly_excluded`` lists what that switched off."""
    flag = classify_scheme("scheme_name", "scheme_title")
    return (schemes.withColumn("newly_excluded", F.col("is_active_equity").isNull() & (flag == 0))
            .withColumn("is_active_equity", F.coalesce("is_active_equity", flag)))
