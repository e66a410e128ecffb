"""Rule files as a source: read, validate with all errors reported, and load all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta import vocabulary as V
from attesta.operators import checks as C

REQUIRED_KEYS = ("code", "title", "requirement", "source_status", "check_type")
ALLOWED_KEYS = REQUIRED_KEYS + (
    "legal_reference", "requires_applicability_conditions", "source_note", "severity", "parameters",
    "applies_to_category_codes", "effective_from", "effective_to", "is_active")
RULE_SCHEMA = (
    "code string, title string, requirement string, source_status string, source_note string, severity string, "
    "check_type string, parameters struct<field_key:string,field_keys:array<string>>, applies_to_category_codes array<string>, "
    "legal_reference string, effective_from string, effective_to string, is_active boolean, requires_applicability_conditions boolean")


def read_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content), one row per ``*.json`` file."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse_rules(files: DataFrame) -> DataFrame:
    """(path, keys, rule): comment keys dropped, null rule where the top level is not an object."""
    valid = F.try_parse_json("content").isNotNull() & F.ltrim("content").startswith("{")
    keys = F.filter(F.json_object_keys(F.when(valid, F.col("content"))), lambda k: ~k.startswith("_"))
    return files.select("path", keys.alias("keys"), F.when(valid, F.from_json("content", RULE_SCHEMA)).alias("rule"))


def rule_errors(parsed: DataFrame) -> DataFrame:
    """(path, error): everything wrong with each file."""
    r = lambda c: F.col(f"rule.{c}")
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    blank = lambda c: F.coalesce(F.length(F.trim(r(c))) == 0, F.lit(True))
    missing, unknown = F.array_except(lits(REQUIRED_KEYS), F.col("keys")), F.array_except(F.col("keys"), lits(ALLOWED_KEYS))
    date = lambda c: F.try_to_date(r(c), "yyyy-MM-dd")
    given = lambda c: F.coalesce(F.length(r(c)) > 0, F.lit(False))
    params = F.coalesce(r("parameters.field_keys"), F.when(r("parameters.field_key").isNotNull(), F.array(r("parameters.field_key"))),
                        F.array().cast("array<string>"))
    say = lambda cond, message: F.when(F.coalesce(cond, F.lit(False)), F.lit(message) if isinstance(message, str) else message)
    present = F.col("rule").isNotNull() & (F.size(missing) == 0)
    errors = F.array_compact(F.array(
        say(F.col("rule").isNull(), "not a JSON object"),
        say(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", "))),
        say(F.size(unknown) > 0, F.concat(F.lit("unrecognised: "), F.array_join(F.array_sort(unknown), ", "))),
        say(present & (blank("code") | blank("title") | blank("requirement")), "empty code, title or requirement"),
        say(present & ~r("source_status").isin(*V.SOURCE_STATUSES), "bad source_status"),
        say(present & (r("source_status") == "verified") & blank("source_note"), "source_note required when verified"),
        say(present & ~F.coalesce(r("severity"), F.lit("major")).isin(*V.SEVERITIES), "bad severity"),
        F.when(present, C.parameter_problem(r("check_type"), params)),
        say(given("effective_from") & date("effective_from").isNull(), "effective_from is not a date"),
        say(given("effective_to") & date("effective_to").isNull(), "effective_to is not a date"),
        say(date("effective_to") < date("effective_from"), "effective_to precedes effective_from"),
    ))
    return parsed.select("path", F.explode(errors).alias("error"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def dangling(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """References to codes the dimension does not hold."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(known.columns[0]).alias(column)), column, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Full outer merge with an ``action`` per row; rows absent from the input stay as they are."""
    cols = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*cols).alias("old"))
    new = incoming.select(key, F.struct(*cols).alias("new"))
    action = (F.when(F.col("new").isNull(), F.lit("kept")).when(F.col("old").isNull(), F.lit("created"))
              .when(F.col("old").eqNullSafe(F.col("new")), F.lit("unchanged")).otherwise(F.lit("updated")))
    value = F.coalesce("new", "old")
    return old.join(new, key, "full_outer").select(key, *[value[c].alias(c) for c in cols], action.alias("action"))


def replace_links(current: DataFrame, wanted: DataFrame, owner: str = "clause") -> DataFrame:
    """Links after a sync: owners that were supplied get exactly the supplied links (full key)."""
    untouched = current.join(wanted.select(owner).distinct(), owner, "left_anti")
    return untouched.unionByName(wanted)
