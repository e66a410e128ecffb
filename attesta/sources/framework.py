"""Framework files: nested JSON lists read as rows, with every fault located by its JSON path.

A file is one row of text and one variant; lists are exploded with their position, nested lists with the key of what holds them.  What an
entry must look like is a `Shape`; all its rules are columns over the entry, so files are read once however many rules there are.
Nothing is dropped on the way: an entry with a fault is a row of `entries` and one of `faults`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta import vocabulary as V


@dataclass(frozen=True)
class Shape:
    """Keys of an entry: required ones, optional ones, and what their values must be."""

    required: Sequence[str]
    optional: Sequence[str] = ()
    texts: Sequence[str] = ()
    choices: Mapping[str, Sequence[str]] = field(default_factory=dict)
    dates: Sequence[str] = ()
    flags: Sequence[str] = ()
    lists: Sequence[str] = ()
    text_lists: Sequence[str] = ()
    note: str | None = None
    #: The columns that must not repeat within a file.
    unique: Sequence[str] = ()


#: The keys of each kind of entry.
SHAPES = {
    "instruments": Shape(
        ("citation", "instrument_type", "verification_status"),
        ("title", "notified_on", "effective_from", "source_url", "source_sha256", "verification_note", "is_active"), ("citation",),
        {"instrument_type": V.INSTRUMENT_TYPES, "verification_status": V.VERIFICATION_STATUSES}, ("notified_on", "effective_from"), ("is_active",),
        note="verification_note", unique=("citation",)),
    "conditions": Shape(
        ("code", "name", "determination"), ("description", "determination_note", "category_code", "is_active"), ("code", "name"),
        {"determination": V.DETERMINATIONS}, flags=("is_active",), unique=("code",)),
    "rules": Shape(
        ("rule_number", "title", "automation_class", "verification_status"), ("chapter", "description", "notes", "is_active", "requirements"), ("rule_number", "title"),
        {"automation_class": V.AUTOMATION_CLASSES, "verification_status": V.VERIFICATION_STATUSES}, flags=("is_active",), lists=("requirements",), unique=("rule_number",)),
    "requirements": Shape(
        ("clause", "title", "requirement", "detection_method", "automation_class", "implementation_status", "verification_status"),
        ("version", "supersedes_version", "verbatim_text", "severity", "source", "legal_reference", "source_note", "effective_from", "effective_to", "is_active",
         "applicability", "compliance_rule_codes"),
        ("clause", "title", "requirement"),
        {"detection_method": V.DETECTION_METHODS, "automation_class": V.AUTOMATION_CLASSES, "implementation_status": V.IMPLEMENTATION_STATUSES,
         "verification_status": V.VERIFICATION_STATUSES, "severity": V.SEVERITIES},
        ("effective_from", "effective_to"), ("is_active",), ("applicability",), ("compliance_rule_codes",), "source_note", ("clause", "version")),
    "applicability": Shape(("condition", "mode"), ("note",), ("condition",), {"mode": V.LINK_MODES}),
}
PARENTS = {"requirements": "rules", "applicability": "requirements"}


def read_framework_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content), one row per ``*.json`` file."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("value").alias("content"))


def kind_of(entry: Column, key: str | None = None) -> Column:
    """STRING, BOOLEAN, BIGINT, ..., ARRAY or OBJECT; null where the key is missing, VOID where it is null."""
    value = entry if key is None else F.try_variant_get(entry, f"$.{key}", "variant")
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def text_of(entry: Column, key: str) -> Column:
    return F.try_variant_get(entry, f"$.{key}", "string")


def entries(files: DataFrame, kind: str) -> DataFrame:
    """(file, at, parent, entry): every entry of one kind with its JSON path and, if nested, the label of what holds it.

    ``files``: file, content.  Entries come from any file that has the list; an entry that is no object is a row as well.
    """
    above = PARENTS.get(kind)
    if above is None:
        held = files.select("file", F.lit("$").alias("at"), F.lit(None).cast("string").alias("parent"), F.try_parse_json("content").alias("entry"))
    else:
        held = entries(files, above)
        held = held.select("file", "at", F.concat_ws(" ", "parent", _name(above)).alias("parent"), "entry")
    listed = F.when(kind_of(F.col("entry")) == "OBJECT", F.when(kind_of(F.col("entry"), kind) == "ARRAY", F.try_variant_get("entry", f"$.{kind}", "array<variant>")))
    return held.select("file", "at", "parent", F.posexplode(listed).alias("n", "entry")).select(
        "file", F.concat("at", F.lit(f".{kind}["), F.col("n").cast("string"), F.lit("]")).alias("at"), "parent", "entry")


def _name(kind: str) -> Column:
    """What an entry is called in messages and in its children's ``parent``."""
    e, first = F.col("entry"), SHAPES[kind].required[0]
    name = F.coalesce(text_of(e, first), F.lit(f"<no {first}>"))
    return F.concat_ws(" v", name, F.coalesce(text_of(e, "version"), F.lit("1"))) if kind == "requirements" else name


def faults(files: DataFrame, kind: str) -> DataFrame:
    """(file, at, fault): everything wrong with the entries of one kind; a fault of a value names its key in the path."""
    shape, e = SHAPES[kind], F.col("entry")
    plain = kind_of(e) == "OBJECT"
    keys = F.filter(F.json_object_keys(F.to_json(F.when(plain, e))), lambda k: ~k.startswith("_"))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    given = lambda k: F.coalesce(kind_of(e, k) != "VOID", F.lit(False))
    is_ = lambda k, *kinds: F.coalesce(kind_of(e, k).isin(*kinds), F.lit(False))
    text = lambda k: F.when(is_(k, "STRING"), F.trim(text_of(e, k)))
    rows = entries(files, kind).withColumn("_keys", keys)
    missing = F.array_except(names(shape.required), F.coalesce("_keys", F.array().cast("array<string>")))
    unknown = F.array_sort(F.array_except(F.col("_keys"), names([*shape.required, *shape.optional])))
    there = lambda k: F.array_contains("_keys", k)
    found = []
    say = lambda at, when, what: found.append(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(at).alias("key"), (F.lit(what) if isinstance(what, str) else what).alias("fault"))))
    say("", ~plain, "not an object")
    say("", F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", ")))
    say("", F.size(unknown) > 0, F.concat(F.lit("unrecognised: "), F.array_join(unknown, ", ")))
    for k in shape.texts:
        say(k, there(k) & (F.coalesce(F.length(text(k)), F.lit(0)) == 0), "not a text")
    for k, values in shape.choices.items():
        say(k, there(k) & ~F.coalesce(is_(k, "STRING") & text_of(e, k).isin(*values), F.lit(False)), "not one of the values")
    day = lambda k: F.when(text(k).rlike(V.DATE_SHAPE), F.try_to_date(text(k), "yyyy-MM-dd"))
    for k in shape.dates:
        say(k, given(k) & (text_of(e, k) != "") & day(k).isNull(), "not a date")
    if {"effective_from", "effective_to"} <= set(shape.dates):
        say("effective_to", day("effective_to") < day("effective_from"), "ends before it begins")
    for k in shape.flags:
        say(k, there(k) & ~is_(k, "BOOLEAN"), "not true or false")
    for k in shape.lists:
        say(k, given(k) & ~is_(k, "ARRAY"), "not a list")
    for k in shape.text_lists:
        listed = F.try_variant_get(e, f"$.{k}", "array<variant>")
        say(k, given(k) & (~is_(k, "ARRAY") | F.exists(listed, lambda x: F.schema_of_variant(x) != "STRING")), "not a list of texts")
    if shape.note:
        say(shape.note, (text_of(e, "verification_status") == "verified") & (F.coalesce(F.length(text(shape.note)), F.lit(0)) == 0), "missing on a verified entry")
    if kind == "requirements":
        whole = lambda k: F.when(is_(k, "BIGINT"), F.try_variant_get(e, f"$.{k}", "bigint"))
        version = F.when(there("version"), whole("version")).otherwise(1)
        say("version", F.coalesce(version < 1, F.lit(True)), "not a whole number from 1")
        say("supersedes_version", given("supersedes_version") & F.coalesce(whole("supersedes_version") >= version, F.lit(True)), "not a whole number below the version")
    if kind == "rules":
        say("rule_number", F.coalesce(F.length(text("rule_number")) > 0, F.lit(False)) & ~text("rule_number").rlike(r"\d"), "has no digits")
    each = rows.select("file", "at", F.explode(F.array_compact(F.array(*found))).alias("f"))
    out = each.select("file", F.concat("at", F.when(F.col("f.key") != "", F.concat(F.lit("."), F.col("f.key"))).otherwise("")).alias("at"), "f.fault")
    if shape.unique:
        own = [F.coalesce(text_of(e, k), F.lit("1")) if k == "version" else text_of(e, k) for k in shape.unique]
        keyed = rows.select("file", "at", *[c.alias(f"_u{n}") for n, c in enumerate(own)]).where("_u0 IS NOT NULL")
        by = ["file", *[f"_u{n}" for n in range(len(own))]]
        again = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n > 1")
        out = out.union(again.select("file", "at", F.concat(F.lit("repeated: "), F.concat_ws(" v", *by[1:])).alias("fault")))
    return out


def file_faults(files: DataFrame, kinds: Sequence[str] = ("instruments", "conditions", "rules")) -> DataFrame:
    """(file, at, fault) of files that are no JSON object or hold none of the lists."""
    doc = F.try_parse_json("content")
    listed = F.lit(False)
    for k in kinds:
        listed = listed | F.coalesce(kind_of(F.col("_doc"), k) == "ARRAY", F.lit(False))
    fault = F.when(F.col("_doc").isNull(), F.lit("not valid JSON")).when(kind_of(F.col("_doc")) != "OBJECT", F.lit("not an object")).when(~listed, F.lit("no list of entries"))
    return files.withColumn("_doc", doc).select("file", F.lit("$").alias("at"), fault.alias("fault")).where("fault IS NOT NULL")


def all_faults(files: DataFrame) -> DataFrame:
    """Every fault of a folder of framework files."""
    out = file_faults(files)
    for kind in SHAPES:
        out = out.union(faults(files, kind))
    return out


def rows_of(files: DataFrame, kind: str) -> DataFrame:
    """The entries of one kind as typed columns: file, at, parent, and every key of its shape; a missing version is 1, a missing flag true."""
    shape, e = SHAPES[kind], F.col("entry")
    cast = {**dict.fromkeys(shape.dates, "date"), **dict.fromkeys(shape.flags, "boolean"), "version": "int", "supersedes_version": "int"}
    default = {"version": F.lit(1), **{k: F.lit(True) for k in shape.flags}, "severity": F.lit("major")}

    def value(k: str) -> Column:
        if k in shape.text_lists:
            return F.try_variant_get(e, f"$.{k}", "array<string>")
        v = F.try_variant_get(e, f"$.{k}", cast[k]) if cast.get(k) in ("int", "boolean") else F.trim(text_of(e, k))
        v = F.try_to_date(v, "yyyy-MM-dd") if cast.get(k) == "date" else v
        return F.coalesce(v, default[k]) if k in default else v

    return entries(files, kind).select("file", "at", "parent", *[value(k).alias(k) for k in (*shape.required, *shape.optional) if k not in shape.lists])
