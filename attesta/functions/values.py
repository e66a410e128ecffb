"""Normalised readings: one struct type, and builders that keep uncertainty beside the value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attesta import vocabulary as V
from attesta.functions.text import ci, let

NORMALIZED_FIELDS = (
    ("uncertain", "boolean"), ("uncertainty_reasons", "array<string>"), ("candidates", "array<string>"),
    ("quantity", "decimal(18,6)"), ("unit", "string"), ("pack_count", "int"), ("measure", "string"),
    ("base_quantity", "decimal(38,12)"), ("base_unit", "string"),
    ("amount", "string"), ("currency", "string"), ("inclusive_of_all_taxes", "boolean"),
    ("per_unit", "string"), ("per_measure", "string"),
    ("date", "string"), ("year_month", "string"), ("duration_value", "double"), ("duration_unit", "string"),
    ("emails", "array<string>"), ("phones", "array<string>"), ("country_text", "string"),
    ("name", "string"), ("declaration", "string"), ("batch_number", "string"), ("matched_by", "string"),
)
NORMALIZED_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in NORMALIZED_FIELDS) + ">"
BOX_TYPE = "struct<x:int,y:int,width:int,height:int>"


def normalized(**values: Column) -> Column:
    """A reading struct; parts that are not given are null."""
    return F.struct(*[
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in NORMALIZED_FIELDS
    ])


def certain(**values: Column) -> Column:
    return normalized(uncertain=F.lit(False), **values)


def uncertain(reason: Column | str, **values: Column) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return normalized(uncertain=F.lit(True), uncertainty_reasons=F.array(text), **values)


def mark_uncertain(value: Column, reason: Column | str) -> Column:
    """Flag a reading and append the reason once."""
    text = F.lit(reason) if isinstance(reason, str) else reason

    def flag(v):
        known = F.coalesce(v["uncertainty_reasons"], F.array().cast("array<string>"))
        return v.withField("uncertain", F.lit(True)).withField(
            "uncertainty_reasons", F.array_union(known, F.array(text))
        )

    return let(value, flag)


def is_uncertain(value: Column) -> Column:
    """Null reading, or a reading that does not say it is certain."""
    return F.coalesce(value["uncertain"], F.lit(True))


# --- numbers ---------------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def parse_decimal(text: Column) -> Column:
    """A printed number, or null where the digits cannot be read one way only."""
    cleaned = _digits(text)
    whole = F.substring_index(cleaned, ".", 1)
    grouped = whole.rlike(r"^\d{1,3}(,\d{2,3})+$")
    plain = F.when(F.contains(cleaned, F.lit(",")), F.when(grouped, F.replace(cleaned, F.lit(","), F.lit(""))))
    value = F.when(F.contains(cleaned, F.lit(",")), plain).otherwise(cleaned).try_cast("decimal(18,6)")
    return F.when(value >= 0, value)


def decimal_reason(text: Column) -> Column:
    """Why ``parse_decimal`` refused, else null."""
    cleaned = _digits(text)
    return (
        F.when(F.coalesce(F.length(cleaned), F.lit(0)) == 0, F.lit("no digits found"))
        .when(parse_decimal(text).isNotNull(), F.lit(None).cast("string"))
        .when(F.contains(cleaned, F.lit(",")), F.lit("comma could be a decimal point or a separator"))
        .when(cleaned.rlike(r"^-\d"), F.lit("negative quantities do not appear on packaging"))
        .otherwise(F.lit("not a number"))
    )


def plain_number(value: Column) -> Column:
    """Shortest exact text of a decimal: no trailing zeros, no trailing point."""
    text = value.cast("string")
    return F.when(
        F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    ).otherwise(text)


def unit_form(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(unit)), r"\.+$", "")


def _factor(unit: Column, table: dict[str, str]) -> Column:
    pairs = [item for u, f in table.items() for item in (F.lit(u), F.lit(f).cast("decimal(18,6)"))]
    return F.try_element_at(F.create_map(*pairs), unit)


def unit_family(unit: Column) -> Column:
    u = unit_form(unit)
    return (
        F.when(u.isin(*V.MASS_UNITS), F.lit("mass"))
        .when(u.isin(*V.VOLUME_UNITS), F.lit("volume"))
        .when(u.isin(*V.COUNT_UNITS), F.lit("count"))
    )


def normalise_quantity(value_text: Column, unit_text: Column, pack_text: Column | None = None) -> Column:
    """Quantity with an exact base value in g or ml; count units have none; anything else is uncertain."""
    pack_text = F.lit(None).cast("string") if pack_text is None else F.when(F.length(pack_text) > 0, pack_text)
    parts = F.struct(
        parse_decimal(value_text).alias("value"), decimal_reason(value_text).alias("reason"),
        unit_form(unit_text).alias("unit"), unit_family(unit_text).alias("family"),
        pack_text.isNotNull().alias("packed"), parse_decimal(pack_text).alias("pack"),
    )

    def build(p):
        value, unit, family = p["value"], p["unit"], p["family"]
        bad_pack = p["packed"] & ~F.coalesce(p["pack"] > 0, F.lit(False))
        factor = F.coalesce(_factor(unit, V.MASS_UNITS), _factor(unit, V.VOLUME_UNITS))
        total = (value * factor).cast("decimal(36,12)") * F.coalesce(p["pack"], F.lit(1)).cast("decimal(4,0)")
        read = dict(quantity=value, unit=unit, pack_count=p["pack"])
        return (
            F.when(value.isNull(), uncertain(p["reason"], unit=F.when(F.length(unit) > 0, unit)))
            .when(bad_pack, uncertain("multi-pack count could not be parsed", quantity=value, unit=unit))
            .when(family.isin("mass", "volume"), certain(
                measure=family, base_quantity=total,
                base_unit=F.when(family == "mass", F.lit("g")).otherwise(F.lit("ml")), **read))
            .when(family == "count", certain(measure=family, **read))
            .otherwise(uncertain("unrecognised unit", **read))
        )

    return let(parts, build)


def _decimals(text: Column) -> Column:
    cleaned = _digits(text)
    return F.when(
        F.contains(cleaned, F.lit(".")), F.length(F.substring_index(cleaned, ".", -1))
    ).otherwise(F.lit(0))


def price_text(amount_text: Column) -> Column:
    """The amount as printed, without group separators: exact, and never a binary float."""
    return F.replace(_digits(amount_text), F.lit(","), F.lit(""))


def normalise_price(amount_text: Column, inclusive: Column | None = None, currency: str = "INR") -> Column:
    cur = F.lit(currency)
    tax = F.lit(None).cast("boolean") if inclusive is None else inclusive
    parts = F.struct(
        parse_decimal(amount_text).alias("value"), decimal_reason(amount_text).alias("reason"),
        _decimals(amount_text).alias("decimals"), price_text(amount_text).alias("text"), tax.alias("tax"),
    )
    return let(parts, lambda p: (
        F.when(p["value"].isNull(), uncertain(p["reason"], currency=cur))
        .when(p["decimals"] > 2, uncertain(
            "more decimal places than a retail price carries", currency=cur, candidates=F.array(p["text"])))
        .otherwise(certain(amount=p["text"], currency=cur, inclusive_of_all_taxes=p["tax"]))
    ))


def normalise_unit_price(amount_text: Column, unit_text: Column, currency: str = "INR") -> Column:
    """A price tied to one unit of measure.  The amount is never converted to another unit."""
    parts = F.struct(
        unit_form(unit_text).alias("unit"), unit_family(unit_text).alias("family"),
        normalise_price(amount_text, currency=currency).alias("price"),
    )

    def build(p):
        with_unit = p["price"].withField("per_unit", F.when(F.length(p["unit"]) > 0, p["unit"]))
        return (
            F.when(p["price"]["uncertain"], with_unit)
            .when(p["family"].isNull(), mark_uncertain(with_unit, "unrecognised unit"))
            .otherwise(with_unit.withField("per_measure", p["family"]))
        )

    return let(parts, build)


# --- dates -----------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text).try_cast("int")


def _year(text: Column) -> Column:
    n = _number(text)
    return F.when(F.length(text) == 2, n + 2000).when(n.between(1900, 2999), n)


def _valid_day(day: Column, month: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = (
        F.when(month.isin(4, 6, 9, 11), F.lit(30))
        .when(month == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28)))
        .otherwise(F.lit(31))
    )
    return F.coalesce(month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False))


def _iso(year: Column, month: Column, day: Column | None = None) -> Column:
    parts = [F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0")]
    if day is not None:
        parts.append(F.lpad(day.cast("string"), 2, "0"))
    return F.concat_ws("-", *parts)


def numeric_date(first: Column, second: Column, year_text: Column) -> Column:
    """Two numbers and a year.  Both orders valid means both are reported and none is chosen."""
    numbers = F.struct(_number(first).alias("a"), _number(second).alias("b"), _year(year_text).alias("year"))
    orders = let(numbers, lambda n: F.struct(
        n["a"].alias("a"), n["b"].alias("b"), n["year"].alias("year"),
        _valid_day(n["a"], n["b"], n["year"]).alias("day_month"),
        _valid_day(n["b"], n["a"], n["year"]).alias("month_day"),
        _iso(n["year"], n["b"], n["a"]).alias("as_day_month"), _iso(n["year"], n["a"], n["b"]).alias("as_month_day"),
    ))
    return let(orders, lambda o: (
        F.when(o["year"].isNull(), uncertain("not a usable year"))
        .when(o["a"].isNull() | o["b"].isNull(), uncertain("date components could not be read as numbers"))
        .when(o["day_month"] & o["month_day"], uncertain(
            "both DD/MM and MM/DD are valid readings of this date",
            candidates=F.array(o["as_day_month"], o["as_month_day"])))
        .when(o["day_month"], certain(date=o["as_day_month"]))
        .when(o["month_day"], certain(date=o["as_month_day"]))
        .otherwise(uncertain("not a valid calendar date"))
    ))


def month_year_date(month_text: Column, year_text: Column) -> Column:
    parts = F.struct(_number(month_text).alias("month"), _year(year_text).alias("year"))
    return let(parts, lambda p: F.when(
        F.coalesce(p["month"].between(1, 12) & p["year"].isNotNull(), F.lit(False)),
        certain(year_month=_iso(p["year"], p["month"])),
    ).otherwise(uncertain("not a usable month and year")))


def named_month_date(day_text: Column, month_name: Column, year_text: Column) -> Column:
    months = F.create_map(*[x for name, n in V.MONTHS.items() for x in (F.lit(name), F.lit(n))])
    parts = F.struct(
        F.try_element_at(months, unit_form(month_name)).alias("month"), _year(year_text).alias("year"),
        _number(day_text).alias("day"), F.coalesce(F.length(day_text) > 0, F.lit(False)).alias("has_day"),
    )
    return let(parts, lambda p: (
        F.when(p["year"].isNull(), uncertain("not a usable year"))
        .when(p["month"].isNull(), uncertain("unrecognised month name"))
        .when(p["has_day"] & _valid_day(p["day"], p["month"], p["year"]),
              certain(date=_iso(p["year"], p["month"], p["day"])))
        .when(p["has_day"], uncertain("not a valid day of the month"))
        .otherwise(certain(year_month=_iso(p["year"], p["month"])))
    ))


def normalise_duration(count_text: Column, unit_text: Column) -> Column:
    """A shelf life stays a value and a unit; no date is computed from it."""
    parts = F.struct(
        parse_decimal(count_text).alias("count"), F.regexp_replace(F.lower(F.trim(unit_text)), r"[s.]+$", "").alias("unit")
    )
    return let(parts, lambda p: (
        F.when(~F.coalesce(p["count"] > 0, F.lit(False)), uncertain("duration could not be parsed"))
        .when(p["unit"].isin("day", "week", "month", "year"),
              certain(duration_value=p["count"], duration_unit=F.concat(p["unit"], F.lit("s"))))
        .otherwise(uncertain("unrecognised duration unit"))
    ))


def date_in(text: Column) -> Column:
    """The first date or shelf life in ``text``: ISO, named month, numeric, month/year, duration."""
    def read(source):
        found = lambda pattern: source.rlike(ci(pattern))
        group = lambda pattern, index: F.regexp_extract(source, ci(pattern), index)
        # every form has a digit
        return F.when(source.rlike(r"(?U)\d"), (
            F.when(found(V.ISO_DATE), numeric_date(group(V.ISO_DATE, 3), group(V.ISO_DATE, 2), group(V.ISO_DATE, 1)))
            .when(found(V.NAMED_MONTH_DATE), named_month_date(*[group(V.NAMED_MONTH_DATE, n) for n in (1, 2, 3)]))
            .when(found(V.NUMERIC_DATE), numeric_date(*[group(V.NUMERIC_DATE, n) for n in (1, 2, 3)]))
            .when(found(V.MONTH_YEAR_DATE), month_year_date(group(V.MONTH_YEAR_DATE, 1), group(V.MONTH_YEAR_DATE, 2)))
            .when(found(V.DURATION), normalise_duration(group(V.DURATION, 1), group(V.DURATION, 2)))
        ))

    return let(text, read)


# --- evidence quality ------------------------------------------------------------------------


def confidence_is_low(confidence: Column) -> Column:
    """Reported and below the threshold.  Not reported is not low."""
    return F.coalesce(confidence < V.LOW_CONFIDENCE, F.lit(False))


def supports_violation(value: Column, confidence: Column) -> Column:
    return ~is_uncertain(value) & ~confidence_is_low(confidence)


def evidence_note(value: Column, confidence: Column) -> Column:
    """Which signal withheld a conclusion; empty when none did."""
    reasons = F.coalesce(value["uncertainty_reasons"], F.array().cast("array<string>"))
    why = F.when(F.size(reasons) > 0, F.concat(F.lit(": "), F.array_join(reasons, "; "))).otherwise(F.lit(""))
    return (
        F.when(is_uncertain(value), F.concat(F.lit("reading not interpreted with confidence"), why))
        .when(confidence_is_low(confidence), F.format_string(
            "confidence %s is below %s", confidence.cast("string"), F.lit(str(V.LOW_CONFIDENCE))))
        .otherwise(F.lit(""))
    )


def committed(value: Column) -> Column:
    """The reading asserts something beyond bookkeeping."""
    parts = [value[name].isNotNull() for name, _ in NORMALIZED_FIELDS if name not in V.BOOKKEEPING_KEYS]
    result = parts[0]
    for part in parts[1:]:
        result = result | part
    return F.coalesce(result, F.lit(False))
