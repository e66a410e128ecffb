"""The check registry.  A check is a column expression over one row: the run and its chosen readings.

All checks of a rule set are evaluated in one pass; adding a check adds a branch, not a shuffle.
Register your own with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from attesta import vocabulary as V
from attesta.functions import text as T, values as N

PASSED, FAILED, INCONCLUSIVE, NOT_APPLICABLE, ERROR = "passed", "failed", "inconclusive", "not_applicable", "error"


@dataclass(frozen=True)
class CheckInput:
    """Columns a check may read."""

    fields: Column          # map<declaration, reading>
    status: Column          # extraction status of the run
    text: Column            # recognised text of the run
    keys: Column            # array<string>, the rule's field keys

    @property
    def usable(self) -> Column:
        return F.coalesce(self.status == "completed", F.lit(False))

    def reading(self, key) -> Column:
        return F.try_element_at(self.fields, F.lit(key) if isinstance(key, str) else key)

    def first_key(self) -> Column:
        return F.try_element_at(self.keys, F.lit(1))


@dataclass(frozen=True)
class CheckSpec:
    check_type: str
    evaluate: Callable[[CheckInput], Column]
    parameter_problem: Callable[[Column], Column]   # array<string> keys -> message or null
    description: str


_REGISTRY: dict[str, CheckSpec] = {}


def register(spec: CheckSpec) -> CheckSpec:
    if spec.check_type in _REGISTRY:
        raise ValueError(f"check type {spec.check_type!r} is already registered")
    _REGISTRY[spec.check_type] = spec
    return spec


def unregister(check_type: str) -> None:
    _REGISTRY.pop(check_type, None)


def registered() -> tuple[str, ...]:
    return tuple(_REGISTRY)


def outcome(status, key, reason, reading: Column | None = None, excerpt: Column | None = None,
            detail: Column | None = None) -> Column:
    """The struct every check returns."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    raw = reading["raw_value"] if reading is not None else F.lit(None)
    return F.struct(
        as_col(status).cast("string").alias("status"),
        as_col(key).cast("string").alias("field_key"),
        as_col(reason).cast("string").alias("reason"),
        (excerpt if excerpt is not None else raw).cast("string").alias("excerpt"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )


def evaluate(check_type: Column, given: CheckInput, types: tuple[str, ...] | None = None) -> Column:
    """Dispatch on the rule's check type; bad parameters or an unknown type yield status ``error``."""
    chain = None
    for name in types or registered():
        spec = _REGISTRY[name]
        problem = spec.parameter_problem(given.keys)
        branch = F.when(problem.isNotNull(), outcome(ERROR, None, problem)).otherwise(spec.evaluate(given))
        chain = F.when(check_type == name, branch) if chain is None else chain.when(check_type == name, branch)
    return chain.otherwise(outcome(ERROR, None, "unknown check type"))


def parameter_problem(check_type: Column, keys: Column) -> Column:
    """Load-time message for a rule's parameters, null when they are fine."""
    chain = None
    for name, spec in _REGISTRY.items():
        problem = spec.parameter_problem(keys)
        chain = F.when(check_type == name, problem) if chain is None else chain.when(check_type == name, problem)
    return chain.when(
        check_type.isin(*V.PLANNED_CHECK_TYPES), F.lit("check type is planned but not available")
    ).otherwise(F.lit("unknown check type"))


# --- parameters ------------------------------------------------------------------------------


def _count(keys: Column) -> Column:
    return F.coalesce(F.size(keys), F.lit(0))


def no_keys(keys: Column) -> Column:
    return F.when(_count(keys) > 0, F.lit("takes no parameters"))


def one_known_key(keys: Column) -> Column:
    first = F.try_element_at(keys, F.lit(1))
    return (
        F.when(_count(keys) != 1, F.lit("needs exactly one field key"))
        .when(~first.isin(*V.FIELD_KEYS), F.lit("unknown field key"))
    )


def several_known_keys(keys: Column) -> Column:
    known = F.array(*[F.lit(k) for k in V.FIELD_KEYS])
    return (
        F.when(_count(keys) < 2, F.lit("needs at least two field keys"))
        .when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("field keys repeat"))
        .when(F.size(F.array_except(keys, known)) > 0, F.lit("unknown field key"))
    )


def one_date_key(keys: Column) -> Column:
    first = F.try_element_at(keys, F.lit(1))
    return (
        F.when(_count(keys) != 1, F.lit("needs exactly one field key"))
        .when(~first.isin(*V.DATE_KEYS), F.lit("field key is not a date declaration"))
    )


# --- the seven shipped checks ----------------------------------------------------------------


def _field_presence(c: CheckInput) -> Column:
    key = c.first_key()
    reading = c.reading(key)
    return (
        F.when(reading.isNotNull(), outcome(PASSED, key, "declaration found", reading))
        .when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .otherwise(outcome(FAILED, key, "declaration not found", excerpt=T.excerpt(c.text)))
    )


def _field_presence_any_of(c: CheckInput) -> Column:
    present = F.filter(c.keys, lambda k: F.try_element_at(c.fields, k).isNotNull())
    first = F.try_element_at(present, F.lit(1))
    satisfied = F.array_join(F.array_sort(present), ", ")
    fallback = c.first_key()
    return (
        F.when(_count(present) > 0, outcome(PASSED, first, "satisfied by an alternative", c.reading(first), detail=satisfied))
        .when(~c.usable, outcome(INCONCLUSIVE, fallback, "no readable text"))
        .otherwise(outcome(FAILED, fallback, "no alternative found", excerpt=T.excerpt(c.text)))
    )


def _consumer_care(c: CheckInput) -> Column:
    key = "consumer_care_contact"
    reading = c.reading(key)
    value = reading["normalized"]
    filled = lambda name: F.coalesce(F.size(value[name]) > 0, F.lit(False))
    phone, email = filled("phones"), filled("emails")
    missing = F.when(phone, F.lit("e-mail address")).otherwise(F.lit("telephone number"))
    return (
        F.when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .when(reading.isNull(), outcome(INCONCLUSIVE, key, "declaration not read"))
        .when(~phone & ~email, outcome(INCONCLUSIVE, key, "no element read", reading))
        .when(phone & email, outcome(PASSED, key, "telephone and e-mail stated", reading))
        .when(N.supports_violation(value, reading["confidence"]),
              outcome(FAILED, key, "element missing", reading, detail=missing))
        .otherwise(outcome(INCONCLUSIVE, key, "element missing, weak evidence", reading, detail=missing))
    )


def _month_year(c: CheckInput) -> Column:
    key = c.first_key()
    reading = c.reading(key)
    value = reading["normalized"]
    stated = F.coalesce(value["year_month"], value["date"])
    options = F.array_join(F.coalesce(value["candidates"], F.array().cast("array<string>")), ", ")
    return (
        F.when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .when(reading.isNull(), outcome(INCONCLUSIVE, key, "declaration not read"))
        .when(stated.isNotNull() & ~N.is_uncertain(value),
              outcome(PASSED, key, "month and year stated", reading, detail=stated))
        .otherwise(outcome(INCONCLUSIVE, key, "month and year not established", reading, detail=options))
    )


def _si_unit(c: CheckInput) -> Column:
    key = "net_quantity"
    reading = c.reading(key)
    stated = F.trim(F.coalesce(reading["normalized"]["unit"], F.lit("")))
    listed = ("", *V.NON_SI_UNITS, *V.MASS_UNITS, *V.VOLUME_UNITS, *V.COUNT_UNITS)  # lower case as they are; ICU's is slow
    judged = lambda unit: (
        F.when(unit == "", outcome(INCONCLUSIVE, key, "no unit identified", reading))
        .when(unit.isin(*V.NON_SI_UNITS), outcome(FAILED, key, "unit is not SI", reading, detail=unit))
        .when(unit.isin(*V.MASS_UNITS, *V.VOLUME_UNITS), outcome(PASSED, key, "SI unit", reading, detail=unit))
        .when(unit.isin(*V.COUNT_UNITS), outcome(PASSED, key, "declared by number", reading, detail=unit))
        .otherwise(outcome(INCONCLUSIVE, key, "unit not recognised", reading, detail=unit))
    )
    return (
        F.when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .when(reading.isNull(), outcome(INCONCLUSIVE, key, "declaration not read"))
        .otherwise(T.let(F.when(stated.isin(*listed), stated).otherwise(F.lower(stated)), judged))
    )


def prohibited_count(raw: Column, unit: Column) -> Column:
    """The first prohibited counting word, ignoring "gross weight" and its relatives."""
    text = F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit("")))
    masked = F.regexp_replace(text, T.ci(r"\bgross\s+(weight|wt|mass|vol|volume)\b"), " ")
    return T.let(masked, lambda m: F.coalesce(*[F.when(m.rlike(T.ci(rf"\b{word}\b")), F.lit(word)) for word in V.PROHIBITED_COUNTS]))


def _prohibited_counting_unit(c: CheckInput) -> Column:
    key = "net_quantity"
    reading = c.reading(key)
    word = prohibited_count(reading["raw_value"], reading["normalized"]["unit"])
    return (
        F.when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .when(reading.isNull(), outcome(INCONCLUSIVE, key, "declaration not read"))
        .otherwise(T.let(word, lambda w: F.when(w.isNotNull(), outcome(FAILED, key, "prohibited counting unit", reading, detail=w))
                         .otherwise(outcome(PASSED, key, "no prohibited counting unit", reading))))
    )


def _retail_price_tax(c: CheckInput) -> Column:
    key = "retail_sale_price"
    reading = c.reading(key)
    value = reading["normalized"]
    inclusive = value["inclusive_of_all_taxes"]
    return (
        F.when(~c.usable, outcome(INCONCLUSIVE, key, "no readable text"))
        .when(reading.isNull(), outcome(INCONCLUSIVE, key, "declaration not read"))
        .when(~inclusive & N.supports_violation(value, reading["confidence"]),
              outcome(FAILED, key, "declared exclusive of taxes", reading, detail=F.lit("exclusive")))
        .when(~inclusive, outcome(INCONCLUSIVE, key, "exclusive of taxes, weak evidence", reading, detail=F.lit("exclusive")))
        .when(inclusive, outcome(PASSED, key, "declared inclusive of taxes", reading, detail=F.lit("inclusive")))
        .otherwise(outcome(PASSED, key, "no tax wording", reading, detail=F.lit("not_observed")))
    )


for _spec in (
    CheckSpec("field_presence", _field_presence, one_known_key, "the named declaration was read"),
    CheckSpec("field_presence_any_of", _field_presence_any_of, several_known_keys, "any listed declaration was read"),
    CheckSpec("consumer_care_elements", _consumer_care, no_keys, "telephone and e-mail are both stated"),
    CheckSpec("month_year_declaration", _month_year, one_date_key, "a date states a month and a year"),
    CheckSpec("si_unit", _si_unit, no_keys, "net quantity uses an SI unit or a number"),
    CheckSpec("prohibited_counting_unit", _prohibited_counting_unit, no_keys, "no dozen, score or gross"),
    CheckSpec("retail_price_tax_declaration", _retail_price_tax, no_keys, "price is not exclusive of taxes"),
):
    register(_spec)
