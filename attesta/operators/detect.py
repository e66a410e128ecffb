"""Label text to readings.

Every detector is a column over one line that yields an array of candidates; the arrays are
concatenated and exploded, so a line table is scanned once however many detectors there are.
Choosing among candidates is aggregation with map-side combine, never a per-label sort.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V
from attesta.functions import text as T, values as N

CANDIDATE_TYPE = (
    f"struct<key:string,raw_value:string,normalized:{N.NORMALIZED_TYPE},matched_by:string,signature:string>"
)
KEYWORD, PATTERN = "keyword", "pattern"


# --- lines -----------------------------------------------------------------------------------


def lines_from_text(texts: DataFrame, key: str = "image_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(image_id, line_index, text, next_text, confidence, box): non-empty normalised lines of a text.

    The following line is taken from the same array, so no window over the label is needed.
    """
    pieces = F.split(T.nfkc(F.col(text), fold), r"\R")
    lines = F.filter(F.transform(pieces, T.collapse), lambda l: F.length(l) > 0)
    # outer: for an inner explode Spark infers a filter on the array and evaluates it, with all that makes the text, a second time
    # next to the scan, in its few splits
    rows = texts.withColumn("_lines", lines).select(
        F.col(key).alias("image_id"), "_lines", F.posexplode_outer("_lines").alias("line_index", "text")
    ).where("line_index IS NOT NULL")
    return rows.select(
        "image_id", "line_index", "text", F.get("_lines", F.col("line_index") + 1).alias("next_text"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast(N.BOX_TYPE).alias("box"),
    )


def with_next_line(lines: DataFrame) -> DataFrame:
    """Add ``next_text`` to a table that already has one row per line with dense ``line_index``.

    An equi-join on (label, index) rather than a window per label: a label with a third of all
    lines spreads over every task.  Both sides are the whole line table, whose size Spark underrates where lines come
    from an exploded array, so the hint keeps them out of the driver's broadcast.
    """
    following = lines.select(
        "image_id", (F.col("line_index") - 1).alias("line_index"), F.col("text").alias("next_text")
    ).hint("merge")
    return lines.join(following, ["image_id", "line_index"], "left")


# --- detectors -------------------------------------------------------------------------------


def _candidate(key, raw, value: Column, matched_by, signature) -> Column:
    """``signature`` is a function of the normalised value: what two candidates are compared on."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    by = lit(matched_by)
    return T.let(value, lambda v: F.struct(
        lit(key).alias("key"), raw.alias("raw_value"), v.withField("matched_by", by).alias("normalized"),
        by.alias("matched_by"), signature(v).cast("string").alias("signature"),
    ).cast(CANDIDATE_TYPE))


def _bare(key, raw, value, matched_by, signature) -> Column:
    """That there is a candidate: what it says is left out."""
    return F.struct((key if isinstance(key, Column) else F.lit(key)).alias("key"))


def _signature(*parts: Column) -> Column:
    """Null when every part is null: such a candidate cannot disagree with another."""
    some = F.coalesce(*[p.cast("string") for p in parts])
    return F.when(some.isNotNull(), F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _one(candidate: Column, present: Column) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), F.array(candidate))


def net_quantity(text: Column, require_keyword: bool = True, candidate=_candidate) -> Column:
    """Every quantity on a declaration line is a candidate; nutrition lines carry none."""
    part = lambda g: F.regexp_extract_all(text, F.lit(T.ci(V.QUANTITY)), F.lit(g))
    has_keyword = T.hit(text, V.NET_QUANTITY_KEYWORD)

    def one(match):
        value = N.normalise_quantity(match["value"], match["unit"], match["pack"])
        flagged = F.when(has_keyword, value).otherwise(N.mark_uncertain(value, "no net-quantity keyword on this line"))
        return candidate(
            "net_quantity", text, flagged, F.when(has_keyword, F.lit(KEYWORD)).otherwise(F.lit(PATTERN)),
            lambda v: _signature(N.plain_number(v["base_quantity"]), v["base_unit"], N.plain_number(v["quantity"]), v["unit"]),
        )

    matches = F.arrays_zip(part(1).alias("pack"), part(2).alias("value"), part(3).alias("unit"))
    outside = ~T.hit(text, V.NON_DECLARATION_CONTEXT)
    wanted = has_keyword & outside if require_keyword else outside
    return F.when(wanted, F.transform(matches, one))


def _first_group(text: Column, pattern: str, *groups: int) -> Column:
    found = [F.nullif(F.regexp_extract(text, T.ci(pattern), g), F.lit("")) for g in groups]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def retail_sale_price(text: Column, candidate=_candidate) -> Column:
    """After the keyword, else before it with a currency; without a keyword only a currency or the
    first amount of a legend pair, both uncertain."""
    def named(sides):
        return F.coalesce(
            _first_group(sides["after"], V.PRICE, 1, 2), _first_group(sides["after"], V.BARE_AMOUNT, 1), _first_group(sides["before"], V.PRICE, 1, 2))

    sides = F.struct(T.after_first(text, V.MRP_KEYWORD).alias("after"), T.before_first(text, V.MRP_KEYWORD).alias("before"))
    lead = T.before_first(text, V.PRICE_PAIR)
    paired = (
        F.contains(text, F.lit("/")) & T.hit(text, V.PRICE_PAIR) & ~T.hit(text, V.NON_DECLARATION_CONTEXT)
        & (lead.rlike(V.PRICE_LEGEND_MISREAD) | T.hit(lead, V.UNIT_PRICE_KEYWORD))
    )
    loose = T.let(_first_group(text, V.PRICE, 1, 2), lambda a: F.when(a.isNotNull() & ~T.hit(text, V.UNIT_PRICE_KEYWORD), a))
    inclusive = F.when(T.hit(text, V.TAX_INCLUSIVE), F.lit(True)).when(T.hit(text, V.TAX_EXCLUSIVE), F.lit(False))

    # each pattern runs at most once a line, the dearer ones only behind those that decide
    def priced(known):
        amount = F.when(known["keyword"], T.let(sides, named)).when(known["pair"], _first_group(text, V.PRICE_PAIR, 1)).otherwise(loose)
        return T.let(amount, lambda a: F.when(a.isNotNull(), F.struct(
            a.alias("amount"), known["keyword"].alias("keyword"), known["pair"].alias("pair"), inclusive.alias("inclusive"))))

    keyword = T.hit(text, V.MRP_KEYWORD)
    known = T.let(keyword, lambda k: F.struct(k.alias("keyword"), (~k & paired).alias("pair")))
    found = T.let(known, priced)

    def build(f):
        value = T.let(N.normalise_price(f["amount"], f["inclusive"]), lambda v: (
            F.when(f["keyword"], v)
            .when(f["pair"], N.mark_uncertain(
                N.mark_uncertain(v, "no retail-price keyword on this line"),
                "first amount of a price pair whose legend was not recognised"))
            .otherwise(N.mark_uncertain(v, "no retail-price keyword on this line"))
        ))
        by = F.when(f["keyword"], F.lit(KEYWORD)).otherwise(F.lit(PATTERN))
        return _one(candidate("retail_sale_price", text, value, by, lambda v: v["amount"]), F.lit(True))

    return T.let(found, lambda f: F.when(f.isNotNull() & ~T.hit(text, V.NON_MRP_CONTEXT), build(f)))


def unit_sale_price(text: Column, candidate=_candidate) -> Column:
    """A per-unit amount after the keyword, else before it with a currency; uncertain without a keyword."""
    currency = lambda source: _first_group(source, V.PER_UNIT_PRICE, 1).isNotNull()
    priced = lambda source: T.hit(source, V.PER_UNIT_PRICE)
    sides = F.struct(T.after_first(text, V.UNIT_PRICE_KEYWORD).alias("after"), T.before_first(text, V.UNIT_PRICE_KEYWORD).alias("before"))
    beside = lambda s: F.when(priced(s["after"]), s["after"]).when(priced(s["before"]) & currency(s["before"]), s["before"])

    def read(keyword):
        source = F.when(keyword, T.let(sides, beside)).when(priced(text) & currency(text) & ~T.hit(text, V.MRP_KEYWORD), text)
        return T.let(source, lambda x: F.when(x.isNotNull(), F.struct(
            _first_group(x, V.PER_UNIT_PRICE, 2).alias("amount"), _first_group(x, V.PER_UNIT_PRICE, 3).alias("unit"),
            keyword.alias("keyword"))))

    # what every such price holds is looked for first
    parts = F.when(T.hit(text, "per|/"), T.let(T.hit(text, V.UNIT_PRICE_KEYWORD), read))

    def build(p):
        value = T.let(N.normalise_unit_price(p["amount"], p["unit"]), lambda v: F.when(p["keyword"], v).otherwise(
            N.mark_uncertain(v, "no unit-sale-price keyword on this line")))
        by = F.when(p["keyword"], F.lit(KEYWORD)).otherwise(F.lit(PATTERN))
        return _one(
            candidate("unit_sale_price", text, value, by, lambda v: _signature(v["amount"], v["per_unit"])), F.lit(True))

    return T.let(parts, lambda p: F.when(p.isNotNull() & ~T.hit(text, V.NON_DECLARATION_CONTEXT), build(p)))


def batch_number(text: Column, candidate=_candidate) -> Column:
    """A code with at least one digit; one that reads as a date is uncertain."""
    def build(code):
        value = F.when(N.date_in(code).isNotNull(), N.uncertain("the value reads as a date", candidates=F.array(code)))
        value = value.otherwise(N.certain(batch_number=code))
        return _one(candidate("batch_number", text, value, KEYWORD, lambda v: code), code.rlike(r"\d"))

    return T.let(T.trim_edges(_first_group(text, V.BATCH_NUMBER, 1)), build)


def dates(text: Column, next_text: Column, candidate=_candidate) -> Column:
    """Four date declarations: the value after the keyword, else the next line (uncertain).

    The next line is not used when it names another date.  Only best-before may be a shelf life.
    """
    def entries(named):
        rows = []
        for at, (key, pattern) in enumerate(V.DATE_KEYWORDS.items()):
            others = "|".join(p for k, p in V.DATE_KEYWORDS.items() if k != key)
            hit = F.get(named, F.lit(at))
            rows.append(F.when(hit, F.struct(
                F.lit(key).alias("key"), T.after_first(text, pattern).alias("own"),
                F.when(~T.hit(next_text, others), next_text).alias("next"))))
        return F.when(F.array_contains(named, F.lit(True)), F.array_compact(F.array(*rows)))

    def one(entry):
        def read(source):
            def keep(v):
                shelf = v["duration_value"].isNotNull() | v["duration_unit"].isNotNull()
                return F.when(~shelf | (entry["key"] == "best_before"), v)

            return T.let(N.date_in(source), keep)

        def build(own, below):
            value = F.when(own.isNotNull(), own).otherwise(
                N.mark_uncertain(below, "read from the line after the keyword"))
            raw = F.when(own.isNotNull(), text).otherwise(F.concat_ws(" ", text, next_text))
            sign = lambda v: F.coalesce(v["date"], v["year_month"], _signature(
                N.plain_number(v["duration_value"].cast("decimal(18,6)")), v["duration_unit"]))
            return F.when(own.isNotNull() | below.isNotNull(), candidate(entry["key"], raw, value, KEYWORD, sign))

        # the next line is read only where the keyword's own has nothing
        return T.let(read(entry["own"]), lambda own: T.let(F.when(own.isNull(), read(entry["next"])), lambda below: build(own, below)))

    found = T.let(F.array(*[T.hit(text, pattern) for pattern in V.DATE_KEYWORDS.values()]), entries)
    return F.filter(F.transform(found, one), lambda c: c.isNotNull())


def country_of_origin(text: Column, candidate=_candidate) -> Column:
    """Explicit wording is certain; "made in" and its relatives are uncertain."""
    declared = F.regexp_extract(text, V.COUNTRY_DECLARED, 1)
    implied = F.regexp_extract(text, V.COUNTRY_IMPLIED, 1)
    explicit = F.length(declared) > 0
    found = F.struct(T.trim_edges(F.when(explicit, declared).otherwise(implied)).alias("country"), explicit.alias("explicit"))

    def build(f):
        value = F.when(f["explicit"], N.certain(country_text=f["country"])).otherwise(
            N.uncertain("read from wording that also names a place of manufacture", country_text=f["country"]))
        return _one(candidate("country_of_origin", text, value, KEYWORD, lambda v: F.lower(v["country_text"])),
                    F.length(f["country"]) > 0)

    return T.let(found, build)


def names(text: Column, next_text: Column, read_next: bool = True, candidate=_candidate) -> Column:
    """The first name declaration of the line that has a usable name, on it or on the next line."""
    usable = lambda v: F.coalesce(v.rlike(r"(?U)[^\W\d_]"), F.lit(False))
    below = T.trim_edges(next_text)
    options = []

    def choose(key):
        def of(own):
            from_next = ~usable(own) & usable(below) if read_next else F.lit(False)
            return F.when(usable(own) | from_next, F.struct(
                F.lit(key).alias("key"), F.when(from_next, below).otherwise(own).alias("name"), from_next.alias("next")))

        return of

    for key, pattern in V.NAME_DECLARATIONS:
        own = T.trim_edges(F.regexp_extract(text, T.ci(pattern), 1))
        options.append(F.when(T.hit(text, pattern), T.let(own, choose(key))))

    def build(pick):
        value = T.let(N.uncertain(
            "the name may continue on following lines; the address is not read", name=pick["name"],
            declaration=F.when(pick["key"] == "other", F.lit("marketed_by"))),
            lambda v: F.when(pick["next"], N.mark_uncertain(v, "read from the line after the keyword")).otherwise(v))
        raw = F.when(pick["next"], F.concat_ws(" ", text, next_text)).otherwise(text)
        return _one(candidate(pick["key"], raw, value, KEYWORD, lambda v: F.lower(v["name"])), pick.isNotNull())

    return T.let(F.coalesce(*options), build)


DETECTORS = {
    "net_quantity": lambda text, below, c: net_quantity(text, candidate=c),
    "any_quantity": lambda text, below, c: net_quantity(text, require_keyword=False, candidate=c),
    "retail_sale_price": lambda text, below, c: retail_sale_price(text, c),
    "unit_sale_price": lambda text, below, c: unit_sale_price(text, c),
    "batch_number": lambda text, below, c: batch_number(text, c),
    "dates": lambda text, below, c: dates(text, below, c),
    "country_of_origin": lambda text, below, c: country_of_origin(text, c),
    "names": lambda text, below, c: names(text, below, candidate=c),
}
ALL_DETECTORS = tuple(name for name in DETECTORS if name != "any_quantity")
#: What an ASCII line must hold for a detector to find anything: a word of a pattern, and a digit.
_NEEDS = {
    "net_quantity": ((V.NET_QUANTITY_KEYWORD,), False),
    "any_quantity": (("",), True),
    "retail_sale_price": ((), True),  # and `_PRICE_SHAPE`
    "unit_sale_price": (("per|/",), True),
    "batch_number": ((V.BATCH_NUMBER,), True),
    "dates": (tuple(V.DATE_KEYWORDS.values()), False),
    "country_of_origin": ((V.COUNTRY_DECLARED, V.COUNTRY_IMPLIED), False),
    "names": (("by",), False),
}
#: A currency, a keyword, or the stroke of a pair, in lower case: cheaper than the patterns that then read it.
_PRICE_SHAPE = r"r\.?\s?s|inr|m\.?\s?r\.?\s?p|retail|/"


def _with_forms(lines: DataFrame) -> DataFrame:
    lower = T.ascii_lower(F.col("text"))
    return lines.withColumn("_lower", lower).withColumn("_digit", F.col("text").rlike("[0-9]"))


def _found(detectors: tuple[str, ...], candidate, kind: str) -> Column:
    """The candidates of a line (`_with_forms`); a detector runs where the line has what it needs."""
    text, below, lower = F.col("text"), F.col("next_text"), F.col("_lower")
    parts = []
    for name in detectors:
        patterns, digit = _NEEDS[name]
        able = T.may_hit(lower, *patterns) if patterns else lower.isNull() | lower.rlike(_PRICE_SHAPE)
        able = (lower.isNull() | F.col("_digit")) & able if digit else able
        parts.append(F.coalesce(F.when(able, DETECTORS[name](text, below, candidate)), F.array().cast(f"array<{kind}>")))
    return F.concat(*parts)


def line_candidates(lines: DataFrame, detectors: tuple[str, ...] = ALL_DETECTORS) -> DataFrame:
    """Candidates of the chosen line detectors: one row per candidate, one scan of the lines."""
    found = _found(detectors, _candidate, CANDIDATE_TYPE)
    rows = _with_forms(lines).select("image_id", "line_index", "confidence", "box", F.posexplode(found).alias("ordinal", "c"))
    return rows.select("image_id", "line_index", "ordinal", "confidence", "box", "c.*")


def keys_read(lines: DataFrame, detectors: tuple[str, ...] = ALL_DETECTORS, contact: bool = True) -> DataFrame:
    """(image_id, field_key): the declarations that `extract` has a reading of, without the readings.

    A declaration is read where some line has a candidate, whatever it says, so nothing is normalised or compared.
    """
    found = _found(detectors, _bare, "struct<key:string>")
    if contact:
        found = F.concat(found, F.transform(_contact(), lambda c: F.struct(F.lit("consumer_care_contact").alias("key"))))
    return _with_forms(lines).select("image_id", F.explode(found).alias("c")).select("image_id", F.col("c.key").alias("field_key")).distinct()


# --- consumer care: one declaration per label ------------------------------------------------


def contact_lines(lines: DataFrame) -> DataFrame:
    """Lines that contribute to the consumer-care declaration, with what each carries."""
    # an array of at most one, exploded: a filter on these columns would evaluate the expressions a second time
    rows = _with_forms(lines).select("image_id", "line_index", "text", "confidence", "box", F.explode(_contact()).alias("_c"))
    return rows.select("image_id", "line_index", "text", "confidence", "box", "_c.emails", "_c.phones", "_c.toll_free", "_c.keyword")


def _contact() -> Column:
    """What a line (`_with_forms`) carries, in an array of one, or none."""
    text, lower = F.col("text"), F.col("_lower")
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    none = F.array().cast("array<string>")
    # a phone has at least eight digits and an e-mail an @, which cost less to look for
    digits = (lower.isNull() | F.col("_digit")) & text.rlike(r"(?U)(?:\d\D*+){8}")
    toll = F.when(digits, every("(?U)" + V.TOLL_FREE_PHONE)).otherwise(none)
    mobile = F.when(digits, every("(?U)" + V.MOBILE_PHONE)).otherwise(none)
    emails = F.when(F.contains(text, F.lit("@")), F.transform(every(V.EMAIL), lambda e: T.normalise_email(e))).otherwise(none)
    keyword = T.may_hit(lower, V.CONTACT_KEYWORD) & T.hit(text, V.CONTACT_KEYWORD)
    found = F.struct(emails.alias("emails"), toll.alias("toll"), mobile.alias("mobile"), keyword.alias("keyword"))

    def carried(f):
        mobiles = F.filter(f["mobile"], lambda m: ~F.exists(f["toll"], lambda t: F.contains(t, m)))
        some = (F.size(f["emails"]) > 0) | (F.size(f["toll"]) > 0) | (F.size(f["mobile"]) > 0) | f["keyword"]
        return F.when(some, F.struct(
            f["emails"].alias("emails"), F.concat(f["toll"], mobiles).alias("phones"), (F.size(f["toll"]) > 0).alias("toll_free"), f["keyword"].alias("keyword")))

    able = T.may_hit(lower, V.CONTACT_KEYWORD, "@") | digits
    return F.coalesce(F.when(able, F.array_compact(F.array(T.let(found, carried)))), F.array().cast(
        "array<struct<emails:array<string>,phones:array<string>,toll_free:boolean,keyword:boolean>>"))


def contact_elements(lines: DataFrame) -> DataFrame:
    """(image_id, kind, value, first_line): distinct e-mails and phones, first printing kept.

    The complete list of a label's contact elements, one row each; equal up to case means equal.
    """
    hits = contact_lines(lines)
    kinds = F.concat(
        F.transform("emails", lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value"))),
        F.transform("phones", lambda v: F.struct(F.lit("phone").alias("kind"), v.alias("value"))),
    )
    rows = hits.select("image_id", "line_index", F.posexplode(kinds).alias("ordinal", "e"))
    seen = F.struct("line_index", "ordinal")
    return (
        rows.groupBy("image_id", F.col("e.kind").alias("kind"), F.lower("e.value").alias("folded"))
        .agg(F.min_by("e.value", seen).alias("value"), F.min(seen).alias("seen"))
        .select("image_id", "kind", "value", F.col("seen.line_index").alias("first_line"), F.col("seen.ordinal").alias("ordinal"))
    )


def contact_candidates(lines: DataFrame) -> DataFrame:
    """One consumer-care candidate per label, in the schema of ``line_candidates``.

    E-mails and phones are the label's distinct ones in the order they are first read; the raw value joins every contributing
    line, and the first line with a value is the evidence.  Lists hold what one label prints.
    """
    hits = contact_lines(lines)
    has_value = (F.size("emails") > 0) | (F.size("phones") > 0)
    body = F.struct("line_index", "text", "confidence", "box")
    read = lambda name: F.flatten(F.transform(F.col("lines"), lambda l: l[name]))
    label = hits.groupBy("image_id").agg(
        F.bool_or("keyword").alias("keyword"), F.bool_or("toll_free").alias("toll_free"),
        F.array_sort(F.collect_list(F.struct("line_index", "text", "emails", "phones"))).alias("lines"),
        F.min_by(body, F.struct((~has_value).alias("v"), "line_index")).alias("anchor"),
    ).withColumn("email_list", _first_printings(read("emails"))).withColumn("phone_list", _first_printings(F.transform(read("phones"), T.collapse)))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    values = dict(emails=some("email_list"), phones=some("phone_list"))
    value = (
        F.when((F.size("email_list") == 0) & (F.size("phone_list") == 0), N.uncertain("keyword found but no e-mail or phone read"))
        .when(F.col("keyword") | F.col("toll_free") | (F.size("email_list") > 0), N.certain(**values))
        .otherwise(N.uncertain("a phone number with no consumer-care keyword on the label", **values))
    )
    by = F.when(F.col("keyword"), F.lit(KEYWORD)).otherwise(F.lit(PATTERN))
    raw = F.array_join(F.transform("lines", lambda l: l["text"]), V.LINE_JOIN)
    signature = lambda v: _signature(F.array_join(some("email_list"), ","), F.array_join(some("phone_list"), ","))
    c = _candidate("consumer_care_contact", raw, value, by, signature)
    return label.select(
        "image_id", F.col("anchor.line_index").alias("line_index"), F.lit(0).alias("ordinal"),
        F.col("anchor.confidence").alias("confidence"), F.col("anchor.box").alias("box"), c.alias("c"),
    ).select("image_id", "line_index", "ordinal", "confidence", "box", "c.*")


def _first_printings(values: Column) -> Column:
    """Values in order, each once; equal up to case is equal."""
    folded = F.transform(values, F.lower)
    return F.filter(values, lambda v, k: F.array_position(folded, F.lower(v)) == k + 1)


# --- choosing --------------------------------------------------------------------------------


def _rank() -> Column:
    """Keyword before pattern, certain before uncertain, confidence down (none counts as 0), line up."""
    return F.struct(
        (F.col("matched_by") != KEYWORD).alias("a"), N.is_uncertain(F.col("normalized")).alias("b"),
        (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("line_index").alias("d"), F.col("ordinal").alias("e"),
    )


def resolve(candidates: DataFrame) -> DataFrame:
    """One reading per (label, declaration).  Disagreeing candidates make it uncertain.

    Aggregated twice, per distinct signature and then per declaration, so the list of a disputed reading's candidates (best
    first) holds each distinct value of one label once.  ``conflicts`` is their number.
    """
    rank = _rank()
    body = F.struct("raw_value", "normalized", "confidence", "box", "line_index", "matched_by")
    per_value = candidates.groupBy("image_id", "key", "signature").agg(
        F.min_by(body, rank).alias("best"), F.min(rank).alias("rank"))
    per_key = per_value.groupBy("image_id", "key").agg(
        F.min_by("best", "rank").alias("best"), F.count("signature").alias("distinct_values"),
        F.collect_list(F.when(F.col("signature").isNotNull(), F.struct("rank", "signature"))).alias("listed"))
    conflict = F.col("distinct_values") > 1
    listed = F.transform(F.array_sort("listed"), lambda x: x["signature"])
    value = F.when(conflict, N.mark_uncertain(
        F.col("best.normalized"),
        F.concat(F.col("distinct_values").cast("string"), F.lit(" different values on the label")),
    ).withField("candidates", listed)).otherwise(F.col("best.normalized"))
    return per_key.select(
        "image_id", F.col("key").alias("field_key"), F.col("best.raw_value").alias("raw_value"), value.alias("normalized"),
        F.col("best.confidence").alias("confidence"), F.col("best.box").alias("box"),
        F.col("best.line_index").alias("line_index"), F.col("best.matched_by").alias("matched_by"),
        F.when(conflict, F.col("distinct_values")).otherwise(F.lit(0)).alias("conflicts"),
    )


def conflicting_values(candidates: DataFrame) -> DataFrame:
    """(image_id, field_key, signature, rank columns): the distinct readings of declarations that
    disagree with themselves; sort by ``rank`` to list the best first."""
    per_value = candidates.where(F.col("signature").isNotNull()).groupBy("image_id", "key", "signature").agg(
        F.min(_rank()).alias("rank"))
    disputed = per_value.groupBy("image_id", "key").agg(F.count(F.lit(1)).alias("values")).where("values > 1")
    return per_value.join(disputed, ["image_id", "key"]).select(
        "image_id", F.col("key").alias("field_key"), "signature", "rank", "values")


def extract(lines: DataFrame, detectors: tuple[str, ...] = ALL_DETECTORS) -> DataFrame:
    """Readings of every label in a line table."""
    found = line_candidates(lines, detectors).unionByName(contact_candidates(lines))
    return resolve(found)


def unread_declarations(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """Declarations a label names but no reading came from; the first such line is the evidence."""
    text = F.col("text")
    named = F.array_compact(F.array(*[F.when(T.hit(text, p), F.lit(k)) for k, p in V.UNREAD_ANCHORS]))
    body = F.struct("line_index", "text", "confidence", "box")
    first = (
        lines.select("image_id", body.alias("line"), F.explode(named).alias("field_key"))
        .groupBy("image_id", "field_key").agg(F.min_by("line", "line.line_index").alias("line"))
    )
    return first.join(readings.select("image_id", "field_key"), ["image_id", "field_key"], "left_anti").select(
        "image_id", "field_key", F.col("line.line_index").alias("line_index"), F.col("line.text").alias("evidence_text"),
        F.col("line.confidence").alias("confidence"), F.col("line.box").alias("box"))


#: The detectors that read what `V.UNREAD_ANCHORS` name.
ANCHORED_DETECTORS = ("net_quantity", "retail_sale_price", "unit_sale_price", "batch_number", "dates")


def unread_in(lines: DataFrame) -> DataFrame:
    """`unread_declarations` of a line table and its own readings, from one scan of the lines and one aggregation by label.

    Whether a line names a declaration and whether it has a candidate are asked together; a declaration without an anchor can't be unread, so only
    the detectors of the others run.
    """
    text, lower = F.col("text"), F.col("_lower")
    named = F.array_compact(F.array(*[F.when(T.may_hit(lower, p) & T.hit(text, p), F.lit(k)) for k, p in V.UNREAD_ANCHORS]))
    found = F.array_distinct(F.transform(_found(ANCHORED_DETECTORS, _bare, "struct<key:string>"), lambda c: c["key"]))
    mark = lambda keys, read: F.transform(keys, lambda k: F.struct(k.alias("field_key"), F.lit(read).alias("read")))
    # what a line names and holds itself is read; only a line that names without holding may become evidence
    marked = T.let(F.struct(named.alias("named"), found.alias("found")), lambda l: F.concat(mark(l["found"], True), mark(F.array_except(l["named"], l["found"]), False)))
    rows = _with_forms(lines).select("image_id", "line_index", "text", "confidence", "box", F.explode(marked).alias("k"))
    at = F.when(~F.col("k.read"), F.col("line_index"))
    first = rows.groupBy("image_id", F.col("k.field_key").alias("field_key")).agg(
        F.bool_or("k.read").alias("read"), F.min_by(F.when(~F.col("k.read"), F.struct("line_index", "text", "confidence", "box")), at).alias("line"), F.min(at).alias("at"))
    return first.where(~F.col("read") & F.col("at").isNotNull()).select(
        "image_id", "field_key", F.col("line.line_index").alias("line_index"), F.col("line.text").alias("evidence_text"),
        F.col("line.confidence").alias("confidence"), F.col("line.box").alias("box"))


# --- label signals ---------------------------------------------------------------------------


def signal_hits(cleaned: Column, context: int = 40, snippets: bool = True) -> Column:
    """Signals that occur in a cleaned text, in table order, each with a snippet around the match (or none, where it isn't shown).

    A pattern runs where one of the words that any match holds (`text.words_of`) occurs, which costs far less to look for.
    """
    found = []
    for position, (phrase, indicates, pattern) in enumerate(V.SIGNALS):
        named = [F.lit(position).alias("position"), F.lit(phrase).alias("phrase"), F.lit(indicates).alias("indicative_of")]
        some = functools.reduce(Column.__or__, [F.contains(cleaned, F.lit(w)) for w in T.words_of(pattern)])
        if not snippets:
            found.append(F.when(some & cleaned.rlike("(?U)" + pattern), F.struct(*named)))
            continue
        at = F.regexp_instr(cleaned, F.lit("(?U)" + pattern))
        match = F.regexp_extract(cleaned, "(?U)" + f"({pattern})", 1)
        end = at - 1 + F.length(match)
        left = F.greatest(F.lit(0), at - 1 - context)
        right = F.least(F.length(cleaned), end + context)
        snippet = F.concat(
            F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
            F.trim(F.substring(cleaned, left + 1, right - left)),
            F.when(right < F.length(cleaned), F.lit("…")).otherwise(F.lit("")),
        )
        found.append(F.when(some & (at > 0), F.struct(*named, snippet.alias("snippet"))))
    return F.array_compact(F.array(*found))


def label_signals(texts: DataFrame, key: str, text: str, limit: int = 6, fold: bool = True) -> DataFrame:
    """The first signals of each text.  The list is cut inside the row; no per-text window."""
    hits = T.let(T.preprocess_text(F.col(text), fold), lambda cleaned: F.slice(signal_hits(cleaned), 1, limit))
    return texts.select(key, F.posexplode(hits).alias("rank", "s")).select(
        key, F.col("rank"), "s.position", "s.phrase", "s.indicative_of", "s.snippet")
