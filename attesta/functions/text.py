"""Text builders: normal forms, tokens, n-grams and comparison forms as Spark columns."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from re import _constants as sre, _parser as sre_parser

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as ST

from attesta import vocabulary as V


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often (or per element) the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ci(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of a pattern (Java flags)."""
    return f"(?iU)(?:{pattern})"


def hit(text: Column, pattern: str) -> Column:
    return text.rlike(ci(pattern))


def words_of(pattern: str, folded: bool = False) -> list[str]:
    """Literal strings of which every match of a case-sensitive pattern holds at least one; ``[""]`` where the pattern has none.

    ``folded``: of a pattern that ignores case, what every match holds in lower case (an ASCII text's matches; others fold to more).
    """
    def least(words):
        return min(map(len, words))

    def of(items):
        best, run = [""], ""
        for op, value in [*items, (None, None)]:
            if op is sre.LITERAL:
                run += chr(value).lower() if folded else chr(value)
                continue
            parts = [[run]]
            run = ""
            if op is sre.BRANCH:
                parts.append([w for branch in value[1] for w in of(branch)])
            elif op is sre.SUBPATTERN and (folded or not value[1] & re.IGNORECASE):
                parts.append(of(value[3]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                parts.append(of(value[2]))
            best = max(best, *parts, key=least)
        return list(dict.fromkeys(best))

    return of(sre_parser.parse(pattern))


def ascii_lower(text: Column) -> Column:
    """The lower-case form of an ASCII text, else null."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text))


def may_hit(lower: Column, *patterns: str) -> Column:
    """False only where no pattern can `hit` a text, by its `ascii_lower` form: other texts may hold letters that fold to ASCII ones."""
    words = dict.fromkeys(w for p in patterns for w in words_of(p, folded=True))
    return functools.reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words], lower.isNull())


def after_first(text: Column, pattern: str) -> Column:
    """The text to the right of the first match of ``pattern``; empty when it does not occur."""
    return F.regexp_extract(text, f"(?isU)^.*?(?:{pattern})(.*)$", _groups(pattern) + 1)


def before_first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, f"(?isU)^(.*?)(?:{pattern}).*$", 1)


def _groups(pattern: str) -> int:
    probe = re.sub(r"\[[^\]]*\]|\\.", "", pattern)
    return len(re.findall(r"\((?!\?)", probe))


# row by row: Spark sends these a hundred texts at a time, an Arrow batch would hold ten thousand whatever their length
@F.udf(ST.StringType(), useArrow=False)
def _nfkc(value):
    return None if value is None else unicodedata.normalize("NFKC", value)


def nfkc(text: Column, fold: bool = True) -> Column:
    """Unicode NFKC.  Spark has no built-in for it, so this is the library's one Python helper.

    ``fold=False`` skips it where the caller knows the text is already composed; the expression
    then stays entirely inside the JVM.
    """
    if not fold:
        return text
    # pure ASCII is its own normal form: such rows cross to Python as null only
    wide = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(wide), text)


@F.udf(ST.ArrayType(ST.StringType()), useArrow=False)
def _nfkc_each(values):
    return None if values is None else [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


def nfkc_each(texts: Column) -> Column:
    """Unicode NFKC of every element of an array; arrays without a non-ASCII element stay in the JVM.

    A Python helper can't stand inside a lambda, so this is a column of its own and not a transform over `nfkc`.
    """
    wide = F.when(F.exists(texts, lambda v: v.rlike(r"[^\x00-\x7F]")), texts)
    return F.coalesce(_nfkc_each(wide), texts)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ +| +$", "")


def normalise_text(text: Column, fold: bool = True) -> Column:
    """Fold presentation forms, collapse white space, trim.  Null becomes empty."""
    return F.coalesce(collapse(nfkc(text, fold)), F.lit(""))


def normalise_email(text: Column, fold: bool = False) -> Column:
    return F.regexp_replace(normalise_text(text, fold), r"\s*@\s*", "@")


def preprocess_text(text: Column, fold: bool = True) -> Column:
    """Form used by the classifier and the signal table: NFKC, plain punctuation, lower, collapsed."""
    plain = F.translate(nfkc(F.coalesce(text, F.lit("")), fold), V.TYPOGRAPHIC_FROM, V.TYPOGRAPHIC_TO)
    return collapse(F.lower(plain))


def word_tokens(cleaned: Column) -> Column:
    """Runs of letters and runs of digits; a letter/digit boundary splits a token."""
    return F.regexp_extract_all(cleaned, F.lit(r"(?U)\d+|[^\W\d_]+"), F.lit(0))


def feature_tokens(cleaned: Column) -> Column:
    # the first character tells: a token is letters or digits throughout; only past ASCII is it looked up
    digits = lambda t: F.when(t < "\x80", (t >= "0") & (t < ":")).otherwise(t.rlike(r"(?U)^\d"))
    return F.transform(word_tokens(cleaned), lambda t: F.when(digits(t), F.lit(V.NUMBER_TOKEN)).otherwise(t))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of ``tokens`` for n in low..high, by n then by start."""
    def build(tokens):
        parts = []
        for n in range(low, high + 1):
            if n == 1:
                parts.append(tokens)
                continue
            starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
                F.array().cast("array<int>")
            )
            parts.append(F.transform(starts, _joined_slice(tokens, n)))
        return F.concat(*parts)

    return let(tokens, build)


def _joined_slice(tokens: Column, n: int):
    return lambda start: F.concat_ws(" ", *[F.get(tokens, start + (k - 1)) for k in range(n)])


def counted(values: Column) -> Column:
    """(value, count) of the distinct values of an array, from the runs of the sorted array."""
    def runs(ordered):
        new = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        starts = F.when(F.size(ordered) > 0, F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), new))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ordered, i), F.coalesce(F.get(at, k + 1), F.size(ordered)) - i)))

    return let(F.sort_array(values), runs)


def trim_edges(text: Column) -> Column:
    """Strip the punctuation a printed value may carry at either end."""
    cls = f"[{V.EDGE_PUNCTUATION}]+"
    return F.regexp_replace(text, f"^{cls}|{cls}$", "")


def comparison_form(text: Column) -> Column:
    """How a transcription is compared to a reading: folded, lower case, collapsed, edges stripped."""
    return _comparable(nfkc(text))


def comparison_forms(texts: Column) -> Column:
    """`comparison_form` of every element of an array."""
    return F.transform(nfkc_each(texts), _comparable)


def _comparable(folded: Column) -> Column:
    return trim_edges(F.regexp_replace(F.lower(folded), r"(?U)\s+", " "))


def duplicate_form(text: Column) -> Column:
    """How two texts are compared for duplication: white space collapsed, lower case."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def value_matches(expected: Column, values: Column, evidence: Column) -> Column:
    """Equal to any comparable value, or contained in the evidence line.  No unit conversion.

    All three are given in their comparison forms (`comparison_form`, `comparison_forms`), as plain columns.
    """
    never = F.lit(False)
    return (F.length(expected) > 0) & (
        F.coalesce(F.array_contains(values, expected), never) | F.coalesce(F.contains(evidence, expected), never))


def machine_marker(name: Column) -> Column:
    """The first machine-labeller marker the name contains, else null."""
    markers = F.array(*[F.lit(m) for m in V.MACHINE_MARKERS])
    return F.try_element_at(F.filter(markers, lambda m: F.contains(F.lower(name), m)), F.lit(1))


def is_iso_date_shape(text: Column) -> Column:
    """YYYY-MM-DD with month 1-12, day 1-31 and year from 1970.  Not a calendar check."""
    part = lambda g: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})$", g).try_cast("int")
    return F.coalesce(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (part(1) >= 1970) & part(2).between(1, 12) & part(3).between(1, 31),
        F.lit(False),
    )


def excerpt(text: Column, limit: int = V.EXCERPT_LENGTH) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def model_term(evidence: Column) -> Column:
    """The quoted term of a recorded ``term: 'x' weighed for y`` string, else null."""
    term = F.regexp_extract(evidence, r"(?s)^term: '(?! weighed for )(.*?)' weighed for ", 1)
    return F.when(F.length(term) > 0, term)


def rule_number_key(number: Column) -> Column:
    """Sort key for rule numbers: three zero-padded digits followed by the letter suffix."""
    digits = F.regexp_extract(number, r"^(\d+)", 1)
    return F.when(
        F.length(digits) > 0, F.concat(F.lpad(digits, 3, "0"), F.regexp_extract(number, r"^\d+(.*)$", 1))
    ).otherwise(number)


#: Code points beyond the basic plane: one for each distinct word of a pair.
_FIRST_SYMBOL, _SYMBOLS = 0x10000, 0x100000


def word_levenshtein(left: Column, right: Column) -> Column:
    """Levenshtein distance over words.

    Each distinct word of the pair is given one code point beyond the basic plane and the built-in distance
    runs over the two encoded strings.  There are a million of them; a pair with more words than that is an error, not a
    guess.
    """
    def encoded(words):
        symbol = lambda w: F.decode(
            F.unhex(F.lpad(F.hex(F.lit(_FIRST_SYMBOL - 1) + F.array_position(words, w)), 8, "0")), "utf-32")
        encode = lambda side: F.array_join(F.transform(side, symbol), "")
        return F.when(F.size(words) > _SYMBOLS, F.raise_error(F.lit("more distinct words than symbols")).cast("int")).otherwise(
            F.levenshtein(encode(left), encode(right)))

    return let(F.array_distinct(F.concat(left, right)), encoded)


# the helpers above travel to the workers by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
