"""URL filters: rules indexed by their rarest literal token; only rules fetched by a URL's tokens run their expression.

A rule is ``host/path``.  It fits its host and every subdomain when the URL's path starts with the rule's path; the longest
fitting rule wins (ties: the smaller text).  Literal tokens of a rule are the words of its host and of the closed path segments, both in the
form in which a fitting URL must hold them.  How often each of these tokens occurs is counted over all URLs; a rule is filed
under its rarest one.  A URL's tokens fetch the rules filed under them, and their regular expressions decide.

Rules are sent to the tasks in slices of at most ``SLICE_BYTES``; with more rules than that, each slice is a pass over the
results of the one before, so what is broadcast is bounded however long the list.  A null URL or one without ``://`` has an empty host and
path, no rule, and the default verdict.  Only the id and URL columns are read; repeated rows stay; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 16 << 20
#: A fixed rule list: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
WORD = re.compile(r"[0-9A-Za-z]+|[^\x00-\x7f]+")


def rule_tokens(rule: str) -> list[str]:
    """Tokens that every URL the rule fits must hold: words of the host (h:) and of closed path segments (p:)."""
    host, _, path = rule.partition("/")
    closed = path[:path.rfind("/") + 1]
    return ["h:" + w for w in host.split(".") if w] + ["p:" + s for s in closed.split("/") if s]


def url_tokens(host: str, path: str) -> set[str]:
    return {"h:" + w for w in host.split(".") if w} | {"p:" + s for s in path.split("/") if s}


def expression(rule: str) -> str:
    """Regular expression of a rule over host and path, which the first slash parts."""
    host, _, path = rule.partition("/")
    return rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"


def parts(url: str) -> tuple[F.Column, F.Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.coalesce(F.contains(F.col(f"`{url}`"), F.lit("://")), F.lit(False))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.expr("substring(b, length(h) + 1)")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return has, before, host, path, lower


def split_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of every row."""
    has, before, host, path, lower = parts(url_col)
    return df.select(F.col(id_col), F.when(has, before).otherwise("").alias("b"), F.when(has, host).otherwise("").alias("h"), F.when(has, lower).otherwise("").alias("host")).select(
        id_col, "host", path.alias("path"))


def token_counts(urls: DataFrame, rules: tuple) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; the rule list bounds what comes back."""
    wanted = sorted({t for _, r in rules for t in rule_tokens(r)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = set(wanted), {}
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in url_tokens(host, path) & known:
                    n[t] = n.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    if not wanted:
        return {}
    return {r.token: r.n for r in urls.select("host", "path").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index_rules(rules, counts: dict[str, int]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules (text, verdict, expression) under their rarest token; under no token where a rule has none."""
    index: dict[str, list] = {}
    for verdict, rule in rules:
        tokens = rule_tokens(rule)
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""
        index.setdefault(rarest, []).append((rule, verdict, expression(rule)))
    return index


def best_rule(host: str, path: str, index: dict, compiled: dict, found: tuple = (None, None)) -> tuple:
    """The longest fitting rule and its verdict, or ``found`` if that is longer."""
    target = None
    for token in (url_tokens(host, path) | {""}) & index.keys():
        for rule, verdict, text in index[token]:
            if found[0] is not None and (-len(rule), rule) >= (-len(found[0]), found[0]):
                continue
            target = target or host + path
            pattern = compiled.get(text) or compiled.setdefault(text, re.compile(text))
            if pattern.match(target):
                found = (rule, verdict)
    return found


def judge(df: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; verdict is the longest fitting rule's, else ``default``."""
    urls = split_urls(df, id_col, url_col)
    counts = token_counts(urls, rules)
    kind = df.schema[id_col].dataType.simpleString()
    judged = urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for some in slices(rules, slice_bytes):
        judged = judged.mapInArrow(_pass(index_rules(some, counts), id_col), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def slices(rules, limit: int) -> list[list]:
    out, held = [], 0
    for r in rules:
        size = 4 * len(r[1]) + 100
        if not out or held + size > limit:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size
    return out


def _pass(index: dict, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        for batch in batches:
            host, path, rule, verdict = (batch.column(i).to_pylist() for i in range(1, 5))
            found = [best_rule(h, p, index, compiled, (r, v)) for h, p, r, v in zip(host, path, rule, verdict, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(3)), pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()),
            ], names=[id_col, "host", "path", "rule", "verdict"])

    return run
