"""Repair of conversations against an exhaustive search that compares whole audit strings."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.llm import repair

SF = "/root/testdata/sf0.01"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out, ids = [], []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        if c not in ids:
            ids.append(c)
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    return set(ids), out


def states(initials):
    """Whether the initials can start a legal sequence."""
    return any(GRAMMAR.fullmatch(initials + end) for end in ("", "a", "ua"))


def cheapest(rows):
    """(cost, audit, repaired rows) of least (cost, audit), by trying every edit."""
    seen, faults = set(), []
    for _, r, x in rows:
        body = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))

    @lru_cache(None)
    def best(i, initials, inserted):
        found = []
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            found.append((0, "", ()))
        if inserted < 2:
            for r in ("user", "assistant"):
                if states(short(initials + r[0])):
                    cost, audit, out = best(i, short(initials + r[0]), inserted + 1)
                    found.append((cost + 3, "I" + audit, ((r, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            ways = [(4, "D", None)]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                ways += [(more, "K", role), (3 + more, "R", "user"), (3 + more, "R", "assistant")]
            for price, edit, r in ways:
                after = initials if r is None else short(initials + r[:1])
                if r is None or (r and states(after)):
                    cost, audit, out = best(i + 1, after, 0)
                    found.append((cost + price, edit + audit, out if r is None else ((r, text), *out)))
        return min(found, default=(10 ** 9, "", ()))

    def short(initials):  # what came before the last pair can't matter
        return initials if len(initials) < 5 else initials[:1] * (initials[0] == "s") + initials[-3 + (initials[-1] == "a"):]

    return faults, best(0, "", 0)


def plain(rows):
    ids, rows = damage(rows)
    out = {}
    for c in ids:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, (cost, audit, kept) = cheapest(tuple(mine))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def held_against(result, rows):
    got = {r[0]: tuple(r)[1:] for r in result}
    want = plain(rows)
    assert len(result) == len(got) and got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = entry.queries()["op12_repair"](spark, SF)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    held_against(result.collect(), rows)


def made(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", "  \t", "Why?", "Well...  ", "so\n", None, "Yes", "naïve – “ok”!", " "]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    return [(c, rng.choice([None, *range(most)]) if rng.random() < 0.3 else t, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {t}.")
            for c in [None, *range(conversations)] for t in range(rng.randint(1, most))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations(spark):
    rows = made(5, 300, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", c int, audit string").repartition(5)
    broken = repair.damaged(df)
    plans = repair.plan(broken)
    held_against(repair.repaired_conversations(broken, plans).collect(), rows)
    check_turns(repair.repaired_conversations(broken, plans), repair.repaired_turns(broken, plans))


def check_turns(conversations, turns):
    text = {}
    for r in turns.orderBy("conv_id", "piece", "position").collect():
        text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in conversations.collect():
        assert hashlib.sha256("\n".join(text.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_conversation_over_many_tasks(spark, seed):
    """One conversation holds most rows: it is cut into pieces, and the costs and counts are those of the whole."""
    rng = random.Random(seed)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"T{t}.", f"T{t}.", f"t{t}", "same.", ""])) for t in range(150)]
    rows += [(7, 80, "user", f"tie {k}") for k in range(60)] + [(7, 81, "user", "tie")] * 30 + made(seed, 12, 4)[5:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    broken = repair.damaged(df)
    plans = repair.plan(broken)
    assert plans.where("c = 7").count() > 3
    result = repair.repaired_conversations(broken, plans)
    held_against(result.collect(), rows)
    check_turns(result, repair.repaired_turns(broken, plans))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repaired_conversations(empty, repair.plan(empty)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    broken = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    got = repair.repaired_conversations(broken, repair.plan(broken)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired_turns(broken, repair.plan(broken)).count() == 0


def test_suffixes_share_their_nodes():
    """Nodes depend on a letter and the costs after it alone, so a long list of conversations needs few of them."""
    rng = random.Random(4)
    keys = sorted({("", "".join(rng.choice("suaSUAxo") for _ in range(rng.randint(0, 30))), 0) for _ in range(3000)})
    steps = repair.Steps()
    results = list(repair.best_edits(steps, iter(keys)))
    assert len(results) == len(keys) and len(steps.known) < 400
    for (_, reversed_, _), (cost, audit, end) in zip(keys, results):
        assert len(audit) - audit.count("I") == len(reversed_) and end in (0, 3)
        costs = tuple(repair.with_inserts(list(repair.FINAL)))
        for letter in reversed_:
            costs = tuple(repair.before(letter, costs))
        assert cost == costs[0]
