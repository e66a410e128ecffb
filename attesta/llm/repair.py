"""Repair of conversation structure by cheapest edits, over a suffix-shared automaton of row signatures.

A row's signature is one letter: which role it holds and whether it must go (blank or duplicate), is truncated, or is
sound.  What the cheapest repair of a conversation does from some row on depends on the letters from there to the end and on
the state of the role grammar ``(s?(ua)+)?`` alone.  So the distinct signatures of all conversations are sorted by their
reversed letters: neighbours share their longest common suffix, a task walks them like a trie grown from the end, and cost-to-go and
best edit of every (suffix, grammar state) are worked out once, however many conversations end that way.  Nodes whose costs
differ by a constant are one node of the minimised automaton (`Steps`).

Edits: Keep costs nothing, Rerole (to user or assistant) 3, Delete 4, Insert an empty user or assistant row 3; a truncated row
that stays adds 3; blank and duplicate rows must go.  In one grammar state each letter of D, I, K, R leads to one other state, so the
least audit string among equally cheap ones is found letter by letter.

A conversation may hold any share of the rows.  Rows without their texts are sorted by range over all tasks, and each task
makes one signature *piece* per conversation that it meets; only the first and last conversation of a task can go on in
another one.  Of these pieces (at most two a task) the driver chains 4 x 4 cost matrices, so each piece gets its costs after
its end and the state before its start, and is then repaired like any other.  Texts are shuffled once, to be written out or
hashed in a stream next to their piece's audit.

Rows are ordered by turn (nulls first), then role, then a digest of the text; null roles and texts are one space, which is no
legal role and a blank text.  The initial of a role is its first character; an empty role has none and can't be kept.  A null
conversation id is one conversation.  Equal rows of one turn are duplicates of the first.  Rows with ``present`` false only say that
their conversation exists.  A conversation without rows is repaired already, at no cost; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as ST

from attesta.llm.common import release, shuffle_partitions, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
START, FINAL = 0, (0, FAR, FAR, 0)
#: The state after an inserted (or rerolled) row, and the role that it takes.
GIVEN, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a row that is kept, by its initial.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
LEGAL = frozenset({"su", "ua", "au"})
#: Characters that make a text blank or are skipped at its end.
SPACE = r"\x20\x09-\x0D"


# --- costs ---------------------------------------------------------------------------------------


def with_inserts(base: list[int]) -> list[int]:
    """Costs when rows may be inserted first: at most one before u or a is in place, two from the start."""
    two, three = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return [min(base[0], INSERT + two), min(base[1], INSERT + two), two, three]


def edits_of(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done to one row, without inserts."""
    out = [("D", DELETE, state)]
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        kept = KEPT[letter.lower()].get(state)
        if kept is not None:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, GIVEN[state]))
    return out


def before(letter: str, after: tuple[int, ...]) -> list[int]:
    """Cost-to-go of the four states before a row, from those after it."""
    return with_inserts([min(c + after[n] for _, c, n in edits_of(letter, s)) for s in range(4)])


class Steps:
    """Nodes of the minimised automaton: costs less their least, and for each state the best edit with its next state and cost."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def node(self, letter: str, after: tuple[int, ...]) -> tuple:
        """(costs, moves) before a row, given the costs after it."""
        found = self.known.get((letter, after))
        if found is None:
            costs = before(letter, after)
            moves = []
            for s in range(4):
                ways = [(e, c, n) for e, c, n in edits_of(letter, s) if c + after[n] == costs[s]]
                if INSERT + costs[GIVEN[s]] == costs[s]:
                    ways.append(("I", INSERT, GIVEN[s]))
                moves.append(min(ways))
            least = min(costs)
            found = self.known[letter, after] = (tuple(min(c - least, FAR) for c in costs), tuple(moves))
        return found


def best_edits(steps: Steps, signatures: Iterator[tuple[str, str, int]]) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, end state) of each (costs after, reversed signature, start state); sorted input shares its suffixes' nodes."""
    held, letters, nodes = None, "", []
    for after, reversed_, start in signatures:
        if after != held:
            held, letters = after, ""
            nodes = [(tuple(with_inserts(list(FINAL))) if after == "" else tuple(int(x) for x in after.split(",")), None)]
        same = shared(letters, reversed_)
        del nodes[same + 1:]
        for letter in reversed_[same:]:
            nodes.append(steps.node(letter, nodes[-1][0]))
        letters = reversed_
        state, cost, audit = start, 0, []
        for _, moves in reversed(nodes[1:]):
            edit = "I"
            while edit == "I":
                edit, price, state = moves[state]
                audit.append(edit)
                cost += price
        while after == "" and state in (1, 2):
            audit.append("I")
            cost, state = cost + INSERT, GIVEN[state]
        yield cost, "".join(audit), state


def shared(a: str, b: str) -> int:
    """Length of the common start of two strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def transfer(signature: str) -> list[int]:
    """Costs from each state before a piece to each state after it, sixteen numbers."""
    columns = []
    for end in range(4):
        costs = tuple(0 if s == end else FAR for s in range(4))
        for letter in reversed(signature):
            costs = tuple(min(c, FAR) for c in before(letter, costs))
        columns.append(costs)
    return [columns[end][s] for s in range(4) for end in range(4)]


# --- signatures ----------------------------------------------------------------------------------


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    said = F.coalesce(F.col(text), space)
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in df.columns else F.lit(True)
    return df.select(
        F.col(conv).alias("c"), present.alias("present"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), space).alias("r"), said.alias("text"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("h")


def _marks(rows: DataFrame) -> DataFrame:
    """(c, present, t, r, h, n, letter, blank, copy): rows without texts, equal ones of a turn counted, faults as letters."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    only = lambda c: F.when(F.col("present"), c)
    marks = rows.select("c", "present", only(F.col("t")).alias("t"), only(F.col("r")).alias("r"), only(_digest()).alias("h"), only(blank).alias("blank"), only(cut).alias("cut"))
    marks = marks.groupBy("c", "present", "t", "r", "h", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    first = marks.where("present AND NOT blank").groupBy("c", "r", "h").agg(F.max(F.col("t").isNull()).alias("nulls"), F.min("t").alias("least"))
    first = first.select(F.col("c").alias("c1"), F.col("r").alias("r1"), F.col("h").alias("h1"), "nulls", "least")
    same = F.col("c").eqNullSafe(F.col("c1")) & (F.col("r") == F.col("r1")) & (F.col("h") == F.col("h1"))
    seen = F.when(F.col("nulls"), F.col("t").isNotNull()).otherwise(F.col("t") != F.col("least"))
    initial = F.substring("r", 1, 1)
    base = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank") | seen, "x").when(F.col("cut"), F.upper(base)).otherwise(base)
    joined = marks.join(first, same & ~F.col("blank"), "left")
    return joined.select("c", "present", "t", "r", "h", "n", base.alias("initial"), letter.alias("letter"), "blank")


PIECE = ("part int, first_t long, first_r string, first_h binary, signature string, blank long, duplicate long, truncated long, illegal long, turns long, "
         "least long, most long, first_i string, last_i string, last_t long, edge boolean, transfer array<long>")


def _pieces(marks: DataFrame) -> DataFrame:
    """One row for each conversation a task of the sorted marks meets."""
    kind = marks.schema["c"].dataType
    schema = ST.StructType([ST.StructField("c", kind), *ST.StructType.fromDDL(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, now, made = TaskContext.get().partitionId(), [], None, 0
        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([("c", batch.schema.field("c").type), *_ARROW_PIECE])
            for c, present, t, r, h, n, initial, letter, blank in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if now is None or now.c != c:
                    if now is not None:
                        out.append(now.row(part, made == 1))
                    now, made = _Piece(c), made + 1
                if present:
                    now.add(t, r, h, n, initial, letter, blank)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            out.append(now.row(part, True))
            yield pa.RecordBatch.from_pylist(out, arrow)
        release()

    order = ["c", "present", "t", "r", "h"]
    cut = marks.repartitionByRange(shuffle_partitions(marks.sparkSession), *order).sortWithinPartitions(*order)
    return cut.select("c", "present", "t", "r", "h", "n", "initial", "letter", "blank").mapInArrow(run, schema)


_ARROW_PIECE = [
    ("part", pa.int32()), ("first_t", pa.int64()), ("first_r", pa.string()), ("first_h", pa.binary()), ("signature", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("first_i", pa.string()), ("last_i", pa.string()),
    ("last_t", pa.int64()), ("edge", pa.bool_()), ("transfer", pa.list_(pa.int64()))]


class _Piece:
    """What a task has seen of one conversation."""

    def __init__(self, c):
        self.c, self.first, self.letters, self.last_t, self.last_i, self.first_i = c, None, [], None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, t, r, h, n, initial, letter, blank) -> None:
        if self.first is None:
            self.first, self.first_i = (t, r, h), initial
        else:
            self.illegal += self.last_i + initial not in LEGAL
        self.illegal += n - 1
        if t is not None:
            self.turns += t != self.last_t
            self.least = t if self.least is None else self.least
            self.most = t
        self.last_t, self.last_i = t, initial
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (letter != "x")
            self.truncated += letter.isupper()
        self.letters.append(letter + "x" * (n - 1))

    def row(self, part: int, edge: bool) -> dict:
        t, r, h = self.first or (None, None, None)
        signature = "".join(self.letters)
        return {
            "c": self.c, "part": part, "first_t": t, "first_r": r, "first_h": h, "signature": signature, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "turns": self.turns, "least": self.least, "most": self.most, "first_i": self.first_i, "last_i": self.last_i, "last_t": self.last_t, "edge": edge,
            "transfer": transfer(signature) if edge else None}


# --- plans ---------------------------------------------------------------------------------------


def plan(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a piece: conversation ``c``, where it starts, its audit, grammar state before it, costs and fault counts."""
    spark = df.sparkSession
    pieces = written(_pieces(written(_marks(_rows(df, conv, turn, role, text)), "marks")), "pieces")
    kind = pieces.schema["c"].dataType
    # conversations that go on from task to task: at most two pieces a task are edges
    seen: dict = {}
    edges = pieces.where("edge").select("c", "part", "transfer", "first_t", "last_t", "first_i", "last_i").collect()
    for p in sorted(edges, key=lambda p: p.part):
        seen.setdefault(p.c, []).append(p)
    chains = {c: ps for c, ps in seen.items() if len(ps) > 1}
    links = [row for c, ps in chains.items() for row in _links(c, ps)]
    fields = [ST.StructField("c1", kind), *ST.StructType.fromDDL("part1 int, after string, more_illegal long, same_turns long").fields]
    linked = F.broadcast(spark.createDataFrame(links, ST.StructType(fields)))  # at most two rows a task
    joined = pieces.join(linked, F.col("c").eqNullSafe(F.col("c1")) & (F.col("part") == F.col("part1")), "left").select(
        *pieces.columns, F.coalesce("after", F.lit("")).alias("after"), F.col("c1").isNotNull().alias("linked"), F.col("part1").isNotNull().alias("chained"),
        F.coalesce("more_illegal", F.lit(0)).alias("more_illegal"), F.coalesce("same_turns", F.lit(0)).alias("same_turns"))
    joined = joined.withColumn("reversed", F.reverse("signature")).drop("linked", "signature", "transfer")
    starts = F.when(F.col("chained"), F.array(*[F.lit(s) for s in range(4)])).otherwise(F.array(F.lit(START)))
    wanted = joined.select("after", "reversed", F.explode(starts).alias("start")).distinct()
    known = written(_automaton(wanted), "automaton")
    begins = []
    if chains:
        ends = {(r.c, r.part, r.start): r.end for r in joined.where("chained").join(known, ["after", "reversed"]).select("c", "part", "start", "end").collect()}
        for c, ps in chains.items():
            state = START
            for p in ps:
                begins.append((c, p.part, state))
                state = ends[c, p.part, state]
    fields = [ST.StructField("c2", kind), *ST.StructType.fromDDL("part2 int, begin int").fields]
    begin = F.broadcast(spark.createDataFrame(begins, ST.StructType(fields)))
    joined = joined.join(begin, F.col("c").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2")), "left").withColumn(
        "start", F.coalesce("begin", F.lit(START))).drop("c2", "part2", "begin")
    return written(joined.join(known, ["after", "reversed", "start"]).drop("after", "reversed", "end", "edge", "first_i", "last_i", "last_t"), "repairs")


def _links(c, pieces: list) -> list[tuple]:
    """For each piece of one conversation: the costs after it, and what its counts miss at the border before it."""
    after, labels = tuple(with_inserts(list(FINAL))), [""]
    for p in reversed(pieces[1:]):
        costs = [min(p.transfer[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
        after = tuple(min(x, FAR) for x in costs)
        labels.append(",".join(str(x - min(after)) for x in after))
    labels.reverse()
    out, last_i, last_t = [], None, None
    for p, label in zip(pieces, labels, strict=True):
        illegal = int(last_i is not None and p.first_i is not None and last_i + p.first_i not in LEGAL)
        same = int(p.first_t is not None and p.first_t == last_t)
        out.append((c, p.part, label, illegal, same))
        if p.first_i is not None:
            last_i, last_t = p.last_i, p.last_t
    return out


def _automaton(wanted: DataFrame) -> DataFrame:
    """(after, reversed, start, cost, audit, end) of the distinct signatures, each suffix worked out once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()

        def keys():
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    piece = batch.slice(a, 1024)
                    yield from zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True)

        held: list[tuple] = []
        source = _Tee(keys())
        for result in best_edits(steps, source):
            held.append((*source.last, *result))
            if len(held) >= 1024:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)
        release()

    order = ["after", "reversed", "start"]
    spread = wanted.repartitionByRange(shuffle_partitions(wanted.sparkSession), *order).sortWithinPartitions(*order)
    return spread.select(*order).mapInArrow(run, "after string, reversed string, start int, cost long, audit string, end int")


class _Tee:
    """Remembers the item that was handed out last."""

    def __init__(self, items):
        self.items, self.last = items, None

    def __iter__(self):
        for self.last in self.items:
            yield self.last


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["after", "reversed", "start", "cost", "audit", "end"])


# --- results -------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "cost", "more_illegal", "same_turns")


def _streamed(df: DataFrame, plans: DataFrame, conv: str, turn: str, role: str, text: str, apart: bool) -> DataFrame:
    """Rows behind the plan of their piece, by conversation (and piece, if ``apart``), in order."""
    rows = _rows(df, conv, turn, role, text).where("present").select("c", "t", "r", _digest(), F.lit(1).alias("kind"), "text")
    nothing = [F.lit(None).cast("string" if n == "audit" else "int" if n in ("start", "part") else "long").alias(n) for n in ("part", "start", "audit", *COUNTS)]
    heads = plans.select(
        "c", F.col("first_t").alias("t"), F.col("first_r").alias("r"), F.col("first_h").alias("h"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"),
        "part", "start", "audit", *COUNTS, F.when(F.col("chained"), F.col("part")).otherwise(-1).alias("spread"))
    order = ["t", "r", "h", "kind"]
    if not apart:
        return rows.select("*", *nothing).union(heads.drop("spread")).repartition("c").sortWithinPartitions("c", *order)
    # a conversation of several pieces is spread by piece: its rows find theirs among the pieces' first rows
    key = F.struct("t", "r", "h")
    firsts = plans.where("chained").groupBy(F.col("c").alias("c1")).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(F.col("first_t").alias("t"), F.col("first_r").alias("r"), F.col("first_h").alias("h")).alias("key"), "part"))).alias("firsts"))
    placed = rows.join(F.broadcast(firsts), F.col("c").eqNullSafe(F.col("c1")), "left")  # at most two pieces a task
    near = F.element_at(F.filter("firsts", lambda f: f["key"] <= key), -1)["part"]
    placed = placed.select(*rows.columns, *nothing, F.coalesce(near, F.lit(-1)).alias("spread"))
    return placed.union(heads).repartition("c", "spread").sortWithinPartitions("c", "spread", *order).drop("spread")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("piece", head) for each piece and (edit, turn, role, text) for each of its edits, in order."""
    audit, at, state = "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield "I", None, ROLE[state], ""
            at, state = at + 1, GIVEN[state]

    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            for row in zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns), strict=True):
                c, t, r, _, kind, text = row[:6]
                if kind == 0:
                    yield from inserted()  # what the piece before ends with
                    audit, at, state = row[8], 0, row[7]
                    yield "piece", row, None, None
                    continue
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    r, state = ROLE[state], GIVEN[state]
                elif edit == "K":
                    state = KEPT[r[0]][state]
                yield edit, t, r, text
    yield from inserted()


def repaired_conversations(df: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, and the digest of its repaired rows.

    A digest is one sequence, so a conversation passes through one task, as a stream: the task holds a batch and a piece's audit.
    """
    kind = plans.schema["c"].dataType
    schema = ST.StructType([ST.StructField(conv, kind), *ST.StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []

        def noted():
            for batch in batches:
                first[:] = first or [batch.schema.field("c").type]
                yield batch

        out, now = [], None
        for edit, a, r, text in _walk(noted()):
            if edit == "piece":
                if now is None or now.c != a[0]:
                    if now is not None:
                        out.append(now.result(conv))
                    now = _Conversation(a[0])
                now.piece(a[8], dict(zip(COUNTS, a[9:], strict=True)))
            elif edit != "D":
                now.row(r, text)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, _result_schema(conv, first[0]))
                out = []
        if now is not None:
            out.append(now.result(conv))
            yield pa.RecordBatch.from_pylist(out, _result_schema(conv, first[0]))
        release()

    return _streamed(df, plans, conv, turn, role, text, False).mapInArrow(run, schema)


def _result_schema(conv: str, kind: pa.DataType) -> pa.Schema:
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return pa.schema([(conv, kind), *((n, pa.int64()) for n in longs), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Conversation:
    def __init__(self, c):
        self.c, self.audit, self.rows, self.hash = c, [], 0, hashlib.sha256()
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.least = self.most = None

    def piece(self, audit: str, counts: dict) -> None:
        self.audit.append(audit)
        for name in self.sums:
            self.sums[name] += counts[name]
        self.sums["illegal"] += counts["more_illegal"]
        self.sums["turns"] -= counts["same_turns"]
        if counts["least"] is not None:
            self.least = counts["least"] if self.least is None else self.least
            self.most = counts["most"]

    def row(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def result(self, conv: str) -> dict:
        turns = self.sums.pop("turns")
        gaps = 0 if self.least is None else self.most - self.least + 1 - turns
        return {conv: self.c, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repaired_turns(df: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: (conversation, piece, position, edit, turn, role, text), in order of piece and position; inserted rows have no turn.

    Rows of a conversation that fills several tasks are spread by piece here too.
    """
    kind = plans.schema["c"].dataType
    schema = ST.StructType([ST.StructField(conv, kind), *ST.StructType.fromDDL("piece int, position long, edit string, turn long, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def noted():
            for batch in batches:
                types[:] = types or [batch.schema.field("c").type]
                yield batch

        held, c, part, at = [], None, None, 0
        names = [conv, "piece", "position", "edit", "turn", "role", "text"]

        def batch():
            kinds = (types[0], pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for edit, a, r, said in _walk(noted()):
            if edit == "piece":
                c, part, at = a[0], a[6], 0
            elif edit != "D":
                held.append((c, part, at, edit, a, r, said))
                at += 1
                if len(held) >= 1024:
                    yield batch()
                    held = []
        if held:
            yield batch()
        release()

    return _streamed(df, plans, conv, turn, role, text, True).mapInArrow(run, schema)


# --- damage for tests and the query --------------------------------------------------------------


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows broken by crc32 of ``conversation:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 repeated, 4 said by the user.

    Dropped rows stay with ``present`` false, so their conversation isn't lost.
    """
    space = F.lit(" ")
    given = lambda c: F.coalesce(F.col(c).cast("string"), space)
    code = F.crc32(F.concat(given(conv), F.lit(":"), given(turn)).cast("binary")) % 20
    rows = df.select(F.col(conv), F.col(turn), given(role).alias(role), given(text).alias(text), code.alias("present"))
    return rows.select(
        conv, turn, F.when(F.col("present") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("present") == 1, "").when(F.col("present") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.array_repeat(F.col("present") != 0, F.when(F.col("present") == 3, 2).otherwise(1))).alias("present"))
