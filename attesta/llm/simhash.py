"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by a general pigeonhole.

Bits that go together share a partition, which leaves the partitions as independent as can be.  With m partitions and radius
tau, thresholds t_i of at least -1 whose sum is tau - m + 1 suffice: two fingerprints within tau differ in at most t_i bits of some
partition i (a partition with -1 is not probed).  A dynamic programme chooses the t_i, and m, of least estimated cost: keys
written plus candidates compared, from bit statistics over all fingerprints.  A partition with threshold t is probed by its
value with every choice of t bits masked; fingerprints that share a key are compared bit by bit.

Equal fingerprints are one row of the search.  Groups that share a key are compared inside tasks, large ones as pairs of
blocks (`common.block_pairs`), and a task emits a spanning forest of the links it found instead of every pair: the same
components, and no more rows than it has read.

`near_duplicates` links by bits alone.  `similar_texts` asks for a similarity of the shingle sets instead.  Its fingerprints have 512
bits; a guarantee over a radius that wide would take too many masked keys, so it bounds the chance of a miss: each key is a random
choice of bits, and there are as many keys as leave a pair at the similarity asked for without a shared key with a chance of at most
MISS, at any number of texts (wider keys come with more of them).  Pairs that share a key and whose leading bits are within
several deviations of the distance expected at that similarity link candidate groups; inside a group the Jaccard similarity of the
whole sets of shingles decides.  Texts that are already in one component are not compared again (`group_components`).  Equal fingerprints of
512 bits count as equal sets.

Null texts count as empty (fingerprint zero).  Rows without an id keep their fingerprint but link with nothing.  Repeated ids
and rows stay.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import block_pairs, forget, slices, written
from attesta.llm.components import components
from attesta.llm.groups import forest, whole_groups

BITS = 64
SEED = 42
#: Rows of a block of a large group; a task compares two blocks at a time.
BLOCK = 1024
#: Cost of one comparison against that of one written key.
PAIR_COST = 0.05
#: At most so many keys of a fingerprint.
MAX_KEYS = 400
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int) -> int:
    """As an unsigned number: bit k is set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(starts), 1 << 16):
        hashes = [digest(joined[x:y], SEED) for x, y in zip(starts[a:a + (1 << 16)].tolist(), ends[a:a + (1 << 16)].tolist(), strict=True)]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_statistics(points: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.append(n, total.ravel()).astype(np.int64))], names=["cell", "n"])

    cells = {r.cell: r.n for r in points.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
    return np.abs(both / max(n, 1) - np.outer(p, p)) / spread


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of like width, each grown by the bit most correlated with its members."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        members = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(members[0])
        while len(members) < width:
            best = max(free, key=lambda b: (corr[b, members].mean(), -b))
            members.append(best)
            free.discard(best)
        out.append(sorted(members))
    return out


def agreement(p: np.ndarray, corr: np.ndarray, bits: list[int]) -> float:
    """Estimated part of all pairs that agree on these bits; correlated bits count as fewer."""
    same = p[bits] ** 2 + (1 - p[bits]) ** 2
    own = np.linalg.eigvalsh(np.where(np.eye(len(bits)) > 0, 1, corr[np.ix_(bits, bits)] ** 2))
    effective = own.sum() ** 2 / (own ** 2).sum()
    return float(np.exp(np.log(np.clip(same, 1e-12, 1)).mean() * effective))


def plan_keys(n: int, both: np.ndarray, radius: int) -> list[int]:
    """Bit masks of the keys of least estimated cost that miss no pair within ``radius``."""
    p, corr = np.diag(both) / max(n, 1), correlations(n, both)
    best: tuple[float, list[int]] | None = None
    for parts in range(1, radius + 4):
        groups = grouped_bits(corr, parts)
        # the dynamic programme: least cost of the first partitions by the sum of their thresholds
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share = agreement(p, corr, bits)
            following: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in reach.items():
                for t in range(-1, min(radius, len(bits) - 1) + 1):
                    keys = comb(len(bits), t) if t >= 0 else 0
                    if keys > MAX_KEYS:
                        break
                    more = cost + (keys * (1 + PAIR_COST * n * share ** ((len(bits) - t) / len(bits))) if t >= 0 else 0)
                    if spent + t not in following or more < following[spent + t][0]:
                        following[spent + t] = (more, [*chosen, t])
            reach = following
        found = reach.get(radius - parts + 1)
        if found and (best is None or found[0] < best[0]):
            masks = [sum(1 << b for b in bits if b not in hidden) for bits, t in zip(groups, found[1], strict=True) if t >= 0 for hidden in combinations(bits, t)]
            best = (found[0], masks)
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(points: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of links between ``points`` (id, fp), fingerprints distinct, at ``radius`` bits or fewer."""
    masks = plan_keys(*bit_statistics(points), radius)
    keyed = points.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("k", "v"))
    laid = block_pairs(keyed, ["k", "v"], F.col("fp"), block).select("k", "v", "b1", "b2", "id", "fp")
    keys = ["k", "v", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            a, b = links_in(table.column("fp").to_numpy().view(np.uint64), bounds, radius)
            if len(a):
                ids = table.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def links_in(fp: np.ndarray, bounds: np.ndarray, radius: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each group: of small groups all, side by side; of others a spanning forest."""
    wide = fp.ndim == 2
    apart = (lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)) if wide else (lambda a, b: np.bitwise_count(a ^ b))
    size = np.diff(bounds)
    left, right = [], []
    group = np.repeat(np.arange(len(size)), size)
    member = np.flatnonzero((size[group] <= small) & (size[group] > 1))
    for d in range(1, small):
        member = member[member + d < len(fp)]
        member = member[group[member] == group[member + d]]
        if not len(member):
            break
        near = member[apart(fp[member], fp[member + d]) <= radius]
        left.append(near)
        right.append(near + d)
    for g in np.flatnonzero(size > small).tolist():
        own = fp[bounds[g]:bounds[g + 1]]
        label = forest(np.concatenate([apart(own[i:i + 256, None], own[None, :]) <= radius for i in range(0, len(own), 256)]))
        at = np.flatnonzero(label != np.arange(len(own)))
        left.append(bounds[g] + at)
        right.append(bounds[g] + label[at])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable by links, its own included."""
    prints = written(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    points = written(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").cast("long").alias("id")), "fingerprint-classes")
    found = components(near_links(points, radius))
    classes = written(points.join(found, points.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")), "fingerprint-components")
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Bits of a wide fingerprint, in lanes of 64.
WIDE = 512


def wide_fingerprint(text: str, shingle: int) -> bytes:
    """Like `fingerprint`, over the set of shingles, with WIDE bits from one hash mixed once for each lane."""
    base = shingle_set(text, shingle)
    if not len(base):
        return bytes(WIDE // 8)
    out = []
    for lane in range(WIDE // BITS):
        counts = np.zeros(BITS, np.int64)
        for a in range(0, len(base), 1 << 16):
            h = (base[a:a + (1 << 16)] + np.uint64(lane + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(base), bitorder="little").tobytes())
    return b"".join(out)


#: Chance that a pair at the similarity asked for shares no key, bits of the shortest keys, texts of a key by chance from which keys widen.
MISS, KEY_BITS, KEY_TEXTS = 0.01, 16, 256
#: Keys after which linked texts are contracted, before the next keys are laid out.
FIRST_KEYS = (2, 10)
#: Leading bits that keys carry along, deviations from their expected distance, rows of a block of shingle sets.
LEADING, DEVIATIONS, SET_BLOCK = 256, 4, 256


def flips(similarity: float) -> float:
    """Part of the bits that differ between sets with this Jaccard similarity: the angle of sets of like size, and 0.01 for short ones."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) + 0.01


def wide_keys(n: int, similarity: float) -> np.ndarray:
    """Bits of each key for n texts, dealt from random orders of all bits: one row a key, as many as keep to MISS."""
    width = max(KEY_BITS, int(np.ceil(np.log2(max(n, 2) / KEY_TEXTS))))
    number = int(np.ceil(np.log(MISS) / np.log1p(-(1 - flips(similarity)) ** width)))
    rng, each = np.random.default_rng(SEED), WIDE // width
    return np.concatenate([rng.permutation(WIDE)[:each * width].reshape(each, width) for _ in range(-(-number // each))])[:number]


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    parts = {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of these sets have a Jaccard similarity of ``similarity`` or more, by counting all shared members."""
    size = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(size)))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    out, held = np.zeros((len(sets), len(sets)), bool), np.zeros(len(values), bool)
    for i in range(len(sets)):
        held[:] = False
        held[place[starts[i]:starts[i + 1]]] = True
        shared = np.diff(np.concatenate(([0], np.cumsum(held[place])))[starts])
        out[i] = shared >= similarity * np.maximum(size + size[i] - shared, 1) - 1e-9
    return out


def similar_texts(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id, digest, first) of every row: groups of texts linked by a similarity of their shingle sets of ``similarity`` or more.

    Texts are told apart by id and ``digest``, xxhash64 of the text (null as empty), so rows without an id and rows that share one are
    compared like any other.  ``component_id`` is the group's smallest id, null where no member has one; ``first`` marks its first text by
    (id, digest), rows without an id last.  Rows equal in both are one text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wide_fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.binary()), batch.column(2)], names=["doc_id", "fp", "digest"])

    held = written(texts.mapInArrow(prints, f"doc_id {kind}, fp binary, digest long"), "wide-fingerprints")
    # one text stands for all with its fingerprint; their numbers are in the order of (id, digest), so the smallest number is the first text
    own = F.col("doc_id").cast("long")
    first = held.groupBy("fp").agg(F.min(F.struct(own.isNull().alias("none"), own.alias("own"), "digest")).alias("first")).select("fp", "first.*")
    numbered = first.repartitionByRange("none", "own", "digest", "fp").sortWithinPartitions("none", "own", "digest", "fp")
    points = written(numbered.withColumn("id", F.monotonically_increasing_id()), "wide-classes")
    chosen = wide_keys(points.count(), similarity)
    radius = int(LEADING * flips(similarity) + DEVIATIONS * np.sqrt(LEADING * flips(similarity) * (1 - flips(similarity))))

    def probe(some: np.ndarray, first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = 1 << np.arange(some.shape[1])
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    part = batch.slice(a, 2048)
                    fp = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    bits = np.unpackbits(fp, axis=1, bitorder="little")
                    lead = pa.array([x.tobytes() for x in fp[:, :LEADING // 8]], pa.binary())
                    for k, own in enumerate(some, first):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(part.num_rows, k, np.int32)), pa.array((bits[:, own] @ weights).astype(np.int32)), part.column(1), part.column(2), lead],
                            names=["k", "v", "id", "_node", "fp"])

        return run

    def near(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lanes = np.frombuffer(b"".join(table.column("fp").to_pylist()), "<u8").reshape(table.num_rows, -1)
        return links_in(lanes, bounds, radius)

    cuts = [c for c in (0, *FIRST_KEYS) if c < len(chosen)] + [len(chosen)]

    def keyed(p: int, known: DataFrame | None) -> DataFrame:
        at = points.select("fp", "id")
        at = at.withColumn("_node", F.col("id")) if known is None else at.join(known, at.id == known.node, "left").select("fp", "id", F.coalesce("component", "id").alias("_node"))
        return at.mapInArrow(probe(chosen[cuts[p]:cuts[p + 1]], cuts[p]), "k int, v int, id long, _node long, fp binary")

    groups = group_components(keyed, len(cuts) - 1, ["k", "v"], near, block)
    found = _alike(texts, points.join(groups, points.id == groups.node).select("id", "own", "digest", "component"), shingle, similarity, min(block, SET_BLOCK))
    placed = points.join(found, points.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("_of"))
    heads = points.select(F.col("id").alias("_head"), F.col("own").alias("_own"), F.col("digest").alias("_digest"))
    classes = written(placed.join(heads, F.col("_of") == F.col("_head")).select("fp", "_own", "_digest"), "wide-components")
    return held.join(classes, "fp").select(
        "doc_id", F.col("_own").cast(kind).alias("component_id"), "digest", (own.eqNullSafe(F.col("_own")) & (F.col("digest") == F.col("_digest"))).alias("first"))


def group_components(make, passes: int, keys: list[str], compare, block: int) -> DataFrame:
    """(node, component) over ids: two rows of one group (equal ``keys``) are linked where ``compare`` says so.

    ``make(p, known)`` lays out the rows of pass ``p`` with their id and ``_node``, the component that ``known`` (node, component) has for
    it so far; ``compare`` gets a table of whole groups with their bounds and returns linked positions.  Each pass sees what the passes before it have
    contracted, so a group of n copies costs about n rows and not a link for each pair and key.  A group beyond ``block`` rows is
    dealt into blocks first.  At the end, pairs across blocks can only matter where a group still holds several components: there the
    rows outside its largest component meet every block of it and each other.  So no link is lost, and none within a component is
    looked at twice.
    """
    known, crowds = None, []
    for p in range(passes):
        rows = make(p, known)
        large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
        large = written(large.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "large-groups")
        crowds.append(large.limit(1).count() > 0)
        if crowds[-1]:
            blocks = F.coalesce("_blocks", F.lit(1))
            rows = rows.join(large, keys, "left").withColumn("_block", F.pmod(F.xxhash64("id", F.lit(p), *keys), blocks).cast("int")).drop("_blocks")
        else:
            rows = rows.withColumn("_block", F.lit(0))
        known = _contracted(known, _links(rows, [*keys, "_block"], compare))
    for p in range(passes):
        if crowds[p]:
            more = _links(_across(make(p, known), keys, block), [*keys, "_kind", "_i", "_j"], compare)
            known = _contracted(known, more)
    return known


def _contracted(known: DataFrame | None, links: DataFrame) -> DataFrame:
    edges = links.distinct()
    if known is not None:
        edges = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges)
    return written(components(edges), "contracted")


def _links(rows: DataFrame, by: list[str], compare) -> DataFrame:
    """(a, b): every linked component of a cell and the smallest one that the cell ties it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, by):
            a, b = rooted(*compare(table, bounds), table.num_rows)
            if len(a):
                nodes = table.column("_node").to_numpy()
                apart = nodes[a] != nodes[b]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a[apart]]), pa.array(nodes[b[apart]])], names=["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by, "_node").mapInArrow(run, "a long, b long")


def rooted(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), each row tied to the first row of its own."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _across(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Cells of the groups that still hold several components: blocks of the largest one against blocks of the others' rows, and these against each other."""
    sizes = rows.groupBy(*keys, "_node").agg(F.count(F.lit(1)).alias("_n"))
    groups = sizes.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "_node")).alias("_top"))
    groups = groups.where((F.col("_all") > block) & (F.col("_top._n") < F.col("_all")))
    count = lambda n: F.ceil(n / block).cast("int")
    groups = written(groups.select(*keys, F.col("_top._node").alias("_major"), count(F.col("_top._n")).alias("_large"), count(F.col("_all") - F.col("_top._n")).alias("_small")), "divided-groups")
    joined = rows.join(groups, keys).withColumn("_is", F.col("_node") == F.col("_major"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("_is"), F.col("_large")).otherwise(F.col("_small"))).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("_kind"), i.alias("_i"), j.alias("_j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    me = F.col("_own")
    cells = F.when(F.col("_is"), F.transform(upto("_small"), lambda j: cell(0, me, j))).otherwise(
        F.concat(F.transform(upto("_large"), lambda i: cell(0, i, me)), F.transform(upto("_small"), lambda j: cell(1, F.least(me, j), F.greatest(me, j)))))
    return joined.withColumn("_own", own).withColumn("_cell", F.explode(cells)).select(*rows.columns, "_cell.*")


def _alike(texts: DataFrame, members: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """(node, component) of texts of one candidate group (``members``: id, own, digest, component) by the exact similarity of their shingle sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingle_set(t, shingle).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["candidates", "id", "members"])

    def same(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s > 1:
                label = forest(alike([np.frombuffer(x, np.uint64) for x in table.column("members").slice(s, e - s).to_pylist()], similarity))
                at = np.flatnonzero(label != np.arange(e - s))
                left.append(s + at)
                right.append(s + label[at])
        return np.concatenate(left), np.concatenate(right)

    members = members.withColumnRenamed("digest", "_digest")
    chosen = texts.join(members, F.col("doc_id").cast("long").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("_digest"))).dropDuplicates(["id"])
    found = written(chosen.select("component", "id", "text").mapInArrow(sets, "candidates long, id long, members binary"), "shingle-sets")

    def laid(p: int, known: DataFrame | None) -> DataFrame:
        if known is None:
            return found.withColumn("_node", F.col("id"))
        # a later pass deals anew only groups that are cut into blocks
        cut = found.groupBy("candidates").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("candidates")
        again = found.join(cut, "candidates", "left_semi")
        return again.join(known, again.id == known.node, "left").select("candidates", "id", "members", F.coalesce(F.col("component"), F.col("id")).alias("_node"))

    return group_components(laid, 2, ["candidates"], same, block)


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
