"""Text classification: TF-IDF features, linear scoring with abstention, and folds; `training` fits the models.

Model tables: ``model_term(term, idf, weights)`` where ``weights`` holds one coefficient per class
in class order, and the intercepts as a plain list.  Scoring joins on the term once and needs one
aggregation per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta import vocabulary as V
from attesta.functions import text as T

MIN_TOKENS, MIN_CATEGORY, MIN_SUBCATEGORY, MAX_TERMS = 3, 0.60, 0.50, 6


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(key, term, tf) over uni- and bigrams.

    The texts of a key meet as texts and their terms are counted inside the row, so terms are not shuffled to be counted.
    A key stands for one text, or a few.
    """
    cleaned = T.preprocess_text(F.col(text), fold)
    given = docs.select(key, cleaned.alias("_text")).groupBy(key).agg(F.collect_list("_text").alias("_texts"))
    return given.select(key, _counted_terms())


def _counted_terms() -> Column:
    grams = F.flatten(F.transform("_texts", lambda t: T.ngrams(T.feature_tokens(t), 1, 2)))
    return F.inline(T.counted(grams).cast("array<struct<term:string,tf:bigint>>"))


def _blocks(df: DataFrame) -> int:
    """Two a shuffle partition: what a block keeps and sorts is half a partition's."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(block, key, _texts[]): cleaned texts by key, dealt out into blocks of equal share, each in a partition of its own.

    A block asks for each of its terms once, however many of its texts hold it (`block_counts`, `block_idf`, `meet`): between blocks go
    the texts, a block's distinct terms, and their weights, never a row a text and term.
    """
    given = docs.select(key, T.preprocess_text(F.col(text), fold).alias("_text"))
    return dealt(given, key).groupBy(key, "block").agg(F.collect_list("_text").alias("_texts"))


def dealt(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with the ``block`` of their key, laid out by it."""
    n = _blocks(rows)
    # the least number that `hash` sends to each partition: blocks named by their plain numbers would share partitions and leave others empty
    place = lambda c: F.pmod(F.hash(c), F.lit(n))
    least = {r.p: r.id for r in rows.sparkSession.range(20 * n).groupBy(place("id").alias("p")).agg(F.min("id").alias("id")).collect()}
    names = F.lit([least.get(p, p) for p in range(n)]).cast("array<bigint>")
    return rows.select(F.get(names, place(key)).alias("block"), "*").repartition(n, "block")


def block_counts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(block, key, term, tf): `term_counts` of texts `in_blocks`."""
    return blocks.select("block", key, _counted_terms())


def block_idf(counts: DataFrame, n_docs: DataFrame, min_df: int = 2) -> DataFrame:
    """(block, term, df, idf): `fit_idf` over all blocks, a row for each block that has the term."""
    own = counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("term")  # neighbours share their beginning, which packs better
    df = own.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).where(F.col("df") >= min_df).drop("n")
    return _with_idf(df, n_docs, "block")


def meet(counts: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """`block_counts` with the columns of a model by block and term; a term that the model doesn't know drops out.

    The model's rows go to their block once and lie beside its counts: a union keeps the layout by block, a join by block and term would
    shuffle both again.
    """
    columns = [c for c in model.columns if c not in ("block", "term")]
    missing = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    asked = counts.select("block", "term", key, "tf", *missing(model, columns))
    told = model.repartition(_blocks(counts), "block").select("block", "term", *missing(counts, (key, "tf")), *columns)
    own = Window.partitionBy("term", "block")  # sorted by what differs first
    met = asked.union(told).select(
        "block", key, "term", "tf", *[F.first(c, ignorenulls=True).over(own).alias(c) for c in columns], F.count_if(F.col("tf").isNull()).over(own).alias("_told"))
    return met.where(F.col("tf").isNotNull() & (F.col("_told") > 0)).drop("_told")


def trainable(docs: DataFrame, text: str = "text", fold: bool = True) -> DataFrame:
    return docs.where(F.size(T.word_tokens(T.preprocess_text(F.col(text), fold))) >= MIN_TOKENS)


def by_term(counts: DataFrame) -> DataFrame:
    """Counts laid out by term: what follows by term needs no other exchange, and equal layouts are one."""
    return counts.repartition("term")


def fit_idf(counts: DataFrame, n_docs: DataFrame, min_df: int = 2, met_again: bool = False) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1; ``n_docs`` is the one-row document count.

    ``met_again``: the counts will be joined to these weights.  Then they are counted in the layout by term that the join uses too; a
    value of the other columns keeps both layouts the same, so that Spark shuffles the counts once.  Else they are combined before the shuffle.
    """
    if met_again:
        others = F.max(F.struct(*[c for c in counts.columns if c != "term"]))
        df = by_term(counts).groupBy("term").agg(F.count(F.lit(1)).alias("df"), others.alias("_any")).where((F.col("df") >= min_df) & F.col("_any").isNotNull()).drop("_any")
    else:
        df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return _with_idf(df, n_docs)


def _with_idf(df: DataFrame, n_docs: DataFrame, *keep) -> DataFrame:
    return df.withColumn("_one", F.lit(1)).join(n_docs.select(F.lit(1).alias("_one"), "n"), "_one").select(
        *keep, "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_rows(counts: DataFrame, idf: DataFrame, key: str = "doc_id", sublinear: bool = False) -> DataFrame:
    """(key, term, weight), L2-normalised over the terms the vocabulary knows."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(idf, "term").select(key, "term", (tf * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def row_norms(counts: DataFrame, idf: DataFrame, key: str = "doc_id", sublinear: bool = False) -> DataFrame:
    """(key, terms, top_weight) of `tfidf_rows`, from one join and one aggregation: terms go to their weight and only sums come back."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = by_term(counts).join(idf.hint("shuffle_hash"), "term").select(key, (tf * F.col("idf")).alias("raw"))
    return raw.groupBy(key).agg(F.count(F.lit(1)).alias("terms"), (F.max("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("top_weight"))


def linear_scores(counts: DataFrame, model: DataFrame, intercepts: Sequence[float], key: str = "doc_id",
                  sublinear: bool = False) -> DataFrame:
    """(key, known_terms, scores[]): the linear score per class, from one join and one aggregation.

    Norm and dot products are summed together; dividing by the norm afterwards equals scoring the
    normalised row.  The counts outgrow their estimate, so they are never broadcast.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    x = tf * F.col("idf")
    k = len(intercepts)
    sums = by_term(counts).join(model.hint("shuffle_hash"), "term").withColumn("x", x).groupBy(key).agg(
        F.count(F.lit(1)).alias("known_terms"), *_sums(k))
    return sums.select(key, "known_terms", _scores(intercepts).alias("scores"))


def _sums(k: int) -> list[Column]:
    x = F.col("x")
    return [F.sum(x * x).alias("sq"), *[F.sum(x * F.get("weights", F.lit(c))).alias(f"d{c}") for c in range(k)]]


def _scores(intercepts: Sequence[float]) -> Column:
    return F.array(*[F.col(f"d{c}") / F.sqrt("sq") + F.lit(float(b)) for c, b in enumerate(intercepts)])


def block_scores(rows: DataFrame, intercepts: Sequence[float], key: str, *keep: str) -> DataFrame:
    """(block, key, keep, known_terms, scores[], norm, weighed[]): `linear_scores` of rows that lie by block.

    ``rows`` hold (block, key, term, x, weights) of the known terms, and one row a text, without a term, that has its ``keep`` columns.
    ``weighed`` has what `heaviest_terms` needs of the terms that weigh for some class.
    """
    weighs = (F.col("x") * F.array_max("weights") > 0) | (F.col("x") * F.array_min("weights") > 0)
    sums = rows.groupBy(key, "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep], F.count("term").alias("known_terms"), *_sums(len(intercepts)),
        F.collect_list(F.when(weighs, F.struct("term", "x", "weights"))).alias("weighed"))
    return sums.select("block", key, *keep, "known_terms", _scores(intercepts).alias("scores"), F.sqrt("sq").alias("norm"), "weighed")


def heaviest_terms(weighed: Column, norm: Column, class_index: Column, k: int = MAX_TERMS) -> Column:
    """(rank, term, contribution) array: the largest positive contributions to one class, within the row.

    Contributions are compared at six decimals, so that ties fall to the term and not to rounding noise.
    """
    able = F.filter(weighed, lambda t: t["x"] * F.get(t["weights"], class_index) > 0)  # before the rounding, which costs more
    given = F.transform(able, lambda t: F.struct((-F.round(t["x"] / norm * F.get(t["weights"], class_index), 6)).alias("less"), t["term"].alias("term")))
    first = F.slice(F.array_sort(F.filter(given, lambda t: t["less"] < 0)), 1, k)
    return F.transform(first, lambda t, n: F.struct((n + 1).alias("rank"), t["term"].alias("term"), (-t["less"]).alias("contribution")))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    shifted = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shifted, lambda e: e / total)


def sigmoid_pair(score: Column) -> Column:
    """Probabilities of the two classes from the single score of the second."""
    p = 1 / (1 + F.exp(-score))
    return F.array(1 - p, p)


def decide(docs: DataFrame, scored: DataFrame, classes: Sequence[str], key: str = "doc_id", text: str = "text",
           fold: bool = True) -> DataFrame:
    """The abstaining decision: too little text, no known term, or a weak category mean unknown."""
    rows = docs.select(key, F.size(T.word_tokens(T.preprocess_text(F.col(text), fold))).alias("tokens")).join(scored.hint("shuffle_hash"), key, "left")
    return decided(rows, classes, key)


def weighed(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``rows`` (``tokens``, ``known_terms``, ``scores``) with the heaviest category ``best`` (m, c), its heaviest class ``sub`` (m, s) and ``reason``."""
    category = {s: c for s, c, _ in V.TAXONOMY}
    rows = rows.withColumn("p", softmax(F.col("scores")))
    prob = lambda i: F.get("p", F.lit(i))
    mass = lambda cat: sum((prob(i) for i, s in enumerate(classes) if category[s] == cat), F.lit(0.0))
    rows = rows.withColumn("food", mass(V.FOOD)).withColumn("non_food", mass(V.NON_FOOD))
    best = F.greatest(F.struct(F.col("food").alias("m"), F.lit(V.FOOD).alias("c")),
                      F.struct(F.col("non_food").alias("m"), F.lit(V.NON_FOOD).alias("c")))
    options = F.array(*[F.struct(prob(i).alias("m"), F.lit(s).alias("s"), F.lit(category[s]).alias("c")) for i, s in enumerate(classes)])
    rows = rows.withColumn("best", best).withColumn("options", options)
    rows = rows.withColumn("sub", F.array_max(F.filter("options", lambda o: o["c"] == F.col("best.c"))))
    reason = (
        F.when(F.col("tokens") < MIN_TOKENS, F.lit("insufficient text"))
        .when(F.coalesce(F.col("known_terms"), F.lit(0)) == 0, F.lit("no known term"))
        .when(F.col("best.m") < MIN_CATEGORY, F.lit("below category threshold"))
        .when(F.col("sub.m") < MIN_SUBCATEGORY, F.lit("subcategory below threshold"))
        .otherwise(F.lit("committed"))
    )
    return rows.withColumn("reason", reason)


def decided(rows: DataFrame, classes: Sequence[str], *keep) -> DataFrame:
    """The decision of each row with its number of ``tokens``, ``known_terms`` and ``scores`` (null where nothing is known)."""
    rows = weighed(rows, classes)
    said = F.col("reason").isin("committed", "subcategory below threshold")
    full = F.col("reason") == "committed"
    four = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    return rows.select(
        *keep, F.when(said, F.col("best.c")).otherwise(F.lit(V.UNKNOWN)).alias("category"),
        F.when(full, F.col("sub.s")).alias("subcategory"), F.when(said, four(F.col("best.m"))).alias("confidence"),
        F.when(full, four(F.col("sub.m"))).alias("subcategory_confidence"), "reason")


def top_terms(counts: DataFrame, model: DataFrame, class_index: int, key: str = "doc_id", k: int = MAX_TERMS) -> DataFrame:
    """(key, rank, term, contribution): the largest positive contributions to one class, ranked within the row.

    ``counts`` are `term_counts`, or `block_counts` with a model by block (`block_idf`).  Terms go to their weight and back once, and only those
    that weigh for the class come back by name; a row holds the terms of one text.
    """
    x = F.col("tf") * F.col("idf")
    by = [c for c in ("block",) if c in counts.columns]
    known = model.select(*by, "term", "idf", F.get("weights", F.lit(class_index)).alias("weight"))
    met = meet(counts, known, key) if by else by_term(counts).join(known.hint("shuffle_hash"), "term")
    rows = met.select(*by, key, "term", x.alias("x"), "weight").groupBy(key, *by).agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
        F.collect_list(F.when(F.col("weight") > 0, F.struct("term", "x", F.array("weight").alias("weights")))).alias("weighed"))
    return rows.select(key, F.inline(heaviest_terms(F.col("weighed"), F.col("norm"), F.lit(0), k)))


# --- training --------------------------------------------------------------------------------


def class_weights(examples: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (k * n_c)."""
    per = examples.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    total = per.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(total, "_one").select(
        label, (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def folds(examples: DataFrame) -> DataFrame:
    """(fold, product_id, examples): one held-out product per fold."""
    return examples.groupBy("product_id").agg(F.count(F.lit(1)).alias("held_out")).select(
        F.concat(F.lit("holdout:"), F.col("product_id")).alias("fold"), "product_id", "held_out")


def unlearnable_classes(examples: DataFrame, label: str = "subcategory") -> DataFrame:
    """(product_id, class): holding the product out leaves no example of the class."""
    per = examples.groupBy(label).agg(F.count_distinct("product_id").alias("products"))
    return examples.select("product_id", label).distinct().join(per.where("products = 1"), label).select(
        "product_id", F.col(label).alias("class"))
