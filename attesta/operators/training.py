"""Linear text models fitted by the table: many folds and configurations at once, no vocabulary on the driver.

A *model* is one (configuration, held-out group).  Texts are tokenised and counted once; terms get dense slots from a sorted
index built by range partitions and prefix counts.  What a fold leaves out is subtracted: its document frequencies, class
counts and sizes are the totals less those of its own group.  Features are rows (model, example, slot, x), coefficients rows
(model, slot, one column a class) - both tables, joined on their keys.

Texts of the same words, label and group are one weighted row: it counts as often as it occurs in sizes, document frequencies, the loss and
its gradient, so steps grow with the different texts and not with their copies.

All models take each step together: one join and aggregation for the scores along the search direction, a line search from
per-model sums, and one join and aggregation for the gradient by (model, slot), combined map-side.  Directions are
conjugate gradients (Polak-Ribiere, restarted where they don't descend), whose only global numbers are a few sums per model.  The
objective is the usual one: C times the class-weighted log loss plus half the squared coefficients, intercepts free; where a model
sees two classes, the softmax's penalty is doubled, which equals one sigmoid.  The driver reads one row per step to know when to
stop.  Feature rows lie by (model, example), so the gradient join does not move them; the other join is skew-split by adaptive
execution where one term is in most texts.  They lie in as many partitions as their number asks for: a fit over few different texts takes
few tasks a step, however many partitions the session has for its larger tables.  Tables of a row an example are joined by a shuffle
(``_PER_EXAMPLE``): their files are small enough to pass for broadcast tables, and the driver would have to hold their rows.  Decisions are
made once a different text and then go to its copies: where the different texts are measured to be at most ``FEW_BYTES`` they go as a
broadcast table and the copies stay where they are, else both meet by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from attesta.functions import text as T
from attesta.operators import classify as M
from attesta.session import Written

INTERCEPT = -1
MAX_STEPS, TOLERANCE = 60, 1e-4
FEATURES_A_TASK, FEW_BYTES = 50_000, 4 << 20
_PER_EXAMPLE = "shuffle_hash"


@dataclass(frozen=True)
class Configuration:
    """One way to turn texts into features and to fit them."""

    name: str = "default"
    c: float = 1.0
    sublinear: bool = False
    min_df: int = 2
    high: int = 2


def numbered(df: DataFrame, column: str, number: str, keep: Written) -> DataFrame:
    """Distinct values of ``column`` with dense numbers in their order: ranges sorted apart, then offset by prefix counts.

    Only the number of rows of each range (one row a partition) meets in one place.
    """
    from pyspark.sql import Window

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    spread = keep(spread.withColumn("_at", F.monotonically_increasing_id()), f"index-{number}")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return keep(spread.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        column, (F.col("_before") + row).cast("long").alias(number)), f"numbers-{number}")


class Fit:
    """Models of all configurations and folds over one table of examples.

    ``examples``: key, text, label, and the fold's group column if there are folds; more columns don't matter.  Texts of fewer than three words
    are not learnt from, but they are scored where they are held out.  A class that a fold leaves no example of has no part in
    its model.  Labels are the driver's: they are the taxonomy's, a few; groups are numbered by the index and never collected.
    """

    def __init__(self, examples: DataFrame, label: str, configurations: Sequence[Configuration] = (Configuration(),), group: str | None = None,
                 key: str = "doc_id", text: str = "text"):
        self.key, self.label, self.group, self.configurations = key, label, group, tuple(configurations)
        self.spark, self.keep = examples.sparkSession, Written(examples.sparkSession)
        self.steps = 0
        per = len(self.configurations)
        cleaned = T.preprocess_text(F.col(text))
        rows = examples.select(
            F.col(key).alias("_key"), F.col(label).alias("_label"), (F.col(group) if group else F.lit(None).cast("string")).alias("_group"),
            T.feature_tokens(cleaned).alias("_tokens"))
        self.given = self.keep(rows, "given")
        rows = self.given.groupBy("_label", "_group", "_tokens").agg(F.count(F.lit(1)).alias("copies")).withColumn("_words", F.size("_tokens"))
        self.texts = rows = self.keep(rows.withColumn("_e", F.monotonically_increasing_id()), "examples")
        row_bytes = F.octet_length(F.concat_ws("", "_tokens", "_label", "_group")) + 16 * F.col("_words") + 200
        self.few = per * (rows.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= FEW_BYTES
        self.classes = [r[0] for r in rows.where(F.col("_label").isNotNull()).select("_label").distinct().orderBy("_label").collect()]
        y = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("_label")) - 1 if self.classes else F.lit(0)
        ok = (F.col("_words") >= M.MIN_TOKENS) & F.col("_label").isNotNull()
        if group:
            folds = numbered(rows.where("_group IS NOT NULL"), "_group", "fold", self.keep)
            docs = rows.join(folds, "_group", "left")
            n_folds = folds.count()
        else:
            docs, n_folds = rows.withColumn("fold", F.lit(None).cast("long")), 1
        self.docs = self.keep(docs.select("_e", "copies", "_label", "_group", "fold", F.coalesce(y, F.lit(-1)).cast("int").alias("y"), ok.alias("ok")), "docs")
        self.models = n_folds * per
        every = F.explode(F.sequence(F.lit(0), F.lit(max(0, self.models - 1)))).alias("model")
        of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("model") % per).cast("int"))
        held_fold = F.floor(F.col("model") / per)
        most = max((c.high for c in self.configurations), default=2)
        # sizes and class counts of each model, by subtraction
        counted = [F.coalesce(F.sum(F.when(F.col("ok") & (F.col("y") == c), F.col("copies"))), F.lit(0)).alias(f"n{c}") for c in range(len(self.classes))]
        total = self.docs.agg(*counted)
        own = self.docs.where("fold IS NOT NULL").groupBy("fold").agg(*counted, F.sum("copies").alias("held_out"))
        left = lambda c: (F.col(f"t.n{c}") - F.coalesce(F.col(f"o.n{c}"), F.lit(0)))
        sums = lambda xs: sum(xs, F.lit(0))
        models = total.select("*", every).withColumn("fold", held_fold).alias("t").join(own.alias("o"), F.col("t.fold") == F.col("o.fold"), "left")
        models = models.select(
            "model", F.col("t.fold").alias("fold"), of([c.name for c in self.configurations], "string").alias("configuration"),
            *[left(c).alias(f"n{c}") for c in range(len(self.classes))], F.coalesce("held_out", F.lit(0)).alias("held_out"))
        present = sums((F.col(f"n{c}") > 0).cast("int") for c in range(len(self.classes)))
        self.model_table = self.keep(models.withColumn("n", sums(F.col(f"n{c}") for c in range(len(self.classes)))).withColumn("present", present).withColumn(
            "penalty", F.when(F.col("present") == 2, 2.0).otherwise(1.0) / of([c.c for c in self.configurations], "double")), "models")
        # terms of all examples, counted once
        grams = rows.select("_e", F.explode(T.ngrams(F.col("_tokens"), 1, most)).alias("term")).groupBy("_e", "term").agg(F.count(F.lit(1)).alias("tf"))
        grams = self.keep(grams, "grams")
        self.terms = numbered(grams, "term", "slot", self.keep)
        counts = grams.join(self.terms, "term").join(self.docs.select("_e", "copies", "fold", "ok").hint(_PER_EXAMPLE), "_e").select(
            "_e", "copies", "slot", "tf", "fold", "ok", F.size(F.split("term", " ")).alias("words"))
        counts = self.keep(counts, "counts")
        df = counts.where("ok").groupBy("slot", "words").agg(F.sum("copies").alias("df"))
        own_df = counts.where("ok AND fold IS NOT NULL").groupBy("slot", "fold").agg(F.sum("copies").alias("own"))
        vocabulary = df.select("slot", "words", "df", every).withColumn("fold", held_fold).join(own_df, ["slot", "fold"], "left").join(
            self.model_table.select("model", "n"), "model").withColumn("seen", F.col("df") - F.coalesce("own", F.lit(0)))
        vocabulary = vocabulary.where((F.col("seen") >= of([c.min_df for c in self.configurations], "int")) & (F.col("words") <= of([c.high for c in self.configurations], "int")))
        self.vocabulary = self.keep(vocabulary.select("model", "slot", (F.log((1 + F.col("n")) / (1 + F.col("seen"))) + 1).alias("idf")), "vocabulary")
        # feature rows: an example is learnt from by every model but those that hold it out, which score it
        tf = F.when(of([c.sublinear for c in self.configurations], "boolean"), 1 + F.log("tf")).otherwise(F.col("tf"))
        held = F.coalesce(F.col("fold") == held_fold, F.lit(False))
        rows = counts.select("_e", "slot", "tf", "fold", "ok", every).withColumn("held", held).where("ok OR held")
        rows = rows.join(self.vocabulary, ["model", "slot"]).select("model", "_e", "slot", (tf * F.col("idf")).alias("x"), "held")
        self.features = self.keep(rows, "features")
        norms = self.features.groupBy("model", "_e").agg(F.count(F.lit(1)).alias("known"), (1 / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("inverse"))
        each = self.docs.select("_e", "copies", "y", "fold", "ok", every).withColumn("held", held).where("ok OR held").drop("fold", "ok")
        weight = lambda c: F.col("n") / (F.col("present") * F.col(f"n{c}"))
        chosen = F.lit(0.0)
        for c in range(len(self.classes)):
            chosen = F.when(F.col("y") == c, F.when(F.col(f"n{c}") > 0, weight(c)).otherwise(0.0)).otherwise(chosen)
        each = each.join(norms.hint(_PER_EXAMPLE), ["model", "_e"], "left").join(self.model_table, "model").select(
            "model", "_e", "y", "held", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("inverse", F.lit(0.0)).alias("inverse"), (chosen * F.col("copies")).alias("weight"),
            *[(F.col(f"n{c}") > 0).alias(f"in{c}") for c in range(len(self.classes))])
        self.examples = self.keep(each, "rows")
        for name in ("grams", "counts"):
            self.keep.keep_last(name, 0)

    # --- steps ---------------------------------------------------------------------------------

    def _cols(self, *names: str) -> list[str]:
        return [f"{n}{c}" for n in names for c in range(len(self.classes))]

    def _each(self, text: str) -> list[str]:
        """``text`` for every class, ``#`` standing for its number."""
        return [text.replace("#", str(c)) for c in range(len(self.classes))]

    def _sum(self, text: str) -> str:
        return "(" + " + ".join(self._each(text)) + ")"

    def _softmax(self, rows: DataFrame, score: str) -> DataFrame:
        """Adds p0.., the softmax of ``score`` over the classes that the model knows."""
        top = f"greatest({', '.join(self._each(f'CASE WHEN in# THEN {score} END'))}, -1e300)"
        rows = rows.selectExpr("*", f"{top} AS _top").selectExpr("*", *self._each(f"CASE WHEN in# THEN exp({score} - _top) ELSE 0D END AS _e#"))
        return rows.selectExpr("*", f"{self._sum('_e#')} AS _all").selectExpr("*", *self._each("_e# / _all AS p#"))

    def _scores(self, features: DataFrame, rows: DataFrame, parameters: DataFrame, source: str, out: str) -> DataFrame:
        """``rows`` with the columns out0.. of x.w + b, from the parameter columns source0.. ."""
        sums = features.join(parameters.where(f"slot <> {INTERCEPT}").select("model", "slot", *self._cols(source)), ["model", "slot"]).groupBy("model", "_e").agg(
            *[F.expr(x) for x in self._each(f"sum(x * {source}#) AS _s#")])
        bias = parameters.where(f"slot = {INTERCEPT}").selectExpr("model", *self._each(f"{source}# AS _b#"))
        return rows.join(sums.hint(_PER_EXAMPLE), ["model", "_e"], "left").join(bias, "model").selectExpr(
            *[f"`{c}`" for c in rows.columns], *self._each(f"coalesce(_s#, 0D) * inverse + _b# AS {out}#"))

    def _gradient(self, rows: DataFrame, features: DataFrame) -> DataFrame:
        """(model, slot, r0..): sums of residual times feature at the scores m0.., intercepts with them."""
        residual = self._softmax(rows, "m#").selectExpr("model", "_e", "inverse", *self._each("weight * (p# - IF(y = #, 1D, 0D)) AS r#"))
        scaled = residual.selectExpr("model", "_e", *self._each("r# * inverse AS r#"))
        of_terms = features.join(scaled.hint(_PER_EXAMPLE), ["model", "_e"]).groupBy("model", "slot").agg(*[F.expr(x) for x in self._each("sum(x * r#) AS r#")])
        of_bias = residual.groupBy("model").agg(*[F.expr(x) for x in self._each("sum(r#) AS r#")]).selectExpr("model", f"{INTERCEPT}L AS slot", *self._cols("r"))
        return of_terms.union(of_bias)

    def _laid_out(self) -> DataFrame:
        """The feature rows that are learnt from, by (model, example)."""
        parts = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + self.features.count() // FEATURES_A_TASK)
        return self.features.where("NOT held").drop("held").repartition(parts, "model", "_e")

    def run(self, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Fit:
        """Fit all models until every gradient is below ``tolerance`` a row of training data, or ``max_steps`` are done."""
        keep, penalty = self.keep, self.model_table.select("model", "penalty", "n")
        features = self._laid_out().persist(StorageLevel.MEMORY_AND_DISK)
        rows = self.examples.where("NOT held").selectExpr("model", "_e", "y", "weight", "inverse", *self._cols("in"), *self._each("0D AS m#"), "0D AS a")
        bias = self.model_table.selectExpr("model", f"{INTERCEPT}L AS slot")
        zeros = [x for n in ("w", "g", "d") for x in self._each(f"0D AS {n}#")]
        parameters = self.vocabulary.select("model", "slot").union(bias).selectExpr("model", "slot", *zeros)
        decay = f"IF(slot = {INTERCEPT}, 0D, penalty)"
        carried = ["model", "_e", "y", "weight", "inverse", *self._cols("in")]
        try:
            while True:
                # the gradient where the rows' scores stand now
                new = parameters.join(self._gradient(rows, features), ["model", "slot"], "left").join(penalty, "model")
                new = keep(new.selectExpr("model", "slot", *self._cols("w", "d"), *self._each("g# AS o#"), *self._each(f"coalesce(r#, 0D) + {decay} * w# AS g#")), "gradients")
                sums = new.groupBy("model").agg(*[F.expr(x) for x in (
                    f"sum({self._sum('g# * g#')}) AS gg", f"sum({self._sum('g# * o#')}) AS go", f"sum({self._sum('o# * o#')}) AS oo", f"sum({self._sum('g# * d#')}) AS gd",
                    f"max(greatest({', '.join(self._each('abs(g#)'))}, 0D)) AS worst")])
                far = sums.join(penalty, "model").where(F.col("worst") > tolerance * F.greatest("n", F.lit(1))).limit(1).count()
                if not far or self.steps >= max_steps:
                    self.parameters = keep(new.select("model", "slot", *self._cols("w")), "parameters")
                    return self
                # the next direction, restarted where it would not descend
                self.steps += 1
                beta = sums.selectExpr("model", "greatest(0D, coalesce(try_divide(gg - go, oo), 0D)) AS beta", "gg", "gd").selectExpr(
                    "model", "IF(beta * gd < gg, beta, 0D) AS beta")
                directions = keep(new.join(beta, "model").selectExpr("model", "slot", *self._cols("w", "g"), *self._each("beta * d# - g# AS d#")), "directions")
                # scores along the direction, and how far to go
                moved = keep(self._scores(features, rows, directions, "d", "z"), "moved")
                length = self._length(moved, directions.join(penalty, "model"))
                rows = moved.drop("a").join(length, "model").selectExpr(*carried, *self._each("m# + a * z# AS m#"), "a")
                parameters = directions.join(length, "model").selectExpr("model", "slot", *self._each("w# + a * d# AS w#"), *self._cols("g", "d"))
                for name in ("gradients", "directions", "moved"):
                    keep.keep_last(name, 2)
        finally:
            features.unpersist()

    def _length(self, moved: DataFrame, directions: DataFrame) -> DataFrame:
        """(model, a): a Newton step from the last length along the new direction, no shorter than the step that is sure to descend.

        The curvature of the log loss along z is at most half the squared length of z, which gives the sure step.
        """
        rows = self._softmax(moved, "(m# + a * z#)").selectExpr(
            "model", "a", "weight", f"{self._sum('p# * z#')} AS mean", f"{self._sum('p# * z# * z#')} AS square", f"{self._sum('IF(y = #, z#, 0D)')} AS truth",
            f"{self._sum('z# * z#')} AS whole")
        loss = rows.groupBy("model").agg(
            F.max("a").alias("at"), F.expr("sum(weight * (mean - truth)) AS s1"), F.expr("sum(weight * (square - mean * mean)) AS s2"), F.expr("sum(weight * whole) / 2 AS s3"))
        still = directions.groupBy("model").agg(
            F.expr(f"sum({self._sum('g# * d#')}) AS slope"), F.expr(f"sum(IF(slot = {INTERCEPT}, 0D, penalty * {self._sum('w# * d#')})) AS wd"),
            F.expr(f"sum(IF(slot = {INTERCEPT}, 0D, penalty * {self._sum('d# * d#')})) AS dd"))
        return loss.join(still, "model").selectExpr(
            "model", "greatest(coalesce(try_divide(-slope, s3 + dd), 0D), at - coalesce(try_divide(s1 + wd + at * dd, s2 + dd), 0D)) AS a")

    # --- results -------------------------------------------------------------------------------

    def coefficients(self) -> DataFrame:
        """(model, configuration, fold, term, idf, weights): the fitted vocabulary; intercepts are in ``intercepts``."""
        named = self.parameters.where(f"slot <> {INTERCEPT}").join(self.vocabulary, ["model", "slot"]).join(self.terms, "slot")
        return named.join(self.model_table.select("model", "configuration", "fold"), "model").select(
            "model", "configuration", "fold", "term", "idf", F.array(*self._cols("w")).alias("weights"))

    def intercepts(self) -> DataFrame:
        return self.parameters.where(f"slot = {INTERCEPT}").select("model", F.array(*self._cols("w")).alias("intercepts"))

    def held_out(self) -> DataFrame:
        """(configuration, group, key, label, known_terms, scores[]): every example scored by the models that have not seen it.

        Scores of classes that a model does not know are null.
        """
        return self.each_copy(self.held_out_texts()).select(
            "configuration", F.col("_group").alias(self.group or "group"), F.col("_key").alias(self.key), F.col("_label").alias(self.label), "known_terms", "scores")

    def held_out_texts(self) -> DataFrame:
        """(configuration, _label, _group, _tokens, known_terms, scores, tokens): each different held-out text once, ``tokens`` being its number of words."""
        rows = self.examples.where("held").select("model", "_e", "known", "inverse", *self._cols("in"))
        scored = self._scores(self.features.where("held").drop("held"), rows, self.parameters, "w", "s")
        scores = F.array(*[F.when(F.col(f"in{c}"), F.col(f"s{c}")) for c in range(len(self.classes))])
        texts = self.texts.select("_e", "_label", "_group", "_tokens", "_words").hint(_PER_EXAMPLE)
        return scored.join(texts, "_e").join(self.model_table.select("model", "configuration"), "model").select(
            "configuration", "_label", "_group", "_tokens", F.col("known").alias("known_terms"), scores.alias("scores"), F.col("_words").alias("tokens"))

    def each_copy(self, texts: DataFrame) -> DataFrame:
        """Rows of different texts (`held_out_texts` and what is derived from it) for every given row of that text, with its ``_key``."""
        same = ["_label", "_group", "_tokens"]
        given = self.given.select("_key", *[F.col(c).alias(f"{c}_given") for c in same])
        return given.join(texts.hint("broadcast" if self.few else _PER_EXAMPLE), [F.col(f"{c}_given").eqNullSafe(F.col(c)) for c in same]).drop(*[f"{c}_given" for c in same])

    def folds(self) -> DataFrame:
        """(configuration, group, n_train, n_held_out, classes_in_training, held_out_classes_absent_from_training) of each model."""
        names = F.array(*[F.when(F.col(f"n{c}") > 0, F.lit(name)) for c, name in enumerate(self.classes)])
        held = self.docs.where("fold IS NOT NULL").groupBy("fold", "_group").agg(F.collect_set("_label").alias("_mine"))  # at most the labels
        return self.model_table.join(held, "fold").select(
            "configuration", F.col("_group").alias(self.group or "group"), F.col("n").alias("n_train"), F.col("held_out").alias("n_held_out"),
            F.array_compact(names).alias("classes_in_training"),
            F.array_sort(F.array_except("_mine", F.array_compact(names))).alias("held_out_classes_absent_from_training"))


def train(examples: DataFrame, label: str, configuration: Configuration = Configuration(), key: str = "doc_id", text: str = "text",
          max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[list[str], DataFrame, list[float]]:
    """(classes, (term, idf, weights) table, intercepts) of one balanced logistic regression over all examples."""
    fit = Fit(examples, label, [configuration], None, key, text)
    if len(fit.classes) < 2:
        raise ValueError(f"training needs at least two classes, got {fit.classes}")
    fit.run(max_steps, tolerance)
    return fit.classes, fit.coefficients().select("term", "idf", "weights"), list(fit.intercepts().first().intercepts)


def cross_validate(examples: DataFrame, label: str = "subcategory", group: str = "product_id", configurations: Sequence[Configuration] = (Configuration(),),
                   key: str = "doc_id", text: str = "text", max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(held-out decisions, fold notes) of leaving each group out once, for every configuration, all models fitted together.

    Decisions: configuration, group, key, truth, category, subcategory, confidence, subcategory_confidence, reason.  Examples without a
    group are learnt from by all models and held out by none.  A repeated key is one example a row.
    """
    fit = Fit(examples, label, configurations, group, key, text).run(max_steps, tolerance)
    rows = fit.held_out_texts().withColumn("scores", F.transform("scores", lambda s: F.coalesce(s, F.lit(-1e9))))
    decided = M.decided(rows.withColumn("scores", F.when(F.col("known_terms") > 0, F.col("scores"))), fit.classes, "configuration", "_label", "_group", "_tokens")
    decided = fit.each_copy(decided).select(
        "configuration", F.col("_group").alias(group), F.col("_key").alias(key), F.col("_label").alias("truth"), "category", "subcategory", "confidence", "subcategory_confidence", "reason")
    return decided, fit.folds()
