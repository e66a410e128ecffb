"""Three-valued applicability: what is known about a product decides which clauses govern it.

Facts of one product are folded into a small map (one entry per known condition), so scope and
clause decisions are column expressions over a row.  No decision multiplies rows or shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta import vocabulary as V

YES, NO, UNKNOWN = "yes", "no", "unknown"
APPLIES, DOES_NOT_APPLY, UNDETERMINED = "applies", "does_not_apply", "undetermined"

NO_CAVEAT_CLAUSES = "facts not declared are not established; rule 3 and rule 26 turn on such facts"


def latest_facts(declarations: DataFrame, conditions: DataFrame, with_id: bool = False) -> DataFrame:
    """One stated answer per (product, condition): the latest wins, of equal times the larger id; unknown codes are dropped.

    ``max`` over a struct is combined map-side, so a product stated millions of times costs one
    row per map task.
    """
    known = conditions.where("is_active").select("condition_code")
    newest = F.max(F.struct("updated_at", "declaration_id", "answer")).alias("last")
    return (
        declarations.join(known, "condition_code")
        .groupBy("product_id", "condition_code").agg(newest)
        .select("product_id", "condition_code", "last.answer", "last.updated_at", *["last.declaration_id"] * with_id)
    )


def fact_maps(facts: DataFrame) -> DataFrame:
    """(product_id, answers): at most one entry per condition of the framework."""
    pair = F.struct("condition_code", "answer")
    return facts.groupBy("product_id").agg(F.map_from_entries(F.collect_list(pair)).alias("answers"))


def answer(code: Column, determination: Column, category: Column, answers: Column, lineage: Column) -> Column:
    """YES, NO or UNKNOWN for one condition of one product.

    ``answers`` is the product's map (may be null); ``lineage`` its category codes (null or empty
    when no category is known).
    """
    stated = F.try_element_at(answers, code)
    known_category = F.coalesce(F.size(lineage) > 0, F.lit(False))
    return (
        F.when(determination == "not_determinable", F.lit(UNKNOWN))
        .when(stated.isNotNull(), stated)
        .when(
            (determination == "product_category") & category.isNotNull() & known_category,
            F.when(F.array_contains(lineage, category), F.lit(YES)).otherwise(F.lit(NO)),
        )
        .otherwise(F.lit(UNKNOWN))
    )


def clause_links(links: DataFrame, conditions: DataFrame) -> DataFrame:
    """(clause, links): the framework's links of each clause in order, with their condition."""
    full = links.join(conditions.select(
        "condition_code", "condition_name", "determination", F.col("category_code").alias("condition_category")
    ), "condition_code")
    entry = F.struct("link_order", "mode", "condition_code", "condition_name", "determination", "condition_category")
    return full.groupBy("clause").agg(F.array_sort(F.collect_list(entry)).alias("links"))


def answered(links: Column, answers: Column, lineage: Column) -> Column:
    return F.transform(
        links,
        lambda l: F.struct(
            l["mode"].alias("mode"), l["condition_code"].alias("condition_code"),
            l["condition_name"].alias("condition_name"), l["determination"].alias("determination"),
            answer(l["condition_code"], l["determination"], l["condition_category"], answers, lineage).alias("answer"),
        ),
    )


def _any(links: Column, mode: str, value: str | None = None) -> Column:
    test = lambda l: (l["mode"] == mode) if value is None else (l["mode"] == mode) & (l["answer"] == value)
    return F.coalesce(F.exists(links, test), F.lit(False))


def scope_gate(links: Column) -> Column:
    """Whether one scope clause takes the package out: a gate holds and no proviso withholds it.

    An unanswered gate does not bite, and an unanswered proviso does not block.
    """
    return _any(links, "scope_gate", YES) & ~_any(links, "withholds_exemption", YES)


def decide(links: Column) -> Column:
    """APPLIES, DOES_NOT_APPLY or UNDETERMINED for one clause from its answered links.

    Gates (unless a proviso withholds them), then exemptions, then triggers.  An unknown answer
    stops at its own step; nothing later may settle it.
    """
    gates = _any(links, "scope_gate")
    triggers = _any(links, "requires")
    return (
        F.when(gates & _any(links, "withholds_exemption", YES), F.lit(APPLIES))
        .when(gates & _any(links, "withholds_exemption", UNKNOWN), F.lit(UNDETERMINED))
        .when(_any(links, "scope_gate", YES), F.lit(DOES_NOT_APPLY))
        .when(_any(links, "scope_gate", UNKNOWN), F.lit(UNDETERMINED))
        .when(_any(links, "exempts", YES), F.lit(DOES_NOT_APPLY))
        .when(_any(links, "exempts", UNKNOWN), F.lit(UNDETERMINED))
        .when(_any(links, "requires", YES), F.lit(APPLIES))
        .when(_any(links, "requires", UNKNOWN), F.lit(UNDETERMINED))
        .when(triggers, F.lit(DOES_NOT_APPLY))
        .otherwise(F.lit(APPLIES))
    )


def blocking_mode(links: Column) -> Column:
    """The link mode whose unanswered conditions stopped ``decide``; null when nothing did."""
    gates = _any(links, "scope_gate")
    return F.when(
        decide(links) == UNDETERMINED,
        F.when(gates & _any(links, "withholds_exemption", UNKNOWN), F.lit("withholds_exemption"))
        .when(_any(links, "scope_gate", UNKNOWN), F.lit("scope_gate"))
        .when(_any(links, "exempts", UNKNOWN), F.lit("exempts"))
        .otherwise(F.lit("requires")),
    )


def unresolved_codes(links: Column) -> Column:
    """Sorted condition codes that left the clause undetermined."""
    mode = blocking_mode(links)
    open_links = F.filter(links, lambda l: (l["answer"] == UNKNOWN) & (l["mode"] == mode))
    return F.array_sort(F.transform(open_links, lambda l: l["condition_code"]))


def deciding_link(links: Column) -> Column:
    """Name of the first holding condition that settled the clause, in link order."""
    pick = lambda mode: F.try_element_at(F.filter(links, lambda l: (l["mode"] == mode) & (l["answer"] == YES)), F.lit(1))
    outcome = decide(links)
    gates = _any(links, "scope_gate")
    return (
        F.when(gates & _any(links, "withholds_exemption", YES), pick("withholds_exemption")["condition_name"])
        .when((outcome == DOES_NOT_APPLY) & _any(links, "scope_gate", YES), pick("scope_gate")["condition_name"])
        .when((outcome == DOES_NOT_APPLY) & _any(links, "exempts", YES), pick("exempts")["condition_name"])
        .when((outcome == APPLIES) & _any(links, "requires", YES), pick("requires")["condition_name"])
    )


def undeterminable_names(links: Column) -> Column:
    """Sorted names of linked conditions the framework says cannot be established at all."""
    closed = F.filter(links, lambda l: l["determination"] == "not_determinable")
    return F.array_sort(F.transform(closed, lambda l: l["condition_name"]))


def applicability_note(clause: Column, links: Column, decision: Column) -> Column:
    """Why the rule was applied or not, what cannot be established, and the scope caveat."""
    names = F.array_join(unresolved_codes(links), ", ")
    who = deciding_link(links)
    reason = (
        F.when(clause.isNull(), F.lit("rule is not mapped to a clause"))
        .when(decision == UNDETERMINED, F.concat(F.lit("clause "), clause, F.lit(" undetermined: "), names))
        .when(who.isNotNull(), F.concat(F.lit("clause "), clause, F.lit(" "), decision, F.lit(": "), who))
        .otherwise(F.concat(F.lit("clause "), clause, F.lit(" "), decision))
    )
    closed = undeterminable_names(links)
    cannot = F.when(
        F.size(closed) > 0, F.concat(F.lit("cannot be established: "), F.array_join(closed, ", "))
    )
    return F.array_join(F.array_compact(F.array(reason, cannot, F.lit(NO_CAVEAT_CLAUSES))), "\n\n")


def lineage_arrays(lineage: DataFrame) -> DataFrame:
    """(category_code, lineage[]): the category and its ancestors, nearest first."""
    ordered = F.array_sort(F.collect_list(F.struct("depth", "ancestor_code")))
    return lineage.groupBy("category_code").agg(F.transform(ordered, lambda x: x["ancestor_code"]).alias("lineage"))


def product_answers(products: DataFrame, facts: DataFrame, lineage: DataFrame) -> DataFrame:
    """Products with ``answers`` (map) and ``lineage`` (category codes, nearest first)."""
    return products.join(lineage_arrays(lineage), "category_code", "left").join(fact_maps(facts), "product_id", "left")


def per_category(lineage: DataFrame, content: DataFrame) -> DataFrame:
    """Attach the one row of ``content`` to every category and to the "no category" key ''.

    Both sides are framework tables.  Data rows then meet the result by an equi-join on their
    category key, which Spark broadcasts when it is small and otherwise shuffles and splits.
    """
    spark = lineage.sparkSession
    keys = lineage.select(F.col("category_code").alias("category_key")).distinct().unionByName(
        spark.sql("SELECT '' AS category_key")
    )
    return keys.withColumn("_one", F.lit(1)).join(content.withColumn("_one", F.lit(1)), "_one").drop("_one")


def category_key() -> Column:
    """The key of ``per_category`` for a row of ``product_answers``."""
    return F.when(F.col("lineage").isNotNull(), F.col("category_code")).otherwise(F.lit(""))


def gate_rows(links: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row: the links of the scope clauses."""
    per_clause = clause_links(links, conditions).where(F.col("clause").isin(*V.SCOPE_CLAUSES))
    return per_clause.agg(F.collect_list(F.struct("clause", "links")).alias("gates"))


def scope(gates: Column, answers: Column, lineage: Column) -> Column:
    """DOES_NOT_APPLY when any scope clause takes the product out."""
    out = F.exists(gates, lambda g: scope_gate(answered(g["links"], answers, lineage)))
    return F.when(F.coalesce(out, F.lit(False)), F.lit(DOES_NOT_APPLY)).otherwise(F.lit(APPLIES))


def scope_decisions(products: DataFrame, lineage: DataFrame, links: DataFrame, conditions: DataFrame) -> DataFrame:
    """(product_id, scope) for rows of ``product_answers``."""
    gates = per_category(lineage, gate_rows(links, conditions))
    return products.withColumn("category_key", category_key()).join(gates, "category_key").select(
        "product_id", scope(F.col("gates"), F.col("answers"), F.col("lineage")).alias("scope")
    )


def condition_answers(products: DataFrame, lineage: DataFrame, conditions: DataFrame) -> DataFrame:
    """(product_id, condition_code, answer) over the whole condition list."""
    entry = F.struct("condition_code", "determination", F.col("category_code").alias("category"))
    wanted = per_category(lineage, conditions.agg(F.collect_list(entry).alias("conditions")))
    rows = products.withColumn("category_key", category_key()).join(wanted, "category_key").select(
        "product_id", "answers", "lineage", F.explode("conditions").alias("c")
    )
    return rows.select(
        "product_id", F.col("c.condition_code").alias("condition_code"),
        answer(F.col("c.condition_code"), F.col("c.determination"), F.col("c.category"), F.col("answers"),
               F.col("lineage")).alias("answer"),
    )


def clause_decisions(products: DataFrame, lineage: DataFrame, links: DataFrame, conditions: DataFrame) -> DataFrame:
    """(product_id, clause, decision, unresolved, note) for every linked clause."""
    table = clause_links(links, conditions).agg(F.collect_list(F.struct("clause", "links")).alias("clauses"))
    rows = products.withColumn("category_key", category_key()).join(
        per_category(lineage, table), "category_key"
    ).select("product_id", "answers", "lineage", F.explode("clauses").alias("c"))
    rows = rows.select("product_id", F.col("c.clause").alias("clause"),
                       answered(F.col("c.links"), F.col("answers"), F.col("lineage")).alias("links"))
    rows = rows.withColumn("decision", decide(F.col("links")))
    return rows.select(
        "product_id", "clause", "decision",
        F.when(F.col("decision") == UNDETERMINED, unresolved_codes(F.col("links"))).alias("unresolved"),
        applicability_note(F.col("clause"), F.col("links"), F.col("decision")).alias("note"),
    )
