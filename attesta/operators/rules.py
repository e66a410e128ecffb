"""Rules as data: validity windows, category targets and the candidate rules of a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVERY_CATEGORY = "*"


def in_force(effective_from: Column, effective_to: Column, on: Column) -> Column:
    """Both ends inclusive; an open end never excludes."""
    return F.coalesce(on >= effective_from, F.lit(True)) & F.coalesce(on <= effective_to, F.lit(True))


def ancestry(categories: DataFrame) -> DataFrame:
    """(category_code, ancestor_code, depth): every category with itself and all its ancestors.

    A visited list keeps a cyclic parent chain from looping.
    """
    spark = categories.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE chain(category_code, ancestor_code, parent_code, depth, visited) AS (
          SELECT category_code, category_code, parent_code, 0, array(category_code) FROM {categories}
          UNION ALL
          SELECT chain.category_code, up.category_code, up.parent_code, chain.depth + 1,
                 array_append(chain.visited, up.category_code)
          FROM chain JOIN {categories} up ON up.category_code = chain.parent_code
          WHERE NOT array_contains(chain.visited, up.category_code)
        )
        SELECT category_code, ancestor_code, depth FROM chain
        """,
        categories=categories,
    )


def rule_targets(rules: DataFrame) -> DataFrame:
    """(rule_code, target): one row per targeted category; an untargeted rule targets everything."""
    targets = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(EVERY_CATEGORY)))
    return rules.select("rule_code", F.explode(targets).alias("target"))


def category_rules(rules: DataFrame, lineage: DataFrame, on) -> DataFrame:
    """(category_code, rule_code): active rules in force on ``on`` that reach the category.

    An equi-join on the ancestor code, with every category also standing under ``*``; a rule that
    matches through several ancestors still counts once.
    """
    live = rules.where("is_active").where(in_force(F.col("effective_from"), F.col("effective_to"), F.lit(on)))
    reach = lineage.select("category_code", F.col("ancestor_code").alias("target")).unionByName(
        lineage.select("category_code", F.lit(EVERY_CATEGORY).alias("target")).distinct()
    )
    return reach.join(rule_targets(live), "target").select("category_code", "rule_code").distinct()


def candidate_rules(products: DataFrame, rules: DataFrame, lineage: DataFrame, on) -> DataFrame:
    """(product_id, rule_code).  A product without a category has no candidates."""
    return products.join(category_rules(rules, lineage, on), "category_code").select("product_id", "rule_code")


def rule_context(rules: DataFrame, requirements: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rule with its clause's detection method and the citation of the instrument behind it."""
    return (
        rules.join(requirements, "clause", "left").join(instruments, "source", "left")
        .withColumn("detection_method", F.coalesce("detection_method", F.lit("")))
        .withColumn("citation", F.coalesce("citation", F.lit("")))
    )


def current_requirements(requirements: DataFrame, on) -> DataFrame:
    """The version of each clause in force on a date; the highest version wins where two overlap."""
    live = requirements.where(in_force(F.col("effective_from"), F.col("effective_to"), F.lit(on)))
    return live.groupBy("clause").agg(
        F.max("version").alias("version"), F.count(F.lit(1)).alias("versions_in_force")
    )


def overlapping_versions(requirements: DataFrame) -> DataFrame:
    """(clause, version, effective_from, open_version, open_until): versions that begin while an earlier one of their clause is still open.

    One sweep over each clause's versions in the order of their begin, which knows the version open longest so far; versions need no
    consecutive numbers.  ``open_until`` null: never closed.  A missing begin is as far back as the data go.
    """
    from pyspark.sql import Window

    never = F.lit("9999-12-31").cast("date")
    order = Window.partitionBy("clause").orderBy(F.asc_nulls_first("effective_from"), "version").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.max(F.struct(F.coalesce("effective_to", never).alias("until"), F.col("version").alias("version"))).over(order)
    return requirements.withColumn("_open", open_).where(
        F.col("_open").isNotNull() & (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("_open.until")))
    ).select("clause", "version", "effective_from", F.col("_open.version").alias("open_version"),
             F.when(F.col("_open.until") != never, F.col("_open.until")).alias("open_until"))


def version_chains(requirements: DataFrame, key: str = "requirement_id", supersedes: str = "supersedes") -> DataFrame:
    """(key, root, depth, cyclic): where each version's chain of ``supersedes`` begins and how many steps back that is.

    Pointer doubling: after k rounds each row knows its ancestor 2^k steps back, so a chain of a million versions takes twenty joins.
    A row whose chain never ends leads into a cycle: no root, no depth, ``cyclic`` true.  A reference to a version that does not exist ends
    the chain there.  Repeated keys count once, by their smallest reference; null keys have no row.
    """
    from attesta.session import Written

    keep = Written(requirements.sparkSession)
    rows = requirements.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(supersedes).alias("to"))
    known = rows.select(F.col("id").alias("_k"))
    now = rows.join(known, F.col("to") == F.col("_k"), "left").select(
        "id", F.coalesce("_k", "id").alias("to"), F.col("_k").isNull().alias("ended"), F.when(F.col("_k").isNotNull(), 1).otherwise(0).cast("long").alias("depth"))
    now = keep(now, "chains")
    left, total, reach = now.where("NOT ended").count(), now.count(), 1
    while left and reach <= total:
        up = now.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("ended").alias("_ended"), F.col("depth").alias("_depth"))
        going = now.where("NOT ended").join(up, F.col("to") == F.col("_i")).select(
            "id", F.col("_to").alias("to"), F.col("_ended").alias("ended"), (F.col("depth") + F.col("_depth")).alias("depth"))
        now = keep(going.union(now.where("ended")), "chains")
        keep.keep_last("chains", 2)
        left, reach = now.where("NOT ended").count(), 2 * reach
    return now.select(F.col("id").alias(key), F.when(F.col("ended"), F.col("to")).alias("root"), F.when(F.col("ended"), F.col("depth")).alias("depth"), (~F.col("ended")).alias("cyclic"))


def chain_heads(chains: DataFrame, key: str = "requirement_id") -> DataFrame:
    """(root, head, length, forked): the newest version of each chain; of two at the same depth the larger key, and ``forked`` says so."""
    ended = chains.where("NOT cyclic")
    depth = ended.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"))
    return depth.groupBy("root").agg(
        F.max(F.struct("depth", "last")).alias("_m"), (F.max("n") > 1).alias("forked")).select("root", F.col("_m.last").alias("head"), (F.col("_m.depth") + 1).alias("length"), "forked")
