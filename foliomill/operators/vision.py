"""Entities and relations of vision answers as sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How a relation between two entities reads (the words between them, the words behind the second).
RELATIONS = {
    "left_of": ("is positioned to the left of the", ""), "right_of": ("is positioned to the right of the", ""), "above": ("is positioned above the", ""),
    "below": ("is positioned below the", ""), "inside": ("is located within the", ""), "contains": ("contains the", ""), "on": ("is on the", ""),
    "under": ("is under the", ""), "behind": ("is behind the", ""), "in_front_of": ("is in front of the", ""), "next_to": ("is next to the", ""),
    "adjacent_to": ("is adjacent to the", ""), "intersects": ("intersects the", ""), "part_of": ("is a component of the", ""), "has_part": ("has the", " as a part"),
    "composed_of": ("is composed of the", ""), "describes": ("describes the entity", ""), "references": ("refers to the entity", ""),
    "links_to": ("is connected to the", " in a flow"), "has_attribute": ("has the attribute", ""), "defines": ("defines the concept of", ""), "is_a": ("is a", ""),
    "used_for": ("is used for", ""), "similar_to": ("is similar to the", ""), "holding": ("is holding the", ""), "wearing": ("is wearing the", ""),
    "riding": ("is riding the", ""), "under_condition_of": ("exists under the condition of", ""),
}
# Fixed value: the answer without any statement.
NOTHING = "No meaningful information was extracted from the image."


def latest(answers: DataFrame) -> DataFrame:
    """Of repeated answers (vision_id) the one asked last; ties: the longest answer."""
    w = Window.partitionBy("vision_id").orderBy(F.col("asked_at").desc_nulls_last(), F.length("answer").desc_nulls_last(), F.col("answer"))
    return answers.where("vision_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def entities(answers: DataFrame) -> DataFrame:
    """``vision_id, name, description, first_pos``: one row per name, its last description, in order of first mention."""
    rows = answers.select("vision_id", F.posexplode("entities").alias("pos", "e")).select("vision_id", "pos", "e.name", "e.description").where("name IS NOT NULL")
    return rows.groupBy("vision_id", "name").agg(F.max_by("description", "pos").alias("description"), F.min("pos").alias("first_pos"))


def relations(answers: DataFrame) -> DataFrame:
    """``vision_id, pos, subject, predicate, object``: relations whose both ends are known entities of the answer."""
    rows = answers.select("vision_id", F.posexplode("relations").alias("pos", "r")).select("vision_id", "pos", "r.subject", "r.predicate", "r.object")
    names = entities(answers).select("vision_id", "name")
    return rows.join(names.withColumnRenamed("name", "subject"), ["vision_id", "subject"], "left_semi").join(
        names.withColumnRenamed("name", "object"), ["vision_id", "object"], "left_semi"
    ).select("vision_id", "pos", "subject", "predicate", "object")


def unrelated(answers: DataFrame) -> DataFrame:
    """Entities in no kept relation: ``vision_id, name``."""
    kept = relations(answers)
    used = kept.select("vision_id", F.col("subject").alias("name")).unionByName(kept.select("vision_id", F.col("object").alias("name")))
    return entities(answers).join(used, ["vision_id", "name"], "left_anti").select("vision_id", "name")


def first_mentions(answers: DataFrame) -> DataFrame:
    """Kept relations with flags that the subject or object is mentioned for the first time (a self-relation sets both)."""
    kept = relations(answers)
    ends = kept.select("vision_id", "pos", F.explode(F.array("subject", "object")).alias("name"))
    first = ends.groupBy("vision_id", "name").agg(F.min("pos").alias("first"))
    return (
        kept.join(first.withColumnsRenamed({"name": "subject", "first": "_s"}), ["vision_id", "subject"])
        .join(first.withColumnsRenamed({"name": "object", "first": "_o"}), ["vision_id", "object"])
        .select("vision_id", "pos", "subject", "predicate", "object", (F.col("pos") == F.col("_s")).alias("subject_first"), (F.col("pos") == F.col("_o")).alias("object_first"))
    )


def sentences(answers: DataFrame) -> DataFrame:
    """``vision_id, sentence``: relations with descriptions at first mention, then the unrelated entities, as one sentence.

    Rejected answers are left out; answers without a statement get a fixed sentence; unknown predicates read as their
    words, without the verb's ``s`` behind a subject that ends in ``s``.
    """
    answers = answers.where(~F.coalesce("is_rejected", F.lit(False)))
    told = entities(answers).select("vision_id", "name", F.concat(F.lit(" ("), F.coalesce("description", F.lit("")), F.lit(")")).alias("d"))
    spoken = F.create_map(*[F.lit(x) for k, (mid, _) in RELATIONS.items() for x in (k, mid)])
    behind = F.create_map(*[F.lit(x) for k, (_, end) in RELATIONS.items() for x in (k, end)])
    verb = F.replace("predicate", F.lit("_"), F.lit(" "))
    plural = F.col("subject").endswith("s") & verb.endswith("s")
    middle = F.coalesce(F.try_element_at(spoken, F.col("predicate")), F.concat(F.when(plural, F.substring(verb, F.lit(1), F.length(verb) - 1)).otherwise(verb), F.lit(" the")))
    m = first_mentions(answers).join(told.withColumnsRenamed({"name": "subject", "d": "_sd"}), ["vision_id", "subject"]).join(
        told.withColumnsRenamed({"name": "object", "d": "_od"}), ["vision_id", "object"]
    )
    stated = m.select("vision_id", F.lit(0).alias("part"), "pos", F.concat(
        F.lit("The "), "subject", F.when(F.col("subject_first"), F.col("_sd")).otherwise(""), F.lit(" "), middle, F.lit(" "), "object",
        F.when(F.col("object_first"), F.col("_od")).otherwise(""), F.coalesce(F.try_element_at(behind, F.col("predicate")), F.lit("")),
    ).alias("s"))
    alone = unrelated(answers).join(entities(answers), ["vision_id", "name"]).select(
        "vision_id", F.lit(1).alias("part"), F.col("first_pos").alias("pos"), F.concat(F.lit("the "), "name", F.lit(" ("), F.coalesce("description", F.lit("")), F.lit(")")).alias("s")
    )
    listed = stated.unionByName(alone).groupBy("vision_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "s"))).alias("all"))
    text = F.transform("all", lambda x, i: F.when(i == 0, F.concat(F.upper(F.left(x["s"], F.lit(1))), F.lower(F.substring(x["s"], F.lit(2), F.length(x["s"])))))
                       .otherwise(F.concat(F.lower(F.left(x["s"], F.lit(1))), F.substring(x["s"], F.lit(2), F.length(x["s"])))))
    whole = listed.select("vision_id", F.concat(F.array_join(text, ", and "), F.lit(".")).alias("sentence"))
    return answers.select("vision_id").distinct().join(whole, "vision_id", "left").select("vision_id", F.coalesce("sentence", F.lit(NOTHING)).alias("sentence"))
