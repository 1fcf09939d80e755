"""Families of candidates: those that share an anchor, a telling word of the mention that their labels have.

A weak signal of a candidate counts only where its family makes it plausible, and a candidate from outside a client's history gets
a bonus only over the history's best of the same family. A family is no fixed group, as one candidate can have several anchors; so
candidates are laid out by anchor, each anchor's bests are aggregates, and a candidate takes the best of its anchors. Pairs of
candidates never meet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import token_score

#: Words that are no anchors; the least score of an anchor; how far below the group's best a secondary signal counts, and from where.
NOT_CORE = set(
    "avec sans pour par dans comme fois un une deux trois quatre cinq six sept huit neuf dix litre litres kilo kilos kg gramme grammes piece pieces carton cartons colis boite boites poche poches "
    "pot pots sac sacs pack paquet paquets barquette barquettes bouteille bouteilles bidon bidons seau seaux pourcent petit petite grand grande format marque grain grains graine graines".split()
)
ANCHOR, BELOW, FLOOR = 90.0, 35.0, 30.0
#: Attributes of which a product has one.
EXCLUSIVE = {
    "fruit": "abricot ananas banane cassis cerise citron coco fraise framboise goyave groseille kiwi litchi mangue mure myrtille orange papaye passion peche pistache poire pomme".split(),
    "forme_decoupe": (
        "brisure brisures concasse concassee copeau copeaux cube cubes emince emincee entier entiere entiers entieres fouette fouettee hache hachee miette miettes laniere lanieres petale petales poudre "
        "rape rapee rondelle rondelles semoule tranche tranchee"
    ).split(),
    "type_farine": "napolitaine t45 t55 t65 t80".split(),
    "type_charcuterie": ["paleta"],
}
#: The bonus and its reasons; how far a candidate may be below the history's best; what a variant that was not understood needs.
BONUS, CLOSE, UNREAD, VARIANT, AHEAD = 125.0, 5.0, 70.0, 45.0, 15.0
BY_ATTRIBUTE, BY_SOUND = "fallback_reappro_attribut_explicite_intra_famille", "fallback_{}_variante_phonetique_intra_famille"


def _core(word: str) -> bool:
    return len(word) >= 3 and word not in NOT_CORE


def heard_in(said: Column, label: Column) -> Column:
    """struct(anchors, scores) of two arrays of words: the said words that are anchors of the label, and for each said word the best score that a word of the label has. Nulls say nothing."""

    @F.arrow_udf("struct<anchors: array<string>, scores: array<double>>")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        anchors, scores = [], []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            best = [max((token_score(w, z) for z in y or ()), default=0.0) for w in x or ()]
            scores.append(best)
            anchors.append(list(dict.fromkeys(w for w, s in zip(x or (), best, strict=True) if _core(w) and not w.isdigit() and s >= ANCHOR)))
        return pa.StructArray.from_arrays([pa.array(anchors, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64()))], ["anchors", "scores"])

    return of(said, label)


def _with_heard(candidates: DataFrame, said: str, label: str) -> DataFrame:
    """candidates with h, what heard_in() says of their texts. Texts repeat from candidate to candidate: each pair is scored once."""
    a, b = F.col(said).alias("__said"), F.col(label).alias("__label")
    pairs = candidates.select(a, b).distinct()
    scored = pairs.select("__said", "__label", F.explode(F.array(heard_in(F.col("__said"), F.col("__label")))).alias("h"))  # found once, not again for what it is joined to
    return candidates.join(scored, F.col(said).eqNullSafe(F.col("__said")) & F.col(label).eqNullSafe(F.col("__label"))).drop("__said", "__label")


def secondary_signals(candidates: DataFrame, mention: str, said: str, label: str, score: str) -> DataFrame:
    """candidates with anchors and eligible: whether signals beside the text may count for a candidate.

    They may for one with an anchor whose text score is at most BELOW under the best of the mention's anchored candidates, and FLOOR
    at least. Null scores are 0.
    """
    text_score = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    rows = _with_heard(candidates, said, label).withColumn("anchors", F.col("h.anchors")).drop("h")
    has = F.size("anchors") > 0
    best = F.max(F.when(has, text_score)).over(Window.partitionBy(mention))
    return rows.withColumn("eligible", F.coalesce(has & (text_score >= F.greatest(F.lit(FLOOR), best - BELOW)), F.lit(False)))


def requested(said: Column, groups: dict[str, list[str]] = EXCLUSIVE) -> Column:
    """For each exclusive group of which something was said, the attributes that were."""
    found = [F.array_intersect(said, F.array(*map(F.lit, words))) for words in groups.values()]
    return F.filter(F.array(*found), lambda x: F.size(x) > 0)


def fallback_bonuses(candidates: DataFrame, mention: str, code: str, said: str, label: str, score: str, in_history: str, fallback: str, source: str, conflict: str, groups: dict[str, list[str]] = EXCLUSIVE) -> DataFrame:
    """mention, code, bonus, reason of candidates outside the history (fallback: from a catalogue, and compatible) that beat it within their family.

    By attribute: the label has an attribute of every group that was asked for, nothing of the family's history does without a
    conflict, and the text score is at most CLOSE below the history's best. By sound, for the others: all that was not understood
    is one word of three letters that no label of the family's history or catalogue has (below UNREAD), which this label sounds like
    (VARIANT, and AHEAD of the history). Both need history in the family. A code that repeats counts once.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = candidates.select(
        mention, code, F.col(said).alias("said"), F.col(label).alias("label"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"), flag(in_history).alias("own"), flag(fallback).alias("other"),
        F.col(source).alias("source"), flag(conflict).alias("conflict"),
    )
    # what a family tells goes by labels, of which a mention has far fewer than candidates
    own = F.when(F.col("own"), F.col("score"))
    labels = rows.where(F.col("own") | F.col("other")).groupBy(mention, "said", "label").agg(F.max(own).alias("best"), F.max("own").alias("own"), F.max("other").alias("other"), F.max(F.col("own") & ~F.col("conflict")).alias("sound"))
    labels = _with_heard(labels, "said", "label").where(F.size("h.anchors") > 0)
    wanted = requested(F.col("said"), groups)
    labels = labels.withColumn("asked", F.size(wanted) > 0).withColumn("all", F.forall(wanted, lambda x: F.arrays_overlap(x, F.col("label"))))
    telling = F.filter(F.arrays_zip(F.col("said").alias("word"), F.col("h.scores").alias("score")), lambda x: (F.length(x["word"]) >= 3) & ~x["word"].isin(*sorted(NOT_CORE)))
    labels = labels.withColumn("words", telling)
    rest = F.filter("words", lambda x: ~F.array_contains(F.col("h.anchors"), x["word"]))
    labels = labels.withColumn("rest", rest)

    by_anchor = labels.withColumn("anchor", F.explode("h.anchors"))
    best = by_anchor.groupBy(mention, "anchor").agg(F.max("best").alias("best"), F.max(F.col("sound") & F.col("all")).alias("served"))
    words = by_anchor.select(mention, "anchor", "own", F.explode("words").alias("w"))
    read = words.groupBy(mention, "anchor", F.col("w.word").alias("word")).agg(F.max(F.when(F.col("own"), F.col("w.score"))).alias("own_read"), F.max("w.score").alias("read"))

    asking = labels.where("other").select(mention, "said", "label", "asked", "all", F.explode("h.anchors").alias("anchor"), F.when(F.size("rest") == 1, F.get("rest", F.lit(0))).alias("left"))
    asking = asking.withColumn("word", F.col("left.word")).join(best, [mention, "anchor"]).join(read, [mention, "anchor", "word"], "left")
    each = asking.groupBy(mention, "said", "label", "asked", "all", "left").agg(F.max("best").alias("best"), F.max("served").alias("served"), F.max("own_read").alias("own_read"), F.max("read").alias("read"))
    sound = F.bround("left.score", 2)
    by_sound = (F.length("left.word") == 3) & (F.col("read") < UNREAD) & (sound >= VARIANT) & (sound >= F.bround("own_read", 2) + AHEAD)
    each = each.select(F.col(mention).alias("__mention"), F.col("said").alias("__said"), F.col("label").alias("__label"), F.when(F.col("asked") & F.col("all") & ~F.col("served"), F.col("best") - CLOSE).alias("from"), F.coalesce(by_sound & F.col("best").isNotNull(), F.lit(False)).alias("by_sound"))
    each = each.where(F.col("from").isNotNull() | F.col("by_sound"))
    same = F.col(mention).eqNullSafe(F.col("__mention")) & F.col("said").eqNullSafe(F.col("__said")) & F.col("label").eqNullSafe(F.col("__label"))
    kind = F.when(F.col("source") == "catalogue_global", BY_SOUND.format("catalogue")).otherwise(BY_SOUND.format("reappro"))
    reason = F.when(F.col("score") >= F.col("from"), BY_ATTRIBUTE).when(F.col("by_sound"), kind)
    found = rows.where("other").join(each, same).withColumn("reason", reason).where("reason is not null")
    return found.groupBy(mention, code).agg(F.min("reason").alias("reason")).select(mention, code, F.lit(BONUS).alias("bonus"), "reason")
