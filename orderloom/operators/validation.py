"""Lines that a model proposes for a call, checked against catalogue and transcript: what has no proof is turned down with its reasons, the rest becomes one line for each code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import extraction, packaging

#: The largest quantity; the least confidence, share of proven words, and score against the queries of a batch.
MOST, CONFIDENCE, PROVEN, QUERY = 10_000.0, 0.35, 0.6, 52.0


def spoken(source: Column) -> Column:
    """A sentence without accents, in lower case, with its number words as digits."""
    return extraction.digits_for_words(F.lower(text.strip_accents(F.coalesce(source, F.lit("")))))


def says_a_number(sentence: Column) -> Column:
    """Whether a sentence of digits has a number that is no percentage and no degree."""
    return sentence.rlike(r"(?<![0-9])[0-9]++(?:[.,][0-9]+)?+(?![0-9])(?!\s*(?:%|pour\s+cent\b|degres?\b))")


def proven(source: Column, transcript: Column) -> Column:
    """Whether a sentence stands in a transcript, or PROVEN of its words of three letters or more do."""
    own, full = text.canonical(source), text.canonical(transcript)
    words = F.filter(F.split(own, " "), lambda w: F.length(w) >= 3)
    said = F.split(full, " ")
    share = F.size(F.filter(words, lambda w: F.array_contains(said, w))) / F.size(words)
    return (own != "") & (full != "") & (F.contains(full, own) | F.when(F.size(words) > 0, share >= PROVEN).otherwise(F.lit(False)))


def checked_lines(lines: DataFrame, catalogue: DataFrame, transcripts: DataFrame, order: str, query_score: str | None = None) -> DataFrame:
    """lines with reasons (empty: accepted), and quantity, unit, label and quantity_resolution as they count.

    lines: order, index, code, source, quantity, unit, confidence; catalogue: code (once each), label, unit, capacity, capacity_unit,
    variable_weight; transcripts: order (once each), transcript. A number of packages in the sentence, or a measure that the capacity
    divides, comes before the model's quantity; the catalogue's unit before the model's. query_score: how well the line fits the best query
    of its batch. Nulls prove nothing.
    """
    known = catalogue.select("code", "label", F.upper(F.trim("unit")).alias("of_unit"), "capacity", "capacity_unit", "variable_weight", F.lit(True).alias("known"))
    rows = lines.withColumn("code", F.trim("code")).join(known, "code", "left").join(transcripts.select(order, "transcript"), order, "left")
    rows = rows.withColumn("sentence", spoken(F.col("source")))
    counted = packaging.explicit_containers(F.col("sentence"), F.col("of_unit"))
    held = packaging.capacity_quantity(F.col("sentence"), F.col("capacity"), F.col("capacity_unit"), F.col("variable_weight"))
    rows = rows.withColumn("counted", F.when(F.col("known"), counted)).withColumn("held", F.when(F.col("known") & F.col("counted").isNull(), held))
    q, c = F.col("quantity").cast("double"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    expected, own = F.when(F.col("of_unit") != "", F.col("of_unit")), F.upper(F.trim(F.coalesce("unit", F.lit(""))))
    said = lambda when, reason: F.when(F.coalesce(when, F.lit(True)), reason)
    out = [
        said(F.col("known").isNull(), "code_hors_catalogue_autorise"), said(F.isnan(q) | (q <= 0) | (q > MOST), "quantite_invalide"), said(~says_a_number(F.col("sentence")), "quantite_non_prouvee_transcription"),
        said(expected.isNull() & (own == ""), "unite_incompatible_catalogue"), said(F.isnan(c) | (c < CONFIDENCE) | (c > 1.0), "confiance_insuffisante"), said(~proven(F.col("source"), F.coalesce("transcript", F.lit(""))), "preuve_absente_transcription"),
    ]
    if query_score:
        out.append(said(F.col(query_score) < QUERY, "produit_hors_perimetre_du_lot"))
    how = F.when(F.col("counted").isNotNull(), "nombre_explicite").otherwise(F.coalesce("held.reason", F.lit("llama_quantity")))
    return rows.select(
        order, "index", "code", "source", F.bround(F.coalesce("counted", "held.quantity", q), 6).alias("quantity"), F.coalesce(expected, own).alias("unit"), "label", F.bround(c, 6).alias("confidence"),
        how.alias("quantity_resolution"), F.array_compact(F.array(*out)).alias("reasons"),
    )


def accepted_lines(checked: DataFrame, order: str) -> DataFrame:
    """order, code, label, unit, quantity, confidence, source, first (index): the accepted lines, one for each code.

    Lines of a code fold in their order: one of the same sentence as so far keeps the larger quantity and confidence, another adds its
    quantity and sentence and keeps the lesser confidence.
    """
    line = F.struct("index", "quantity", "confidence", "source", "unit", "label")
    groups = checked.where(F.size("reasons") == 0).groupBy(order, "code").agg(F.array_sort(F.collect_list(line)).alias("all"))

    def step(now: Column, x: Column) -> Column:
        same = text.canonical(now["source"]) == text.canonical(x["source"])
        quantity = F.when(same, F.greatest(now["quantity"], x["quantity"])).otherwise(F.bround(now["quantity"] + x["quantity"], 6))
        confidence = F.when(same, F.greatest(now["confidence"], x["confidence"])).otherwise(F.least(now["confidence"], x["confidence"]))
        source = F.when(same, now["source"]).otherwise(F.concat(now["source"], F.lit(" + "), x["source"]))
        return now.withField("quantity", quantity).withField("confidence", confidence).withField("source", source)

    first = F.get("all", F.lit(0))
    folded = F.aggregate(F.slice("all", F.lit(2), F.size("all")), first, step)
    found = groups.select(order, "code", folded.alias("f"))
    return found.select(order, "code", *[F.col(f"f.{k}").alias(k) for k in ("label", "unit", "quantity", "confidence", "source")], F.col("f.index").alias("first"))
