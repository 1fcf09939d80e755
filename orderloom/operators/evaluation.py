"""Comparison of two multisets of order lines: matches, what is missing and extra, records, metrics, sweeps, version diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counted(lines: DataFrame, keys: list[str], name: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count("*").alias(name))


def aligned_counts(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """How often either side has each line. One pass over the union instead of a full join: counts are added up before the shuffle."""
    both = truth.select(*keys, F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("p")).unionByName(
        predicted.select(*keys, F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("p"))
    )
    return both.groupBy(*keys).agg(F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"))


def compare_orders(truth: DataFrame, predicted: DataFrame, order: str, code: str, quantity: str) -> DataFrame:
    """One row an order: sizes, matching codes and exact lines (multiset intersections), missing and extra lines, flags and a cause."""
    exact = aligned_counts(truth, predicted, [order, code, quantity])
    exact = exact.withColumn("m", F.least("n_truth", "n_predicted"))
    by_code = exact.groupBy(order, code).agg(F.sum("n_truth").alias("ct"), F.sum("n_predicted").alias("cp"), F.sum("m").alias("m"))
    records = by_code.groupBy(order).agg(
        F.sum("ct").alias("n_truth"), F.sum("cp").alias("n_predicted"), F.sum(F.least("ct", "cp")).alias("code_matches"), F.sum("m").alias("exact_matches"),
    )
    n_t, n_p, c, e = (F.col(x) for x in ("n_truth", "n_predicted", "code_matches", "exact_matches"))
    cause = (
        F.when((e == n_t) & (e == n_p), "none").when(n_p == 0, "no_prediction").when(n_t == 0, "no_truth").when((c == n_t) & (c == n_p), "quantity")
        .when((c == n_t) & (n_p > n_t), "extra_lines").when((c == n_p) & (n_t > n_p), "missing_lines").otherwise("wrong_articles")
    )
    return records.select("*", (n_t - e).alias("n_missing"), (n_p - e).alias("n_extra"), ((n_t > 0) & (e == n_t) & (e == n_p)).alias("perfect"), cause.alias("cause"))


def micro_metrics(records: DataFrame, split: str) -> DataFrame:
    """Micro-averaged rates by split and overall (null split), from records with truth lines."""
    rate = lambda a, b: F.round(F.sum(a) / F.sum(b), 4)
    rows = records.where("n_truth > 0").rollup(split).agg(
        F.count("*").alias("n_orders"), rate("code_matches", "n_truth").alias("code_recall"), rate("code_matches", "n_predicted").alias("code_precision"),
        rate("exact_matches", "n_truth").alias("line_recall"), rate("exact_matches", "n_predicted").alias("line_precision"),
        F.round(F.sum(F.col("perfect").cast("int")) / F.count("*"), 4).alias("perfect_rate"),
    )
    return rows


def expanded_differences(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line that one side has more often than the other, as often as it does; side says which."""
    counts = aligned_counts(truth, predicted, keys)
    gap = F.col("n_truth") - F.col("n_predicted")
    rows = counts.where(gap != 0).withColumn("side", F.when(gap > 0, "missing").otherwise("extra"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(gap)))).select(*keys, "side", "copy")


def aligned_occurrences(truth: DataFrame, predicted: DataFrame, order: str, code: str, value: str) -> DataFrame:
    """The i-th occurrence of a code in an order beside the i-th on the other side, with a tag for where it is."""
    numbered = lambda df, name: df.select(order, code, F.row_number().over(Window.partitionBy(order, code).orderBy(value)).cast("long").alias("occurrence"), F.col(value).alias(name))
    both = numbered(truth, "truth_value").join(numbered(predicted, "predicted_value"), [order, code, "occurrence"], "full")
    tag = F.when(F.col("truth_value").isNull(), "predicted only").when(F.col("predicted_value").isNull(), "truth only").otherwise("both")
    return both.withColumn("tag", tag)


def version_changes(old: DataFrame, new: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Lines added or removed between two versions of the predictions, counted, and whether truth makes that a gain or a regression."""
    change = aligned_counts(old, new, keys).withColumn("change", F.col("n_predicted") - F.col("n_truth")).where("change <> 0").select(*keys, "change")
    known = truth.select(*keys).distinct().withColumn("true_line", F.lit(True))
    out = change.join(known, keys, "left").withColumn("true_line", F.coalesce("true_line", F.lit(False)))
    added, right = F.col("change") > 0, F.col("true_line")
    label = F.when(added & right, "gain").when(added, "false addition").when(right, "regression").otherwise("cleanup")
    return out.withColumn("label", label)


def consumed_matches(lines: DataFrame, truth: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """Predicted lines with correct: the first k of a key are, where truth has it k times."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    have = counted(truth, keys, "have")
    return lines.withColumn("place", place).join(have, keys, "left").withColumn("correct", F.col("place") <= F.coalesce("have", F.lit(0))).drop("have", "place")


def substitutions(truth: DataFrame, predicted: DataFrame, order: str, code: str, least: int = 2) -> DataFrame:
    """Codes that stand in for others: in orders with exactly one code missing and one extra, pairs seen `least` times or more."""
    gap = F.col("n_truth") - F.col("n_predicted")
    counts = aligned_counts(truth.select(order, code).distinct(), predicted.select(order, code).distinct(), [order, code]).where(gap != 0)
    per = counts.groupBy(order).agg(
        F.count_if(gap > 0).alias("fn"), F.count_if(gap < 0).alias("fp"), F.min(F.when(gap > 0, F.col(code))).alias("missing"), F.min(F.when(gap < 0, F.col(code))).alias("extra")
    )
    return per.where("fn = 1 and fp = 1").groupBy("extra", "missing").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def order_causes(truth: DataFrame, predicted: DataFrame, heads: DataFrame, candidates: DataFrame, order: str, code: str, quantity: str, unit: str) -> DataFrame:
    """One row a head: client_correct, date_correct, lines_exact, automation_exact and the sorted causes of what is wrong.

    `heads` has truth_client, predicted_client, truth_date, predicted_date, status, error and n_products (null for orders without a
    prediction); `candidates` the codes that the search had for an order. Lines are compared in three ways, whole, by quantity and by
    unit, laid out as rows of one table, so that one aggregate by order and code serves all of them.
    """
    whole = F.concat_ws("\u0001", F.coalesce(F.col(quantity).cast("string"), F.lit("\u0002")), F.coalesce(F.col(unit), F.lit("\u0002")))
    facets = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (("line", whole), ("quantity", F.col(quantity).cast("string")), ("unit", F.col(unit)))]))
    laid = lambda df: df.select(order, code, facets.alias("f")).select(order, code, "f.*")
    gaps = aligned_counts(laid(truth), laid(predicted), [order, code, "facet", "value"])
    differs = lambda facet: F.max((F.col("facet") == facet) & (F.col("n_truth") != F.col("n_predicted")))
    of_line = lambda n: F.sum(F.when(F.col("facet") == "line", F.col(n)).otherwise(0))
    by_code = gaps.groupBy(order, code).agg(of_line("n_truth").alias("t"), of_line("n_predicted").alias("p"), differs("line").alias("lines"), differs("quantity").alias("q"), differs("unit").alias("u"))
    known = candidates.select(order, code).distinct().withColumn("known", F.lit(True))
    both = (F.col("t") > 0) & (F.col("p") > 0)
    per = by_code.join(known, [order, code], "left").groupBy(order).agg(
        F.sum("t").alias("n_truth"), F.max("lines").alias("differs"), F.max(F.col("t") > F.col("p")).alias("missing"), F.max(F.col("p") > F.col("t")).alias("extra"),
        F.max((F.col("t") > F.col("p")) & F.col("known").isNotNull()).alias("ranked"), F.max(both & F.col("q")).alias("q"), F.max(both & F.col("u")).alias("u"),
    )
    rows = heads.join(per, order, "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = F.coalesce(F.col("predicted_client"), F.lit("")) != ""
    client = named & F.col("truth_client").eqNullSafe(F.col("predicted_client"))
    dated = F.col("truth_date").isNull() | F.col("truth_date").eqNullSafe(F.col("predicted_date"))
    exact = (F.coalesce("n_truth", F.lit(0)) > 0) & ~said("differs")
    accepted = F.coalesce(F.upper("status") == "VALIDEE", F.lit(False))
    absent = F.col("n_products").isNull() | (F.coalesce(F.col("error"), F.lit("")) != "")
    fewer = F.coalesce("n_products", F.lit(0)) < F.coalesce("n_truth", F.lit(0))
    # fixed values: the names of the causes
    causes = [
        (absent, "prediction_absente_ou_erreur"), (~named, "client_non_reconnu"), (named & ~client, "mauvais_client"), (~dated, "date_livraison"), (said("ranked"), "classement_produit"),
        (said("missing") & ~said("ranked") & fewer, "segmentation_ou_asr"), (said("missing") & ~said("ranked") & ~fewer, "recherche_candidat"), (said("extra"), "faux_produit"),
        (said("q"), "quantite"), (said("u"), "unite_conditionnement"), (client & exact & ~accepted, "rejet_interne_d_une_commande_correcte"),
    ]
    found = F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in causes]), lambda x: x.isNotNull()))
    return rows.select(order, client.alias("client_correct"), dated.alias("date_correct"), exact.alias("lines_exact"), (client & exact & dated & accepted).alias("automation_exact"), found.alias("causes"))
