"""From recognised products of a call to its order lines: what is said twice becomes one line, of the better of both; statuses that only rise.

The products of one order and code, few by nature, fold in their order; nothing else meets in one row. Everything is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Words that do not tell products apart.
TOOL_WORDS = "a au aux avec d de des du en et la le les long longue pour sans sur sous dlc".split()
#: Reasons that an inferred quantity settles.
SETTLED = ("quantite_absente_a_resoudre", "quantite_commande_non_resolue")
#: What products() reads, and of which type.
PRODUCT = {
    "index": "int", "segment": "string", "code": "string", "label": "string", "said": "string", "quantity": "double", "quantity_said": "double", "unit": "string", "unit_said": "string", "price": "double",
    "score": "double", "selection_score": "double", "text_score": "double", "reliable": "boolean", "ambiguous": "boolean", "recognised": "boolean", "reasons": "array<string>",
}
_LINE = (
    "struct<index: int, code: string, label: string, quantity: double, inferred: boolean, unit: string, price: double, text_score: double, reliable: boolean, ambiguous: boolean, "
    "quality: struct<reliable: boolean, clear: boolean, score: double, selection: double, unit: boolean, index: int>, tokens: array<string>, segment: string, segments: array<string>, created: int>"
)


def semantic_tokens(said: Column) -> Column:
    """The words that name a product, in order: no tool words, no numbers."""
    return F.filter(text.tokens(said), lambda w: ~w.isin(*TOOL_WORDS) & ~w.rlike("^[0-9]+$"))


def to_keep_apart(a: Column, b: Column) -> Column:
    """Whether two lines of one code are two products that a common code hides: of different segments, with equal scores of 65 or more, and with words that differ but that the label has none of.

    Their first words agree (a base and two kinds), or they share no word.
    """
    differ = F.array_union(F.array_except(a["tokens"], b["tokens"]), F.array_except(b["tokens"], a["tokens"]))
    segments = (a["segment"] != "") & (b["segment"] != "") & (a["segment"] != b["segment"])
    told = (F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0) & (a["tokens"] != b["tokens"])
    equal = (F.least(a["text_score"], b["text_score"]) >= 65.0) & (F.abs(a["text_score"] - b["text_score"]) <= 0.01)
    unexplained = (F.size(differ) > 0) & ~F.arrays_overlap(differ, text.tokens(a["label"]))
    kinds = (F.get(a["tokens"], F.lit(0)) == F.get(b["tokens"], F.lit(0))) | ~F.arrays_overlap(a["tokens"], b["tokens"])
    return F.coalesce(segments & told & equal & unexplained & kinds, F.lit(False))


def _fold(products: Column) -> Column:
    """lines and merges of the products of one code, in their order. An equal name joins its line; else the code's first line, unless some pair is to be kept apart."""
    start = F.struct(F.array().cast(f"array<{_LINE}>").alias("lines"), F.lit(False).alias("apart"), F.lit(0).alias("merges"))

    def step(state: Column, p: Column) -> Column:
        lines = state["lines"]
        same = F.when(F.size(p["tokens"]) > 0, F.array_position(F.transform(lines, lambda x: x["tokens"] == p["tokens"]), True)).otherwise(F.lit(0)).cast("int")
        apart = state["apart"] | ((same == 0) & F.exists(lines, lambda x: to_keep_apart(p, x)))
        target = F.when(same > 0, same).when((F.size(lines) > 0) & ~apart, 1).otherwise(0)

        def merged(x: Column, i: Column) -> Column:
            better = p["quality"] > x["quality"]
            both = lambda first, second: F.filter(F.array_distinct(F.array_union(first, second)), lambda s: s != "")
            longer = F.when(better, both(p["segments"], F.array(x["segment"]))).otherwise(both(x["segments"], p["segments"]))
            best = F.when(better, p).otherwise(x)
            segments = F.when(same > 0, longer).when(better, p["segments"]).otherwise(x["segments"])
            return F.when(i + 1 == target, best.withField("created", x["created"]).withField("segments", segments)).otherwise(x)

        after = F.when(target == 0, F.concat(lines, F.array(p))).otherwise(F.transform(lines, merged))
        return F.struct(after.cast(f"array<{_LINE}>").alias("lines"), apart.alias("apart"), (state["merges"] + (target > 0).cast("int")).alias("merges"))

    return F.aggregate(products, start, step)


def order_lines(products: DataFrame, order: str, units: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines: order, line, code, label, quantity, inferred, unit, price, reliable, ambiguous, source (index), segments; reasons: order, reasons).

    products: order and the columns of PRODUCT; index counts an order's products from 1. A product without a code (nothing was
    chosen) and one that was told to be none (recognised is false) give no line. One that was recognised without a quantity is
    ordered once; else a missing quantity leaves it out, with a reason. Of two products that become one line the better stays:
    reliable, unambiguous, the higher scores, a unit said, the later. units: the unit that the code is ordered in, if known; PCE
    is PI. Lines are numbered in the order of their first products. Reasons are sorted and distinct; each order of products has a
    row of them. Nulls are false, 0 or the empty text.
    """
    c = {k: F.col(k).cast(t) for k, t in PRODUCT.items()}
    no = lambda k: F.coalesce(c[k], F.lit(False))
    zero = lambda k: F.coalesce(c[k], F.lit(0.0))
    chosen = (F.coalesce(c["code"], F.lit("")) != "") & F.coalesce(c["recognised"], F.lit(True))
    spoken = F.coalesce(c["quantity"], c["quantity_said"])
    inferred = spoken.isNull() & no("recognised")
    left = F.filter(F.coalesce(c["reasons"], F.array().cast("array<string>")), lambda r: ~r.isin(*SETTLED))
    segment = F.trim(F.coalesce(c["segment"], F.lit("")))
    unit = F.coalesce(F.lit(None) if units is None else units, c["unit"], c["unit_said"])
    reliable, ambiguous = no("reliable") | inferred, F.when(inferred, F.size(left) > 0).otherwise(no("ambiguous"))
    quality = F.struct(reliable.alias("reliable"), (~ambiguous).alias("clear"), zero("score").alias("score"), zero("selection_score").alias("selection"), (F.coalesce(c["unit_said"], F.lit("")) != "").alias("unit"), c["index"].alias("index"))
    product = F.struct(
        c["index"].alias("index"), c["code"].alias("code"), c["label"].alias("label"), F.when(inferred, 1.0).otherwise(spoken).alias("quantity"), inferred.alias("inferred"),
        F.when(F.upper(unit) == "PCE", "PI").otherwise(unit).alias("unit"), c["price"].alias("price"), zero("text_score").alias("text_score"), reliable.alias("reliable"), ambiguous.alias("ambiguous"),
        quality.alias("quality"), semantic_tokens(c["said"]).alias("tokens"), segment.alias("segment"), F.filter(F.array(segment), lambda s: s != "").alias("segments"), c["index"].alias("created"),
    ).cast(_LINE)
    note = lambda when, prefix, n: F.when(when, F.concat(F.lit(prefix), n.cast("string")))
    noted = F.coalesce(note(inferred, "quantite_implicite_un_ligne_", c["index"]), note(spoken.isNull(), "quantite_absente_ligne_", c["index"]))
    rows = products.select(order, chosen.alias("chosen"), spoken.isNotNull().alias("counted"), inferred.alias("inferred"), F.when(chosen, noted).alias("reason"), product.alias("p"))
    groups = rows.where("chosen and (counted or inferred)").groupBy(order, F.col("p.code").alias("code")).agg(F.array_sort(F.collect_list(F.struct("p.index", "p"))).alias("all"))
    folded = groups.select(order, "code", _fold(F.transform("all", lambda x: x["p"])).alias("f"))
    lines = folded.select(order, "f.merges", F.explode("f.lines").alias("x"))
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy(order).orderBy("x.created", "x.code")))
    said = F.array_compact(F.array(
        note(~F.col("x.reliable"), "produit_non_fiable_ligne_", F.col("line")), note(F.col("x.ambiguous"), "produit_ambigu_ligne_", F.col("line")),
        note(F.col("x.price") == 0, "produit_non_vendu_prix_zero_ligne_", F.col("line")), note(F.col("merges") > 0, "article_duplique_consolide_", F.col("x.code")),
    ))
    of_lines = lines.select(order, F.lit(1).alias("n"), said.alias("reasons"))
    of_products = rows.select(order, F.lit(0).alias("n"), F.array_compact(F.array("reason")).alias("reasons"))
    reasons = of_lines.unionByName(of_products).groupBy(order).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("reasons")).alias("reasons"))
    none = F.when(F.col("n") == 0, F.array(F.lit("produit_non_vendu_aucune_selection"))).otherwise(F.array().cast("array<string>"))
    reasons = reasons.select(order, F.array_sort(F.array_distinct(F.concat("reasons", none))).alias("reasons"))
    out = [F.col(f"x.{k}").alias(k) for k in ("code", "label", "quantity", "inferred", "unit", "price", "reliable", "ambiguous")]
    return lines.select(order, "line", *out, F.col("x.index").alias("source"), F.col("x.segments").alias("segments")), reasons


def blocking(reasons: Column, has_lines: Column) -> Column:
    """Reasons that hold an order back: not that lines were joined, nor a missing quantity where other lines are left; without lines that is one itself."""
    kept = F.filter(reasons, lambda r: ~F.startswith(r, F.lit("article_duplique_consolide_")) & ~(F.startswith(r, F.lit("quantite_absente_ligne_")) & has_lines))
    return F.when(has_lines, kept).otherwise(F.array_union(kept, F.array(F.lit("produit_non_vendu_aucune_selection"))))


def rising_status(versions: DataFrame, key: str, version: str, client_known: str, blocked: str, changed: str, accepted: str) -> DataFrame:
    """versions with status: VALIDEE or PROBLEMATIQUE, which from version to version only rises.

    accepted: whether the version came as VALIDEE. One that came otherwise rises if something in it changed, its client is
    known and nothing blocks it. Once up, a key stays up. Nulls are false; versions of one number rise together.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    up = yes(accepted) | (yes(changed) & yes(client_known) & ~F.coalesce(F.col(blocked), F.lit(True)))
    w = Window.partitionBy(key).orderBy(version).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return versions.withColumn("status", F.when(F.max(up).over(w), "VALIDEE").otherwise("PROBLEMATIQUE"))
