"""Packaging that a product's label states, and what a said quantity makes of it in the unit that the product is ordered in.

Both are column expressions: patterns give the numbers of a label, a reference row (where there is one) overrules them, and
an ordered table of branches, of which the first that fits decides, becomes one CASE. Rows are read once and none moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import canonical, strip_accents

#: Units of outer packages, and those with pouches; units that a tub of ice is sold in; the two that mean a carton.
OUTER = ("COL", "CAR", "BOITE", "PAL", "SAC", "PACK", "BARQ", "SEAU", "BID")
PACKAGES = (*OUTER, "POC")
TUBS = ("BOITE", "PI", "PCE", "BAC")
CARTONS = ("CAR", "COL")
#: Names of packages in a sentence and the order units that each can mean.
CONTAINERS = {
    "packs?": ("PACK",), "cartons?": ("CAR", "COL"), "caisses?": ("CAR", "COL"), "colis": ("CAR", "COL"), "boites?": ("BOITE",), "bidons?": ("BID", "PI", "PCE"), "seaux?": ("SEAU",), "sacs?": ("SAC",), "sachets?": ("SACH", "POC"),
    "poches?": ("POC",), "barquettes?": ("BARQ",), "pieces?": ("PI", "PCE"), "unites?": ("PI", "PCE"), "bouteilles?": ("PI", "PCE"), "pots?": ("PI", "PCE"), "paquets?": ("PAQUET", "PACK", "SACH"),
}
_NUMBER, _UNIT = r"([0-9]+(?:\.[0-9]+)?)", "(kg|k|g|l|cl|ml)"
MANY = rf"([0-9]+)\s*x\s*{_NUMBER}\s*{_UNIT}\b"
MANY_BEHIND = rf"{_NUMBER}\s*{_UNIT}\s*x\s*([0-9]+)\s*p?\b"
ITEMS = r"(?:x\s*([1-9][0-9]*)\s*p?\b|(?<![a-z0-9])([1-9][0-9]*)\s*p\b)"
SIZE = rf"{_NUMBER}\s*{_UNIT}\b"
#: The type of a reference row: what the product is ordered in, how many base units that holds, both units as the source has them, and a mean weight.
REFERENCE = "struct<order_unit: string, pack_size: double, base_unit: string, source_unit: string, average_weight: double>"
#: The type of what is said beside the quantity.
PRECISIONS = "array<struct<quantity: double, unit: string>>"


def measured_label(label: Column) -> Column:
    """Without accents, lower case, one space for all but letters, digits and points; a comma or point between digits is a point."""
    plain = F.regexp_replace(F.lower(strip_accents(F.coalesce(label, F.lit("")))), r"(?<=[0-9])\s*[,.]\s*(?=[0-9])", ".")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9.]+", " "))


def _base(size: Column, unit: Column) -> Column:
    """A size in kilograms or litres."""
    return size.cast("double") / F.when(unit.isin("g", "ml"), 1000.0).when(unit == "cl", 100.0).otherwise(1.0)


def _weight(unit: Column) -> Column:
    return unit.isin("kg", "k", "g")


def _filled(text: Column) -> Column:
    """null for the empty text."""
    return F.when(text != "", text)


def with_packaging(rows: DataFrame, label: Column, sale_unit: Column, usual: Column, net_ratio: Column, reference: Column | None = None, out: str = "pack") -> DataFrame:
    """rows with a struct: order_unit, kg, litres (of one order unit), subunits, items, sub_kg, sub_litres, official_pack, official_base, official_source, official_unit, source.

    6X1L and 1L X6 are six of a litre, X10P and 10P ten pieces, else the last size in the label counts. Where no sale unit is known,
    the net ratio tells a single piece from the package, the usual quantity tells packages of items, and three litres or more are a can. A
    reference row has the last word on units, packs and mean weight. Nulls stand for nothing known.
    """
    given = F.upper(_filled(F.trim(sale_unit)))
    ref = F.lit(None).cast(REFERENCE) if reference is None else reference.cast(REFERENCE)
    t = lambda name: F.col(f"__{out}_{name}")
    step = lambda df, **columns: df.withColumns({f"__{out}_{k}": v for k, v in columns.items()})
    df = step(rows, label=measured_label(label), given=given, usual=F.coalesce(usual.cast("double"), F.lit(0.0)), ratio=F.coalesce(net_ratio.cast("double"), F.lit(0.0)), ref=ref)
    part = lambda pattern, i: _filled(F.regexp_extract(t("label"), pattern, i))
    ahead = part(MANY, 0).isNotNull()
    df = step(df, ahead=ahead, behind=part(MANY_BEHIND, 0).isNotNull())
    pick = lambda a, b: F.when(t("ahead"), part(MANY, a)).otherwise(part(MANY_BEHIND, b))
    df = step(df, many=pick(1, 3).cast("int"), many_size=pick(2, 1), many_unit=pick(3, 2), items=F.coalesce(part(ITEMS, 1), part(ITEMS, 2)).cast("int"))
    df = step(df, one=_base(t("many_size"), t("many_unit")), unit0=F.coalesce(t("given"), F.lit("PCE")))
    df = step(df, whole=t("one") * t("many"))
    # no sale unit: the ratio says whether the piece or the package is what is sold
    near = lambda x: F.greatest(F.lit(0.05), F.abs(x) * 0.25)
    off_one, off_whole = F.abs(t("ratio") - t("one")), F.abs(t("ratio") - t("whole"))
    as_package = t("given").isNull() & (t("ratio") > 0) & (off_whole <= near(t("whole"))) & (off_whole + 0.01 < off_one)
    df = step(df, as_package=F.coalesce(as_package, F.lit(False)))
    df = step(df, unit1=F.when(t("as_package"), "COL").otherwise(t("unit0")), content=F.when(t("as_package") | t("unit0").isin(*OUTER), t("whole")).otherwise(t("one")))
    sub = F.coalesce(t("many"), F.when(t("unit1") == "PCE", t("items")))
    in_cartons = t("given").isNull() & (t("usual") > 0) & (t("usual") < t("items"))
    carton = F.contains(t("label"), F.lit("oeuf")) | F.contains(t("label"), F.lit("seau")) | (t("items") >= 20)
    sizes = F.regexp_extract_all(t("label"), F.lit(f"({SIZE})"), 1)
    last = F.when(t("content").isNull() & (F.size(sizes) > 0), F.element_at(sizes, -1))
    df = step(df, sub=sub, unit2=F.when(in_cartons, F.when(carton, "CAR").otherwise("COL")).otherwise(t("unit1")), last=last)
    last_unit = F.regexp_extract(t("last"), "[a-z]+$", 0)
    df = step(df, content=F.coalesce(t("content"), _base(F.regexp_extract(t("last"), "^[0-9.]+", 0), last_unit)), weighs=_weight(F.coalesce(t("many_unit"), last_unit)))
    kg, litres = F.when(t("weighs"), t("content")), F.when(~t("weighs"), t("content"))
    source = F.when(t("ahead"), "libelle_multi").when(t("behind"), "libelle_multi_inverse").when(t("items").isNotNull(), "libelle_items").when(t("last").isNotNull(), "libelle_taille_simple").otherwise("defaut_piece")
    can = t("given").isNull() & (t("unit2") == "PCE") & (litres >= 3)
    many_weighs = _weight(t("many_unit"))
    df = step(df, kg=kg, litres=litres, unit3=F.when(can, "BID").otherwise(t("unit2")), source=source, sub_kg=F.when(many_weighs, t("one")), sub_litres=F.when(~many_weighs, t("one")))

    has, r = t("ref").isNotNull(), lambda name: t("ref")[name]
    text = lambda name: F.when(has, F.upper(F.coalesce(r(name), F.lit(""))))
    official = _filled(text("order_unit"))
    df = step(df, official=official, base=text("base_unit"), from_unit=text("source_unit"), size=F.when(r("pack_size") > 0, r("pack_size")))
    df = step(df, unit=F.when(t("official") == "PI", "PCE").otherwise(F.coalesce(t("official"), t("unit3"))))
    outer = t("unit").isin(*OUTER)
    recount = has & (t("size") > 1) & t("base").isin("PCE", "UNI") & t("unit").isin(*CARTONS)
    again = has & (t("sub") > 0) & outer
    by_pack = has & (t("size") > 1) & (t("source") == "libelle_taille_simple") & outer & (t("base") != "") & (t("from_unit") != "") & (t("base") != t("from_unit"))
    mean = F.when(has & (t("base") == t("from_unit")) & (r("average_weight") > 0), r("average_weight"))
    sized = lambda now, one: F.when(again & one.isNotNull(), one * t("sub")).when(by_pack, now * t("size")).otherwise(now)
    found = F.struct(
        t("unit").alias("order_unit"), F.coalesce(mean, sized(t("kg"), t("sub_kg"))).alias("kg"), sized(t("litres"), t("sub_litres")).alias("litres"), t("sub").alias("subunits"),
        F.when(recount, F.bround(t("size"), 0).cast("int")).otherwise(t("items")).alias("items"), t("sub_kg").alias("sub_kg"), t("sub_litres").alias("sub_litres"), t("size").alias("official_pack"),
        F.coalesce(t("base"), F.lit("")).alias("official_base"), F.coalesce(t("from_unit"), F.lit("")).alias("official_source"), F.coalesce(t("official"), t("unit")).alias("official_unit"),
        F.when(has, "controle_references_officiel").otherwise(t("source")).alias("source"),
    )
    return df.select(*rows.columns, found.alias(out))


@dataclass
class Branch:
    """A row of the decision table. reason: the code that the result bears; quantity and unit: the result, null where nothing is decided."""

    reason: str
    when: Column
    quantity: Column | None
    unit: Column
    score: Column | float = 0.0

    def result(self) -> Column:
        quantity = F.lit(None).cast("double") if self.quantity is None else self.quantity.cast("double")
        score = self.score if isinstance(self.score, Column) else F.lit(self.score)
        return F.struct(quantity.alias("quantity"), self.unit.alias("unit"), score.cast("double").alias("score"), F.lit(self.reason).alias("reason"))


def first_that_fits(branches: Sequence[Branch]) -> Column:
    """One CASE over the table, in its order; a condition that is null does not fit."""
    case = F
    for b in branches:
        case = case.when(F.coalesce(b.when, F.lit(False)), b.result())
    return case


def quantity_table(quantity: Column, unit: Column, multiple: Column, said: Column, precisions: Column, label: Column, pack: Column, factor: Column, target: Column) -> list[Branch]:
    """The branches by which a said quantity becomes one in the order unit, first to last.

    unit: KG, L, PCE, a package or null; multiple: a count said with the package; said: the sentence; factor and target: a
    learned rule for the product and unit, or null. See with_packaging() for pack.
    """
    q, own = quantity, numbers.commercial(quantity)
    order, official, size = pack["order_unit"], pack["official_unit"], pack["official_pack"]
    sub, items = F.when(pack["subunits"] > 0, pack["subunits"]), F.when(pack["items"] > 0, pack["items"])
    times = lambda n: numbers.commercial(q * n)
    family, sentence = canonical(label), canonical(said)
    portion = F.get(F.filter(F.coalesce(precisions, F.array().cast(PRECISIONS)), lambda p: (p["unit"] == "KG") & p["quantity"].isin(0.125, 0.25, 0.5)), F.lit(0))["quantity"]
    tub = order.isin(*TUBS) & family.rlike(r"\b(?:glace|glacee|sorbet)\b") & (F.abs(q - pack["litres"]) <= 0.01) & (pack["litres"] > 0)
    carton, same = unit.isin(*CARTONS), pack["official_base"] == pack["official_source"]
    packaged = unit.isin(*PACKAGES)
    plain_unit = unit.isNull() | (unit == "PCE")
    per = F.coalesce(items, sub)
    near_whole = F.abs(q / per - F.bround(q / per, 0)) <= 0.05

    def by_size(of: Column) -> tuple[Column, Column]:
        n = numbers.commercial(F.greatest(F.lit(1.0), F.bround(q / of, 0)))
        return n, F.bround(30.0 / (1.0 + F.abs(n * of - q) / F.greatest(q, F.lit(0.1))), 2)

    (in_kg, kg_score), (in_litres, litre_score) = by_size(pack["kg"]), by_size(pack["litres"])
    return [
        Branch("quantite_absente_non_resolue", q.isNull(), None, order),
        Branch("portions_converties_en_kg", (order == "KG") & portion.isNotNull(), times(portion), F.lit("KG"), 38.0),
        Branch("contenance_bac_glace_resolue_en_unite", tub & ((unit == "L") | unit.isNull() & (q != F.floor(q))), F.lit(1.0), F.lit("BOITE"), 38.0),
        Branch("emballage_aligne_controle_references", carton & official.isin(*CARTONS), own, official, 36.0),
        Branch("pack_converti_par_controle_references", sentence.rlike(r"\bpacks?\b") & (size > 1) & (official != "PACK") & same, times(size), official, 36.0),
        Branch("colisage_controle_references_officiel", carton & (size > 1) & (pack["official_base"] != "") & same, times(size), official, 36.0),
        Branch("conditionnement_article_appris_agrege", factor > 0, times(factor), F.coalesce(F.upper(_filled(target)), order), 34.0),
        Branch("unite_metier_deja_alignee", unit.isin("KG", "L") & (order == unit), own, order, 32.0),
        Branch("multiple_conditionnement_detecte", F.abs(multiple - sub) <= 0.05, F.when(order == "PCE", times(sub)).otherwise(own), order, 30.0),
        Branch("carton_colis_equivalents", carton & order.isin(*CARTONS), own, unit, 30.0),
        Branch("carton_converti_en_unites_de_vente", (unit == "CAR") & items.isNotNull(), times(items), order, 28.0),
        Branch("carton_conserve_en_colis", (unit == "CAR") & (order == "PCE"), own, F.lit("COL"), 25.0),
        Branch("emballages_exterieurs_equivalents", packaged & ~carton & order.isin(*PACKAGES), own, order, 30.0),
        Branch("carton_converti_en_pieces", packaged & (order == "PCE") & sub.isNotNull(), times(sub), order, 24.0),
        Branch("unite_emballage_alignee", packaged, own, F.when((order == "PCE") & F.rlike(said, F.lit(r"\bpot\b")), "BOITE").otherwise(order), 24.0),
        Branch("conversion_depuis_kg", (unit == "KG") & (pack["kg"] > 0), in_kg, order, kg_score),
        Branch("conversion_depuis_litre", (unit == "L") & (pack["litres"] > 0), in_litres, order, litre_score),
        Branch("dimension_physique_article_inconnue", unit.isin("KG", "L"), None, order),
        Branch("quantite_convertie_en_emballage", order.isin(*PACKAGES) & (q >= per) & (plain_unit | near_whole), numbers.commercial(F.when(plain_unit, F.ceil(q / per)).otherwise(q / per)), order, 23.0),
        Branch("unite_implicite_cadencier", unit.isNull(), own, order, 20.0),
        Branch("quantite_directe", F.lit(True), own, order, 18.0),
    ]


def resolved_quantity(quantity: Column, unit: Column, pack: Column, label: Column, multiple: Column | None = None, said: Column | None = None, precisions: Column | None = None, factor: Column | None = None, target: Column | None = None) -> Column:
    """struct(quantity, unit, score, reason) of an order line; columns that are left out say nothing."""
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    said = F.coalesce(none(said, "string"), F.lit(""))
    table = quantity_table(quantity.cast("double"), F.upper(_filled(unit)), none(multiple, "double"), said, none(precisions, PRECISIONS), label, pack, none(factor, "double"), none(target, "string"))
    return first_that_fits(table)


def explicit_containers(said: Column, order_unit: Column) -> Column:
    """The number right before the first package in a sentence of digits that can mean the order unit; null for none, 0 or over 10,000."""
    fits = F.lit(None).cast("string")
    for unit in sorted({u for units in CONTAINERS.values() for u in units}):
        fits = F.when(F.upper(F.trim(order_unit)) == unit, "|".join(n for n, u in CONTAINERS.items() if unit in u)).otherwise(fits)
    pattern = F.concat(F.lit(r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s+(?:"), fits, F.lit(r")\b"))
    value = lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")
    found = F.regexp_extract_all(F.lower(strip_accents(said)), pattern, F.lit(1))
    return F.get(F.filter(F.transform(found, value), lambda x: (x > 0) & (x <= 10_000)), F.lit(0))


def capacity_quantity(said: Column, capacity: Column, capacity_unit: Column, variable_weight: Column) -> Column:
    """struct(quantity, reason) of a sentence of digits, for a product whose order unit holds `capacity` kilograms or litres; null where nothing fits.

    A packaging named as it is (6x1L, or 3 packs of 6x1L) is that number of packages. A measure is divided by the capacity, and taken if that
    is within 0.02 of a quarter. Products of variable weight and without a capacity have no answer.
    """
    text = F.replace(F.lower(strip_accents(F.coalesce(said, F.lit("")))), F.lit(","), F.lit("."))
    named = rf"(?:{_NUMBER}\s*(?:packs?|cartons?|colis|caisses?|boites?)\s+(?:de\s+)?)?{_NUMBER}\s*[x×]\s*{_NUMBER}\s*(kg|k|g|l|ml)\b"
    part = lambda i: _filled(F.regexp_extract(text, named, i))
    unit = F.when(_weight(part(4)), "KG").otherwise("L")
    described = part(2).cast("double") * _base(part(3), part(4))
    as_named = (unit == capacity_unit) & (F.abs(described - capacity) <= F.greatest(F.lit(0.02), capacity * 0.02))
    spoken = r"(?<![0-9])([0-9]+(?:\.[0-9]+)?)\s*(kilogrammes?|kilos?|kg|litres?|l)(?:\b|$)"
    amount, measure = _filled(F.regexp_extract(text, spoken, 1)).cast("double"), F.regexp_extract(text, spoken, 2)
    measure_unit = F.when(F.startswith(measure, F.lit("k")), "KG").otherwise("L")
    share = amount / capacity
    quarters = F.bround(share * 4, 0) / 4
    as_measured = (measure_unit == capacity_unit) & (share > 0) & (F.abs(share - quarters) <= 0.02)
    result = lambda quantity, reason: F.struct(quantity.alias("quantity"), reason.alias("reason"))
    reason = F.concat(F.lit("mesure_"), F.lower(measure_unit), F.lit("_divisee_par_capacite_officielle"))
    known = (capacity > 0) & ~F.coalesce(variable_weight, F.lit(False))
    found = F.when(as_named, result(F.coalesce(part(1).cast("double"), F.lit(1.0)), F.lit("conditionnement_explicite_identique_au_referentiel"))).when(as_measured, result(quarters, reason))
    return F.when(known, found)
