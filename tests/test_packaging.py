import pytest
from orderloom.operators.packaging import CONTAINERS, PRECISIONS, REFERENCE, capacity_quantity, explicit_containers, resolved_quantity, with_packaging
from pyspark.sql import functions as F

GOODS = f"label string, sale_unit string, usual double, ratio double, ref {REFERENCE}"


def packed(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], GOODS)
    return with_packaging(df, *[F.col(c) for c in ("label", "sale_unit", "usual", "ratio", "ref")])


#: label, sale unit, usual quantity, ratio, reference; order unit, kg, litres, subunits, items, source
PACKS = [
    (("LAIT UHT 6X1L", "PACK"), ("PACK", None, 6.0, 6, None, "libelle_multi")),
    (("LAIT UHT 6X1L", "PCE"), ("PCE", None, 1.0, 6, None, "libelle_multi")),
    (("LAIT UHT 6 x 1 L", None, None, 6.2), ("COL", None, 6.0, 6, 1, "libelle_multi")),
    (("LAIT 6X1L", None, None, 1.03), ("PCE", None, 1.0, 6, None, "libelle_multi")),
    (("LAIT 6X1L", None, None, None), ("PCE", None, 1.0, 6, None, "libelle_multi")),
    (("GLACON 2K X5P", "COL"), ("COL", 10.0, None, 5, 5, "libelle_multi_inverse")),
    (("GLACON 2K X5P", "PCE"), ("PCE", 2.0, None, 5, 5, "libelle_multi_inverse")),
    (("CHEVRE X10P", "PCE"), ("PCE", None, None, 10, 10, "libelle_items")),
    (("CHEVRE (10P) 150G", "CAR"), ("CAR", 0.15, None, None, 10, "libelle_items")),
    (("OEUFS 30P", None, 2.0), ("CAR", None, None, 30, 30, "libelle_items")),
    (("PAIN 12P", None, 3.0), ("COL", None, None, 12, 12, "libelle_items")),
    (("PAIN 12P", None, 24.0), ("PCE", None, None, 12, 12, "libelle_items")),
    (("2.5L YAOURT CRÈME GLACÉE", "BOITE"), ("BOITE", None, 2.5, None, None, "libelle_taille_simple")),
    (("HUILE 2 , 5 L", None), ("PCE", None, 2.5, None, None, "libelle_taille_simple")),
    (("HUILE 5L", None), ("BID", None, 5.0, None, None, "libelle_taille_simple")),
    (("SIROP 75CL 200ML", ""), ("PCE", None, 0.2, None, None, "libelle_taille_simple")),
    (("BURRATA 125G X6P", "car"), ("CAR", 0.75, None, 6, 6, "libelle_multi_inverse")),
    (("CREME X0", "PCE"), ("PCE", None, None, None, None, "defaut_piece")),
    ((None, None), ("PCE", None, None, None, None, "defaut_piece")),
    (("COSSETTE 2KG", "POC", None, None, ("COL", 5.0, "POC", "COL", 0.0)), ("COL", 10.0, None, None, None, "controle_references_officiel")),
    (("EAU 6X1L", "PCE", None, None, ("CAR", 6.0, "PCE", "CAR", None)), ("CAR", None, 6.0, 6, 6, "controle_references_officiel")),
    (("JAMBON 3KG", "PCE", None, None, ("PI", None, "PCE", "PCE", 2.7)), ("PCE", 2.7, None, None, None, "controle_references_officiel")),
    (("JAMBON 3KG", "KG", None, None, (None, None, None, None, None)), ("KG", 3.0, None, None, None, "controle_references_officiel")),
]


def test_packs_of_labels(spark):
    got = [r.pack for r in packed(spark, [g for g, _ in PACKS]).coalesce(1).collect()]
    for (goods, want), p in zip(PACKS, got, strict=True):
        found = (p.order_unit, p.kg, p.litres, p.subunits, p["items"], p.source)
        assert found == pytest.approx(want), goods


def ref(unit, size, base=None, source=None):
    return (unit, size, base, source, None)


#: goods; quantity, unit, multiple, sentence, precisions, factor, target; quantity, unit, score, reason: one or more for each branch
LINES = [
    (("x", "KG"), (None, "KG"), (None, "KG", 0, "quantite_absente_non_resolue")),
    (("beurre 250g", "KG"), (4.0, "PCE", None, None, [(0.25, "KG")]), (1.0, "KG", 38, "portions_converties_en_kg")),
    (("beurre 250g", "KG"), (4.0, None, None, None, [(2.0, "KG"), (0.125, "PCE"), (0.5, "KG")]), (2.0, "KG", 38, "portions_converties_en_kg")),
    (("2.5L YAOURT GLACE", "BOITE"), (2.5, None), (1.0, "BOITE", 38, "contenance_bac_glace_resolue_en_unite")),
    (("5L SORBET", "PCE"), (5.0, "L"), (1.0, "BOITE", 38, "contenance_bac_glace_resolue_en_unite")),
    (("5L SORBET", "PCE"), (5.0, None), (5.0, "PCE", 20, "unite_implicite_cadencier")),
    (("x", "CAR"), (3.0, "COL"), (3.0, "CAR", 36, "emballage_aligne_controle_references")),
    (("eau 1l", "PCE", None, None, ref("PCE", 6.0, "PCE", "PCE")), (2.0, "PACK", None, "2 packs d'eau"), (12.0, "PCE", 36, "pack_converti_par_controle_references")),
    (("mozzarella 2.5k", "POC", None, None, ref("POC", 4.0, "POC", "POC")), (2.0, "CAR"), (8.0, "POC", 36, "colisage_controle_references_officiel")),
    (("x", "PCE"), (2.0, "SAC", None, None, None, 5.0, "kg"), (10.0, "KG", 34, "conditionnement_article_appris_agrege")),
    (("beurre doux 250g", "KG"), (2.0, "KG"), (2.0, "KG", 32, "unite_metier_deja_alignee")),
    (("lait 6x1l", "PCE"), (2.0, "PCE", 6.0), (12.0, "PCE", 30, "multiple_conditionnement_detecte")),
    (("lait 6x1l", "PACK"), (2.0, "PCE", 6.0), (2.0, "PACK", 30, "multiple_conditionnement_detecte")),
    (("x", "CAR", None, None, ref("CAR", None)), (2.0, "CAR"), (2.0, "CAR", 36, "emballage_aligne_controle_references")),
    (("chevre x10p", "PCE"), (2.0, "CAR"), (20.0, "PCE", 28, "carton_converti_en_unites_de_vente")),
    (("x", "PCE"), (2.0, "CAR"), (2.0, "COL", 25, "carton_conserve_en_colis")),
    (("x", "SAC"), (2.0, "PACK"), (2.0, "SAC", 30, "emballages_exterieurs_equivalents")),
    (("lait 6x1l", "PCE"), (2.0, "PACK"), (12.0, "PCE", 24, "carton_converti_en_pieces")),
    (("creme", "PCE"), (2.0, "SAC", None, "2 pot de creme"), (2.0, "BOITE", 24, "unite_emballage_alignee")),
    (("creme", "KG"), (2.0, "SAC"), (2.0, "KG", 24, "unite_emballage_alignee")),
    (("glacon 2k x5p", "COL"), (20.0, "KG"), (2.0, "COL", 30, "conversion_depuis_kg")),
    (("farine 10kg", "SAC"), (12.0, "KG"), (1.0, "SAC", 25.71, "conversion_depuis_kg")),
    (("lait uht 6x1l", "PACK"), (6.0, "L"), (1.0, "PACK", 30, "conversion_depuis_litre")),
    (("2.5L YAOURT BULGARE CREME GLACEE", "BOITE"), (15.0, "L"), (6.0, "BOITE", 30, "conversion_depuis_litre")),
    (("vin", "BOITE"), (10.0, "L"), (None, "BOITE", 0, "dimension_physique_article_inconnue")),
    (("burrata 125g x6p", "CAR"), (16.0, "PCE"), (3.0, "CAR", 23, "quantite_convertie_en_emballage")),
    (("pain 12p", "COL"), (24.0, None), (2.0, "COL", 23, "quantite_convertie_en_emballage")),
    (("pain 12p", "COL"), (4.0, None), (4.0, "COL", 20, "unite_implicite_cadencier")),
    (("creme x0", "PCE"), (2.0, "PCE"), (2.0, "PCE", 18, "quantite_directe")),
    (("x", "PCE"), (2.004, "PCE"), (2.0, "PCE", 18, "quantite_directe")),
    (("x", "PCE"), (2.12345, "PCE"), (2.123, "PCE", 18, "quantite_directe")),
]


def test_a_line_for_every_branch(spark):
    said = [(*a, *b, *[None] * (7 - len(b))) for (a, b) in (((*g, *[None] * (5 - len(g))), m) for g, m, _ in LINES)]
    df = spark.createDataFrame(said, f"{GOODS}, q double, unit string, multiple double, said string, precisions {PRECISIONS}, factor double, target string").coalesce(1)
    df = with_packaging(df, *[F.col(c) for c in ("label", "sale_unit", "usual", "ratio", "ref")])
    line = resolved_quantity(*[F.col(c) for c in ("q", "unit", "pack", "label", "multiple", "said", "precisions", "factor", "target")])
    for (goods, mention, want), r in zip(LINES, df.select(line.alias("r")).collect(), strict=True):
        assert (r.r.quantity, r.r.unit, r.r.score, r.r.reason) == pytest.approx(want), (goods, mention)


def test_names_of_the_rows_stay(spark):
    assert packed(spark, [("a 2kg", "KG")]).columns == ["label", "sale_unit", "usual", "ratio", "ref", "pack"]
    assert packed(spark, []).count() == 0


def test_explicit_containers(spark):
    rows = [("3 cartons et 2 packs", "COL", 3.0), ("3 cartons et 2 packs", "PACK", 2.0), ("2,5 boîtes", "boite", 2.5), ("2 paquets", "PACK", 2.0), ("5 pots", "PI", 5.0), ("12 sacs", "BOITE", None), ("0 sac puis 4 sacs", "SAC", 4.0), ("20000 sacs", "SAC", None), ("x", None, None), (None, "SAC", None), ("3 colisages", "COL", None), ("2 bidons", "PI", 2.0), ("4 sachets et 3 poches", "POC", 4.0), ("4 poches", "SACH", None)]
    df = spark.createDataFrame(rows, "said string, unit string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", explicit_containers(F.col("said"), F.col("unit"))).collect())
    assert {u for units in CONTAINERS.values() for u in units} >= {"CAR", "COL", "PACK", "SACH", "PCE"}


def test_quantities_by_capacity(spark):
    named, by_l, by_kg = "conditionnement_explicite_identique_au_referentiel", "mesure_l_divisee_par_capacite_officielle", "mesure_kg_divisee_par_capacite_officielle"
    rows = [
        ("du lait 6x1L", 6.0, "L", None, 1.0, named), ("3 packs de 6x1l", 6.0, "L", False, 3.0, named), ("2 cartons 5 x 2,0 kg", 10.0, "KG", False, 2.0, named), ("4x250g", 1.0, "KG", False, 1.0, named),
        ("12 litres", 6.0, "L", False, 2.0, by_l), ("1.5 kilos", 6.0, "KG", False, 0.25, by_kg), ("7 litres", 6.0, "L", False, None, None), ("12 litres", 6.0, "KG", False, None, None),
        ("12 litres", 6.0, "L", True, None, None), ("12 litres", 0.0, "L", False, None, None), ("12 litres", None, "L", False, None, None), ("rien", 6.0, "L", False, None, None), (None, 6.0, "L", False, None, None),
    ]
    df = spark.createDataFrame(rows, "said string, capacity double, unit string, variable boolean, quantity double, reason string")
    got = df.withColumn("got", capacity_quantity(F.col("said"), F.col("capacity"), F.col("unit"), F.col("variable"))).collect()
    for r in got:
        assert (tuple(r.got) if r.got else (None, None)) == (r.quantity, r.reason), r
