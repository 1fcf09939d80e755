"""Queries on packaging: what labels of parts state, and order quantities in the units of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import packaging
from ..sources.tables import table

#: Packaging behind a part's name, by the remainder of its key; the sale unit, by that of its size; a ratio.
FORMS = ("6X1L", "2K X5P", "X10P", "2.5L GLACEE", "(12P)", "30P OEUFS", "75CL", "500G", "", "5 L", "12 x 0,5kg")
SALE_UNITS = (None, "COL", "PCE", "BOITE", "KG", None, "CAR", "SAC", "PACK", "POC")
RATIOS = (None, 6.0, 1.0, 10.2)
#: Reference rows of the parts of brands that end in 1 or 2, by the remainder of the key: order unit, pack size, base unit, unit of the source.
REFERENCES = (("CAR", 6.0, "PCE", "CAR"), ("PI", None, "PCE", "PCE"), ("COL", 5.0, "POC", "COL"), (None, 4.0, "POC", "POC"), ("BOITE", 2.0, "UNI", "UNI"))
#: What is said of the unit, by the remainder of the supplier's key.
SAID = (None, "PCE", "CAR", "COL", "KG", "L", "PACK")


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), key % len(values))


def _parts(spark, sf_dir) -> DataFrame:
    """p_partkey, label, pack of every part."""
    usual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("usual"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").join(usual, "p_partkey", "left")
    key = F.col("p_partkey").cast("int")
    row = F.get(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("order_unit", "pack_size", "base_unit", "source_unit"), r, ("string", "double", "string", "string"), strict=True)]) for r in REFERENCES]), key % len(REFERENCES))
    weight = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice").cast("double") / 1000)
    reference = F.when(F.col("p_brand").rlike("[12]$"), F.struct(*[row[c].alias(c) for c in ("order_unit", "pack_size", "base_unit", "source_unit")], weight.alias("average_weight")))
    parts = parts.select("p_partkey", F.concat_ws(" ", "p_name", _pick(FORMS, key)).alias("label"), _pick(SALE_UNITS, F.col("p_size")).alias("sale_unit"), "usual", _pick(RATIOS, F.col("p_size")).alias("ratio"), reference.alias("ref"))
    return packaging.with_packaging(parts, *[F.col(c) for c in ("label", "sale_unit", "usual", "ratio", "ref")]).select("p_partkey", "label", "pack")


def part_packaging(spark, sf_dir):
    """What the label, sale unit, usual quantity and reference row of each part say of its packaging."""
    sizes = [F.bround(F.col(f"pack.{c}"), 6).alias(c) for c in ("kg", "litres")]
    return _parts(spark, sf_dir).select("p_partkey", "pack.order_unit", *sizes, "pack.subunits", "pack.items", "pack.official_unit", "pack.source")


def order_quantities(spark, sf_dir):
    """Every order line's quantity and unit as said, in the unit that the part is ordered in, with the branch that decided."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_returnflag")
    rows = li.join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    said = _pick(SAID, F.col("l_suppkey").cast("int"))
    half = F.when(F.col("l_linenumber") == 6, 0.5).otherwise(0.0)
    quantity = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A"), None).when((F.col("l_linenumber") == 5) & said.isNull(), 2.5).otherwise(F.col("l_quantity").cast("double") + half)
    multiple = F.when(F.col("l_linenumber") == 1, 6.0).when(F.col("l_linenumber") == 2, 5.0)
    sentence = F.when(F.col("l_returnflag") == "R", "des packs").when(F.col("l_linenumber") == 3, "un pot de").otherwise("il me faut")
    precisions = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 4), F.array(F.struct(F.lit(0.25).alias("quantity"), F.lit("KG").alias("unit"))))
    learned = (F.col("l_partkey") % 13 == 0) & (said == "COL")
    line = packaging.resolved_quantity(quantity, said, F.col("pack"), F.col("label"), multiple, sentence, precisions, F.when(learned, 4.0), F.when(learned, "SAC"))
    return rows.select("l_orderkey", "l_linenumber", line.alias("r")).select("l_orderkey", "l_linenumber", F.bround("r.quantity", 3).alias("quantity"), "r.unit", F.bround("r.score", 2).alias("score"), "r.reason")


QUERIES = {"part_packaging": part_packaging, "order_quantities": order_quantities}

_PACKS = r"""
WITH usual AS (SELECT l_partkey AS p_partkey, avg(l_quantity) AS usual FROM lineitem GROUP BY l_partkey),
raw AS (
  SELECT p.p_partkey, p_name || ' ' || ['6X1L', '2K X5P', 'X10P', '2.5L GLACEE', '(12P)', '30P OEUFS', '75CL', '500G', '', '5 L', '12 x 0,5kg'][p.p_partkey % 11 + 1] AS label,
         [NULL, 'COL', 'PCE', 'BOITE', 'KG', NULL, 'CAR', 'SAC', 'PACK', 'POC'][p_size % 10 + 1] AS given, coalesce(usual, 0) AS usual, coalesce([NULL, 6.0, 1.0, 10.2][p_size % 4 + 1], 0)::DOUBLE AS ratio,
         right(p_brand, 1) IN ('1', '2') AS has, ['CAR', 'PI', 'COL', NULL, 'BOITE'][p.p_partkey % 5 + 1] AS ru, [6.0, NULL, 5.0, 4.0, 2.0][p.p_partkey % 5 + 1]::DOUBLE AS rp,
         ['PCE', 'PCE', 'POC', 'POC', 'UNI'][p.p_partkey % 5 + 1] AS rb, ['CAR', 'PCE', 'COL', 'POC', 'UNI'][p.p_partkey % 5 + 1] AS rs,
         CASE WHEN p_size % 3 = 0 THEN p_retailprice::DOUBLE / 1000 END AS rw
  FROM part p LEFT JOIN usual u ON p.p_partkey = u.p_partkey),
l0 AS (SELECT *, trim(regexp_replace(regexp_replace(lower(label), '([0-9])\s*[,.]\s*([0-9])', '\1.\2', 'g'), '[^a-z0-9.]+', ' ', 'g')) AS l FROM raw),
l1 AS (
  SELECT *, regexp_extract(l, '([0-9]+)\s*x\s*([0-9]+(?:\.[0-9]+)?)\s*(kg|k|g|l|cl|ml)\b', ['n', 's', 'u']) AS a,
         regexp_extract(l, '([0-9]+(?:\.[0-9]+)?)\s*(kg|k|g|l|cl|ml)\s*x\s*([0-9]+)\s*p?\b', ['s', 'u', 'n']) AS b,
         regexp_extract(l, '(?:x\s*([1-9][0-9]*)\s*p?\b|(?:^|[^a-z0-9])([1-9][0-9]*)\s*p\b)', ['i', 'j']) AS c,
         regexp_extract_all(l, '[0-9]+(?:\.[0-9]+)?\s*(?:kg|k|g|l|cl|ml)\b') AS z
  FROM l0),
l2 AS (
  SELECT *, coalesce(nullif(a.n, ''), nullif(b.n, ''))::INT AS many, CASE WHEN a.n <> '' THEN a.s ELSE nullif(b.s, '') END AS ms, CASE WHEN a.n <> '' THEN a.u ELSE nullif(b.u, '') END AS mu,
         coalesce(nullif(c.i, ''), nullif(c.j, ''))::INT AS items
  FROM l1),
l3 AS (SELECT *, ms::DOUBLE / CASE WHEN mu IN ('g', 'ml') THEN 1000 WHEN mu = 'cl' THEN 100 ELSE 1 END AS one, coalesce(given, 'PCE') AS u0 FROM l2),
l4 AS (
  SELECT *, coalesce(given IS NULL AND ratio > 0 AND abs(ratio - one * many) <= greatest(0.05, one * many * 0.25) AND abs(ratio - one * many) + 0.01 < abs(ratio - one), false) AS asp FROM l3),
l5 AS (
  SELECT *, CASE WHEN asp THEN 'COL' ELSE u0 END AS u1,
         CASE WHEN asp OR u0 IN ('COL', 'CAR', 'BOITE', 'PAL', 'SAC', 'PACK', 'BARQ', 'SEAU', 'BID') THEN one * many ELSE one END AS c1
  FROM l4),
l6 AS (
  SELECT *, coalesce(many, CASE WHEN u1 = 'PCE' THEN items END) AS sub, CASE WHEN c1 IS NULL AND len(z) > 0 THEN z[len(z)] END AS last,
         CASE WHEN given IS NULL AND usual > 0 AND usual < items THEN CASE WHEN contains(l, 'oeuf') OR contains(l, 'seau') OR items >= 20 THEN 'CAR' ELSE 'COL' END ELSE u1 END AS u2
  FROM l5),
l7 AS (SELECT *, regexp_extract(last, '[a-z]+$') AS lu, regexp_extract(last, '^[0-9.]+') AS ls FROM l6),
l8 AS (
  SELECT *, coalesce(c1, nullif(ls, '')::DOUBLE / CASE WHEN lu IN ('g', 'ml') THEN 1000 WHEN lu = 'cl' THEN 100 ELSE 1 END) AS c2, coalesce(mu, nullif(lu, '')) IN ('kg', 'k', 'g') AS w FROM l7),
l9 AS (
  SELECT *, CASE WHEN w THEN c2 END AS kg0, CASE WHEN NOT w THEN c2 END AS li0, CASE WHEN mu IN ('kg', 'k', 'g') THEN one END AS skg, CASE WHEN mu IN ('l', 'cl', 'ml') THEN one END AS sli,
         CASE WHEN a.n <> '' THEN 'libelle_multi' WHEN b.n <> '' THEN 'libelle_multi_inverse' WHEN items IS NOT NULL THEN 'libelle_items' WHEN last IS NOT NULL THEN 'libelle_taille_simple' ELSE 'defaut_piece' END AS src,
         CASE WHEN given IS NULL AND u2 = 'PCE' AND NOT w AND c2 >= 3 THEN 'BID' ELSE u2 END AS u3
  FROM l8),
m1 AS (SELECT *, CASE WHEN has AND ru = 'PI' THEN 'PCE' WHEN has AND ru IS NOT NULL THEN ru ELSE u3 END AS unit FROM l9),
m2 AS (SELECT *, unit IN ('COL', 'CAR', 'BOITE', 'PAL', 'SAC', 'PACK', 'BARQ', 'SEAU', 'BID') AS o FROM m1),
pack AS (
  SELECT p_partkey, label, unit AS order_unit,
         CASE WHEN has AND rb = rs AND rw > 0 THEN rw WHEN has AND sub > 0 AND o AND skg IS NOT NULL THEN skg * sub
              WHEN has AND rp > 1 AND src = 'libelle_taille_simple' AND o AND rb <> rs THEN kg0 * rp ELSE kg0 END AS kg,
         CASE WHEN has AND sub > 0 AND o AND sli IS NOT NULL THEN sli * sub WHEN has AND rp > 1 AND src = 'libelle_taille_simple' AND o AND rb <> rs THEN li0 * rp ELSE li0 END AS litres,
         sub AS subunits, CASE WHEN has AND rp > 1 AND rb IN ('PCE', 'UNI') AND unit IN ('CAR', 'COL') THEN rp::INT ELSE items END AS items,
         CASE WHEN has AND rp > 0 THEN rp END AS opack, CASE WHEN has THEN rb ELSE '' END AS obase, CASE WHEN has THEN rs ELSE '' END AS osource,
         CASE WHEN has AND ru IS NOT NULL THEN ru ELSE unit END AS official_unit, CASE WHEN has THEN 'controle_references_officiel' ELSE src END AS source
  FROM m2)"""

SQL = {
    "part_packaging": f"{_PACKS} SELECT p_partkey, order_unit, round_even(kg, 6) AS kg, round_even(litres, 6) AS litres, subunits, items, official_unit, source FROM pack",
    "order_quantities": _PACKS
    + r""",
said AS (
  SELECT l_orderkey, l_linenumber, pack.*, u, CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN NULL WHEN l_linenumber = 5 AND u IS NULL THEN 2.5 ELSE l_quantity::DOUBLE + CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 0 END END AS q,
         CASE l_linenumber WHEN 1 THEN 6 WHEN 2 THEN 5 END AS multiple, l_returnflag = 'R' AS packs, l_returnflag <> 'R' AND l_linenumber = 3 AS pot, l_returnflag = 'A' AND l_linenumber = 4 AS portion,
         l_partkey % 13 = 0 AND u = 'COL' AS learned, coalesce(items, subunits) AS per
  FROM (SELECT *, [NULL, 'PCE', 'CAR', 'COL', 'KG', 'L', 'PACK'][l_suppkey % 7 + 1] AS u FROM lineitem) JOIN pack ON l_partkey = p_partkey),
f AS (
  SELECT *, order_unit IN ('COL', 'CAR', 'BOITE', 'PAL', 'SAC', 'PACK', 'BARQ', 'SEAU', 'BID', 'POC') AS packed, u IN ('CAR', 'COL') AS carton,
         greatest(1.0, round_even(q / kg, 0)) AS nk, greatest(1.0, round_even(q / litres, 0)) AS nl
  FROM said),
r AS (
  SELECT *, CASE
    WHEN q IS NULL THEN 'quantite_absente_non_resolue'
    WHEN order_unit = 'KG' AND portion THEN 'portions_converties_en_kg'
    WHEN order_unit IN ('BOITE', 'PI', 'PCE', 'BAC') AND contains(label, 'GLACEE') AND abs(q - litres) <= 0.01 AND (u = 'L' OR u IS NULL AND q <> floor(q)) THEN 'contenance_bac_glace_resolue_en_unite'
    WHEN carton AND official_unit IN ('CAR', 'COL') THEN 'emballage_aligne_controle_references'
    WHEN packs AND opack > 1 AND official_unit <> 'PACK' AND obase = osource THEN 'pack_converti_par_controle_references'
    WHEN carton AND opack > 1 AND obase <> '' AND obase = osource THEN 'colisage_controle_references_officiel'
    WHEN learned THEN 'conditionnement_article_appris_agrege'
    WHEN u IN ('KG', 'L') AND order_unit = u THEN 'unite_metier_deja_alignee'
    WHEN subunits > 0 AND abs(multiple - subunits) <= 0.05 THEN 'multiple_conditionnement_detecte'
    WHEN carton AND order_unit IN ('CAR', 'COL') THEN 'carton_colis_equivalents'
    WHEN u = 'CAR' AND items IS NOT NULL THEN 'carton_converti_en_unites_de_vente'
    WHEN u = 'CAR' AND order_unit = 'PCE' THEN 'carton_conserve_en_colis'
    WHEN u = 'PACK' AND packed THEN 'emballages_exterieurs_equivalents'
    WHEN u IN ('PACK', 'CAR', 'COL') AND order_unit = 'PCE' AND subunits > 0 THEN 'carton_converti_en_pieces'
    WHEN u IN ('PACK', 'CAR', 'COL') THEN 'unite_emballage_alignee'
    WHEN u = 'KG' AND kg > 0 THEN 'conversion_depuis_kg'
    WHEN u = 'L' AND litres > 0 THEN 'conversion_depuis_litre'
    WHEN u IN ('KG', 'L') THEN 'dimension_physique_article_inconnue'
    WHEN packed AND q >= per AND (u IS NULL OR u = 'PCE' OR abs(q / per - round_even(q / per, 0)) <= 0.05) THEN 'quantite_convertie_en_emballage'
    WHEN u IS NULL THEN 'unite_implicite_cadencier' ELSE 'quantite_directe' END AS reason
  FROM f),
v AS (
  SELECT *, CASE reason
    WHEN 'quantite_absente_non_resolue' THEN NULL WHEN 'dimension_physique_article_inconnue' THEN NULL WHEN 'portions_converties_en_kg' THEN q * 0.25 WHEN 'contenance_bac_glace_resolue_en_unite' THEN 1.0
    WHEN 'pack_converti_par_controle_references' THEN q * opack WHEN 'colisage_controle_references_officiel' THEN q * opack WHEN 'conditionnement_article_appris_agrege' THEN q * 4
    WHEN 'multiple_conditionnement_detecte' THEN CASE WHEN order_unit = 'PCE' THEN q * subunits ELSE q END WHEN 'carton_converti_en_unites_de_vente' THEN q * items WHEN 'carton_converti_en_pieces' THEN q * subunits
    WHEN 'conversion_depuis_kg' THEN nk WHEN 'conversion_depuis_litre' THEN nl WHEN 'quantite_convertie_en_emballage' THEN CASE WHEN u IS NULL OR u = 'PCE' THEN ceil(q / per) ELSE q / per END ELSE q END AS x
  FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(x - round_even(x, 0)) <= 0.05 THEN round_even(x, 0) ELSE round_even(x, 3) END AS quantity,
       CASE reason WHEN 'portions_converties_en_kg' THEN 'KG' WHEN 'contenance_bac_glace_resolue_en_unite' THEN 'BOITE' WHEN 'emballage_aligne_controle_references' THEN official_unit
         WHEN 'pack_converti_par_controle_references' THEN official_unit WHEN 'colisage_controle_references_officiel' THEN official_unit WHEN 'conditionnement_article_appris_agrege' THEN 'SAC'
         WHEN 'carton_colis_equivalents' THEN u WHEN 'carton_conserve_en_colis' THEN 'COL' WHEN 'unite_emballage_alignee' THEN CASE WHEN order_unit = 'PCE' AND pot THEN 'BOITE' ELSE order_unit END ELSE order_unit END AS unit,
       CASE reason WHEN 'quantite_absente_non_resolue' THEN 0.0 WHEN 'dimension_physique_article_inconnue' THEN 0.0 WHEN 'portions_converties_en_kg' THEN 38.0 WHEN 'contenance_bac_glace_resolue_en_unite' THEN 38.0
         WHEN 'emballage_aligne_controle_references' THEN 36.0 WHEN 'pack_converti_par_controle_references' THEN 36.0 WHEN 'colisage_controle_references_officiel' THEN 36.0
         WHEN 'conditionnement_article_appris_agrege' THEN 34.0 WHEN 'unite_metier_deja_alignee' THEN 32.0 WHEN 'multiple_conditionnement_detecte' THEN 30.0 WHEN 'carton_colis_equivalents' THEN 30.0
         WHEN 'carton_converti_en_unites_de_vente' THEN 28.0 WHEN 'carton_conserve_en_colis' THEN 25.0 WHEN 'emballages_exterieurs_equivalents' THEN 30.0 WHEN 'carton_converti_en_pieces' THEN 24.0
         WHEN 'unite_emballage_alignee' THEN 24.0 WHEN 'conversion_depuis_kg' THEN round_even(30.0 / (1.0 + abs(nk * kg - q) / greatest(q, 0.1)), 2)
         WHEN 'conversion_depuis_litre' THEN round_even(30.0 / (1.0 + abs(nl * litres - q) / greatest(q, 0.1)), 2)
         WHEN 'quantite_convertie_en_emballage' THEN 23.0 WHEN 'unite_implicite_cadencier' THEN 20.0 ELSE 18.0 END::DOUBLE AS score, reason
FROM v""",
}
