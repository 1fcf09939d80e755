"""Queries on order lines: products of a call as lines, statuses over versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import consolidation, mentions, resumable, validation
from ..sources.tables import table
from ..streaming.jobs import shared_folder


def consolidated_order_lines(spark, sf_dir):
    """Every order's recognised products as lines: a brand is the code that products share, the part's name what was said of it."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_suppkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"))
    rows = li.withColumn("place", place).join(p, F.col("l_partkey") == F.col("p_partkey"))
    at = lambda n, k: F.col("l_suppkey") % n == k
    products = rows.select(
        "l_orderkey", F.col("place").alias("index"), F.concat(F.lit("s"), F.col("place") % 3).alias("segment"), F.when(~at(19, 4), F.col("p_brand")).alias("code"), F.col("p_type").alias("label"),
        F.concat(F.lit("2 de "), F.col("p_name")).alias("said"), F.when(~at(7, 3), F.col("l_quantity").cast("double")).alias("quantity"), F.lit(None).cast("double").alias("quantity_said"),
        F.when(at(3, 0), "PCE").when(at(3, 1), "KG").alias("unit"), F.when(at(2, 0), "pce").alias("unit_said"), F.when(at(11, 0), 0.0).otherwise(1.0).alias("price"),
        (100 * F.col("l_discount")).cast("int").cast("double").alias("score"), (100 * F.col("l_tax")).cast("int").cast("double").alias("selection_score"), F.lit(60.0).alias("text_score"),
        (F.col("l_returnflag") != "R").alias("reliable"), (F.col("p_size") % 4 == 0).alias("ambiguous"), F.when(at(23, 5), False).when(~at(14, 3), True).alias("recognised"),
        F.when(F.col("p_size") % 8 == 0, F.array(F.lit("autre"), F.lit("quantite_commande_non_resolue"))).otherwise(F.array(F.lit("quantite_absente_a_resoudre"))).alias("reasons"),
    )
    return products


def order_line_consolidation(spark, sf_dir):
    """The lines: what is said twice under one code is one line, of the better of both."""
    lines, _ = consolidation.order_lines(consolidated_order_lines(spark, sf_dir), "l_orderkey")
    return lines.select("l_orderkey", "line", "code", "quantity", "inferred", "unit", "reliable", "ambiguous", "source")


def order_line_reasons(spark, sf_dir):
    """The reasons of each order, and those that hold it back."""
    lines, reasons = consolidation.order_lines(consolidated_order_lines(spark, sf_dir), "l_orderkey")
    has = ~F.array_contains("reasons", "produit_non_vendu_aucune_selection")
    blocking = F.size(consolidation.blocking(F.col("reasons"), has))
    return reasons.withColumn("n_blocking", blocking).select("l_orderkey", F.array_join("reasons", " ").alias("reasons"), "n_blocking")


def status_over_versions(spark, sf_dir):
    """Three versions of every order, by keys: a status that rises when something changed, the client is known and nothing blocks, and never falls."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumn("version", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    step = F.col("o_orderkey") + F.col("version")
    o = o.withColumns({"known": F.col("o_custkey") % 5 > 0, "blocked": step % 3 == 0, "changed": step % 2 == 0, "accepted": (F.col("o_orderstatus") == "F") & (F.col("version") == 2)})
    return consolidation.rising_status(o, "o_orderkey", "version", "known", "blocked", "changed", "accepted").select("o_orderkey", "version", "status")


def resumed_results(spark, sf_dir):
    """Every order once through a long run that is taken up again: a first run had other payloads for some orders, the second computes those anew and keeps the rest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("payload"))
    key = F.col("o_orderkey")
    stale = o.withColumn("payload", F.when(key % 3 == 0, "old").otherwise(F.col("payload")))
    signed = lambda df: df.withColumn("digest", F.when(key % 31 == 1, "none").otherwise(F.sha2("payload", 256)))

    def compute(todo):
        made = todo.where(key % 50 != 7)
        urgent = F.contains("payload", F.lit("URGENT"))
        return made.select("o_orderkey", F.when(~urgent, F.reverse("payload")).alias("result"), F.when(urgent, "cannot wait").alias("error"))

    path = shared_folder(spark, "resumable")
    for inputs in (stale, o):
        found = resumable.resumable(signed(inputs), "o_orderkey", "payload", "digest", "v1", path, compute)
    return found


def tidied_mentions(spark, sf_dir):
    """Each order's lines as mentions of a call in which some are said twice, some again with a number, without repeats and rewordings. No SQL: a fold over lines that change; tests hold it against expected tables."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    mention = lambda quantity: F.struct(F.col("p_name").alias("product"), quantity.alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("multiple"), F.col("p_name").alias("said"), *[F.array().cast("array<string>").alias(c) for c in ("precisions", "exclusions", "reasons")])
    counted, bare = mention(F.col("l_quantity").cast("double")), mention(F.lit(None).cast("double"))
    said = F.when(F.col("l_suppkey") % 5 == 0, F.array(counted, counted)).when(F.col("l_suppkey") % 5 == 1, F.array(bare, counted)).otherwise(F.array(counted))
    calls = li.groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", said.alias("said")))), lambda x: x["said"])).alias("mentions"))
    rows = calls.select("l_orderkey", F.posexplode(mentions.tidied(F.col("mentions"))).alias("position", "m"))
    return rows.select("l_orderkey", "position", "m.product", "m.quantity", F.array_join("m.reasons", " ").alias("reasons"))


QUERIES = {f.__name__: f for f in (order_line_consolidation, order_line_reasons, status_over_versions, resumed_results, tidied_mentions)}
_P = """
WITH r AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag)::INT AS i, CASE WHEN l_suppkey % 19 <> 4 THEN p_brand END AS code, CASE WHEN l_suppkey % 7 <> 3 THEN l_quantity::DOUBLE END AS q,
         CASE l_suppkey % 3 WHEN 0 THEN 'PI' WHEN 1 THEN 'KG' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'PI' END END AS unit, l_suppkey % 2 = 0 AS said, CASE WHEN l_suppkey % 11 = 0 THEN 0.0 ELSE 1.0 END AS price,
         trunc(100 * l_discount)::INT AS score, trunc(100 * l_tax)::INT AS selection, l_returnflag <> 'R' AS reliable, p_size % 4 = 0 AS ambiguous,
         CASE WHEN l_suppkey % 23 = 5 THEN false WHEN l_suppkey % 14 <> 3 THEN true END AS recognised, p_size % 8 = 0 AS other
  FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT *, code IS NOT NULL AND coalesce(recognised, true) AS chosen, q IS NULL AND coalesce(recognised, false) AS inferred FROM r),
p AS (SELECT o, i, code, coalesce(q, 1.0) AS q, inferred, unit, price, score, selection, said, reliable OR inferred AS reliable, CASE WHEN inferred THEN other ELSE ambiguous END AS ambiguous FROM c WHERE chosen AND (q IS NOT NULL OR inferred)),
b AS (SELECT *, min(i) OVER g AS created, count(*) OVER g AS n, row_number() OVER (PARTITION BY o, code ORDER BY reliable DESC, ambiguous, score DESC, selection DESC, said DESC, i DESC) AS best FROM p WINDOW g AS (PARTITION BY o, code)),
l AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY created) AS line FROM b WHERE best = 1)"""
SQL = {
    "order_line_consolidation": f"{_P} SELECT o AS l_orderkey, line::INT AS line, code, q AS quantity, inferred, unit, reliable, ambiguous, i AS source FROM l",
    "order_line_reasons": f"""{_P},
x AS (
  SELECT o, 'quantite_implicite_un_ligne_' || i AS r FROM c WHERE chosen AND inferred UNION ALL SELECT o, 'quantite_absente_ligne_' || i FROM c WHERE chosen AND q IS NULL AND NOT inferred
  UNION ALL SELECT o, 'article_duplique_consolide_' || code FROM l WHERE n > 1 UNION ALL SELECT o, 'produit_non_fiable_ligne_' || line FROM l WHERE NOT reliable
  UNION ALL SELECT o, 'produit_ambigu_ligne_' || line FROM l WHERE ambiguous UNION ALL SELECT o, 'produit_non_vendu_prix_zero_ligne_' || line FROM l WHERE price = 0
  UNION ALL SELECT o, 'produit_non_vendu_aucune_selection' FROM (SELECT o FROM r EXCEPT SELECT o FROM l)),
y AS (SELECT o, list_sort(list_distinct(list(r))) AS r FROM x GROUP BY o),
z AS (SELECT DISTINCT o, coalesce(y.r, []) AS r FROM r LEFT JOIN y USING (o))
SELECT o AS l_orderkey, array_to_string(r, ' ') AS reasons,
       len(list_filter(r, lambda t: NOT starts_with(t, 'article_duplique') AND NOT (starts_with(t, 'quantite_absente_ligne_') AND NOT list_contains(r, 'produit_non_vendu_aucune_selection'))))::INT AS n_blocking FROM z""",
    "status_over_versions": """
WITH v AS (
  SELECT o_orderkey, v AS version, (o_orderstatus = 'F' AND v = 2) OR ((o_orderkey + v) % 2 = 0 AND o_custkey % 5 > 0 AND (o_orderkey + v) % 3 <> 0) AS up FROM orders, (VALUES (1), (2), (3)) AS x(v))
SELECT o_orderkey, version, CASE WHEN bool_or(up) OVER (PARTITION BY o_orderkey ORDER BY version) THEN 'VALIDEE' ELSE 'PROBLEMATIQUE' END AS status FROM v""",
    "resumed_results": """
WITH o AS (SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS p, o_orderkey % 31 <> 1 AS ok, o_orderkey % 50 <> 7 AS out FROM orders)
SELECT o_orderkey, CASE WHEN ok AND out AND NOT contains(p, 'URGENT') THEN reverse(p) END AS result,
       CASE WHEN NOT ok THEN 'hash_transcription_incorrect' WHEN NOT out THEN 'aucune_sortie_du_moteur' WHEN contains(p, 'URGENT') THEN 'cannot wait' END AS error FROM o""",
}


def model_line_checks(spark, sf_dir):
    """Lines that a model might propose for each order, some of them wrong, checked against parts and the order's transcript; accepted ones joined by part."""
    key = F.col("l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag").join(p, key == F.col("p_partkey"))
    q, s = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey")
    sentence = F.when(s % 3 == 0, F.concat(q, F.lit(" cartons de "), "p_name")).when(s % 3 == 1, F.concat(q, F.lit(" litres "), "p_name")).otherwise(F.concat_ws(" ", "p_name", q))
    rows = li.withColumn("sentence", F.when(s % 11 == 0, F.concat("p_name", F.lit(" "), q, F.lit(" %"))).otherwise(sentence))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"))
    lines = rows.select(
        "l_orderkey", place.alias("index"), F.when(s % 13 > 0, key.cast("string")).otherwise("none").alias("code"), "sentence", "l_returnflag",
        F.when(s % 17 == 0, 0.0).otherwise(F.col("l_quantity").cast("double")).alias("quantity"), F.when(s % 5 > 0, "pi").alias("unit"), (0.3 + F.col("l_discount")).alias("confidence"),
    )
    # what is returned was not said in the call
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", F.struct("index", "sentence")))), lambda x: x["sentence"]), ", ")
    transcripts = lines.groupBy("l_orderkey").agg(said.alias("transcript"))
    catalogue = p.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 3 == 0, "CAR").when(F.col("p_partkey") % 3 == 1, "BID").alias("unit"), F.when(F.col("p_size") % 2 == 0, 2.0).alias("capacity"), F.lit("L").alias("capacity_unit"), (F.col("p_size") % 8 == 0).alias("variable_weight"))
    checked = validation.checked_lines(lines.withColumn("source", F.col("sentence")).drop("sentence", "l_returnflag"), catalogue, transcripts, "l_orderkey")
    return checked.select("l_orderkey", "index", "code", "quantity", "unit", "quantity_resolution", F.array_join("reasons", " ").alias("reasons"))


QUERIES["model_line_checks"] = model_line_checks
SQL["model_line_checks"] = """
WITH r AS (
  SELECT l.*, p_name, p_size, l_quantity::INT::VARCHAR AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag)::INT AS i FROM lineitem l JOIN part ON l_partkey = p_partkey),
s AS (
  SELECT *, CASE WHEN l_suppkey % 11 = 0 THEN p_name || ' ' || q || ' %' WHEN l_suppkey % 3 = 0 THEN q || ' cartons de ' || p_name WHEN l_suppkey % 3 = 1 THEN q || ' litres ' || p_name ELSE p_name || ' ' || q END AS t,
         l_suppkey % 13 > 0 AS known, CASE l_partkey % 3 WHEN 0 THEN 'CAR' WHEN 1 THEN 'BID' END AS u FROM r),
n AS (SELECT *, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS c FROM s),
f AS (SELECT l_orderkey, coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE l_returnflag <> 'R'), '') AS full_text FROM n GROUP BY 1),
w AS (SELECT n.*, full_text, list_filter(string_split(c, ' '), lambda x: length(x) >= 3) AS w FROM n JOIN f USING (l_orderkey)),
v AS (
  SELECT *, CASE WHEN known AND u = 'CAR' AND l_suppkey % 11 > 0 AND l_suppkey % 3 = 0 AND l_quantity > 0 THEN l_quantity::INT::DOUBLE END AS counted,
         CASE WHEN known AND p_size % 2 = 0 AND p_size % 8 > 0 AND l_suppkey % 11 > 0 AND l_suppkey % 3 = 1 AND l_quantity > 0 THEN l_quantity::INT / 2.0::DOUBLE END AS held,
         c <> '' AND full_text <> '' AND (contains(full_text, c) OR len(w) > 0 AND len(list_filter(w, lambda x: list_contains(string_split(full_text, ' '), x))) / len(w) >= 0.6) AS proof FROM w)
SELECT l_orderkey, i AS index, CASE WHEN known THEN l_partkey::VARCHAR ELSE 'none' END AS code, coalesce(counted, held, CASE WHEN l_suppkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_quantity END) AS quantity,
       coalesce(CASE WHEN known THEN u END, CASE WHEN l_suppkey % 5 > 0 THEN 'PI' ELSE '' END) AS unit,
       CASE WHEN counted IS NOT NULL THEN 'nombre_explicite' WHEN held IS NOT NULL THEN 'mesure_l_divisee_par_capacite_officielle' ELSE 'llama_quantity' END AS quantity_resolution,
       concat_ws(' ', CASE WHEN NOT known THEN 'code_hors_catalogue_autorise' END, CASE WHEN l_suppkey % 17 = 0 OR l_quantity <= 0 THEN 'quantite_invalide' END, CASE WHEN l_suppkey % 11 = 0 THEN 'quantite_non_prouvee_transcription' END,
         CASE WHEN (u IS NULL OR NOT known) AND l_suppkey % 5 = 0 THEN 'unite_incompatible_catalogue' END, CASE WHEN 0.3::DOUBLE + l_discount < 0.35::DOUBLE THEN 'confiance_insuffisante' END, CASE WHEN NOT proof THEN 'preuve_absente_transcription' END) AS reasons
FROM v"""
