"""Queries on what there is to choose from: authorised catalogues, nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import nested, retrieval, synonyms
from ..sources.tables import table
from . import ratios

#: Items of a catalogue; matches of a query; rounds in which every query gets one.
QUOTA, MATCHES, ROUNDS = 50, 12, 3


def authorised_catalogue(spark, sf_dir):
    """For each customer 50 parts: what it bought, what its newest order has, families of that order's names, the best matches of each name in turn, further matches."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    label = F.concat_ws(" ", "p_name", F.concat(F.lit("serie"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("x"), "p_size"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", label.alias("label"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.groupBy("o_custkey", F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sales"))
    newest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o")).select(F.col("o.o_orderkey").alias("l_orderkey"))
    asked = lines.join(newest, "l_orderkey", "left_semi").select("o_custkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    queries = asked.join(parts, "p_partkey").groupBy("o_custkey", "label", "p_brand", "p_type", "p_size").agg(F.min("l_linenumber").alias("query"))
    place = lambda stage, major, minor: [F.lit(stage).alias("stage"), major.cast("double").alias("major"), minor.cast("double").alias("minor")]
    history = sold.select("o_custkey", "p_partkey", *place(0, -F.col("sales"), -F.col("p_partkey")))
    initial = asked.select("o_custkey", "p_partkey", *place(1, F.lit(0), F.col("l_linenumber")))
    family = retrieval.families(queries, parts, "o_custkey", "label", "p_partkey", "label").join(sold, ["o_custkey", "p_partkey"], "left")
    family = family.select("o_custkey", "p_partkey", *place(2, F.col("size"), -F.coalesce("sales", F.lit(0))))
    # matches: of the same brand and type, nearest in size; found once for each kind of query and not for each customer
    kinds = queries.select("p_brand", "p_type", "p_size").distinct()
    near = kinds.join(parts.select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("size")), ["p_brand", "p_type"])
    w = Window.partitionBy("p_brand", "p_type", "p_size").orderBy(F.abs(F.col("size") - F.col("p_size")), "p_partkey")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MATCHES).select("p_brand", "p_type", "p_size", "p_partkey", "rank")
    matches = queries.join(near, ["p_brand", "p_type", "p_size"])
    in_turn = F.when(F.col("rank") <= ROUNDS, 3).otherwise(4).alias("stage")
    matches = matches.select("o_custkey", "p_partkey", in_turn, F.col("rank").cast("double").alias("major"), F.col("query").cast("double").alias("minor"))
    lists = reduce(DataFrame.unionByName, [history, initial, family, matches])
    return retrieval.merged_lists(lists, "o_custkey", "p_partkey", QUOTA)


def nested_code_labels(spark, sf_dir):
    """For each code that stands beside a label anywhere in the events' JSON, four levels deep, the label that it mostly has."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.col("value").cast("int").alias("v"))
    pair = lambda code, label: [code.alias("code"), label.alias("produit")]
    deep = F.struct(*pair(F.concat(F.lit("d"), F.col("v") % 7), F.upper("event_type")))
    lines = F.array(
        F.struct(*pair((F.col("user_id") % 50).cast("string"), F.col("event_type")), F.struct(F.array(deep).alias("deep")).alias("more")),
        F.struct(*pair(F.when(F.col("v") % 3 > 0, F.concat(F.lit(" c"), F.col("v") % 11)), F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))), F.lit(None).cast(f"struct<deep: array<{'struct<code: string, produit: string>'}>>").alias("more")),
    )
    text = F.to_json(F.struct(*pair(F.col("user_id").cast("string"), F.lit("")), lines.alias("lines"), F.from_json("props", "map<string, string>").alias("props")))
    return nested.labels_of_codes(e.select("event_id", text.alias("json")), "event_id", "json", "code", "produit", depth=6)


#: Keys of a manifest's row; parts that no key may have.
ALLOWED, FORBIDDEN = ("audio", "transcription_sha256"), ("truth", "erp", "order_number", "article", "product", "client_code", "commande_reelle")


def manifest_faults(spark, sf_dir):
    """Faults of a manifest with a row for each document, some of them with other keys, nested targets, names that repeat or have a folder, digests of another form."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    at = lambda n, k: F.col("doc_id") % n == k
    name = F.when(at(10, 3), F.concat(F.lit("in/"), F.col("doc_id"))).otherwise(F.concat(F.lit("call-"), F.floor(F.col("doc_id") / F.when(at(10, 1) | at(10, 0), 2).otherwise(1)), F.lit("-"), F.col("doc_id") % 10 < 2))
    audit = F.when(at(10, 5), F.struct(F.array(F.struct(F.lit(1).alias("Truth_rows"), F.lit(2).alias("plain"))).alias("items")))
    row = F.struct(name.alias("audio"), F.when(at(10, 7), F.substring(sha, 1, 40)).otherwise(F.upper(sha)).alias("transcription_sha256"), F.when(at(10, 6), F.col("lang")).alias("lang"), audit.alias("audit"), F.when(at(20, 8), F.lit(1)).alias("ErpOrder"))
    text = F.when(at(50, 9), "not json").otherwise(F.to_json(row))
    report = nested.manifest_report(d.select("doc_id", text.alias("json")), "doc_id", "json", ALLOWED, FORBIDDEN, "audio", "transcription_sha256", depth=4)
    return report.select("doc_id", F.array_join("faults", " ").alias("faults"))


#: Synonyms of words of part names.
GROUPS = {"ring": ["anneau", "bague"], "widget": ["gadget", "petit machin"], "red widget": ["machin rouge", "widget cerise"], "small ring": ["petite bague", "anneau fin"], "gear wheel": ["roue dentee"], "large plate": ["grande plaque", "plate geante"]}


def part_search_variants(spark, sf_dir):
    """What each distinct part name, as it is and misheard, becomes by declared synonyms, and the alias that confirms the part."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    heard = F.explode(F.array("p_name", F.concat_ws(" ", last, first), F.concat_ws(" ", F.lit("une"), first, F.concat(last, F.lit("s"))), F.concat_ws(" ", F.lit("une petite bague"), last))).alias("said")
    rows = names.select("p_name", heard).distinct()
    found = F.explode(synonyms.search_variants(F.col("said"), GROUPS)).alias("variant")
    return rows.select("p_name", "said", F.coalesce(synonyms.confirmed_by(F.col("said"), F.col("p_name"), GROUPS), F.lit("")).alias("alias"), found)


QUERIES = {f.__name__: f for f in (authorised_catalogue, nested_code_labels, manifest_faults, part_search_variants)}
SQL = {
    "authorised_catalogue": """
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, p_name || ' serie' || regexp_extract(p_brand, '[0-9]+') || 'x' || p_size AS label FROM part),
l AS (SELECT o_custkey, o_orderkey, o_orderdate, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sold AS (SELECT o_custkey, l_partkey AS p_partkey, count(*) AS sales FROM l GROUP BY ALL),
newest AS (SELECT o_custkey, max({'d': o_orderdate, 'k': o_orderkey}).k AS k FROM orders GROUP BY 1),
asked AS (SELECT l.o_custkey, l_linenumber, l_partkey AS p_partkey FROM l JOIN newest ON o_orderkey = k),
q AS (SELECT o_custkey, label, p_brand, p_type, p_size, min(l_linenumber) AS query FROM asked JOIN p USING (p_partkey) GROUP BY ALL),
w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(label), ' ')) AS word FROM p),
small AS (SELECT word, count(*) AS size FROM w WHERE length(word) >= 4 GROUP BY 1 HAVING count(*) <= 64),
t0 AS (SELECT DISTINCT label, unnest(string_split(lower(label), ' ')) AS word FROM q),
t AS (SELECT label, word FROM t0 WHERE length(word) >= 4 UNION SELECT label, word[:-2] FROM t0 WHERE length(word) > 4 AND suffix(word, 's') UNION SELECT label, word[:-3] FROM t0 WHERE length(word) > 5 AND suffix(word, 'es')),
r AS (SELECT label, word, size FROM t JOIN small USING (word) QUALIFY row_number() OVER (PARTITION BY label ORDER BY size, word) <= 2),
f AS (SELECT DISTINCT o_custkey, word, size FROM q JOIN r USING (label)),
k AS (SELECT DISTINCT p_brand, p_type, p_size FROM q),
n AS (SELECT k.*, p.p_partkey, row_number() OVER (PARTITION BY k.p_brand, k.p_type, k.p_size ORDER BY abs(p.p_size - k.p_size), p.p_partkey) AS rank FROM k JOIN p ON k.p_brand = p.p_brand AND k.p_type = p.p_type),
u AS (
  SELECT o_custkey, p_partkey, 0 AS stage, -sales::DOUBLE AS major, -p_partkey::DOUBLE AS minor FROM sold
  UNION ALL SELECT o_custkey, p_partkey, 1, 0, l_linenumber FROM asked
  UNION ALL SELECT f.o_custkey, w.p_partkey, 2, size, -coalesce(sales, 0) FROM f JOIN w USING (word) LEFT JOIN sold ON sold.o_custkey = f.o_custkey AND sold.p_partkey = w.p_partkey
  UNION ALL SELECT o_custkey, n.p_partkey, CASE WHEN rank <= 3 THEN 3 ELSE 4 END, rank, query FROM q JOIN n ON q.p_brand = n.p_brand AND q.p_type = n.p_type AND q.p_size = n.p_size WHERE rank <= 12),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, p_partkey ORDER BY stage, major, minor) = 1)
SELECT o_custkey, p_partkey, stage, row_number() OVER (PARTITION BY o_custkey ORDER BY stage, major, minor, p_partkey) AS place FROM m
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY stage, major, minor, p_partkey) <= 50""",
    "nested_code_labels": """
WITH e AS (SELECT user_id, event_type, trunc(value)::INT AS v FROM events),
p AS (
  SELECT lpad((user_id % 50)::VARCHAR, 8, '0') AS code, event_type AS label FROM e
  UNION ALL SELECT lpad('C' || v % 11, 8, '0'), event_type FROM e WHERE v % 3 > 0
  UNION ALL SELECT lpad('D' || v % 7, 8, '0'), upper(event_type) FROM e WHERE v IS NOT NULL),
c AS (SELECT code, label, count(*) AS n FROM p WHERE code IS NOT NULL AND label <> '' GROUP BY ALL)
SELECT code, label, n FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, label) = 1""",
    "manifest_faults": """
WITH d AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 10 = 3 THEN 'in/' || doc_id ELSE 'call-' || floor(doc_id / CASE WHEN doc_id % 10 IN (0, 1) THEN 2 ELSE 1 END)::BIGINT || '-' || (doc_id % 10 < 2) END AS name, doc_id % 50 <> 9 AS ok FROM documents),
f AS (
  SELECT d.doc_id, d.*, d.doc_id > min(CASE WHEN ok THEN doc_id END) OVER (PARTITION BY name) AND ok AS again FROM d)
SELECT doc_id, array_to_string(list_sort(list_filter([
  CASE WHEN NOT ok THEN 'not_an_object' END, CASE WHEN ok AND contains(name, '/') THEN 'bad_name' END, CASE WHEN again THEN 'duplicate_name' END, CASE WHEN ok AND doc_id % 10 = 7 THEN 'bad_digest' END,
  CASE WHEN ok AND doc_id % 10 = 6 AND lang IS NOT NULL THEN 'unexpected:lang' END, CASE WHEN ok AND doc_id % 10 = 5 THEN 'unexpected:audit' END, CASE WHEN ok AND doc_id % 10 = 5 THEN 'forbidden:$.audit.items[0].Truth_rows' END,
  CASE WHEN ok AND doc_id % 20 = 8 THEN 'unexpected:ErpOrder' END, CASE WHEN ok AND doc_id % 20 = 8 THEN 'forbidden:$.ErpOrder' END], lambda x: x IS NOT NULL)), ' ') AS faults FROM f""",
    "part_search_variants": f"""
WITH raw(g, t) AS (VALUES ('ring', 'ring'), ('ring', 'anneau'), ('ring', 'bague'), ('widget', 'widget'), ('widget', 'gadget'), ('widget', 'petit machin'), ('red widget', 'red widget'), ('red widget', 'machin rouge'),
  ('red widget', 'widget cerise'), ('small ring', 'small ring'), ('small ring', 'petite bague'), ('small ring', 'anneau fin'), ('gear wheel', 'gear wheel'), ('gear wheel', 'roue dentee'),
  ('large plate', 'large plate'), ('large plate', 'grande plaque'), ('large plate', 'plate geante')),
w AS (SELECT g, t, string_split(t, ' ') AS w FROM raw), pos AS (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM w),
x AS (SELECT *, CASE WHEN length(w[k]) >= 5 AND suffix(w[k], 's') THEN left(w[k], length(w[k]) - 1) WHEN length(w[k]) >= 4 THEN w[k] || 's' END AS o FROM pos),
f AS (SELECT g, t FROM raw UNION SELECT g, array_to_string(list_transform(w, lambda y, i: CASE WHEN i = k THEN o ELSE y END), ' ') FROM x WHERE o IS NOT NULL),
n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part),
s AS (SELECT DISTINCT p_name, unnest([p_name, w[-1] || ' ' || w[1], 'une ' || w[1] || ' ' || w[-1] || 's', 'une petite bague ' || w[-1]]) AS said FROM n),
u AS (SELECT DISTINCT said, string_split(said, ' ') AS w FROM s),
v AS (SELECT said, w[i] AS a, w[i + 1] AS b FROM (SELECT said, w, unnest(range(1, len(w))) AS i FROM u)),
two AS (SELECT g, string_split(t, ' ')[1] AS c, string_split(t, ' ')[2] AS d FROM f WHERE contains(t, ' ')),
p AS (SELECT DISTINCT v.a, v.b, c, d FROM v JOIN two ON v.a IN (c, d) OR v.b IN (c, d)),
r AS (SELECT *, {ratios.indel('a', 'c')} AS ac, {ratios.indel('b', 'd')} AS bd, {ratios.indel('b', 'c')} AS bc, {ratios.indel('a', 'd')} AS ad FROM p),
h AS (SELECT a, b, c, d, CASE WHEN ac + bd >= bc + ad THEN ac ELSE bc END AS x, CASE WHEN ac + bd >= bc + ad THEN bd ELSE ad END AS y FROM r),
m AS (
  SELECT said, g, t AS part FROM u JOIN f ON contains(' ' || said || ' ', ' ' || t || ' ')
  UNION SELECT said, g, v.a || ' ' || v.b FROM v JOIN h ON v.a = h.a AND v.b = h.b JOIN two ON two.c = h.c AND two.d = h.d WHERE least(x, y) >= 85 AND (x + y) / 2 >= 92 AND (x < 99.9)::INT + (y < 99.9)::INT <= 1),
z AS (SELECT said, said AS variant FROM u UNION SELECT said, replace(said, part, f.t) FROM m JOIN f ON m.g = f.g),
best AS (SELECT said, variant FROM z QUALIFY row_number() OVER (PARTITION BY said ORDER BY length(variant) DESC, variant) <= 16),
c AS (SELECT g, t FROM raw WHERE g <> t AND contains(g, ' ') AND contains(t, ' '))
SELECT s.p_name, s.said, coalesce((SELECT min(c.t) FROM c WHERE contains(' ' || s.said || ' ', ' ' || c.t || ' ') AND list_sort(string_split(c.g, ' ')) = list_sort(string_split(s.p_name, ' '))), '') AS alias, variant FROM s JOIN best ON s.said = best.said""",
}
