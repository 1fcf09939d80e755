"""Queries over texts: normalisation, tokens, windows, repeats, names, packaging, rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, similarity, text
from ..operators import linkage
from ..sources.tables import table
from . import ratios

#: Rules as (name, all of, any of, none of, bonus).
RULES = [("the", ["the"], [], [], 10), ("that and", ["that", "and"], [], ["est"], 25), ("le or la", [], ["le", "la"], ["the"], 40), ("und", ["und"], ["die", "der"], [], 55), ("que", ["que"], [], ["le"], 30)]


def normalized_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.select("doc_id", F.explode(F.array(text.canonical(F.col("text")))).alias("canon"))  # found once
    words = F.when(F.col("canon") == "", 0).otherwise(F.length("canon") - F.length(F.replace("canon", F.lit(" "), F.lit(""))) + 1)
    return d.select("doc_id", F.sha2("canon", 256).alias("canonical_sha256"), words.cast("long").alias("n_tokens"))


def token_document_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n_documents"))


def hotwords_topk(spark, sf_dir, k: int = 160):
    """The k best words of each source: document frequency within it against that in all; a top-k report."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(text.content_tokens(F.col("text")))).alias("token"))
    own = d.groupBy("source", "token").agg(F.count("*").alias("n"))
    every = own.groupBy("token").agg(F.sum("n").alias("df"))
    scored = own.join(every, "token").withColumn("score", F.bround(30.0 / F.col("df") + F.log1p("n"), 6))
    w = Window.partitionBy("source").orderBy(F.col("score").desc(), "token")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("source", "token", "n", "score", "rank")


def overlapping_word_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(text.tokens(F.col("text")))).alias("tokens"))  # found once, then cut
    d = d.select("doc_id", F.posexplode(text.windows(F.col("tokens"))).alias("position", "words"))
    return d.select("doc_id", F.col("position").cast("long").alias("position"), F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("window_sha256"))


def adjacent_repeats(spark, sf_dir):
    """Turns of a conversation whose canonical text is that of the turn before."""
    c = table(spark, sf_dir, "conversations").withColumn("canon", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("repeats", F.coalesce(F.lag("canon").over(w) == F.col("canon"), F.lit(False))).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if("repeats").alias("n_repeats"))


def lookback_near_duplicates(spark, sf_dir):
    """Turns that share half of their tokens with one of the three turns before them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = [F.coalesce(similarity.containment(F.col("t"), F.lag("t", k).over(w)) >= 0.5, F.lit(False)) for k in (1, 2, 3)]
    rows = c.withColumn("distance", F.when(near[0], 1).when(near[1], 2).when(near[2], 3))
    return rows.where("distance is not null").select("conv_id", "turn", "distance")


def carried_context(spark, sf_dir):
    """Each turn with the last user text before or at it: context carried forward."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select("conv_id", "turn", said.alias("user_turn"))


def enumeration_headers(spark, sf_dir):
    """Turns after which three shorter turns follow: a look ahead of three rows."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = F.max("n").over(w.rowsBetween(1, 3))
    many = F.count("*").over(w.rowsBetween(1, 3))
    return c.withColumn("header", (many == 3) & (ahead < F.col("n"))).select("conv_id", "turn", "header")


def name_phonetic_keys(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", text.name_key(F.col("p_name")).alias("name_key"), text.consonant_key(F.col("p_name")).alias("consonants"))


def _name_pairs(spark, sf_dir):
    """Distinct part names that share a token, each pair once: candidates come from an inverted index, not from all pairs."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("tokens", text.tokens(F.col("p_name")))
    index = names.select("p_name", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    other = index.select(F.col("p_name").alias("other"), F.col("tokens").alias("other_tokens"), "token")
    return index.join(other, "token").where("p_name < other").select("p_name", "other", "tokens", "other_tokens").distinct()


def indel_ratio_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("p_name", "other", F.bround(similarity.indel_ratio(F.col("p_name"), F.col("other")), 4).alias("ratio"))


def token_set_pairs(spark, sf_dir):
    t, o = F.col("tokens"), F.col("other_tokens")
    return _name_pairs(spark, sf_dir).select("p_name", "other", F.bround(similarity.token_set_ratio(t, o), 4).alias("set_ratio"), F.bround(similarity.token_sort_ratio(t, o), 4).alias("sort_ratio"))


def partial_ratio_pairs(spark, sf_dir):
    a, b = F.col("p_name"), F.col("other")
    return _name_pairs(spark, sf_dir).select("p_name", "other", F.bround(similarity.partial_ratio(a, b), 4).alias("partial"))


def matching_ratio_pairs(spark, sf_dir):
    """No SQL: which matching blocks count depends on how the longest one splits the texts, step by step."""
    return _name_pairs(spark, sf_dir).select("p_name", "other", F.bround(similarity.matching_ratio(F.col("p_name"), F.col("other")), 4).alias("matching"))


def blocked_product_search(spark, sf_dir, limit: int = 9):
    """For each distinct type of part the best names by what they share with it and what they sold, within quotas by brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    score = F.bround(0.7 * F.col("p_size") + 1.5 * F.log1p(F.coalesce("n", F.lit(0))), 4)
    rows = parts.join(sold, "p_partkey", "left").select("p_type", "p_brand", "p_name", score.alias("score"))
    best = rows.groupBy("p_type", "p_brand", "p_name").agg(F.max("score").alias("score"))
    return linkage.quota_union(best, ["p_type"], "p_brand", "p_name", "score", limit)


def packaging_quantity(spark, sf_dir):
    """Packs that the ordered quantities of a part make at its size."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").distinct()
    p = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    n, score = numbers.packs(F.col("l_quantity"), F.col("size"))
    return li.join(p, li.l_partkey == p.p_partkey).select("l_partkey", "l_quantity", n.cast("long").alias("packs"), F.bround(score, 4).alias("score"), numbers.commercial(F.col("l_quantity") / F.col("size")).alias("ratio"))


def rule_bonus_match(spark, sf_dir):
    """The best rule whose words a document has (all of, any of, none of), and its bonus; the rules are literals, so nothing is joined."""
    t = F.col("t")
    has = lambda w: F.array_contains(t, w)
    fits = []
    for name, every, some, none, bonus in RULES:
        ok = F.lit(True)
        for w in every:
            ok = ok & has(w)
        if some:
            ok = ok & F.arrays_overlap(t, F.array(*[F.lit(w) for w in some]))
        for w in none:
            ok = ok & ~has(w)
        fits.append(F.when(ok, F.struct(F.lit(min(max(bonus, 0), 80)).alias("bonus"), F.lit(name).alias("rule"))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))
    return d.select("doc_id", best["rule"].alias("rule"), F.coalesce(best["bonus"], F.lit(0)).alias("bonus"))


def spoken_codes(spark, sf_dir):
    """Digit groups of 5 to 10 in documents, as heard and without leading zeros."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]{5,10})"), 1))).alias("code"))
    return d.select("doc_id", "code", numbers.bare_code(F.col("code")).alias("bare"))


def phones_in_documents(spark, sf_dir):
    """Phone numbers in texts, in national or international form, and how many documents have each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:\+33|0033|0)[ .-]?[1-9](?:[ .-]?[0-9]{2}){4})"), 1)).alias("raw"))
    return d.select("doc_id", numbers.phone(F.col("raw")).alias("phone")).where("phone is not null").groupBy("phone").agg(F.count_distinct("doc_id").alias("n_documents"))


def markdown_report(spark, sf_dir):
    """Conversations as one table cell each: turns in order, with pipes and newlines escaped."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: text.markdown_cell(x["line"]))
    return c.groupBy("conv_id").agg(F.array_join(lines, "<br>").alias("cell"))


QUERIES = {f.__name__: f for f in (normalized_documents, token_document_frequency, hotwords_topk, overlapping_word_windows, adjacent_repeats, lookback_near_duplicates, carried_context, enumeration_headers, name_phonetic_keys, indel_ratio_pairs, token_set_pairs, partial_ratio_pairs, matching_ratio_pairs, blocked_product_search, packaging_quantity, rule_bonus_match, spoken_codes, phones_in_documents, markdown_report)}

_CANON = "trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_CANON}, ' '), lambda x: x <> '')"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in text.GENERIC) + "]"
_PAIRS = "n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS t FROM part), pairs AS (SELECT a.p_name, b.p_name AS other, a.t AS a, b.t AS b FROM n a JOIN n b ON a.p_name < b.p_name AND len(list_intersect(a.t, b.t)) > 0)"
_RULE = "CASE " + " ".join("WHEN " + " AND ".join([f"list_contains(t, '{w}')" for w in e] + ([f"list_has_any(t, {s})"] if s else []) + [f"NOT list_contains(t, '{w}')" for w in x]) + f" THEN '{n}'" for n, e, s, x, _ in sorted(RULES, key=lambda r: -r[4])) + " END"


def _key(col: str) -> str:
    unnamed = "[" + ", ".join(f"'{w}'" for w in text.NAME_GENERIC + text.CALL_WORDS) + "]"
    out = f"array_to_string(list_filter(string_split({col}, ' '), lambda x: x <> '' AND NOT list_contains({unnamed}, x)), '')"
    for a, b in text.SOUNDS:
        out = f"replace({out}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return out


SQL = {
    "normalized_documents": f"SELECT doc_id, sha256({_CANON}) AS canonical_sha256, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents",
    "token_document_frequency": f"SELECT token, count(*) AS n_documents FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY 1",
    "hotwords_topk": f"""
WITH d AS (SELECT source, unnest(list_filter(list_distinct({_TOKENS}), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({_GENERIC}, x))) AS token FROM documents),
o AS (SELECT source, token, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT source, token, n, round_even(30.0 / sum(n) OVER (PARTITION BY token) + ln(1 + n), 6) AS score FROM o)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, token) AS rank FROM s QUALIFY rank <= 160""",
    "overlapping_word_windows": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(ceil((len(t) - 14) / 28.0), 1) AS BIGINT))) AS position FROM d WHERE len(t) > 0)
SELECT doc_id, position, CAST(len(t[position * 28 + 1 : position * 28 + 42]) AS BIGINT) AS n_words, sha256(array_to_string(t[position * 28 + 1 : position * 28 + 42], ' ')) AS window_sha256 FROM w""",
    "adjacent_repeats": """
WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS canon FROM conversations),
r AS (SELECT conv_id, coalesce(lag(canon) OVER (PARTITION BY conv_id ORDER BY turn) = canon, false) AS repeats FROM c)
SELECT conv_id, count(*) AS n_turns, count_if(repeats) AS n_repeats FROM r GROUP BY 1""",
    "lookback_near_duplicates": f"""
WITH c AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS t FROM conversations), p AS (SELECT conv_id, turn, t, [lag(t, 1) OVER w, lag(t, 2) OVER w, lag(t, 3) OVER w] AS b FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT conv_id, turn, list_position(list_transform(b, lambda x: x IS NOT NULL AND len(t) > 0 AND 2 * len(list_intersect(t, x)) >= len(t)), true) AS distance FROM p)
SELECT conv_id, turn, CAST(distance AS INT) AS distance FROM d WHERE distance > 0""",
    "carried_context": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations",
    "enumeration_headers": """
SELECT conv_id, turn, coalesce(count(*) OVER w = 3 AND max(length(text)) OVER w < length(text), false) AS header FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "name_phonetic_keys": f"SELECT p_name, {_key('p_name')} AS name_key, regexp_replace(replace({_key('p_name')}, 'ts', 's'), '[aeiou]', '', 'g') AS consonants FROM (SELECT DISTINCT p_name FROM part)",
    "indel_ratio_pairs": f"WITH {_PAIRS} SELECT p_name, other, round_even({ratios.indel('p_name', 'other')}, 4) AS ratio FROM pairs",
    "token_set_pairs": f"""
WITH {_PAIRS}, d AS (SELECT p_name, other, list_sort(list_intersect(a, b)) AS common, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS only_b,
 array_to_string(list_sort(a), ' ') AS sorted_a, array_to_string(list_sort(b), ' ') AS sorted_b FROM pairs),
w AS (SELECT *, array_to_string(common, ' ') AS base, trim(array_to_string(list_concat(common, only_a), ' ')) AS wa, trim(array_to_string(list_concat(common, only_b), ' ')) AS wb FROM d)
SELECT p_name, other, round_even(CASE WHEN len(only_a) = 0 OR len(only_b) = 0 THEN 100.0 ELSE greatest({ratios.indel('wa', 'wb')}, 200.0 * length(base) / (length(base) + length(wa)), 200.0 * length(base) / (length(base) + length(wb))) END, 4) AS set_ratio,
 round_even({ratios.indel('sorted_a', 'sorted_b')}, 4) AS sort_ratio FROM w""",
    "partial_ratio_pairs": f"""
WITH {_PAIRS}, s AS (SELECT p_name, other, CASE WHEN length(p_name) <= length(other) THEN p_name ELSE other END AS short, CASE WHEN length(p_name) <= length(other) THEN other ELSE p_name END AS long FROM pairs),
w AS (SELECT *, unnest(list_transform(range(1 - length(short), length(long)), lambda i: substr(long, 1 + greatest(i, 0), length(short) + least(i, 0)))) AS cut FROM s)
SELECT p_name, other, round_even(max({ratios.indel('short', 'cut')}), 4) AS partial FROM w GROUP BY ALL""",
    "lookback_near_duplicates": f"""
WITH t AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS t FROM conversations), l AS (SELECT *, lag(t, 1) OVER w AS a, lag(t, 2) OVER w AS b, lag(t, 3) OVER w AS c FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT conv_id, turn, CASE WHEN 2 * len(list_intersect(t, a)) >= len(t) AND len(t) > 0 AND a IS NOT NULL THEN 1 WHEN 2 * len(list_intersect(t, b)) >= len(t) AND len(t) > 0 AND b IS NOT NULL THEN 2 WHEN 2 * len(list_intersect(t, c)) >= len(t) AND len(t) > 0 AND c IS NOT NULL THEN 3 END AS distance FROM l)
SELECT * FROM d WHERE distance IS NOT NULL""",
    "blocked_product_search": """
WITH s AS (SELECT p_type, p_brand, p_name, max(round_even(0.7 * p_size + 1.5 * ln(1 + coalesce(n, 0)), 4)) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY ALL),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_type, p_name ORDER BY score DESC, p_brand) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_name) AS place, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY score DESC, p_name) AS pp FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN place = 1 THEN 0 WHEN pp <= 3 THEN 1 ELSE 2 END, score DESC, p_name) AS shown FROM p)
SELECT p_type, p_brand, p_name, score, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_name) AS final_rank FROM q WHERE shown <= 9""",
    "packaging_quantity": """
WITH x AS (SELECT DISTINCT l_partkey, l_quantity, CAST(p_size AS DOUBLE) AS size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 0), n AS (SELECT *, greatest(1.0, round_even(l_quantity / size, 0)) AS n FROM x)
SELECT l_partkey, l_quantity, CAST(n AS BIGINT) AS packs, round_even(30.0 / (1 + abs(n * size - l_quantity) / l_quantity), 4) AS score,
 CASE WHEN abs(l_quantity / size - round_even(l_quantity / size, 0)) <= 0.05 THEN round_even(l_quantity / size, 0) ELSE round_even(l_quantity / size, 3) END AS ratio FROM n""",
    "rule_bonus_match": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), r AS (SELECT doc_id, {_RULE} AS rule FROM d)
SELECT doc_id, rule, CASE rule {" ".join(f"WHEN '{r[0]}' THEN {r[4]}" for r in RULES)} ELSE 0 END AS bonus FROM r""",
    "spoken_codes": "SELECT DISTINCT doc_id, code, regexp_replace(code, '^0{1,9}([0-9])', '\\1') AS bare FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{5,10}')) AS code FROM documents)",
    "phones_in_documents": "SELECT phone, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '(\\+33|0033|0)[ .-]?[1-9]([ .-]?[0-9]{2}){4}')), '[^0-9]', '', 'g'), '^(0033|33)0?', '0') AS phone FROM documents) GROUP BY 1",
    "markdown_report": "SELECT conv_id, string_agg(replace(replace(role || ': ' || text, '|', '\\|'), chr(10), ' '), '<br>' ORDER BY turn) AS cell FROM conversations GROUP BY 1",
}
