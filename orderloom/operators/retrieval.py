"""What a model may choose from: several ranked lists merged under a quota, and small product families by rare words.

A list's place in the merge is three numbers, stage, major and minor. History comes whole before families; rounds over queries
have the rank as major number and the query as minor, so that every query gets its best item before any gets its second. An
item counts at its first place. Places are minima, taken before rows move; the quota is a rank within a key, which Spark limits
in each task before it sorts a key's rows together. No list is held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Words that say nothing of a family.
NO_FAMILY = (
    "avec sans pour dans sous plus moins carton cartons colis boite boites sachet sachets poche poches paquet paquets pack packs piece pieces kilo kilos litre litres "
    "produit produits frais fraiche fraiches surgele surgeles unite unites"
).split()
STAGES = ("stage", "major", "minor")


def family_words(label: Column) -> Column:
    """The words of a label that can name a family: four letters or more, not digits alone, once each."""
    return F.array_distinct(F.filter(text.tokens(label), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$")))


def query_words(query: Column) -> Column:
    """The words of a query, also without an s or es at their end, that can name a family."""
    own = F.filter(family_words(query), lambda w: ~w.isin(*NO_FAMILY))
    cut = lambda end, least: F.transform(F.filter(own, lambda w: F.endswith(w, F.lit(end)) & (F.length(w) > least)), lambda w: F.substr(w, F.lit(1), F.length(w) - len(end)))
    return F.array_distinct(F.concat(own, cut("s", 4), cut("es", 5)))


def families(queries: DataFrame, catalogue: DataFrame, key: str, query: str, item: str, label: str, most: int = 64, words: int = 2) -> DataFrame:
    """key, item, word, size: the items of the catalogue that have one of the rarest words of a key's queries.

    Of each query the `words` words that fewest items have (ties: the first), each in 1 to `most` items; so a word adds at most `most` rows
    to a query, and common words never join. Nulls ask for nothing and are in no family; rows that repeat count once.
    """
    of_word = catalogue.select(item, F.explode(family_words(F.col(label))).alias("word")).distinct()
    small = of_word.groupBy("word").agg(F.count("*").alias("size")).where(F.col("size") <= most)
    asked = queries.select(key, query).where(F.col(query).isNotNull()).distinct()
    texts = asked.select(query).distinct().select(query, F.explode(query_words(F.col(query))).alias("word")).join(small, "word")
    rarest = texts.withColumn("__place", F.row_number().over(Window.partitionBy(query).orderBy("size", "word"))).where(F.col("__place") <= words)
    chosen = asked.join(rarest.drop("__place"), query).select(key, "word", "size").distinct()
    return chosen.join(of_word, "word").select(key, item, "word", "size")


def merged_lists(lists: DataFrame, key: str, item: str, quota: int) -> DataFrame:
    """key, item, stage, place: of each key the first `quota` items by stage, major, minor and item, each at its first place.

    lists: key, item and the columns of STAGES, of any order; nulls in them come first. place counts from 1 within the key.
    """
    at = F.struct(*STAGES)
    first = lists.groupBy(key, item).agg(F.min(at).alias("at"))
    w = Window.partitionBy(key).orderBy("at", item)
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= quota).select(key, item, "at.stage", "place")
