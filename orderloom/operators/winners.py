"""Which candidate of a mention wins: what can be ordered, one score of all evidence, and the order of sales that breaks ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.similarity import indel_ratio

#: Points of a candidate's source; beginnings of reasons by which the packaging was asked for, and what it then weighs, or else; the day from which recency counts.
SOURCES = {"cadencier_client": 80.0, "catalogue_global": 30.0, "catalogue_reappro": -30.0}
ASKED_FOR = ("preference_dimension_", "preference_conditionnement_", "preference_volume_unitaire_", "conversion_depuis_kg", "conversion_depuis_litre")
ASKED, NOT_ASKED, DAY_ZERO = 0.7, 0.05, 739_700
#: Articles of these sources can be ordered without a price; least day, text and packaging scores and sales of the two ways to be ordered by what was sold.
PRICELESS = ("referentiel_articles", "historique_client_pretest")
SOLD_TEXT, HABIT_TEXT, HABIT_PACK, HABIT_DAY, HABIT_SALES = 80.0, 50.0, 55.0, 739_760, 5
#: Sounds of the bounded phonetic signature, in order.
SOUNDS = (("eaux", "o"), ("eau", "o"), ("aux", "o"), ("au", "o"), ("ou", "u"), ("ill", "i"), ("ph", "f"), ("qu", "k"))
#: Columns that the scores read, and the type of each; nulls are 0, the empty text, an empty array, and true for compatible.
CANDIDATE = {
    "label": "string", "price": "double", "known": "boolean", "compatible": "boolean", "source": "string", "article_source": "string", "reasons": "array<string>", "text_score": "double", "pack_score": "double", "global_score": "double",
    "attribute_score": "double", "physical_score": "double", "history_bonus": "double", "fallback_bonus": "double", "volume_bonus": "double", "sales": "long", "recent_sales": "long", "last_day": "long",
}


def usable_price(price: Column) -> Column:
    """A price above zero, or null."""
    return F.when(price > 0, price)


def _of(name: str) -> Column:
    c, kind = F.col(name).cast(CANDIDATE[name]), CANDIDATE[name]
    default = {"string": F.lit(""), "double": F.lit(0.0), "long": F.lit(0).cast("long"), "array<string>": F.array().cast("array<string>"), "boolean": F.lit(name == "compatible")}[kind]
    return F.coalesce(c, default)


def _starts(reasons: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(reasons, lambda r: reduce(lambda a, b: a | b, [F.startswith(r, F.lit(p)) for p in prefixes]))


def orderable() -> Column:
    """Whether a candidate, by the columns of CANDIDATE, can be ordered: not starred out, compatible, and one of five: a price, a reference row, a priceless source, sold and named well, a habit asked for."""
    day = F.coalesce(F.col("last_day"), F.lit(-1))
    ways = [
        usable_price(F.col("price").cast("double")).isNotNull(), _of("known"), _of("article_source").isin(*PRICELESS), (_of("text_score") >= SOLD_TEXT) & (day >= DAY_ZERO) & (_of("sales") > 0),
        (_of("text_score") >= HABIT_TEXT) & (_of("pack_score") >= HABIT_PACK) & (day >= HABIT_DAY) & (_of("sales") >= HABIT_SALES) & _starts(_of("reasons"), ("preference_",)),
    ]
    return ~F.contains(_of("label"), F.lit("***")) & _of("compatible") & reduce(lambda a, b: a | b, ways)


def selection_score() -> Column:
    """One score of text, packaging, history, source and sales, by the columns of CANDIDATE. Packaging weighs much only where it was asked for."""
    source = reduce(lambda c, kv: F.when(_of("source") == kv[0], kv[1]).otherwise(c), SOURCES.items(), F.lit(0.0))
    plain = reduce(lambda a, b: a + b, [_of(c) for c in ("text_score", "attribute_score", "physical_score", "history_bonus", "fallback_bonus", "volume_bonus")])
    packaging = F.when(_starts(_of("reasons"), ASKED_FOR), ASKED).otherwise(NOT_ASKED) * _of("pack_score")
    recency = F.greatest(F.lit(0), _of("last_day") - DAY_ZERO)
    sold = 1.5 * F.log1p(_of("sales")) + 3.5 * F.log1p(_of("recent_sales")) + 0.06 * recency
    return F.bround(plain + source + packaging + sold + F.when(_of("article_source") == "referentiel_articles", 4.0).otherwise(0.0), 4)


def sales_order() -> Column:
    """What ranks candidates by how they sell: packaging, sales, recent sales, last day, the lower price (none last), the global score; the greatest is first."""
    price = usable_price(F.col("price").cast("double"))
    day = F.coalesce(F.col("last_day").cast("long"), F.lit(-1).cast("long"))
    return F.struct(_of("pack_score").alias("pack"), _of("sales").alias("sales"), _of("recent_sales").alias("recent"), day.alias("day"), (-F.coalesce(price, F.lit(999_999.0))).alias("price"), _of("global_score").alias("score"))


def winners(candidates: DataFrame, mention: str, code: str) -> DataFrame:
    """mention, code, score, margin, n: of the candidates that can be ordered the one of the best score; ties by sales, then the first code.

    candidates: the columns of CANDIDATE too. margin: to the second (to 0 where there is none); n: candidates that can be ordered.
    Mentions without such have no row. The first two of a mention are ranked before rows move; no task holds a mention.
    """
    rows = candidates.where(orderable()).select(mention, code, selection_score().alias("score"), sales_order().alias("by"))
    n = rows.groupBy(mention).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(mention).orderBy(F.desc("score"), F.desc("by"), code))
    two = rows.withColumn("place", place).where("place <= 2").groupBy(mention)
    best = two.agg(F.min_by(code, "place").alias(code), F.max("score").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    return best.join(n, mention).select(mention, code, "score", F.bround(F.col("score") - F.coalesce("second", F.lit(0.0)), 4).alias("margin"), "n")


def phonetic_signatures(expression: Column) -> Column:
    """What an expression sounds like, for comparisons within a client's catalogue alone: as it is without articles and spaces, in sounds, and (of three or more) its consonants. Short ones only as they are."""
    bare = F.replace(F.regexp_replace(text.canonical(expression), r"\b(?:de|du|des|d|la|le|les)\b", " "), F.lit(" "), F.lit(""))
    sound = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SOUNDS, bare)
    sound = F.regexp_replace(F.regexp_replace(sound, "c(?=[eiy])", "s"), "g(?=[eiy])", "j")
    sound = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), (("ck", "k"), ("z", "s"), ("y", "i"), ("h", "")), sound)
    sound = text.single_letters(F.regexp_replace(sound, "(?:es|e|s)$", ""))
    consonants = F.regexp_replace(sound, "[aeiou]", "")
    forms = F.array(bare, sound, F.when(F.length(consonants) >= 3, consonants))
    return F.filter(F.array_distinct(F.when(F.length(bare) < 4, F.array(bare)).otherwise(F.array_compact(forms))), lambda f: f != "")


def phonetic_score(rows: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, sound_score: the best Indel ratio of a signature of a and one of b (nine at most a row); 0 where either has none."""
    pairs = rows.select(*key, F.explode_outer(phonetic_signatures(F.col(a))).alias("x"), F.col(b)).select(*key, "x", F.explode_outer(phonetic_signatures(F.col(b))).alias("y"))
    return pairs.groupBy(*key).agg(F.coalesce(F.max(indel_ratio(F.col("x"), F.col("y"))), F.lit(0.0)).alias("sound_score"))
