"""Extraction from order messages: number words, clauses, mentions, actions, cancellations, clients, repeats. Built-in expressions on canonical text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: French number words.
ONES = ("zero", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize")
TENS = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre vingt"}
#: Units as they are said, longest first within a kind.
UNIT_WORDS = ("kilos", "kilo", "kg", "grammes", "gramme", "litres", "litre", "pieces", "piece", "cartons", "carton", "colis", "bidons", "bidon", "sachets", "sachet", "caisses", "caisse")
#: What a message asks for, the first that fits.
ACTIONS = (
    ("MODIFICATION", r"\b(modifi\w*|chang\w*|remplac\w*|rajout\w*)\b"),
    ("CANCELLATION", r"\b(annul\w*|supprim\w*|enlev\w*)\b"),
    ("CALLBACK", r"\b(rappel\w*|recontact\w*)\b"),
    ("ORDER", r"\b(command\w*|voudrais|faudrait|besoin|mettre|prendre)\b"),
)
#: Roles of a clause, the first that fits.
ROLES = (
    ("GREETING", r"^(bonjour|bonsoir|allo|salut)\b"), ("CLOSING", r"\b(merci|au revoir|bonne (journee|soiree)|a demain)\b$"), ("CLIENT", r"\b(ici|c est|de la part d)\b"),
    ("CALLBACK", r"\brappel\w*"), ("CANCELLATION", r"\b(annul\w*|enlev\w*|supprim\w*)\b"), ("DELIVERY", r"\b(livr\w*|pour (demain|apres demain|lundi|mardi|mercredi|jeudi|vendredi|samedi))\b"),
    ("PRODUCT", r"^[0-9]"), ("PRECISION", r"^(plutot|de preference|bien|pas|sans|avec)\b"),
)


def number_phrase(n: int) -> str:
    """0 to 99 in words: seventies and nineties go on from sixty and eighty, one is joined by `et` up to 71."""
    if n < 17:
        return ONES[n]
    if n < 20:
        return f"dix {ONES[n - 10]}"
    base = n // 10 * 10 - (10 if n // 10 in (7, 9) else 0)
    rest = n - base
    if not rest:
        return TENS[base] + ("s" if n == 80 else "")
    return f"{TENS[base]} {'et ' if rest in (1, 11) and base < 80 else ''}{number_phrase(rest)}"


def digits_for_words(text: Column) -> Column:
    """Number words as digits: tens with what follows them (`et` between them or not) as one number, `un` and `une` as 1.

    Spaces are doubled first, so that words next to each other have theirs each; words that are read bear a mark until numbers are put together.
    """
    padded = F.replace(F.regexp_replace(text, r"([,;.:!?])(?=\s|$)", " $1"), F.lit(" "), F.lit("  "))
    words = [("quatre  vingts", 80), ("quatre  vingt", 80), *((TENS[n], n) for n in (20, 30, 40, 50, 60)), *((f"dix  {ONES[n - 10]}", n) for n in (17, 18, 19)), *((w, n) for n, w in enumerate(ONES)), ("une", 1)]
    marked = reduce(lambda c, w: F.replace(c, F.lit(f" {w[0]} "), F.lit(f" §{w[1]} ")), words, F.concat(F.lit(" "), padded, F.lit(" ")))
    for pattern, number in ((r"§60  (?:et  )?§1([0-9])(?= )", "7$1"), (r"§80  (?:et  )?§1([0-9])(?= )", "9$1"), (r"§([2-68])0  (?:et  )?§([1-9])(?= )", "$1$2")):
        marked = F.regexp_replace(marked, pattern, number)
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(marked, F.lit("§"), F.lit("")), " +", " "), r" ([,;.:!?])(?=\s|$)", "$1"))


def spoken_decimals(text: Column) -> Column:
    """`2 kilos 5` as `2.5 kilos`: digits that follow a unit of measure at once, and no unit follows them, are its decimals."""
    return F.regexp_replace(text, rf"\b([0-9]+) (kilos?|kg|litres?) ([0-9]{{1,2}})\b(?! *(?:{'|'.join(UNIT_WORDS)})\b)", "$1.$3 $2")


def without_calendar(text: Column) -> Column:
    """Days of a month out of a text, so that they are no quantities; a weekday before them stays."""
    months = "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
    return F.trim(F.regexp_replace(text, rf"(?:\ble )?\b[0-9]{{1,2}}(?:er)? (?:{months})\b", ""))


def clauses(text: Column) -> Column:
    """Clauses of a message with digits: cut at , ; and points that are no decimals, at `et` before a number, before a closing formula."""
    cut = F.regexp_replace(text, r"\s*(?:[;,]|\.(?![0-9]))\s*|\s+et\s+(?=[0-9])|\s+(?=(?:pour (?:demain|apres demain|lundi|mardi|mercredi|jeudi|vendredi|samedi)|merci)\b)", "\u0001")
    cut = F.regexp_replace(cut, r"\b(?:je voudrais|il (?:me )?faudrait|j ai besoin de|vous pouvez mettre|je commande)\s+", "\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda c: F.trim(c)), lambda c: c != "")


def role(clause: Column) -> Column:
    return reduce(lambda rest, r: F.when(clause.rlike(r[1]), F.lit(r[0])).otherwise(rest), reversed(ROLES), F.lit("OTHER"))


def mention(clause: Column) -> Column:
    """struct(quantity, unit, article) of a clause that begins with a quantity; null for others."""
    grammar = rf"^([0-9]+(?:[.,][0-9]+)?)\s*(?:x\s*)?({'|'.join(UNIT_WORDS)})?\s*(?:de |d )?(.*)$"
    part = lambda i: F.regexp_extract(clause, grammar, i)
    quantity = F.replace(part(1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(quantity.isNotNull(), F.struct(quantity.alias("quantity"), F.nullif(part(2), F.lit("")).alias("unit"), F.trim(part(3)).alias("article")))


def action(text: Column) -> Column:
    return reduce(lambda rest, a: F.when(text.rlike(a[1]), F.lit(a[0])).otherwise(rest), reversed(ACTIONS), F.lit("UNKNOWN"))


def cancelled(text: Column) -> Column:
    """What a message takes back: the words after each verb of cancelling, up to a comma, `et` or the end, split at commas."""
    said = F.regexp_extract_all(text, F.lit(r"\b(?:annul\w*|supprim\w*|enlev\w*)\s+(?:le |la |les |l )?([^,;.]*?)(?=\s+et\s|[,;.]|\s+(?:pour|merci)\b|$)"), 1)
    return F.filter(F.transform(said, lambda x: F.trim(x)), lambda x: x != "")


def client_zone(text: Column) -> Column:
    """The words between the presentation and the request."""
    return F.trim(F.regexp_extract(text, r"\b(?:ici|c est|de la part d[eu]?)\s+(.*?)(?:\s+(?:je|j|il|vous|pour|on)\b|[,;.]|$)", 1))


def callback_only(text: Column) -> Column:
    """A wish to be called back, without an order or a quantity."""
    return text.rlike(ACTIONS[2][1]) & ~text.rlike(ACTIONS[3][1]) & ~text.rlike(rf"[0-9]+\s*(?:{'|'.join(UNIT_WORDS)})\b")


def without_repeated_blocks(keys: Column, longest: int = 8) -> Column:
    """An array less blocks of up to `longest` entries that repeat the block just before them: a fold that drops each as it completes."""

    def step(kept: Column, x: Column) -> Column:
        grown = F.concat(kept, F.array(x))
        n = F.size(grown)
        out = grown
        for b in range(1, longest + 1):
            repeats = (n >= 2 * b) & (F.slice(grown, F.greatest(n - b + 1, F.lit(1)), F.lit(b)) == F.slice(grown, F.greatest(n - 2 * b + 1, F.lit(1)), F.lit(b)))
            out = F.when(repeats, F.slice(grown, F.lit(1), n - b)).otherwise(out)
        return out

    return F.aggregate(keys, F.array().cast("array<string>"), step)


def stitched(a: Column, b: Column, least: int = 2, most: int = 16) -> Column:
    """Two arrays of tokens as one, without the longest end of a that b begins with."""
    overlap = F.coalesce(
        *[F.when((F.size(a) >= n) & (F.size(b) >= n) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)) == F.slice(b, 1, n)), F.lit(n)) for n in range(most, least - 1, -1)],
        F.lit(0),
    )
    return F.concat(a, F.slice(b, overlap + 1, F.size(b)))


def message_clauses(messages: DataFrame, key: str, text: str) -> DataFrame:
    """One row a clause: key, position, clause, role, mention, and the position of the mention that it belongs to (its own or the last before it)."""
    rows = messages.select(key, F.posexplode(clauses(digits_for_words(F.col(text)))).alias("position", "clause"))
    rows = rows.select(key, F.col("position").cast("long").alias("position"), "clause", role(F.col("clause")).alias("role"), mention(F.col("clause")).alias("mention"))
    so_far = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("belongs_to", F.last(F.when(F.col("mention").isNotNull(), F.col("position")), ignorenulls=True).over(so_far))


def consolidated(mentions: DataFrame, key: str, article: str, quantity: str, unit: str) -> DataFrame:
    """Order lines: mentions of an article in the same unit added up, in the order of their first mention, renumbered."""
    lines = mentions.groupBy(key, article, unit).agg(F.sum(quantity).alias("quantity"), F.count("*").alias("n_mentions"), F.min("position").alias("first_position"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first_position"))
    return lines.withColumn("line_number", number.cast("long")).drop("first_position")
