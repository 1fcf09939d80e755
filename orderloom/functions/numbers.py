"""Numbers, units, packaging, phones, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit spellings and what they stand for.
UNITS = {"kilo": "KG", "kilos": "KG", "kg": "KG", "gramme": "G", "grammes": "G", "g": "G", "litre": "L", "litres": "L", "l": "L", "piece": "P", "pieces": "P", "p": "P", "carton": "COL", "cartons": "COL", "colis": "COL", "bidon": "BID", "bidons": "BID"}


def tolerant_number(text: Column) -> Column:
    """A decimal with comma or point, or null."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def canonical_decimal(text: Column) -> Column:
    """A decimal as text: point, no trailing zeros, no minus before zero; null if it is no number."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def unit(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(text))], F.upper(F.trim(text)))


def commercial(quantity: Column) -> Column:
    """A whole number if within 0.05 of one, else three decimals (half to even)."""
    whole = F.bround(quantity, 0)
    return F.when(F.abs(quantity - whole) <= 0.05, whole).otherwise(F.bround(quantity, 3))


def packs(quantity: Column, size: Column) -> tuple[Column, Column]:
    """How many packs of a size a quantity makes, one at least, and a score of 30 that falls with the relative gap."""
    n = F.greatest(F.lit(1.0), F.bround(quantity / size, 0))
    gap = F.abs(n * size - quantity) / quantity
    return n, F.lit(30.0) / (1 + gap)


def phone(text: Column) -> Column:
    """Ten digits that begin with 0, or null. 0033, +33 and 33 stand for 0; nine digits lack their 0."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    national = F.regexp_replace(digits, "^(0033|33)0?(?=[0-9]{9}$)", "0")
    full = F.when(F.length(national) == 9, F.concat(F.lit("0"), national)).otherwise(national)
    return F.when(full.rlike("^0[0-9]{9}$"), full)


def bare_code(code: Column) -> Column:
    """A code without leading zeros; of only zeros, one stays."""
    return F.regexp_replace(code, "^0+(?=.)", "")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """A bucket from the first 32 bits of SHA-256, the same on every run."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets


def measures(label: Column) -> Column:
    """Sizes in a label as structs of value and dimension: grams for weights, millilitres for volumes."""
    found = F.regexp_extract_all(F.lower(label), F.lit(r"\b([0-9]+(?:[.,][0-9]+)? ?(?:kg|g|l|cl|ml))\b"), 0)
    value = lambda m: F.replace(F.regexp_extract(m, r"^[0-9.,]+", 0), F.lit(","), F.lit(".")).try_cast("double")
    unit_of = lambda m: F.regexp_extract(m, r"[a-z]+$", 0)
    factor = lambda u: F.when(u == "kg", 1000.0).when(u == "l", 1000.0).when(u == "cl", 10.0).otherwise(1.0)
    return F.transform(found, lambda m: F.struct((value(m) * factor(unit_of(m))).alias("value"), F.when(unit_of(m).isin("kg", "g"), "weight").otherwise("volume").alias("dimension")))


def physical_fit(said: Column, label: Column) -> Column:
    """How well a said measure fits those of a label: 12 within a twentieth, else the less the further; -12 if none has its dimension, 0 if there are none."""
    same = F.filter(label, lambda m: m["dimension"] == said["dimension"])
    gap = F.array_min(F.transform(same, lambda m: F.abs(m["value"] - said["value"]) / F.greatest(said["value"], F.lit(1e-9))))
    return F.when(F.size(label) == 0, 0.0).when(F.size(same) == 0, -12.0).when(gap <= 0.05, 12.0).otherwise(-F.least(F.lit(12.0), 4 + 10 * gap))
