"""Mentions of one call put in order: blocks that the recogniser repeated, products that come again in such a storm, and rewordings of a line close before.

The mentions of a call are an array of structs, few by nature, in the order in which they were said; each step reads one array and
gives one back, inside an Arrow function, so no row moves. A call is never held together with another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import set_ratio

#: The type of a call's mentions. product: canonical text; said: the sentence.
MENTION = "array<struct<product: string, quantity: double, unit: string, multiple: double, said: string, precisions: array<string>, exclusions: array<string>, reasons: array<string>>>"
#: Reasons that the steps add, and the one that a rewording settles.
REPEATED, MERGED, NO_QUANTITY = "repetition_transcription_supprimee", "reformulation_proche_fusionnee", "quantite_absente_a_resoudre"
#: The longest block that counts as repeated; how many lines back a rewording looks; how near products must be, and quantities.
BLOCK, BACK, NEAR, SAME_QUANTITY = 8, 3, 94.0, 0.001
#: Words that tell forms of one product apart, those of which it has one, and words that say nothing.
FORMS = set("blanc jaune entier liquide dur ecale rape rapee copeau copeaux bloc tranche tranches laniere lanieres rondelle rondelles".split())
ONE_OF = (set("blanc jaune entier".split()), set("rape rapee copeau copeaux bloc tranche tranches".split()))
LINKS = set("d de des du l la le les".split())


def _key(m: dict) -> tuple:
    return m["product"], "" if m["quantity"] is None else f"{m['quantity']:.4f}", m["unit"] or ""


def without_repeats(mentions: list[dict]) -> list[dict]:
    """Of blocks of up to BLOCK mentions that stand twice or more in a row (the longest first) one stays, with the reason REPEATED."""
    keys, found, i = list(map(_key, mentions)), [], 0
    while i < len(mentions):
        n = next((n for n in range(min(BLOCK, (len(mentions) - i) // 2), 0, -1) if keys[i : i + n] == keys[i + n : i + 2 * n]), 0)
        if not n:
            found.append(mentions[i])
            i += 1
            continue
        found += [m | {"reasons": sorted({*m["reasons"], REPEATED})} for m in mentions[i : i + n]]
        block, i = keys[i : i + n], i + 2 * n
        while keys[i : i + n] == block:
            i += n
    return found


def without_storm(mentions: list[dict]) -> list[dict]:
    """Where a block was repeated and two products or more come again, only the first mention of each of those."""
    names = [m["product"] for m in mentions]
    again = {p for p in names if p and names.count(p) > 1}
    if len(again) < 2 or not any(REPEATED in m["reasons"] for m in mentions):
        return mentions
    return [m for i, m in enumerate(mentions) if names[i] not in again or names[i] not in names[:i]]


def one_core(a: set[str], b: set[str]) -> bool:
    """Whether two products are one but for their forms, none of which exclude each other."""
    core = a - FORMS - LINKS
    return bool(core) and core == b - FORMS - LINKS and not any(a & g and b & g and not a & b & g for g in ONE_OF)


def _rewords(m: dict, earlier: dict) -> bool:
    a, b = set(m["product"].split()), set(earlier["product"].split())
    if not a or not b or not one_core(a, b) and (set_ratio(a, b) < NEAR or a & FORMS != b & FORMS):
        return False
    if None not in (m["quantity"], earlier["quantity"]) and abs(m["quantity"] - earlier["quantity"]) > SAME_QUANTITY:
        return False
    return not (m["unit"] and earlier["unit"] and m["unit"] != earlier["unit"]) and m["multiple"] == earlier["multiple"]


def _merged(earlier: dict, m: dict) -> dict:
    """One line of two: what was counted names it, the longer name or the union of both forms stays, quantities are not added."""
    found = dict(earlier)
    if earlier["quantity"] is None and m["quantity"] is not None:
        found |= {k: m[k] for k in ("product", "quantity", "unit", "multiple", "said")}
    old, new = found["product"].split(), m["product"].split()
    if len(new) > len(old):
        found["product"] = m["product"]
        if m["quantity"] is not None:
            found["said"] = m["said"]
    elif one_core(set(new), set(old)):
        found["product"] = " ".join(dict.fromkeys([*old, *new])) if set(new) - set(old) else found["product"]
    found["precisions"] = earlier["precisions"] + m["precisions"]
    found["exclusions"] = earlier["exclusions"] + [x for x in m["exclusions"] if x not in earlier["exclusions"]]
    found["reasons"] = sorted({*earlier["reasons"], *m["reasons"], MERGED} - {NO_QUANTITY})
    return found


def without_rewordings(mentions: list[dict]) -> list[dict]:
    """Each mention that rewords one of the BACK lines kept last, the nearest first, becomes part of it."""
    found: list[dict] = []
    for m in mentions:
        at = next((i for i in range(len(found) - 1, max(-1, len(found) - 1 - BACK), -1) if _rewords(m, found[i])), None)
        if at is None:
            found.append(m)
        else:
            found[at] = _merged(found[at], m)
    return found


def tidied(mentions: Column) -> Column:
    """A call's mentions, an array of the type MENTION, after all steps: repeats twice, as the first round can make others, then the storm, then rewordings.

    A mention with reasons is ambiguous. Null members are empty (quantity, unit and multiple stay null); a null array is null.
    """
    @F.arrow_udf(MENTION)
    def of(calls: pa.Array) -> pa.Array:
        found = []
        for call in calls.to_pylist():
            if call is not None:
                call = [m | {k: m[k] or "" for k in ("product", "said")} | {k: m[k] or [] for k in ("precisions", "exclusions", "reasons")} for m in call if m is not None]
                call = without_rewordings(without_storm(without_repeats(without_repeats(call))))
            found.append(call)
        return pa.array(found, calls.type)

    return of(mentions.cast(MENTION))
