"""Text functions on columns: accents, canonical text, tokens, phonetic keys, references. All of them are built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_pairs() -> tuple[str, str]:
    """Letters from U+00C0 to U+024F and U+1E00 to U+1EFF that decompose into a base letter and marks, with those bases."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, BARE = _accent_pairs()
#: Words that carry no identity in a name.
GENERIC = ("boulangerie", "boucherie", "charcuterie", "epicerie", "restaurant", "traiteur", "hotel", "bar", "cafe", "sarl", "sas", "sa", "eurl", "le", "la", "les", "l", "du", "de", "des", "d", "et", "au", "aux", "chez", "ets")
#: Replacements of the name key, in order.
SOUNDS = (("eau", "o"), ("au", "o"), ("ph", "f"), ("qu", "k"), ("ck", "k"), ("ch", "sh"), ("y", "i"), ("q", "k"), ("c", "k"), ("z", "s"), ("h", ""))
#: Words of a client's name that carry no identity; words of a call that a name key leaves out.
NAME_GENERIC = ("le", "la", "les", "de", "du", "des", "d", "au", "aux", "a", "l", "restaurant", "resto", "hotel", "bar", "brasserie", "bistrot", "sarl", "sas", "sasu", "eurl", "societe", "appareil")
CALL_WORDS = ("bonjour", "bonsoir", "salut", "c", "est", "chez", "pour", "commande", "aujourd", "hui", "demain")


def strip_accents(text: Column) -> Column:
    """Letters without their marks. A text of ASCII alone, of as many bytes as letters, is left as it is."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), ACCENTED, BARE))


def canonical(text: Column) -> Column:
    """Without accents, lower case, one space for whatever is neither a-z nor 0-9; null as the empty text."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(canonical(text), " "), lambda t: t != "")


def header_key(text: Column) -> Column:
    return F.replace(canonical(text), F.lit(" "), F.lit(""))


def without(token_array: Column, words: tuple[str, ...] = GENERIC) -> Column:
    """Tokens less the given words; repeats of others stay."""
    return F.filter(token_array, lambda t: ~t.isin(*words))


def holds_sequence(text: Column, part: Column) -> Column:
    """Whether the tokens of part stand next to each other in text, both canonical; an empty part is in nothing."""
    space = F.lit(" ")
    return (part != "") & F.contains(F.concat(space, text, space), F.concat(space, part, space))


def content_tokens(text: Column, stop: tuple[str, ...] = GENERIC, least: int = 3) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop))


def root(token: Column) -> Column:
    """A token without its plural ending."""
    return F.when((F.length(token) > 4) & F.endswith(token, F.lit("es")), F.substr(token, F.lit(1), F.length(token) - 2)).when(
        (F.length(token) > 3) & F.endswith(token, F.lit("s")), F.substr(token, F.lit(1), F.length(token) - 1)
    ).otherwise(token)


def single_letters(text: Column) -> Column:
    """Repeated characters as one."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def name_key(text: Column) -> Column:
    """A phonetic key: generic words and words of a call dropped, the rest joined, sounds replaced in order, repeated characters as one."""
    joined = F.array_join(without(tokens(text), NAME_GENERIC + CALL_WORDS), "")
    return single_letters(reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SOUNDS, joined))


def consonant_key(text: Column) -> Column:
    return F.regexp_replace(F.replace(name_key(text), F.lit("ts"), F.lit("s")), "[aeiou]", "")


def reference_slug(text: Column, prefix: str = "NC-") -> Column:
    """A reference that is safe in a file name: 64 characters at most, with the prefix."""
    safe = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_.-]+", "-")
    return F.concat(F.lit(prefix), F.substring(F.regexp_replace(safe, "^-+|-+$", ""), 1, 64))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def windows(token_array: Column, width: int = 42, overlap: int = 14) -> Column:
    """Overlapping runs of tokens: as many as it takes for the last to reach the end; none for no tokens."""
    step = width - overlap
    count = F.greatest(F.ceil((F.size(token_array) - overlap) / step), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    return F.when(F.size(token_array) == 0, F.array()).otherwise(F.transform(starts, lambda i: F.slice(token_array, i * step + 1, F.lit(width))))
