"""Search variants of a product's words by declared synonyms, and what confirms one.

A dictionary has a canonical form and its aliases for each group; all terms of a group stand for each other. It is a parameter of
stated size, which goes to the tasks with the function; texts are rewritten where they stand, one Arrow batch at a time, so no row
moves. A group is looked up by its terms and by their words, not tried on every text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import indel
from .matching import set_ratio

#: Variants of a text at most: the longest, then the first. Terms of a dictionary at most.
MOST, MOST_TERMS = 16, 50_000
#: The least score of each word of a term that was heard in another order or form, of their mean, and when a word is perfect.
WORD, MEAN, PERFECT = 85.0, 92.0, 99.9
#: Fixed value: how near a label must be to a canonical form for an alias of it to confirm the label.
CONFIRMED = 88.0


def inflected(term: str) -> set[str]:
    """A term, and with one of its words in the other number: es and s lose their last letter from five letters on, others get an s from four on."""
    words = term.split()
    forms = {term}
    for i, w in enumerate(words):
        other = w[:-1] if len(w) >= 5 and w.endswith("s") else w + "s" if len(w) >= 4 and not (w.endswith("s") and len(w) >= 5) else None
        if other:
            forms.add(" ".join([*words[:i], other, *words[i + 1 :]]))
    return forms


def heard_as(window: Sequence[str], term: Sequence[str]) -> bool:
    """Whether words, in some order, are a term's with at most one of them imperfect. The order of the best sum counts, of equal ones the first."""
    best: tuple[float, ...] = ()
    for order in permutations(window):
        scores = tuple(indel(a, b) for a, b in zip(order, term, strict=True))
        if not best or sum(scores) > sum(best):
            best = scores
    return min(best) >= WORD and sum(best) / len(best) >= MEAN and sum(s < PERFECT for s in best) <= 1


class Dictionary:
    """Groups of synonyms, canonical texts all of them, by term and by word. canonical(): how texts are written."""

    def __init__(self, groups: Mapping[str, Sequence[str]]):
        self.groups = [(name, sorted({form for term in (name, *terms) for form in inflected(term) if form})) for name, terms in groups.items() if name]
        if sum(len(terms) for _, terms in self.groups) > MOST_TERMS:
            raise ValueError(f"a dictionary has {MOST_TERMS} terms at most")
        self.by_term: dict[str, list[int]] = {}
        self.by_word: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        for g, (_, terms) in enumerate(self.groups):
            for term in terms:
                self.by_term.setdefault(term, []).append(g)
                words = tuple(term.split())
                if 2 <= len(words) <= 3:
                    for w in set(words):
                        self.by_word.setdefault(w, []).append((g, words))
        self.longest = max((len(t.split()) for t in self.by_term), default=0)

    def _said(self, words: list[str]) -> dict[int, set[str]]:
        """For each group the fragments of a text that are a term, or heard as one. A term of two or three words has at most one imperfect, so some word of it stands in the text."""
        found: dict[int, set[str]] = {}
        for n in range(1, self.longest + 1):
            for i in range(len(words) - n + 1):
                fragment = " ".join(words[i : i + n])
                for g in self.by_term.get(fragment, ()):
                    found.setdefault(g, set()).add(fragment)
        for place, w in enumerate(words):
            for g, term in self.by_word.get(w, ()):
                n = len(term)
                for i in range(max(0, place - n + 1), min(place, len(words) - n) + 1):
                    window = words[i : i + n]
                    fragment = " ".join(window)
                    if fragment not in found.get(g, ()) and heard_as(window, term):
                        found.setdefault(g, set()).add(fragment)
        return found

    def variants(self, base: str) -> list[str]:
        """base and what it becomes when a fragment that a group has is replaced, wherever it stands, by each term of the group; the MOST longest, ties in alphabetical order."""
        if not base:
            return []
        found = {base}
        for g, fragments in self._said(base.split()).items():
            for fragment in fragments:
                found.update(base.replace(fragment, term) for term in self.groups[g][1])
        return sorted(found, key=lambda v: (-len(v), v))[:MOST]


def _telling(term: str) -> list[str]:
    return [w for w in term.split() if len(w) >= 3 and not w.isdigit()]


class Confirmations:
    """Aliases of two telling words or more, whose canonical form has as many; the first of the dictionary's order counts."""

    def __init__(self, groups: Mapping[str, Sequence[str]]):
        self.terms = [(name, set(name.split()), alias) for name, terms in groups.items() if len(_telling(name)) >= 2 for alias in terms if len(_telling(alias)) >= 2]
        self.by_word: dict[str, list[int]] = {}
        for n, (_, _, alias) in enumerate(self.terms):
            self.by_word.setdefault(alias.split()[0], []).append(n)

    def confirm(self, said: str, label: str) -> str | None:
        """The alias that stands whole in what was said and whose canonical form the label nearly is."""
        if not said or not label:
            return None
        own, spoken = set(label.split()), f" {said} "
        for n in sorted({n for w in set(said.split()) for n in self.by_word.get(w, ())}):
            _, canonical, alias = self.terms[n]
            if f" {alias} " in spoken and set_ratio(canonical, own) >= CONFIRMED:
                return alias
        return None


def search_variants(said: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """array of the variants of a text by a dictionary of canonical texts; empty for null and for a text without words."""
    book = Dictionary(groups)

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([book.variants(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return of(text.canonical(said))


def confirmed_by(said: Column, label: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """The alias by which what was said confirms a label, or null."""
    book = Confirmations(groups)

    @F.arrow_udf("string")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([book.confirm(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return of(text.canonical(said), text.canonical(label))
