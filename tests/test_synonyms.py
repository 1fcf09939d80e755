import random
from itertools import permutations

import pytest
from orderloom.functions.similarity import indel
from orderloom.operators.synonyms import Confirmations, Dictionary, confirmed_by, heard_as, inflected, search_variants
from pyspark.sql import functions as F


def test_inflections():
    assert inflected("sauces fromagere") == {"sauces fromagere", "sauce fromagere", "sauces fromageres"}
    assert inflected("pates") == {"pates", "pate"} and inflected("ble") == {"ble"} and inflected("pois") == {"pois", "poiss"} and inflected("") == {""}


@pytest.mark.parametrize(("heard", "term", "fits"), [("cheese cream", "cream cheese", True), ("creams cheese", "cream cheese", True), ("creams cheeses", "cream cheese", False), ("cram chees", "cream cheese", False), ("huile olive vierge", "olive vierge huile", True), ("huile olivo vierge", "huile olive verte", False)])
def test_words_heard_as_a_term(heard, term, fits):
    assert heard_as(heard.split(), term.split()) == fits


def plainly(base, groups):
    """Every group and every term on every window of the text."""
    found, words = {base}, base.split()
    for name, aliases in groups.items():
        terms = sorted({f for t in (name, *aliases) for f in inflected(t) if f})
        present = {t for t in terms if f" {t} " in f" {base} "}
        for t in terms:
            n = len(t.split())
            if 2 <= n <= 3:
                for i in range(len(words) - n + 1):
                    window = words[i : i + n]
                    best = max((tuple(indel(a, b) for a, b in zip(p, t.split(), strict=True)) for p in permutations(window)), key=sum)
                    if min(best) >= 85 and sum(best) / n >= 92 and sum(s < 99.9 for s in best) <= 1:
                        present.add(" ".join(window))
        found |= {base.replace(p, t) for p in present for t in terms}
    return sorted(found, key=lambda v: (-len(v), v))[:16]


def test_variants_against_all_terms_on_all_windows(spark):
    rng = random.Random(7)
    words = ["creme", "cremes", "fromage", "frais", "fouette", "cream", "cheese", "huile", "olive", "olives", "vierge", "de", "pain", "pains", "mie", "12"]
    groups = {" ".join(rng.sample(words, rng.randint(1, 3))): [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(rng.randint(0, 4))] for _ in range(14)}
    mangle = lambda w: w + "s" if rng.random() < 0.2 else w[:-1] if rng.random() < 0.1 else w
    texts = list(dict.fromkeys(" ".join(mangle(rng.choice(words)) for _ in range(rng.randint(1, 6))).strip() for _ in range(300)))
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, "Crème  FRAÎCHE"]], "t string").repartition(3)
    got = {r.t: r.v for r in df.select("t", search_variants(F.col("t"), groups).alias("v")).collect()}
    assert all(got[t] == plainly(" ".join(t.split()), groups) for t in texts)
    assert got[""] == got[None] == [] and got["Crème  FRAÎCHE"] == plainly("creme fraiche", groups)
    assert sum(len(v) > 1 for v in got.values()) > 100


def test_a_canonical_form_stands_for_its_aliases_too():
    book = Dictionary({"cream cheese": ["fromage fouette"]})
    assert book.variants("du cream cheese") == ["du fromage fouettes", "du fromages fouette", "du fromage fouette", "du cream cheeses", "du creams cheese", "du cream cheese"]
    assert "du cream cheese" in book.variants("du fromages fouette") and "le cream cheese" in book.variants("le fouette fromage")
    assert book.variants("du pain") == ["du pain"]


def test_confirmations(spark):
    groups = {"fromage blanc": ["faisselle nature", "petit suisse 5", "blanc"], "huile": ["huile olive"], "sauce tomate basilic": ["napoletana sauce", "sauce rouge"]}
    book = Confirmations(groups)
    cases = [
        ("de la faisselle nature 2", "fromage blanc", "faisselle nature"), ("faisselle natures", "fromage blanc", None), ("petit suisse 5", "fromage blanc 1kg", "petit suisse 5"), ("petit suisse", "fromage blanc", None),
        ("blanc", "fromage blanc", None), ("huile olive", "huile", None), ("sauce rouge", "sauce tomate basilic", "sauce rouge"), ("sauce rouge", "sauce soja", None), ("", "fromage blanc", None), (None, None, None),
    ]
    assert [book.confirm(a or "", b or "") for a, b, _ in cases] == [c for _, _, c in cases]
    df = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(cases)], "n int, a string, b string")
    assert [r.c for r in df.select("n", confirmed_by(F.col("a"), F.col("b"), groups).alias("c")).orderBy("n").collect()] == [c for _, _, c in cases]


def test_a_dictionary_has_a_bound(monkeypatch):
    monkeypatch.setattr("orderloom.operators.synonyms.MOST_TERMS", 3)
    with pytest.raises(ValueError):
        Dictionary({"cream cheese": ["fromage fouette"]})
