import random

from orderloom.operators.mentions import MENTION, MERGED, NO_QUANTITY, REPEATED, one_core, tidied, without_repeats, without_rewordings, without_storm
from pyspark.sql import functions as F


def m(product, quantity=None, unit=None, **x):
    return {"product": product, "quantity": quantity, "unit": unit, "multiple": None, "said": f"said {product}", "precisions": [], "exclusions": [], "reasons": []} | x


def short(mentions):
    return [(x["product"], x["quantity"]) for x in mentions]


def test_repeated_blocks():
    a, b, c = m("pain", 1.0), m("sel", 2.0, "KG"), m("riz")
    found = without_repeats([a, b, a, b, a, b, c])
    assert short(found) == [("pain", 1.0), ("sel", 2.0), ("riz", None)] and [x["reasons"] for x in found] == [[REPEATED], [REPEATED], []]
    assert short(without_repeats([a, a, m("pain", 2.0), m("sel", 2.0, "L"), b])) == [("pain", 1.0), ("pain", 2.0), ("sel", 2.0), ("sel", 2.0)]
    nine = [m(f"p{i}") for i in range(9)]
    assert without_repeats([*nine, *nine]) == [*nine, *nine] and len(without_repeats([*nine[:8], *nine[:8]])) == 8
    assert without_repeats([]) == []


def test_storms():
    said = [m("pain", reasons=[REPEATED]), m("sel"), m("pain", 3.0), m("sel"), m(""), m("riz"), m("")]
    assert short(without_storm(said)) == [("pain", None), ("sel", None), ("", None), ("riz", None), ("", None)]
    assert without_storm([x | {"reasons": []} for x in said]) == [x | {"reasons": []} for x in said]
    assert without_storm(said[:3]) == said[:3]


def test_cores():
    assert one_core({"oeuf", "liquide"}, {"des", "oeuf", "entier"}) and not one_core({"oeuf", "blanc"}, {"oeuf", "jaune"}) and not one_core({"rape"}, {"bloc"}) and not one_core({"oeuf"}, {"lait"})
    assert one_core({"fromage", "rape"}, {"fromage"})


#: said in this order: what must come out
REWORDINGS = [
    ([m("sas tomates"), m("tomates sas rondes", 4.0, "CAR")], [("tomates sas rondes", 4.0)]),
    ([m("oeuf liquide", 2.0), m("oeuf entier", 2.0)], [("oeuf liquide entier", 2.0)]),
    ([m("oeuf blanc", 2.0), m("oeuf jaune", 2.0)], [("oeuf blanc", 2.0), ("oeuf jaune", 2.0)]),
    ([m("lait", 2.0), m("lait", 3.0)], [("lait", 2.0), ("lait", 3.0)]),
    ([m("lait", 2.0, "L"), m("lait", None, "CAR")], [("lait", 2.0), ("lait", None)]),
    ([m("lait", 2.0, multiple=6.0), m("lait")], [("lait", 2.0), ("lait", None)]),
    ([m("lait"), m("pain"), m("sel"), m("riz"), m("lait", 2.0)], [("lait", None), ("pain", None), ("sel", None), ("riz", None), ("lait", 2.0)]),
    ([m("lait"), m("pain"), m("sel"), m("lait", 2.0)], [("lait", 2.0), ("pain", None), ("sel", None)]),
    ([m(""), m("")], [("", None), ("", None)]),
]


def test_rewordings():
    for said, want in REWORDINGS:
        assert short(without_rewordings(said)) == want
    (one,) = without_rewordings([m("lait", said="chez lait", reasons=[NO_QUANTITY, "z"], precisions=["a"], exclusions=["x"]), m("lait", 2.0, "CAR", said="2 cartons de lait", precisions=["b"], exclusions=["x", "y"], reasons=["b"])])
    assert one == m("lait", 2.0, "CAR", said="2 cartons de lait", precisions=["a", "b"], exclusions=["x", "y"], reasons=["b", MERGED, "z"])


def test_calls_as_arrays(spark):
    rng = random.Random(2)
    calls = [[m(rng.choice(["pain", "pain rond", "oeuf entier", "oeuf liquide", "sel", ""]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "KG"])) for _ in range(rng.randint(0, 12))] for _ in range(150)]
    rows = [(i, [tuple(x.values()) for x in call]) for i, call in enumerate(calls)] + [(900, None), (901, [(None,) * 8, (None,) * 8])]
    got = {r.i: r.t for r in spark.createDataFrame(rows, f"i int, c {MENTION}").repartition(3).select("i", tidied(F.col("c")).alias("t")).collect()}
    for i, call in enumerate(calls):
        want = without_rewordings(without_storm(without_repeats(without_repeats(call))))
        assert [x.asDict() for x in got[i]] == want and len(want) <= len(call)
    assert got[900] is None and [x.product for x in got[901]] == [""]
