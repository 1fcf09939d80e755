import random

import pytest
from orderloom.operators.consolidation import PRODUCT, TOOL_WORDS, blocking, order_lines, rising_status
from pyspark.sql import functions as F

SCHEMA = "o string, " + ", ".join(f"{k} {t}" for k, t in PRODUCT.items())


def product(order, index, code, said="", quantity=1.0, **x):
    row = {"segment": "", "label": f"ARTICLE {code}", "quantity_said": None, "unit": "PCE", "unit_said": "PCE", "price": 1.0, "score": 80.0, "selection_score": 80.0, "text_score": 60.0, "reliable": True, "ambiguous": False, "recognised": True, "reasons": None}
    row |= {"index": index, "code": code, "said": said, "quantity": quantity} | x
    return (order, *[row[k] for k in PRODUCT])


def run(spark, rows):
    lines, reasons = order_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), "o")
    found = {r.o: ([], r.reasons) for r in reasons.collect()}
    for r in lines.orderBy("o", "line").collect():
        found[r.o][0].append((r.line, r.code, r.quantity, r.unit, r.source, r.segments))
    return found


def test_expected_lines(spark):
    rows = [
        product("twice", 1, "A1", "2 article A1", 2.0, reliable=False, ambiguous=True, score=45.0), product("twice", 2, "A1", "12 article A1", 12.0),
        product("two", 1, "A1", "article un"), product("two", 2, "A2", "article un", 2.0),
        product("same words", 1, "A", "les tomates", 1.0, segment="s1"), product("same words", 2, "B", "pain", 1.0), product("same words", 3, "A", "tomates 2", 5.0, segment="s2"), product("same words", 4, "A", "des tomates", 7.0, segment="s3", score=1.0),
        product("kinds", 1, "A", "glace vanille", 1.0, segment="s1", text_score=70.0, label="GLACE"), product("kinds", 2, "A", "glace fraise", 2.0, segment="s2", text_score=70.0, label="GLACE"),
        product("told by the label", 1, "A", "glace vanille", 1.0, segment="s1", text_score=70.0, label="GLACE VANILLE"), product("told by the label", 2, "A", "glace fraise", 2.0, segment="s2", text_score=70.0, label="GLACE VANILLE"),
        product("no number", 1, "A", "pain", None), product("no number", 2, "B", "sel", None, recognised=None), product("no number", 3, "C", "riz", None, quantity_said=4.0, price=0.0),
        product("nothing", 1, None), product("nothing", 2, "A", recognised=False),
        product("still unclear", 1, "A", "pain", None, reasons=["quantite_absente_a_resoudre", "autre"], ambiguous=True), product("still unclear", 2, "B", "sel", None, reasons=["quantite_commande_non_resolue"], ambiguous=True),
    ]
    got = run(spark, rows)
    assert got["twice"] == ([(1, "A1", 12.0, "PI", 2, [])], ["article_duplique_consolide_A1"])
    assert [x[:3] for x in got["two"][0]] == [(1, "A1", 1.0), (2, "A2", 2.0)] and got["two"][1] == []
    assert got["same words"] == ([(1, "A", 5.0, "PI", 3, ["s2", "s1", "s3"]), (2, "B", 1.0, "PI", 2, [])], ["article_duplique_consolide_A"])
    assert got["kinds"] == ([(1, "A", 1.0, "PI", 1, ["s1"]), (2, "A", 2.0, "PI", 2, ["s2"])], [])
    assert got["told by the label"] == ([(1, "A", 2.0, "PI", 2, ["s2"])], ["article_duplique_consolide_A"])
    assert [x[:3] for x in got["no number"][0]] == [(1, "A", 1.0), (2, "C", 4.0)]
    assert got["no number"][1] == ["produit_non_vendu_prix_zero_ligne_2", "quantite_absente_ligne_2", "quantite_implicite_un_ligne_1"]
    assert got["nothing"] == ([], ["produit_non_vendu_aucune_selection"])
    assert got["still unclear"][1] == ["produit_ambigu_ligne_1", "quantite_implicite_un_ligne_1", "quantite_implicite_un_ligne_2"]


def plainly(products):
    """One order's lines, product by product. products: dicts by index."""
    lines, apart = [], set()
    words = lambda p: [w for w in p["said"].split() if w not in TOOL_WORDS and not w.isdigit()]

    def hidden(a, b):
        x, y, label = words(a), words(b), set(a["label"].lower().split())
        if not (a["segment"] and b["segment"] and a["segment"] != b["segment"] and x and y and x != y):
            return False
        if min(a["text_score"], b["text_score"]) < 65 or abs(a["text_score"] - b["text_score"]) > 0.01 or not set(x) ^ set(y) or (set(x) ^ set(y)) & label:
            return False
        return x[0] == y[0] or not set(x) & set(y)

    for p in products:
        quality = (p["reliable"], not p["ambiguous"], p["score"], p["selection_score"], True, p["index"])
        own = [x for x in lines if x["p"]["code"] == p["code"]]
        same = next((x for x in own if words(p) and words(x["p"]) == words(p)), None)
        if same is None and any(hidden(p, x["p"]) for x in own):
            apart.add(p["code"])
        into = same or (own[0] if own and p["code"] not in apart else None)
        if into is None:
            lines.append({"p": p, "quality": quality, "segments": [p["segment"]] if p["segment"] else []})
            continue
        better = quality > into["quality"]
        if same is not None:
            new = [p["segment"], into["p"]["segment"]] if better else [*into["segments"], p["segment"]]
            into["segments"] = [s for s in dict.fromkeys(new) if s]
        elif better:
            into["segments"] = [p["segment"]] if p["segment"] else []
        if better:
            into |= {"p": p, "quality": quality}
    return [(n, x["p"]["code"], x["p"]["quantity"], "PI", x["p"]["index"], x["segments"]) for n, x in enumerate(lines, 1)]


def test_lines_as_product_by_product(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for o in range(150):
        products = []
        for i in range(1, rng.randint(1, 9) + 1):
            said = " ".join(rng.choice(["glace", "vanille", "fraise", "de", "2", "pain"]) for _ in range(rng.randint(0, 3)))
            x = {"segment": rng.choice(["", "s1", "s2", "s3"]), "text_score": rng.choice([60.0, 70.0, 70.005, 80.0]), "score": rng.choice([1.0, 2.0]), "selection_score": 1.0, "reliable": rng.random() < 0.5, "ambiguous": rng.random() < 0.5, "label": rng.choice(["GLACE", "GLACE VANILLE"])}
            rows.append(product(str(o), i, rng.choice("AB"), said, float(i), **x))
            products.append(x | {"index": i, "code": rows[-1][3], "said": said, "quantity": float(i)})
        want[str(o)] = plainly(products)
    assert {o: x for o, (x, _) in run(spark, rows).items()} == want


def test_blocking_reasons(spark):
    df = spark.createDataFrame([(["article_duplique_consolide_A", "quantite_absente_ligne_2", "x"], True), (["article_duplique_consolide_A", "quantite_absente_ligne_2"], False), ([], True)], "r array<string>, n boolean")
    assert [r[0] for r in df.select(blocking(F.col("r"), F.col("n"))).collect()] == [["x"], ["quantite_absente_ligne_2", "produit_non_vendu_aucune_selection"], []]


@pytest.mark.parametrize("order", [1, -1])
def test_status_only_rises(spark, order):
    #: key, version, client known, blocked, changed, came as accepted; status
    rows = [
        ("a", 1, True, True, True, False, "PROBLEMATIQUE"), ("a", 2, True, False, True, False, "VALIDEE"), ("a", 3, False, True, True, False, "VALIDEE"),
        ("b", 1, False, False, True, False, "PROBLEMATIQUE"), ("b", 2, True, False, False, False, "PROBLEMATIQUE"), ("b", 3, None, None, None, None, "PROBLEMATIQUE"),
        ("c", 1, False, True, False, True, "VALIDEE"), ("c", 2, False, True, False, False, "VALIDEE"),
    ]
    df = spark.createDataFrame(rows[::order], "k string, v int, known boolean, blocked boolean, changed boolean, accepted boolean, want string")
    assert all(r.status == r.want for r in rising_status(df, "k", "v", "known", "blocked", "changed", "accepted").collect())
