import random
import re
from itertools import permutations

import pytest
from orderloom.llm.filter_audit import failures, interaction

from .conftest import EDGES


def plainly(docs, labels):
    """Every document through every order, one by one. docs: doc_id, text, lang."""
    great = 1 << 70
    at = lambda i: great if i is None else i
    least = {}
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", great), at(i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    by_part = {}
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": least[t] < at(i),
        }
        by_part.setdefault(part or "", []).append((fails, i in good, i in toxic))
    found = {}
    for part, rows in by_part.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                out = [r for r in left if r[0][f]]
                stay = [r for r in left if not r[0][f]]
                total[f] += len(out)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                found[part, order, step] = [len(stay), len(out), sum(r[0][f] for r in rows) - len(out), alone, sum(r[1] for r in out), sum(r[2] for r in out)]
                left = stay
        for (p, order, step), row in found.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in interaction(failures(docs, labels), list("ABCDE")).collect()}


def test_against_running_every_order(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "GAMMA", "delta#", "eps", "ÉTÉ", "x|y", "\n", "z"]
    texts = [" ".join((rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(500)}") for _ in range(rng.choice([3, 90, 100, 101, 200]))) for _ in range(120)]
    docs = [(rng.choice([None, *range(300)]), rng.choice([None, "", *texts, *texts]), rng.choice([None, "", "en", "fr"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(300)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(250)]
    got = audited(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == plainly(docs, labels)


def test_edges_and_nothing(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(edges, none) == plainly([r[:3] for r in EDGES], [])
    assert audited(edges.withColumnsRenamed({"key": "digest", "size": "A", "source": "part"}), None) == plainly([r[:3] for r in EDGES], [])
    assert audited(nothing, none) == {}


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None, None), ("p", True, True, None), (None, False, False, True)], "part string, x boolean, y boolean, good boolean").selectExpr("*", "false toxic")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in interaction(rows, ["x", "y"]).collect()}
    assert got["p", "xy", 1] == (0, 2, 0, 1, 0, 3) and got["p", "xy", 2] == (0, 0, 1, 0, 0, 1) and got["p", "yx", 1] == (1, 1, 0, 0, 0, 1)
    assert got["", "yx", 2] == (1, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        interaction(rows, ["x", "x"])
