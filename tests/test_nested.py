import json
import random
from collections import Counter

from orderloom.operators.nested import deeper, entries, labels_of_codes, manifest_report

FORBIDDEN = ["truth", "erp", "article"]


def walk(value, path="$", name=None, level=0):
    yield path, name, level, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from walk(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", k if isinstance(value, dict) else None, level + 1)


def random_value(rng, depth):
    kind = rng.randrange(5 if depth else 3)
    if kind < 3:
        return rng.choice([1, "x", "12", True, None, "é ü"])
    if kind == 3:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: random_value(rng, depth - 1) for k in rng.sample(["code", "produit", "a", "b", "TruthX"], rng.randrange(5))}


def test_entries_against_a_walk(spark):
    rng = random.Random(3)
    values = [random_value(rng, 4) for _ in range(120)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{no json"), (902, "")]
    df = spark.createDataFrame(rows, "i int, j string").repartition(4)
    got = sorted((r.i, r.path, r.name or "", r.level) for r in entries(df, "i", "j", 5).collect())
    assert got == sorted((i, path, name or "", level) for i, v in enumerate(values) for path, name, level, _ in walk(v))
    shallow = sorted((r.i, r.path) for r in deeper(df, "i", "j", 2).collect())
    assert shallow == sorted((i, path) for i, v in enumerate(values) for path, _, level, x in walk(v) if level == 2 and isinstance(x, (dict, list)) and x)
    texts = {(r.i, r.path): r.text for r in entries(df, "i", "j", 5).collect()}
    assert all(texts[i, path] == x for i, v in enumerate(values) for path, _, _, x in walk(v) if isinstance(x, str))


def test_labels_of_codes(spark):
    rng = random.Random(5)
    values = [{"code": rng.choice(["a1", " A1 ", 12, "", None, "123456789"]), "produit": rng.choice(["pain", " pain", "sel", "", None]), "more": [{"deep": {"code": "b", "produit": rng.choice(["x", "y"])}}]} for _ in range(60)]
    counts = Counter()
    for v in values:
        for _, _, _, x in walk(v):
            if isinstance(x, dict):
                code, label = (str("" if x.get(k) is None else x[k]).strip() for k in ("code", "produit"))
                if code and label:
                    counts[code.upper().zfill(8), label] += 1
    best = {}
    for (code, label), n in counts.items():
        best[code] = min(best.get(code, (0, "")), (-n, label)) if code in best else (-n, label)
    got = {r.code: (-r.n, r.label) for r in labels_of_codes(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string"), "i", "j", "code", "produit").collect()}
    assert got == best


def test_manifest_report(spark):
    good = "0aF" * 21 + "b"
    rows = {
        1: ({"audio": "a.wav", "sha": good}, []), 2: ({"audio": "a.wav", "sha": good}, ["duplicate_name"]), 3: ({"audio": "x/a.wav", "sha": good[1:]}, ["bad_digest", "bad_name"]),
        4: ({"audio": "b.wav", "sha": good, "Order": 1, "my_ERP": {"deep": [{"TruthX": 1}]}}, ["forbidden:$.my_ERP", "forbidden:$.my_ERP.deep[0].TruthX", "unexpected:Order", "unexpected:my_ERP"]),
        5: ([1], ["not_an_object"]), 6: (None, ["not_an_object"]), 7: ({}, ["bad_digest", "bad_name"]), 8: ({"audio": "c.wav", "sha": good}, []),
    }
    df = spark.createDataFrame([(i, None if v is None else json.dumps(v)) for i, (v, _) in rows.items()] + [(9, "{")], "i int, j string")
    got = {r.i: r.faults for r in manifest_report(df, "i", "j", ["audio", "sha"], FORBIDDEN, "audio", "sha").collect()}
    assert got == {i: want for i, (_, want) in rows.items()} | {9: ["not_an_object"]}
    assert manifest_report(df.limit(0), "i", "j", ["audio"], FORBIDDEN, "audio", "sha").count() == 0
