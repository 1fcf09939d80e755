import random

from orderloom.operators.families import BY_ATTRIBUTE, EXCLUSIVE, NOT_CORE, fallback_bonuses, heard_in, secondary_signals
from orderloom.operators.matching import token_score
from pyspark.sql import functions as F

SCHEMA = "m int, code string, said array<string>, label array<string>, score double, own boolean, other boolean, source string, conflict boolean"


def anchors(said, label):
    return {w for w in said if len(w) >= 3 and w not in NOT_CORE and not w.isdigit() and any(token_score(w, x) >= 90 for x in label)}


def plainly(rows):
    """Every candidate against every other of its mention."""
    eligible, bonuses = set(), {}
    for m in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == m]
        with_anchor = [r for r in group if anchors(r[2], r[3])]
        best = max((r[4] for r in with_anchor), default=0)
        eligible |= {(m, r[1]) for r in with_anchor if r[4] >= max(30, best - 35)}
        for r in group:
            said, mine = r[2], anchors(r[2], r[3])
            if not r[6] or not mine:
                continue
            own = [x for x in with_anchor if x[5] and anchors(said, x[3]) & mine]
            if not own:
                continue
            asked = [set(said) & set(words) for words in EXCLUSIVE.values() if set(said) & set(words)]
            full = lambda label: all(a & set(label) for a in asked)
            if asked and full(r[3]) and not any(not x[8] and full(x[3]) for x in own) and r[4] >= max(x[4] for x in own) - 5:
                bonuses[m, r[1]] = BY_ATTRIBUTE
                continue
            family = [x for x in with_anchor if x[6] and anchors(said, x[3]) & mine]
            rest = [w for w in said if w not in mine and w not in NOT_CORE and len(w) >= 3]
            if len(rest) != 1 or len(rest[0]) > 3:
                continue
            read = lambda x: max((token_score(rest[0], w) for w in x[3]), default=0.0)
            if max(map(read, own + family)) >= 70:
                continue
            if round(read(r), 2) >= 45 and round(read(r), 2) >= max(round(read(x), 2) for x in own) + 15:
                bonuses[m, r[1]] = f"fallback_{'catalogue' if r[7] == 'catalogue_global' else 'reappro'}_variante_phonetique_intra_famille"
    return eligible, bonuses


def test_against_every_pair(spark):
    rng = random.Random(12)
    words = ["creme", "cremes", "glace", "fraise", "citron", "cube", "rape", "tarte", "xrf", "xarf", "exquise", "xr", "carton", "12", "pot", "fromage", "urf"]
    rows = []
    for m in range(400):
        said = [rng.choice(words[:9]) for _ in range(rng.randint(1, 4))]
        for c in range(rng.randint(1, 9)):
            own = rng.random() < 0.4
            label = [rng.choice(said if rng.random() < 0.7 else words) for _ in range(rng.randint(1, 4))]
            label = ["xfab" if w == "xrf" and rng.random() < 0.8 else w for w in label]
            rows.append((m, f"c{c}", said, label, float(rng.choice([20, 30, 50, 60, 63, 90])), own, not own and rng.random() < 0.8, rng.choice(["catalogue_global", "catalogue_reappro"]), rng.random() < 0.2))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    eligible, bonuses = plainly(rows)
    got = secondary_signals(df, "m", "said", "label", "score").collect()
    assert {(r.m, r.code) for r in got if r.eligible} == eligible and len(got) == len(rows)
    found = fallback_bonuses(df, "m", "code", "said", "label", "score", "own", "other", "source", "conflict").collect()
    assert {(r.m, r.code): r.reason for r in found} == bonuses and all(r.bonus == 125.0 for r in found)
    assert len(set(bonuses.values())) == 3


def test_odd_rows(spark):
    rows = [(1, "a", None, ["creme"], 90.0, True, False, None, None), (1, "b", ["creme"], None, 90.0, False, True, None, None), (2, "c", ["creme"], ["creme"], None, None, None, None, None), (2, "d", [], [], 1.0, True, True, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.eligible for r in secondary_signals(df, "m", "said", "label", "score").orderBy("code").collect()] == [False] * 4
    assert fallback_bonuses(df, "m", "code", "said", "label", "score", "own", "other", "source", "conflict").count() == 0
    assert df.select(heard_in(F.col("said"), F.col("label")).alias("h")).where("size(h.anchors) > 0").count() == 1
