import math

import pytest
from orderloom.operators.winners import CANDIDATE, orderable, phonetic_score, phonetic_signatures, selection_score, winners
from pyspark.sql import functions as F

SCHEMA = "m string, code string, " + ", ".join(f"{k} {t}" for k, t in CANDIDATE.items())


def candidate(mention, code, **x):
    return (mention, code, *[x.get(k) for k in CANDIDATE])


@pytest.mark.parametrize(
    ("x", "can"),
    [
        ({"price": 1.0}, True), ({"price": 0.0}, False), ({"price": -2.0, "known": True}, True), ({}, False), ({"price": 1.0, "label": "a *** b"}, False), ({"price": 1.0, "compatible": False}, False),
        ({"article_source": "referentiel_articles"}, True), ({"article_source": "historique_client_pretest"}, True), ({"article_source": "autre"}, False),
        ({"text_score": 80.0, "last_day": 739_700, "sales": 1}, True), ({"text_score": 79.9, "last_day": 739_700, "sales": 1}, False), ({"text_score": 80.0, "last_day": 739_699, "sales": 1}, False), ({"text_score": 80.0, "last_day": 739_700, "sales": 0}, False),
        ({"text_score": 50.0, "pack_score": 55.0, "last_day": 739_760, "sales": 5, "reasons": ["preference_x"]}, True), ({"text_score": 50.0, "pack_score": 55.0, "last_day": 739_760, "sales": 5, "reasons": ["x"]}, False), ({"text_score": 50.0, "pack_score": 55.0, "last_day": 739_760, "sales": 4, "reasons": ["preference_x"]}, False),
    ],
)
def test_what_can_be_ordered(spark, x, can):
    assert spark.createDataFrame([candidate("m", "c", **x)], SCHEMA).select(orderable()).first()[0] is can


def test_scores(spark):
    rows = [
        ({"text_score": 82.0, "source": "catalogue_global", "sales": 8, "recent_sales": 3, "pack_score": 25.0}, 82 + 30 + 0.05 * 25 + 1.5 * math.log1p(8) + 3.5 * math.log1p(3)),
        ({"text_score": 65.0, "source": "cadencier_client", "pack_score": 25.0, "reasons": ["y", "conversion_depuis_kg"], "last_day": 739_800}, 65 + 80 + 0.7 * 25 + 6),
        ({"source": "catalogue_reappro", "article_source": "referentiel_articles", "attribute_score": 1.0, "physical_score": 2.0, "history_bonus": 4.0, "fallback_bonus": 8.0, "volume_bonus": 16.0}, -30 + 4 + 31),
        ({}, 0.0),
    ]
    df = spark.createDataFrame([candidate("m", str(i), **x) for i, (x, _) in enumerate(rows)], SCHEMA)
    assert [r[0] for r in df.orderBy("code").select(selection_score()).collect()] == pytest.approx([w for _, w in rows], abs=1e-4)


def test_winners_and_ties(spark):
    rows = [
        candidate("a", "2", price=2.0, text_score=50.0), candidate("a", "1", price=1.0, text_score=50.0), candidate("a", "0", text_score=99.0), candidate("b", "9", price=1.0, text_score=7.0),
        candidate("c", "3", text_score=9.0), candidate("d", "5", price=1.0, text_score=20.0), candidate("d", "4", price=1.0, text_score=20.0), candidate("d", "6", price=1.0, text_score=19.5, pack_score=10.0),
    ]
    got = {r.m: tuple(r)[1:] for r in winners(spark.createDataFrame(rows, SCHEMA).repartition(3), "m", "code").collect()}
    assert got == {"a": ("1", 50.0, 0.0, 2), "b": ("9", 7.0, 7.0, 1), "d": ("6", 20.0, 0.0, 3)}


def test_signatures(spark):
    cases = {"Le Château": {"chateau", "cato", }, "des": set(), "thé": {"the"}, "quiche lorraine": {"quichelorraine", "kislorain", "kslrn"}, "": set(), "phare": {"phare", "far"}}
    got = {r.t: set(r.s) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", phonetic_signatures(F.col("t")).alias("s")).collect()}
    assert got["des"] == got[""] == set() and got["thé"] == {"the"} and got["phare"] == {"phare", "far"} and got["Le Château"] == {"chateau", "cato"}
    df = spark.createDataFrame([(1, "phare", "fare"), (2, "", "x"), (3, "pain", "vin"), (4, None, None)], "k int, a string, b string")
    scores = {r.k: r.sound_score for r in phonetic_score(df, ["k"], "a", "b").collect()}
    assert scores[1] == 100.0 and scores[2] == scores[4] == 0.0 and 0 < scores[3] < 100
