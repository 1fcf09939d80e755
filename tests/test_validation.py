import pytest
from orderloom.operators.validation import accepted_lines, checked_lines, proven, says_a_number, spoken
from pyspark.sql import functions as F

LINES = "o int, index int, code string, source string, quantity double, unit string, confidence double"
GOODS = "code string, label string, unit string, capacity double, capacity_unit string, variable_weight boolean"


@pytest.mark.parametrize(
    ("sentence", "number"),
    [("2 cartons", True), ("deux cartons", True), ("creme 30 %", False), ("creme 30% et 2 pots", True), ("lait 3,5 % leger", False), ("rhum 40 degres", False), ("trente pour cent", False), ("du pain", False), ("", False), (None, False), ("3.5 kilos", True)],
)
def test_numbers_that_are_said(spark, sentence, number):
    assert spark.createDataFrame([(sentence,)], "s string").select(says_a_number(spoken(F.col("s")))).first()[0] is number


def test_proofs(spark):
    rows = [("deux Cartons", "il faut deux cartons de lait", True), ("lait deux cartons", "deux cartons", True), ("trois cartons pain lait sel", "du lait", False), ("le", "la", False), ("", "x", False), ("x", "", False), (None, None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(bool(r.got) == r.want for r in df.withColumn("got", proven(F.col("a"), F.col("b"))).collect())


def run(spark, lines, transcripts=((1, "deux cartons de lait et 12 litres d'eau, 3 pains, 1 pain, du sel 30%"), (2, None))):
    goods = [("A", "LAIT", "CAR", None, None, None), ("B", "EAU 6X1L", "pack", 6.0, "L", False), ("C", "PAIN", None, None, None, None), ("D", "SEL", "PI", None, None, None)]
    checked = checked_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(goods, GOODS), spark.createDataFrame(list(transcripts), "o int, transcript string"), "o")
    return {(r.o, r["index"]): r for r in checked.collect()}, {(r.o, r.code): r for r in accepted_lines(checked, "o").collect()}


def test_lines_and_reasons(spark):
    lines = [
        (1, 1, " A ", "deux cartons de lait", 9.0, "PI", 0.9), (1, 2, "B", "12 litres d'eau", 12.0, None, 0.8), (1, 3, "C", "3 pains", 3.0, "pi", 0.5), (1, 4, "C", "1 pain", 1.0, "PI", 0.7), (1, 5, "C", "3 pains", 2.0, "PI", 0.9),
        (1, 6, "Z", "3 pains", 3.0, "PI", 0.9), (1, 7, "C", "3 pains", 0.0, "", 0.1), (1, 8, "D", "du sel 30%", 30.0, "PI", 1.1), (1, 9, "A", "4 sacs de riz blanc", float("nan"), None, float("nan")), (2, 1, "A", "2 cartons", None, None, None), (1, 10, None, None, 20_000.0, None, 0.9),
        (3, 1, "A", "2 cartons", 1.0, None, 0.4),
    ]
    got, kept = run(spark, lines)
    reasons = {k: list(r.reasons) for k, r in got.items()}
    assert reasons[1, 1] == reasons[1, 2] == reasons[1, 3] == reasons[1, 4] == []
    assert reasons[1, 6] == ["code_hors_catalogue_autorise"]
    assert reasons[1, 7] == ["quantite_invalide", "unite_incompatible_catalogue", "confiance_insuffisante"]
    assert reasons[1, 8] == ["quantite_non_prouvee_transcription", "confiance_insuffisante"]
    assert reasons[1, 9] == ["quantite_invalide", "confiance_insuffisante", "preuve_absente_transcription"]
    assert reasons[2, 1] == ["quantite_invalide", "confiance_insuffisante", "preuve_absente_transcription"]
    assert reasons[1, 10] == ["code_hors_catalogue_autorise", "quantite_invalide", "quantite_non_prouvee_transcription", "unite_incompatible_catalogue", "preuve_absente_transcription"]
    assert reasons[3, 1] == ["preuve_absente_transcription"]
    assert (got[1, 1].quantity, got[1, 1].unit, got[1, 1].quantity_resolution) == (2.0, "CAR", "nombre_explicite")
    assert (got[1, 2].quantity, got[1, 2].unit, got[1, 2].quantity_resolution) == (2.0, "PACK", "mesure_l_divisee_par_capacite_officielle")
    assert (got[1, 3].quantity, got[1, 3].unit, got[1, 3].quantity_resolution) == (3.0, "PI", "llama_quantity")
    c = kept[1, "C"]
    assert (c.quantity, c.confidence, c.source, c["first"]) == (6.0, 0.5, "3 pains + 1 pain + 3 pains", 3) and set(kept) == {(1, "A"), (1, "B"), (1, "C")}


def test_one_sentence_twice(spark):
    _, kept = run(spark, [(1, 1, "C", "3 pains", 3.0, "PI", 0.5), (1, 2, "C", " 3 PAINS", 4.0, "PI", 0.4), (1, 3, "C", "1 pain", 1.0, "PI", 0.9)])
    assert (kept[1, "C"].quantity, kept[1, "C"].confidence, kept[1, "C"].source) == (5.0, 0.5, "3 pains + 1 pain")
    assert run(spark, [])[0] == {}
