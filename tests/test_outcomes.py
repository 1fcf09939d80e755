from pyspark.sql import functions as F

from orderloom.operators import decisions, evaluation
from orderloom.sources import tables


def test_safe_rules_fail_closed(spark):
    rows = [(1, "general", {"a": "x"}), (2, "general", {"client_code": "C1"}), (3, "general", {"client_code": ""}), (4, "other", {}), (5, None, {}), (6, " general ", None)]
    df = spark.createDataFrame(rows, "id long, origin string, rule map<string,string>")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(decisions.safe_rules(df, "origin", "rule", ["general"])) == [1, 3, 6]
    assert ids(decisions.safe_rules(df, "origin", "rule", ["general"], client_rules=True)) == [1, 2, 3, 6]
    assert ids(decisions.safe_rules(df, "origin", "rule", None)) == ids(decisions.safe_rules(df, "origin", "rule", [])) == []


def test_updates_by_place(spark):
    rows = spark.createDataFrame([(1, 1, "a", "NEW"), (1, 2, "b", "NEW"), (2, 1, "c", "SENT"), (3, 1, None, "NEW")], "g long, n long, x string, s string")
    new = spark.createDataFrame([(1, 1, "B"), (1, 0, " "), (1, 9, "none"), (2, 0, "C"), (3, 0, "D")], "g long, index long, x string")
    got = decisions.updated_rows(rows, new, "g", "n", ["x"], F.col("s") == "SENT").orderBy("g", "n").collect()
    assert [(r.x, r.refused, r.changed) for r in got] == [("a", False, False), ("B", False, True), ("c", True, False), ("D", False, True)]


def test_causes_of_one_order_each(spark):
    line = "o long, c string, q double, u string"
    truth = spark.createDataFrame([(1, "A", 1.0, "KG"), (2, "A", 1.0, "KG"), (3, "A", 1.0, None), (3, "A", 1.0, None)], line)
    predicted = spark.createDataFrame([(1, "A", 2.0, "CART"), (1, "B", 1.0, None), (2, "A", 1.0, "KG"), (3, "A", 1.0, None)], line)
    heads = spark.createDataFrame([(1, "c", "d", None, None, "VALIDEE", None, 5), (2, "c", "c", "x", "x", "PROBLEME", None, 1), (3, "c", "c", None, None, "VALIDEE", None, 1), (4, "c", None, "x", None, None, None, None)],
        "o long, truth_client string, predicted_client string, truth_date string, predicted_date string, status string, error string, n_products int")
    got = evaluation.order_causes(truth, predicted, heads, truth.limit(0).select("o", "c"), "o", "c", "q", "u").orderBy("o").collect()
    assert [r.causes for r in got] == [["faux_produit", "mauvais_client", "quantite", "unite_conditionnement"], ["rejet_interne_d_une_commande_correcte"], ["quantite", "segmentation_ou_asr", "unite_conditionnement"], ["client_non_reconnu", "date_livraison", "prediction_absente_ou_erreur"]]


def test_json_maps(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": ["y", "z"], "c": ""}'), (2, None), (3, "no json"), (4, "{}")], "id long, j string")
    assert sorted(map(tuple, tables.json_map_entries(df, ["id"], "j").collect())) == [(1, "a", "x"), (1, "b", "y"), (1, "b", "z")]
    df = spark.createDataFrame([(1, '{"a": {"value": "x", "confirme": true}, "b": {"value": "y", "confirme": false}, "c": {"value": ["u", "v"], "confirme": true}, "d": "s"}')], "id long, j string")
    assert sorted((r.key, r.value) for r in tables.json_map_entries(df, ["id"], "j", "confirme").collect()) == [("a", "x"), ("c", "u"), ("c", "v")]
