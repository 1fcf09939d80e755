import functools
import io
import re
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderloom.operators import decisions, extraction, linkage, matching, profiles, queue
from orderloom.sources import sinks, tables, xlsx
from orderloom.streaming import jobs

SAID = "bonjour ici le bar du port je voudrais vingt et un kilos de tomates; deux cartons de riz, plutot long et quatre vingt dix neuf pieces de pain pour apres demain merci"


def column(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression.alias("x")).first().x


def test_number_words(spark):
    for n in (0, 2, 16, 17, 20, 21, 31, 45, 69, 70, 71, 76, 80, 81, 90, 91, 99):
        assert column(spark, extraction.digits_for_words(F.col("t")), f"et {extraction.number_phrase(n)} kilos") == f"et {n} kilos"
    assert column(spark, extraction.digits_for_words(F.col("t")), "un deux un") == "1 2 1"
    for said, want in {"deux deux kilos": "2 2 kilos", "un zero zero sept": "1 0 0 7", "une caisse, vingt et un cartons": "1 caisse, 21 cartons", "quatre vingts et soixante et onze": "80 et 71", "quatre vingt dix sept": "97", "soixante dix": "70", "cinq, six.": "5, 6.", "un peu 2.5 kilos": "1 peu 2.5 kilos", "quatre vingt quatre": "84", "": ""}.items():
        assert column(spark, extraction.digits_for_words(F.col("t")), said) == want, said


def test_clauses_and_mentions(spark):
    rows = extraction.message_clauses(spark.createDataFrame([(1, SAID)], "k long, t string"), "k", "t").orderBy("position").collect()
    assert [(r.mention.quantity, r.mention.unit, r.mention.article) for r in rows if r.mention] == [(21.0, "kilos", "tomates"), (2.0, "cartons", "riz"), (99.0, "pieces", "pain")]
    assert [r.role for r in rows] == ["GREETING", "PRODUCT", "PRODUCT", "PRECISION", "PRODUCT", "DELIVERY", "CLOSING"]
    assert rows[3].belongs_to == rows[2].position


@pytest.mark.parametrize(("said", "want"), [("je voudrais modifier ma commande", "MODIFICATION"), ("annulez le pain", "CANCELLATION"), ("rappelez moi", "CALLBACK"), ("il me faudrait du pain", "ORDER"), ("allo", "UNKNOWN")])
def test_actions(spark, said, want):
    assert column(spark, extraction.action(F.col("t")), said) == want


def test_cancelled_client_callback(spark):
    assert column(spark, extraction.cancelled(F.col("t")), "annulez le pain, enlever les tomates et merci") == ["pain", "tomates"]
    assert column(spark, extraction.client_zone(F.col("t")), SAID) == "le bar du port"
    assert column(spark, extraction.callback_only(F.col("t")), "rappelez moi svp") is True
    assert column(spark, extraction.callback_only(F.col("t")), "rappelez moi je voudrais 2 kilos") is False


def fold(keys, longest=8):
    kept = []
    for k in keys:
        kept.append(k)
        for b in range(longest, 0, -1):
            if len(kept) >= 2 * b and kept[-b:] == kept[-2 * b : -b]:
                del kept[-b:]
                break
    return kept


@pytest.mark.parametrize("keys", ["", "a", "aa", "abab", "abcabcabc", "aabb", "abcdabcd", "abba"])
def test_repeated_blocks(spark, keys):
    assert column(spark, extraction.without_repeated_blocks(F.col("t")), list(keys), "array<string>") == fold(list(keys))


def test_stitching(spark):
    df = spark.createDataFrame([("a b c d e".split(), "c d e f g".split()), ("a b".split(), "x y".split()), ([], ["x"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(extraction.stitched(F.col("a"), F.col("b")).alias("x")).collect()] == [list("abcdefg"), list("abxy"), ["x"]]


def test_client_decisions(spark):
    rows = [(1, 10, 90.0, False), (1, 11, 70.0, False), (2, 10, 90.0, False), (2, 11, 88.0, False), (3, 12, 65.0, False), (4, 13, 10.0, True), (4, 14, 99.0, False), (5, 1, 30.0, False), (6, 1, 100.0, True), (6, 2, 100.0, True)]
    got = decisions.decide_client(spark.createDataFrame(rows, "m long, c long, s double, p boolean"), "m", "c", "s", "p").orderBy("m").collect()
    assert [(r.c, r.branch) for r in got] == [(10, "SCORE"), (None, "AMBIGUOUS"), (12, "ALONE"), (13, "PHONE"), (None, "NONE"), (None, "AMBIGUOUS_PHONE")]


def test_nearest_of_two_sides(spark):
    left = spark.sql("SELECT 1L AS k, 1L AS l, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts UNION ALL SELECT 1, 2, TIMESTAMP_NTZ'2024-01-09 10:00:00' UNION ALL SELECT 2, 3, TIMESTAMP_NTZ'2024-01-01 10:00:00'")
    right = spark.sql("SELECT 1L AS k, 7L AS r, TIMESTAMP_NTZ'2024-01-01 09:00:00' AS ts UNION ALL SELECT 1, 8, TIMESTAMP_NTZ'2024-01-01 11:00:00' UNION ALL SELECT 1, 9, TIMESTAMP_NTZ'2024-01-01 09:00:00'")
    assert [(r.l, r.r, r.gap_micros) for r in linkage.nearest(left, right, "k", "l", "r", "ts", 86400).collect()] == [(1, 7, 3_600_000_000)]


def test_refresh_keeps_frozen_groups(spark):
    q = spark.createDataFrame([(1, "a", "SENT"), (1, "b", "NEW"), (2, "c", "NEW")], "g long, x string, s string")
    f = spark.createDataFrame([(1, "n", "NEW"), (2, "m", "NEW"), (3, "o", "NEW")], "g long, x string, s string")
    assert sorted((r.g, r.x) for r in queue.refresh(q, f, "g", F.col("s") == "SENT").collect()) == [(1, "a"), (1, "b"), (2, "m"), (3, "o")]


def test_latest_version_keeps_rows_whole(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (2, 1, "b", "y")], "k long, v long, p string, q string")
    assert sorted(map(tuple, profiles.latest_version(df, ["k"], ["v"]).select("k", "v", "p", "q").collect())) == [(1, 2, None, "x"), (2, 1, "b", "y")]


def book(rows):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    strings = ["Code", "Label", "café"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>12</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="A3"><v></v></c></row><row><c r="B4" t="inlineStr"><is><t>x_x000D_y</t></is></c></row>'
    (tmp_path / "a.xlsx").write_bytes(book(rows))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    got = xlsx.xlsx_rows(spark, str(tmp_path))
    assert [r.cells for r in got.orderBy("row").collect()] == [["Code", "", "Label"], ["12", "", "café"], ["", "xy"]]
    named = xlsx.with_header(got, ["Label", "Code", "None"]).orderBy("row").collect()
    assert [(r.Label, r.Code, r["None"]) for r in named] == [("café", "12", None), (None, "", None)]


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None), ('q"', "é")], "x string, y string")
    sinks.write_delimited(df, str(tmp_path / "out"), ["y", "x", "z"], one_file=True)
    back = tables.delimited(spark, str(tmp_path / "out"))
    assert back.columns == ["y", "x", "z"]
    assert sorted((r.x, r.y or "") for r in back.collect()) == [("a;b", ""), ('q"', "é")]
    assert tables.delimited(spark, str(tmp_path / "none")).count() == 0


def test_documents_and_corrections(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "o long, c string, q long")
    sinks.write_documents(lines, str(tmp_path / "docs"), ["o"], ["c", "q"])
    assert [r.value for r in spark.read.text(str(tmp_path / "docs")).collect()] == ['{"o":1,"n_lines":2,"lines":[{"c":"a","q":1},{"c":"b","q":2}]}']
    events = spark.createDataFrame([(1, "x", "y", [("a", "b"), ("c", "d")])], "event_id long, client string, new_client string, products array<struct<before:string,after:string>>")
    for _ in range(2):
        sinks.append_corrections(events, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_header_names():
    assert tables.pick_column(["Code article", "Libellé", "Qté cde"], ["qte", "Code"]) == "Code article"
    assert tables.pick_column(["a", "Quantité totale"], ["quantit"]) == "Quantité totale"
    with pytest.raises(KeyError):
        tables.pick_column(["a"], ["b"])


def test_cycle_tries_failures_again(spark, tmp_path):
    schema = "item string, size long"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    process = lambda df: df.withColumn("ok", (F.col("size") < 10) | (F.col("attempts") >= 2))
    spark.createDataFrame([("a", 1), ("b", 20)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    run = lambda: jobs.run_cycle(spark, stream(), str(tmp_path / "state"), str(tmp_path / "check"), process, "item")
    assert sorted((r["item"], r.ok, r.attempts) for r in run().collect()) == [("a", True, 1), ("b", False, 1)]
    assert sorted((r["item"], r.ok, r.attempts) for r in run().collect()) == [("a", True, 1), ("b", False, 2)]  # nothing new came
    spark.createDataFrame([("c", 2)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert sorted((r["item"], r.ok, r.attempts) for r in run().collect()) == [("a", True, 1), ("b", True, 3), ("c", True, 1)]


def test_outcomes_are_compacted(spark, tmp_path):
    path = str(tmp_path / "state")
    outcomes = jobs.Outcomes(spark, path, "item", compact_at=3)
    assert outcomes.before() is None
    for number in range(10_001, 10_006):
        rows = [("a", number), (f"own {number}", number)]
        outcomes.write(spark.createDataFrame(rows, "item string, size long").coalesce(1), f"{number:012d}-000000")
        outcomes.compact()
    assert len(outcomes.names()) == 1
    assert sorted(map(tuple, outcomes.before().collect())) == [("a", 10_005), *((f"own {n}", n) for n in range(10_001, 10_006))]


def test_windows_of_a_stream(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts, CAST(id % 2 AS STRING) AS kind FROM range(48)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").parquet(str(tmp_path / "in"))
    counts = jobs.windowed_counts(stream, "ts", "1 day", "10 days", ["kind"])
    query = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("windowed").collect()) == [("0", 5), ("0", 7), ("0", 12), ("1", 5), ("1", 7), ("1", 12)]


@pytest.mark.parametrize(("said", "listed", "score"), [("miels", "miel", 100.0), ("mozza", "mozzarella", 100.0), ("cart", "carton", 80.0), ("jus", "ju", 80.0), ("chocolat", "kocolat", 100.0), ("faro", "phareau", 100.0), ("abc", "xyz", 0.0), ("riz", "rizs", 600 / 7)])
def test_scores_of_words(said, listed, score):
    assert matching.token_score(said, listed) == pytest.approx(score)


@pytest.mark.parametrize(("said", "listed", "score"), [("red ring", "large red ring", 95.91), ("ring", "ring plate", 93.57), ("", "ring", 0.0), ("jambon", "epaule cuite", None), ("glace vanille", "glace vanille 5 l", 100.0)])
def test_scores_of_products(said, listed, score):
    got = matching.product_score(said.split(), listed.split())
    assert got == pytest.approx(score) if score is not None else got < 0


def test_product_search_against_a_full_scan(spark, sf):
    from orderloom.plans import messages

    got = messages.message_product_matches(spark, sf).collect()
    tables_of = {t: spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("lineitem", "orders", "part")}
    name, client = {r.p_partkey: r.p_name for r in tables_of["part"]}, {r.o_orderkey: r.o_custkey for r in tables_of["orders"]}
    bought, truth = defaultdict(set), {}
    for r in tables_of["lineitem"]:
        if r.l_partkey in name and r.l_orderkey in client:
            bought[client[r.l_orderkey]].add(name[r.l_partkey])
            first, _, rest = name[r.l_partkey].partition(" ")
            kind, whole = r.l_partkey % 4, name[r.l_partkey]
            said = [whole, whole + "s", first[:-1] + " " * bool(rest) + rest, re.sub("^(.*)([lnrt])", r"\1\2\2", whole)][kind]
            truth.setdefault((client[r.l_orderkey], said), set()).add(whole)
    assert {(r.o_custkey, r.said) for r in got} == truth.keys()
    first = {(r.o_custkey, r.said): r.p_name for r in got if r.rank == 1}
    assert sum(first[k] in v for k, v in truth.items()) > 0.98 * len(truth)
    score = functools.cache(lambda a, b: matching.product_score(a.split(), b.split()))
    want = {k: sorted(((-score(k[1], x), x) for x in bought[k[0]] if score(k[1], x) >= 35))[:3] for k in truth}
    have = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        have[r.o_custkey, r.said].append((-r.score, r.p_name))
    hits = sum(len(set(have[k]) & set(v)) for k, v in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(have[k][0] == v[0] for k, v in want.items() if v[0][0] <= -88)
