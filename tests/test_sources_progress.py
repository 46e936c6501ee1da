"""Sources (S1, S5, S8), cleaning helpers and the quiz/progress operators."""
import os
import tempfile

from pyspark.sql import functions as F

from panelkit.operators import clean as CL
from panelkit.operators.joins import grade_answers
from panelkit.operators.sampling import sample_per_entity
from panelkit.plans.progress import badges, missions, quiz_sessions, weakest_subject, xp_level
from panelkit.sources.readers import question_rows, read_delimited_panel, read_metrics, write_metrics


def test_read_latin1_semicolon_panel(spark):
    d = tempfile.mkdtemp(prefix="panelkit-csv-")
    p = os.path.join(d, "panel.csv")
    with open(p, "w", encoding="utf-8") as f:  # UTF-8 bytes read as latin-1 → mojibake, as in the source file
        f.write("NOME;INDE_2020;PEDRA_2020\nAna;7,5;Ágata\nBia;#NULO!;Topázio\n")
    df = read_delimited_panel(spark, p, ["NOME", "INDE_2020", "PEDRA_2020"])
    df = CL.canonicalise_tier(CL.coerce_numeric(df, ["INDE_2020"], decimal_comma=True), ["PEDRA_2020"])
    assert [tuple(r) for r in df.collect()] == [("Ana", 7.5, "Ágata"), ("Bia", None, "Topázio")]


def test_add_missing_columns_and_rename(spark):
    df = spark.createDataFrame([(1,)], "Fase int")
    out = CL.add_missing_columns(CL.rename_columns(df, {"Fase": "FASE", "Absent": "X"}), {"NOTA_ING": (None, "double")})
    assert out.columns == ["FASE", "NOTA_ING"] and out.schema["NOTA_ING"].dataType.typeName() == "double"


def test_metrics_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="panelkit-metrics-")
    df = spark.createDataFrame([("lag_risk", 0.7)], "model string, accuracy double")
    write_metrics(df, d + "/m")
    assert read_metrics(spark, d + "/m").first()["accuracy"] == 0.7


def test_question_bank_sampling_and_grading(spark):
    bank = {"Matemática": [{"question": f"q{i}", "options": ["a", "b", "c", "d"], "answer": "a"} for i in range(20)],
            "Português": [{"question": f"p{i}", "options": ["a", "b", "c", "d"], "answer": "b"} for i in range(20)]}
    qb = question_rows(spark, bank)
    students = spark.createDataFrame([(1, 3.0, 7.0, None), (2, 9.0, 2.0, 5.0)], "sid int, mat double, port double, ing double")
    st = students.withColumn("subject", weakest_subject("mat", "port", "ing"))
    assert [r["subject"] for r in st.orderBy("sid").collect()] == ["Matemática", "Português"]
    pairs = st.join(qb, "subject").select("sid", "subject", "question_id")
    pick = sample_per_entity(pairs, "sid", "question_id", 10, seed=42)
    assert {r["sid"]: r["count"] for r in pick.groupBy("sid").count().collect()} == {1: 10, 2: 10}
    ans = pick.withColumn("chosen", F.when(F.col("question_id") % 2 == 0, "a").otherwise("b"))
    g = grade_answers(ans, qb).groupBy("sid").agg(F.sum(F.col("correct").cast("int")).alias("right"))
    assert g.count() == 2


def test_quiz_points_and_badges(spark):
    ev = spark.createDataFrame([(1, i, i % 3 != 0) for i in range(12)], "u int, ts int, ok boolean")
    ev = ev.withColumn("ts", F.timestamp_seconds("ts"))
    s = {r["session"]: r for r in quiz_sessions(ev, "u", "ts", "ts", "ok").collect()}
    assert s[0]["answers"] == 10 and s[0]["right"] == 6 and s[0]["points"] == 6 * 10 + 4 * 2 + 20
    assert s[0]["band"] == "good" and s[1]["band"] is None and s[1]["points"] == 2 * 10
    df = spark.createDataFrame([(7.52, 7.5, 8.0, 3, "Ametista")], "inde double, nota_mat double, nota_port double, streak int, tier string")
    b = df.withColumn("b", badges("inde", "nota_mat", "nota_port", "streak", "tier")).select("b", *xp_level("inde", "b")).first()
    assert b["b"] == ["first_login", "inde_7", "nota_port_8", "streak_3"] and b["xp"] == 952 and b["level"] == 1
    m = {r["mission"]: r for r in missions(df.withColumn("nota_ing", F.lit(None).cast("double")), [],
                                           {}).collect()}
    assert m["inde_7"]["done"] and m["nota_mat_8"]["progress_pct"] == 93.75 and m["nota_ing_6"]["progress_pct"] is None


def test_bad_lines_are_quarantined_whole(spark):
    """Short and long lines, quoted separators, blank lines, several files."""
    import os
    import tempfile
    from panelkit.sources.readers import read_delimited_checked
    d = tempfile.mkdtemp(prefix="panelkit-lines-")
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write("ID;NOME;X\n1;José;5\n2;curta\n\n3;\"a;b\";7\n4;longa;8;9\n".encode("latin-1"))
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("ID;NOME;X\n5;;\n6\n".encode("latin-1"))
    good, bad = read_delimited_checked(spark, d, ["ID", "NOME", "X"])
    assert sorted(map(tuple, good.collect())) == [("1", "José", "5"), ("3", "a;b", "7"), ("5", None, None)]
    got = sorted((r["file"], r["line"], r["fields"], r["reason"]) for r in bad.collect())
    assert got == [("a.csv", "2;curta", 2, "too few fields"), ("a.csv", "4;longa;8;9", 4, "too many fields"), ("b.csv", "6", 1, "too few fields")]
    assert good.count() == 3 and bad.count() == 3  # also where no column is asked for
