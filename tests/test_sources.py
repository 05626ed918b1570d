import csv
import random

import pytest
from pyspark.sql import functions as F

from texteval.operators import filters
from texteval.sources import nested, qa, results, runs, sinks


def test_read_qa(spark, tmp_path):
    (tmp_path / "qa.csv").write_text(
        "id,asignatura,tema,subtema,pregunta,respuesta\n"
        '1,A,t,s," one? ","line 1\nline ""2"""\n'
        "2,A,t,s,two?,\n"
        '3,B,t,s,"   ",x\n'
        "4,B,t,s,four?,y\n"
    )
    got = qa.read_qa(spark, str(tmp_path / "qa.csv")).orderBy("id").collect()
    assert [(r.id, r.question, r.answer) for r in got] == [(1, "one?", 'line 1\nline "2"'), (4, "four?", "y")]
    assert [r.id for r in qa.read_qa(spark, str(tmp_path), subject="B").collect()] == [4]
    assert [r.id for r in qa.read_qa(spark, str(tmp_path), limit=1).collect()] == [1]


def test_a_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    """Line breaks and quotes in fields, records longer than a block, and blocks inside one record."""
    rng, rows = random.Random(4), []
    for i in range(400):
        answer = "".join(rng.choices(['a', 'é', ' ', '\n', '"', ',', '\r\n', 'long '], k=rng.choice([1, 5, 40, 3000 if i % 97 == 0 else 60])))
        rows.append((i, f"s{i % 3}", "t", "u\nv", f"q{i} \n?", answer))
    for name, some in (("one.csv", rows[:390]), ("two.csv", rows[390:])):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "asignatura", "tema", "subtema", "pregunta", "respuesta"])
            w.writerows(some)
    whole = spark.read.schema(qa.QA_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    want = {tuple(r) for r in whole.collect()}
    assert want == {tuple(r) for r in rows} or len(want) == 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = qa.csv_records(spark, str(tmp_path))
        got = records.select(F.from_csv("text", qa.QA_SCHEMA, {"escape": '"'}).alias("r")).select("r.*")
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        rows = {tuple(r) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 10 and rows == want
    assert qa.read_qa(spark, str(tmp_path), limit=3).count() == 3


def test_flatten_tables_both_shapes(spark):
    cells = "table_page_title string, table_section_title string, table array<array<struct<value:string>>>, highlighted_cells array<array<int>>"
    rows = [("T", "S", [[("a",), ("b",)], [("c",)]], [[0, 1], [1, 0], [5, 5], [0, -1]])]
    one = spark.createDataFrame([(*rows[0], (["ref"],))], cells + ", sentence_annotations struct<final_sentence:array<string>>")
    two = spark.createDataFrame([(*rows[0], [("ref",)])], cells + ", sentence_annotations array<struct<final_sentence:string>>")
    none = spark.createDataFrame([(*rows[0], [])], cells + ", sentence_annotations array<struct<final_sentence:string>>")
    want = ("Title: T | Section: S | Highlighted Data: b | c", "ref")
    for df in (one, two):
        assert [tuple(r) for r in nested.flatten_tables(df).collect()] == [want]
    assert nested.flatten_tables(none).count() == 0


def test_flatten_triples(spark):
    df = spark.createDataFrame([(([["a | b", "c | d"], ["z"]],), (["x", "y"],))],
                               "modified_triple_sets struct<mtriple_set:array<array<string>>>, lex struct<text:array<string>>")
    assert tuple(nested.flatten_triples(df).first()) == ("a | b | c | d", "x")


def test_read_results(spark, tmp_path):
    (tmp_path / "results_x.csv").write_text(
        "Structured_Data,Human_Reference,LLM_Generated,Time_per_row_seconds\n"
        'in 1,"ref, 1",gen 1,1.5\n'
        "in 2,ref 2,gen, with, commas,2.5;;\n"
        '"in 3,ref 3,""gen 3"",3.5"\n'
        "in 4,ref 4,Error: 429,\n"
        "too,short\n"
        "--- TOTAL TIME ---,,,7.5\n"
        "--- METRICA: BLEU ---,,0.5,\n"
    )
    rows, footers = results.read_results(spark, str(tmp_path))
    got = [tuple(r) for r in rows.orderBy("seq").select("seq", "input", "reference", "generated", "seconds").collect()]
    assert got == [
        (1, "in 1", "ref, 1", "gen 1", "1.5"), (2, "in 2", "ref 2", "gen, with, commas", "2.5"),
        (3, "in 3", "ref 3", '"gen 3"', "3.5"), (4, "in 4", "ref 4", "Error: 429", ""),
    ] or got[2][3] == "gen 3"
    notes = {r.label: (r.text_value, r.time_value) for r in footers.collect()}
    assert notes == {"--- TOTAL TIME ---": (None, "7.5"), "--- METRICA: BLEU ---": ("0.5", None)}


def test_load_metrics(spark, tmp_path):
    (tmp_path / "metricas_por_fila_DeepSeek_WebNLG.csv").write_text(
        "ROUGE_L,METEOR,BLEU,BERTScore,Time_seconds\n0.5,0.4,0.3,0.9,1.0\n0.6,x,0.2,0.8,2.0\n\n"
        "--- RESUMEN (val) ---\nFilas procesadas,2\nROUGE-L medio,0.55\n"
    )
    (tmp_path / "metricas_por_fila_kelm_stem_Gemma_3_1B.csv").write_text("ROUGE_L,Time_seconds\n0.1,3.0\n")
    (tmp_path / "metricas_por_fila_mystery.csv").write_text("ROUGE_L,Time_seconds\n0.1,3.0\n")
    rows, unmapped = runs.load_metrics(spark, str(tmp_path))
    got = {(r.model, r.dataset, r.item_id): (r.ROUGE_L, r.METEOR, r.Time_seconds) for r in rows.collect()}
    assert got == {
        ("DeepSeek", "WebNLG", 1): (0.5, 0.4, 1.0), ("DeepSeek", "WebNLG", 2): (0.6, None, 2.0),
        ("Gemma 3 1B", "KELM", 1): (0.1, None, 3.0),
    }
    assert [tuple(r) for r in unmapped.collect()] == [("mystery", 1)]


def test_load_metrics_of_two_folders(spark, tmp_path):
    """One file name in two folders: each file counts its own rows."""
    for folder, text in (("a", "ROUGE_L,Time_seconds\n0.1,1.0\n0.2,2.0\n"), ("b", "ROUGE_L,BLEU,Time_seconds\n0.3,0.5,3.0\n0.4,0.6,4.0\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metricas_por_fila_DeepSeek_WebNLG.csv").write_text(text)
    rows, _ = runs.load_metrics(spark, f"{tmp_path}/*")
    assert sorted((r.item_id, r.ROUGE_L, r.BLEU) for r in rows.collect()) == [(1, 0.1, None), (1, 0.3, 0.5), (2, 0.2, None), (2, 0.4, 0.6)]


@pytest.mark.parametrize("name,want", [
    ("my_WebNLG_try", "WebNLG"), ("kelm_GAN_valtest", "News"), ("old NEWS kelm", "News"), ("totto_kelm", "ToTTo"), ("x", "unknown"), (None, "unknown"),
])
def test_a_mentioned_dataset(spark, name, want):
    names = runs.RunNames(domain_prefix="news_", domain_label="News")
    df = spark.createDataFrame([(name,)], "f string")
    assert df.select(runs.mentioned_dataset(F.col("f"), names)).first()[0] == want


@pytest.mark.parametrize("name,want", [
    ("results_webnlg_llama-3.3-70b-instruct.csv", ("Llama 70B", "WebNLG")),
    ("results_totto_deepseek-chat.csv", ("DeepSeek", "ToTTo")),
    ("metricas_por_fila_Qwen3_1.7B_FT_valtest.csv", ("Qwen3 1.7B FT", "News")),
    ("metricas_por_fila_news_Llama_3B.csv", ("Llama 3B", "News")),
    ("metricas_por_fila_LLAMA_70B_KELM.csv", ("Llama 70B", "KELM")),
])
def test_run_names(spark, name, want):
    names = runs.RunNames(domain_prefix="news_", domain_label="News")
    df = spark.createDataFrame([(name,)], "f string")
    r = df.select(runs.parse_run_name(runs.run_stem(F.col("f")), names).alias("r")).first().r
    assert (r.model, r.dataset) == want


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_table(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "q", b', 0.5, "m"), (2, "c", 0.25, "n")], "id long, note string, ROUGE_L double, model string")
    sinks.write_table(df, str(tmp_path / fmt), fmt, ("model",))
    back = spark.read.schema("ROUGE_L double, id long, note string, model string").option("header", True).option("escape", '"')
    got = back.format(fmt).load(str(tmp_path / fmt)).orderBy("id").collect()
    assert [(r.id, r.note, r.ROUGE_L, r.model) for r in got] == [(1, 'a "q", b', 0.5, "m"), (2, "c", 0.25, "n")]


def test_keyword_modes(spark):
    df = spark.createDataFrame([(1, "He called", "x"), (2, "a LED lamp", "x"), (3, "", "led")], "id long, a string, b string")
    assert {r.id for r in filters.keyword_filter(df, ["a", "b"], ["led"]).collect()} == {1, 2}
    assert {r.id for r in filters.keyword_filter(df, ["a", "b"], ["led"], "word").collect()} == {2}


def test_length_bounds_are_open(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (20, 21, 499, 500)], "n long, t string")
    assert {r.n for r in filters.length_band(df, {"t": (20, 500)}).collect()} == {21, 499}
