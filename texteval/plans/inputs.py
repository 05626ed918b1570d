"""The operators' inputs as views of the benchmark tables.

Each view uses every row and the whole text of the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.operators.distribution import value_counts
from texteval.operators.filters import melt_metrics, range_policy, select_group
from texteval.sources.tables import read_table, small_table

# The registry of the stand-in runs: event types play the models.
MODELS = ["click", "error", "purchase", "signup", "view"]
CATEGORIES = {"click": "browse", "view": "browse", "purchase": "buy", "signup": "buy", "error": "fail"}
DATASETS = ["d0", "d1", "d2"]
RATES = [("m0", 8e-7, 2e-6, 5e-7), ("m1", 2e-7, 2e-7, 2e-7)]
# Tables with much work per row, and the column to spread them by when they are one small file.
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "events": "event_id"}
EPOCH_START = 1704067200
SYSTEM_PROMPT = (
    "You are a text generation service. "
    "Output ONLY the final English sentence without any extra comments."
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = SPREAD_KEYS.get(name)
    return read_table(spark, f"{sf_dir}/{name}.parquet", key)


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row metrics: one row per event, model = event type."""
    c = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", c.alias("c"))
    return e.select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.col("event_id").alias("item_id"),
        (F.floor(F.col("c") / 5.0) / 10000.0).alias("ROUGE_L"),
        ((F.col("c") * 7 % 10007) / 10000.0).alias("METEOR"),
        ((F.col("event_id") * 31 % 10000) / 10000.0).alias("BLEU"),
        ((F.col("c") % 5000 + 5000) / 10000.0).alias("BERTScore"),
        (F.col("c") / 1000.0).alias("Time_seconds"),
        (F.length("props") + 45).cast("long").alias("Tokens_Input"),
        F.floor(F.col("c") / 10.0).alias("Tokens_Output"),
        (F.col("c") * 3 / 100000000.0).alias("Coste_USD"),
        (F.col("c") / 1000000.0).alias("CO2_gramos"),
    )


def experiment_groups(spark: SparkSession) -> DataFrame:
    rows = [("G1", d, m, CATEGORIES[m], i) for d in DATASETS for i, m in enumerate(MODELS, 1)]
    rows += [("G2", "d0", m, CATEGORIES[m], i) for i, m in enumerate(["view", "click"], 1)]
    return small_table(spark, rows, "grp string, dataset string, model string, category string, ord long")


def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = range_policy(wide_metrics(spark, sf_dir), policy="drop_row_unit")
    return melt_metrics(wide, ["dataset", "model", "item_id"])


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (grp, dataset, metric, model, category, ord, item_id, value, better)."""
    return select_group(melted(spark, sf_dir), experiment_groups(spark))


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value table of ``long_metrics``: each distinct value of a model and metric once, with its number of rows."""
    # the group join asks for these; asked before counting, both uses of the counts are one exchange
    named = melted(spark, sf_dir).filter("dataset is not null and model is not null")
    counted = value_counts(named, ["dataset", "metric", "model"])
    return select_group(counted, experiment_groups(spark), weight="cnt")


def paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per user and event type: mean event value, and number of events."""
    c = F.round(F.col("value") * 100).cast("long")
    ord_of = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("event_type"))
    per_user = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.sum(c).alias("s"), F.count(F.lit(1)).alias("n")
    )
    mean = F.floor(F.col("s") / (F.col("n") * 50000.0) * 10000.0 + 0.5) / 10000.0
    both = F.array(
        F.struct(F.lit("ROUGE_L").alias("metric"), mean.alias("value")),
        F.struct(F.lit("Time_seconds").alias("metric"), F.col("n").cast("double").alias("value")),
    )
    return per_user.select(
        F.lit("all").alias("dataset"), F.col("user_id").alias("item_id"),
        F.col("event_type").alias("model"), ord_of.alias("ord"), F.inline(both),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    t = table(spark, sf_dir, "conversations")
    asked = t.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    told = t.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"]).withColumn("seq", F.col("conv_id") * 100 + F.col("turn"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved generations with errors, duplicates of texts and unreadable times."""
    p = turn_pairs(spark, sf_dir)
    failed = F.col("conv_id") % 11 == 0
    text = F.replace(F.replace(F.col("answer"), F.lit(" the "), F.lit(" a ")), F.lit(" de "), F.lit(" du "))
    seconds = (F.length("answer") / 1000.0).cast("string")
    return p.select(
        "seq", "conv_id",
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.lit("chat").alias("dataset"),
        "input", F.col("answer").alias("reference"),
        F.when(failed, F.concat(F.lit("Error: "), F.col("input"))).otherwise(text).alias("generated"),
        F.when(F.col("turn") == 2, F.lit("n/a")).otherwise(F.concat(seconds, F.lit('";'))).alias("seconds"),
    )


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to run: every pair of texts occurs twice."""
    r = results(spark, sf_dir).select("seq", "model", "dataset", "input", "reference")
    return r.unionByName(r.withColumn("seq", F.col("seq") + 1000000000))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an altered copy: lines in reverse order, some words replaced."""
    changed = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" a ")), F.lit(" de "), F.lit(" du "))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("model"),
        F.col("text").alias("reference"),
        F.array_join(F.reverse(F.split(changed, "\n")), "\n").alias("generated"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers about parts; some answers are blank or missing."""
    answer = F.when(F.col("p_size") == 1, F.lit(" \n ")).when(
        F.col("p_size") != 2, F.concat(F.lit("\t"), F.col("p_type"), F.lit(" size "), F.col("p_size").cast("string"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"),
        F.col("p_type").alias("topic"), F.col("p_name").alias("subtopic"),
        F.concat(F.lit(" What is "), F.col("p_name"), F.lit("? ")).alias("question"),
        answer.alias("answer"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of a document and the rest of it."""
    head = F.get(F.split("text", "\n"), 0)
    return table(spark, sf_dir, "documents").select(
        "doc_id", head.alias("triple"),
        F.col("text").substr(F.length(head) + 2, F.length("text")).alias("sentence"),
    )


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the line after it."""
    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return d.select("doc_id", "lines", F.posexplode("lines").alias("line_no", "triple")).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "triple",
        F.coalesce(F.get("lines", F.col("line_no") + 1), F.lit("")).alias("sentence"),
    )


def table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as small tables with highlighted cells, one of them sometimes out of range."""

    def cell(c) -> F.Column:
        return F.struct(F.col(c).cast("string").alias("value"))

    rows = F.array(F.array(cell("p_name"), cell("p_brand")), F.array(cell("p_type"), cell("p_size")))
    spots = F.array(
        F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1)), F.array(F.col("p_size") % 3, F.lit(0))
    )
    sentence = F.when(
        F.col("p_size") > 1, F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("table_page_title"), F.col("p_type").alias("table_section_title"),
        rows.alias("table"), spots.alias("highlighted_cells"),
        F.struct(F.array(sentence).alias("final_sentence")).alias("sentence_annotations"),
    )


def triple_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as triple sets with two wordings."""
    brand = F.concat_ws(" ", F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    kind = F.concat_ws(" ", F.col("p_name"), F.lit("type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.struct(F.array(F.array(brand, kind), F.array(kind)).alias("mtriple_set")).alias("modified_triple_sets"),
        F.struct(F.array(F.concat_ws(" ", "p_brand", "p_name"), F.col("p_type")).alias("text")).alias("lex"),
    )


def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    # a pattern may be one file or a folder of files; a plain path of a stream must be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[c]onversations.parquet")


def token_stream(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Words of the assistant turns as tokens, with reasoning tags split over tokens."""
    source = table(spark, sf_dir, "conversations") if source is None else source
    word = F.split("text", " ")
    closed = F.concat(
        F.slice(word, 1, 2), F.array(F.lit("<th"), F.lit("ink>")), F.slice(word, 3, 4),
        F.array(F.lit("</thi"), F.lit("nk>")), F.slice(word, 7, F.size(word)),
    )
    never_closed = F.concat(F.array(F.lit("<think>")), word)
    parts = F.when(F.col("conv_id") % 13 == 0, never_closed).when(F.col("conv_id") % 2 == 0, closed).otherwise(word)
    t = source.filter(F.col("role") == "assistant")
    spread = t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), "conv_id", "turn",
        F.size(parts).alias("size"), F.posexplode(parts).alias("seq", "part"),
    )
    pause = F.when((F.col("conv_id") % 7 == 0) & (F.col("seq") >= 3), 61000).otherwise(0)
    millis = (F.lit(EPOCH_START) + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000 + F.col("seq") * 50 + pause
    return spread.select(
        "request_id", F.col("seq").cast("long").alias("seq"), F.timestamp_millis(millis).alias("ts"),
        F.when(F.col("part").isin("<th", "</thi"), F.col("part")).otherwise(F.concat("part", F.lit(" "))).alias("token"),
        (F.col("seq") == F.col("size") - 1).alias("last"),
    )


def broken_stream(tokens: DataFrame) -> DataFrame:
    """The tokens without those of some requests, and without the last one of others."""
    conv = F.floor(F.col("request_id") / 100)
    return tokens.filter((conv % 17 != 0) & ((conv % 11 != 0) | ~F.col("last")))


def clock(source: DataFrame, request_id: Column | None = None) -> DataFrame:
    """Two hours after each conversation, a time of no request."""
    request_id = F.lit(None) if request_id is None else request_id
    later = F.timestamp_seconds(F.lit(EPOCH_START) + F.col("conv_id") * 3600 + 7200)
    return source.select(request_id.cast("long").alias("request_id"), later.alias("ts"))


def requests(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """One request per assistant turn, started 200 ms before its first token slot."""
    source = table(spark, sf_dir, "conversations") if source is None else source
    t = source.filter(F.col("role") == "assistant")
    base = (F.lit(EPOCH_START) + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000
    backend = F.element_at(
        F.array(F.lit("device"), F.lit("desktop"), F.lit("server"), F.lit("other")), (F.col("conv_id") % 4 + 1).cast("int")
    )
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
        F.timestamp_millis(base - 200).alias("started_at"),
        F.timestamp_millis(base + 90000).alias("ended_at"),
        F.col("text").alias("prompt"), backend.alias("backend"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(EPOCH_START) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("vec_id") % 2 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("item_id"),
        F.when(even, F.lit("candidate")).otherwise(F.lit("reference")).alias("side"),
        F.floor(F.col("vec_id") / 2.0).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")

    def mean_of(status: str):
        of = F.col("o_orderstatus") == status
        return F.round(F.sum(F.when(of, cents)) / (F.count_if(of) * 10000000.0), 4)

    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("run"), F.month("o_orderdate").cast("long").alias("epoch")
    ).agg(mean_of("F").alias("loss_lm_train"), mean_of("O").alias("loss_lm_val"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of runs in every style, made from the parts table."""
    names = [
        "webnlg_", "totto_", "kelm_stem_", "kelm_", "qa_",
    ]
    model = F.replace("p_name", F.lit(" "), F.lit("_"))
    styles = F.array(
        *[F.concat(F.lit("metricas_por_fila_" + n), model, F.lit(".csv")) for n in names],
        *[F.concat(F.lit("metricas_por_fila_"), model, F.lit(s + ".csv")) for s in ("_WebNLG", "_ToTTo", "_KELM")],
        F.concat(F.lit("metricas_por_fila_"), model, F.lit("_FT_valtest.csv")),
        F.concat(F.lit("/data/results_webnlg_"), F.lit("qwen-2.5-7b-instruct.csv")),
        F.concat(F.lit("results_"), model, F.lit("_gemma-2-9b-it.csv")),
        F.lit("metricas_por_fila_kelm_stem_Gemma_3_1B.csv"),
        F.lit("metricas_por_fila_GAN_valtest.csv"),
        F.concat(F.lit("results_"), model, F.lit(".csv")),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.posexplode(styles).alias("style", "file")
    ).withColumn("style", F.col("style").cast("long"))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as found in result files: quoted, bare, with stray semicolons, and footers."""

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    p = turn_pairs(spark, sf_dir)
    flat = {c: F.replace(F.col(c), F.lit("\n"), F.lit(" ")) for c in ("input", "answer")}
    time = (F.length("answer") / 1000.0).cast("string")
    good = F.concat_ws(",", quoted(flat["input"]), quoted(flat["answer"]), quoted(flat["answer"]), time)
    loose = F.concat_ws(",", quoted(flat["input"]), quoted(flat["answer"]), flat["answer"], F.concat(time, F.lit(";;")))
    whole = quoted(F.concat_ws(",", F.lit("a b"), F.lit("c"), F.lit("Error: x"), time))
    footer = F.concat(F.lit("--- TOTAL TIME ---,,,"), time)
    kind = F.col("conv_id") % 5
    line = F.when(kind == 0, loose).when(kind == 1, whole).when(kind == 2, footer).otherwise(good)
    return p.select("seq", line.alias("line"))
