"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.functions import labels, sequences
from texteval.functions import text as tx
from texteval.operators import (
    chat, filters, inference, joins, prompts, rowmetrics, splits, stats, summary, vocab, windows,
)
from texteval.plans import inputs
from texteval.session import checkpoint_dir
from texteval.sources import nested, qa, results, runs, sinks
from texteval.sources.tables import small_table
from texteval.streaming import tokens as tk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CELL = ["dataset", "metric"]
GROUP = ["grp", "dataset", "metric"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("long") for f in df.schema if f.dataType.simpleString() == "int"})


# --- sources and sinks -------------------------------------------------------


@query
def src1_read_qa(spark, d):
    return qa.clean_qa(inputs.qa(spark, d)).select("id", "subject", "question", "answer")


@query
def src1_read_qa_subject_limit(spark, d):
    return qa.clean_qa(inputs.qa(spark, d), subject="Brand#2", limit=50).select("id", "question", "answer")


@query
def src2_flatten_tables(spark, d):
    return nested.flatten_tables(inputs.table_items(spark, d)).select("id", "input", "reference")


@query
def src3_flatten_triples(spark, d):
    return nested.flatten_triples(inputs.triple_items(spark, d)).select("id", "input", "reference")


@query
def src4_normalise_pairs(spark, d):
    pairs = inputs.text_pairs(spark, d).select("item_id", F.col("generated").alias("input"), "reference")
    return nested.normalise_pairs(pairs)


@query
def src5_result_rows(spark, d):
    rows, _ = results.split_results(results.parse_fields(inputs.result_lines(spark, d)))
    return rows.select("seq", "input", "reference", "generated", "seconds")


@query
def src5_result_footers(spark, d):
    _, footers = results.split_results(results.parse_fields(inputs.result_lines(spark, d)))
    return footers.select("seq", "label", "time_value")


def _text_metrics(spark, d):
    """Metric rows as text with footer lines among them."""
    rows = inputs.wide_metrics(spark, d).select(
        F.concat("model", F.lit("_"), "dataset").alias("run"), "item_id",
        *[F.col(c).cast("string").alias(c) for c in runs.METRIC_COLUMNS],
    )
    footers = rows.groupBy("run").agg(F.count(F.lit(1)).cast("string").alias("METEOR")).select(
        "run", F.lit(-1).cast("long").alias("item_id"), F.lit("Filas").alias(runs.METRIC_COLUMNS[0]), "METEOR"
    )
    return rows.unionByName(footers, allowMissingColumns=True)


def _registry(spark):
    rows = [(f"{m}_{x}", m, x) for m in inputs.MODELS[:4] for x in inputs.DATASETS]
    return small_table(spark, rows, "pattern string, model string, dataset string")


@query
def src6_load_metrics(spark, d):
    rows, _ = runs.numeric_metrics(_text_metrics(spark, d))
    tagged, _ = runs.tag_runs(rows, "run", _registry(spark))
    return tagged.select("run", "model", "dataset", "item_id", *runs.METRIC_COLUMNS)


@query
def src6_unmapped_runs(spark, d):
    rows, _ = runs.numeric_metrics(_text_metrics(spark, d))
    return runs.tag_runs(rows, "run", _registry(spark))[1]


@query
def src7_parse_run_names(spark, d):
    names = inputs.run_names(spark, d)
    return names.select("id", "style", runs.parse_run_name(runs.run_stem(F.col("file"))).alias("r")).select(
        "id", "style", "r.model", "r.dataset"
    )


@query
def src7_mentioned_dataset(spark, d):
    names = inputs.run_names(spark, d)
    return names.select("id", "style", runs.mentioned_dataset(runs.run_stem(F.col("file"))).alias("dataset"))


@query
def snk1_column_order(spark, d):
    wide = inputs.wide_metrics(spark, d).select("item_id", "CO2_gramos", "BLEU", "ROUGE_L", "model")
    return sinks.ordered_columns(wide)


QA_GROUP = ["subject", "topic", "subtopic"]


def _assigned(spark, d):
    return splits.group_split(qa_rows(spark, d), "id", ["subject"], QA_GROUP)


def qa_rows(spark, d):
    return inputs.qa(spark, d).select("id", *QA_GROUP)


@query
def snk2_split_manifest(spark, d):
    return sinks.split_manifest(_assigned(spark, d), QA_GROUP, 42, 0.70, 0.15)


# --- filters -----------------------------------------------------------------


@query
def flt1_keyword_filter(spark, d):
    return filters.keyword_filter(inputs.triples(spark, d), ["triple", "sentence"]).select("doc_id")


@query
def flt1_keyword_filter_words(spark, d):
    rows = filters.keyword_filter(inputs.line_pairs(spark, d), ["triple"], ["the", "que", "und", "de la"], "word")
    return rows.select("doc_id", "line_no")


@query
def flt2_length_band(spark, d):
    lines = inputs.line_pairs(spark, d).withColumns(
        {c: tx.single_line(F.col(c)) for c in ("triple", "sentence")}
    )
    return filters.length_band(lines, {"triple": (20, 500), "sentence": (15, 500)})


@query
def flt3_valid_rows(spark, d):
    return filters.valid_rows(inputs.results(spark, d)).select("seq", "model", "generated")


@query
def flt4_drop_row_unit(spark, d):
    return filters.range_policy(inputs.wide_metrics(spark, d), policy="drop_row_unit").select("item_id", "METEOR")


@query
def flt4_null_over_100(spark, d):
    raw = inputs.table(spark, d, "events").select("event_id", F.col("value").alias("BLEU"))
    return filters.range_policy(raw, policy="null_over_100")


@query
def flt4_drop_over_1(spark, d):
    raw = inputs.table(spark, d, "events").select("event_id", F.col("value").alias("BLEU"))
    return filters.range_policy(raw, policy="drop_over_1")


@query
def flt5_select_group(spark, d):
    return inputs.long_metrics(spark, d).select("grp", "dataset", "metric", "model", "category", "ord", "item_id", "value")


@query
def flt6_melt_metrics(spark, d):
    rows = filters.describe_metrics(inputs.melted(spark, d))
    return rows.select("dataset", "model", "item_id", "metric", "value", "label", "better")


@query
def prj1_missing_metrics(spark, d):
    stored = inputs.wide_metrics(spark, d).select("item_id", "ROUGE_L", "Time_seconds", "Tokens_Input")
    return filters.missing_metrics(stored, inputs.table(spark, d, "events"))


@query
def prj1_stale_metrics(spark, d):
    stored = inputs.melted(spark, d).filter("metric = 'BLEU'").select("item_id", F.col("value").alias("BLEU"))
    return filters.missing_metrics(stored, inputs.table(spark, d, "events"))


# --- joins and sets ----------------------------------------------------------


@query
def jn1_rows_in_split(spark, d):
    return joins.rows_in_split(inputs.qa(spark, d), _assigned(spark, d), ["val", "test"]).select("id", "question")


@query
def jn2_resume_done(spark, d):
    run = ["model", "dataset"]
    done, _ = joins.resume_plan(inputs.run_items(spark, d), inputs.results(spark, d), run)
    return done.select("seq", "model", "generated", "seconds")


@query
def jn2_resume_pending(spark, d):
    run = ["model", "dataset"]
    _, pending = joins.resume_plan(inputs.run_items(spark, d), inputs.results(spark, d), run)
    return pending.select("seq", "model", "input", "reference")


def _mixed_results(spark, d):
    """Each text twice: every error is followed by a success for two of three models."""
    r = inputs.results(spark, d).drop("conv_id")
    again = r.filter(F.col("model") != "m2").withColumn("seq", F.col("seq") + 1000000000)
    return r.unionByName(again.withColumn("generated", F.concat(F.lit("again "), "reference")))


@query
def jn3_compact_results(spark, d):
    kept = joins.compact_results(_mixed_results(spark, d), inputs.results(spark, d), ["model", "dataset"])
    return kept.select("model", "seq", "rank", "generated")


@query
def jn4_apply_repairs(spark, d):
    r = inputs.results(spark, d)
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("repaired "), "input"))
    fixes = r.select("seq", text.alias("generated"), F.lit("0.5").alias("seconds"))
    return joins.apply_repairs(r, fixes, ["seq"]).select("seq", "generated", "seconds", "repaired")


def _rates(spark):
    return small_table(spark, inputs.RATES, "model string, price_in double, price_out double, kwh_per_token double")


@query
def jn5_with_rates(spark, d):
    rows = inputs.results(spark, d).select("seq", "model")
    return joins.with_rates(rows, _rates(spark), rowmetrics.DEFAULT_RATES).select(
        "seq", "model", "price_in", "price_out", "kwh_per_token"
    )


@query
def jn6_model_pairs(spark, d):
    return joins.model_pairs(inputs.paired_items(spark, d), CELL)


@query
def jn7_ci_overlaps(spark, d):
    few = inputs.experiment_groups(spark)
    s = summary.summary(inputs.metric_values(spark, d), [*GROUP, "model", "ord"], weight="cnt", median=False, registry=few)
    half = 2 * F.col("std") / F.sqrt("n")
    cis = s.withColumns({"ci_low": F.round(F.col("mean") - half, 6), "ci_high": F.round(F.col("mean") + half, 6)})
    return joins.ci_overlaps(cis, GROUP)


@query
def set1_union_splits(spark, d):
    a, rows = _assigned(spark, d), inputs.qa(spark, d)
    return joins.union_splits(
        joins.rows_in_split(rows, a, ["val"]), joins.rows_in_split(rows, a, ["test"])
    ).select("id", "subject", "answer")


@query
def set2_dedupe_prefix(spark, d):
    """The option with a prefix as the key."""
    return joins.dedupe_prefix(inputs.table(spark, d, "documents"), "text", "doc_id", 200).select("doc_id", "source")


@query
def set2_dedupe_text(spark, d):
    return joins.dedupe_prefix(inputs.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "source")


@query
def set3_split_overlaps(spark, d):
    return splits.split_overlaps(_assigned(spark, d), "id", QA_GROUP)


# --- splits and samples ------------------------------------------------------


@query
def spl1_group_split(spark, d):
    return _assigned(spark, d).select("id", "split")


@query
def spl1_group_split_small_strata(spark, d):
    rows = qa_rows(spark, d)
    return splits.group_split(rows, "id", ["subject", "topic"], QA_GROUP, 0.6, 0.2, 7).select("id", "split")


@query
def spl2_split_summary(spark, d):
    return splits.split_summary(_assigned(spark, d), QA_GROUP)


@query
def spl3_random_split(spark, d):
    return splits.random_split(inputs.table(spark, d, "part").select("p_partkey"), "p_partkey")


@query
def spl4_sample_n(spark, d):
    return splits.sample_n(inputs.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, 42, "o_orderkey")


@query
def spl5_paired_subsample(spark, d):
    return splits.paired_subsample(inputs.paired_items(spark, d), CELL, 60).select(*CELL, "item_id", "model", "value")


# --- text functions ----------------------------------------------------------


def _tagged_text(spark, d):
    """Turns wrapped in reasoning tags in several ways."""
    t = inputs.table(spark, d, "conversations")
    text = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n "), "text"))
        .when(F.col("conv_id") % 4 == 1, F.concat("text", F.lit(" <think>\n"), "text"))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("<think>"), "text", F.lit("</think>")))
        .otherwise(F.concat(F.lit(" \t"), "text", F.lit("\n")))
    )
    return t.select("conv_id", "turn", text.alias("text"))


@query
def txt1_strip_think(spark, d):
    return _tagged_text(spark, d).select("conv_id", "turn", tx.strip_think(F.col("text")).alias("clean"))


@query
def txt2_clean_output(spark, d):
    noisy = F.concat(F.lit("<|im_start|>\nAssistant \n"), "text", F.lit("</Think>rest<|im_end|>\n"))
    lead = F.concat(F.lit("assistant\n"), "text", F.lit("<|im_end|>"))
    t = _tagged_text(spark, d).withColumn("text", F.when(F.col("turn") == 0, noisy).otherwise(lead))
    return t.select("conv_id", "turn", tx.clean_output(F.col("text")).alias("clean"))


@query
def txt3_single_line(spark, d):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n"))
    t = inputs.table(spark, d, "documents").select("doc_id", text.alias("t"))
    return t.select("doc_id", tx.single_line(F.col("t")).alias("a"), tx.single_line(F.col("t"), " ").alias("b"))


@query
def txt4_approx_tokens(spark, d):
    t, text = inputs.table(spark, d, "documents"), F.col("text")
    return t.select(
        "doc_id", tx.approx_tokens(text).alias("quarter"),
        tx.approx_tokens(F.substring("lang", 3, 9), min_tokens=1).alias("at_least_one"),
        tx.approx_tokens(text, "budget").alias("budget"),
    )


@query
def txt5_tokens(spark, d):
    t, text = inputs.table(spark, d, "documents"), F.col("text")
    out = {s: tx.tokens(text, s) for s in ("rouge", "unicode", "whitespace", "13a")}
    return t.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{s}") for s, c in out.items()],
        *[F.md5(F.array_join(c, "|")).alias(f"h_{s}") for s, c in out.items()],
    )


@query
def txt6_ellipsis(spark, d):
    return inputs.table(spark, d, "conversations").select(
        "conv_id", "turn", tx.ellipsis(F.col("text"), 45).alias("title"), tx.ellipsis(F.col("text"), 60).alias("preview")
    )


def _id_rows(spark, d):
    t = inputs.turn_pairs(spark, d)
    return t.select(
        "seq", F.floor(F.col("seq") / 1000.0).alias("batch"),
        F.transform(tx.tokens(F.col("input"), "whitespace"), lambda w: F.length(w) + 4).alias("src"),
        F.transform(tx.tokens(F.col("answer"), "whitespace"), lambda w: F.length(w) + 4).alias("tgt"),
    )


def _joined(*cols):
    return [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in cols]


@query
def txt7_frame_sequences(spark, d):
    return sequences.frame_sequences(_id_rows(spark, d), "src", "tgt", 64).select(
        "seq", *_joined("enc_ids", "dec_in", "dec_out")
    )


@query
def txt7_pad_batch(spark, d):
    framed = sequences.frame_sequences(_id_rows(spark, d), "src", "tgt", 128)
    return sequences.pad_batch(framed, "batch", ["enc_ids", "dec_in", "dec_out"], 100).select(
        "seq", *_joined("enc_ids", "dec_in", "dec_out")
    )


@query
def txt8_labels(spark, d):
    p = F.pow(F.lit(10.0), -(F.col("event_id") % 400).cast("double")) * 0.37
    r = F.col("event_id") % 100 / 100.0
    e = inputs.table(spark, d, "events").select("event_id", p.alias("p"), r.alias("r"))
    return e.select(
        "event_id", labels.p_stars(F.col("p")).alias("stars"), labels.effect_class(F.col("r")).alias("effect"),
        labels.p_label(F.col("p")).alias("global_label"), labels.p_label(F.col("p"), "posthoc").alias("posthoc_label"),
    )


@query
def txt9_normalise_math(spark, d):
    t = inputs.table(spark, d, "documents")
    return t.select("doc_id", tx.normalise_math(F.col("text")).alias("text"))


# --- prompts -----------------------------------------------------------------


def _family_rows(spark, d):
    names = F.array(F.lit("Gemma_9B"), F.lit("Qwen3_1.7B"), F.lit("DeepSeek"))
    return inputs.turn_pairs(spark, d).withColumn(
        "model", F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int"))
    )


@query
def prm1_chat_messages(spark, d):
    rows = prompts.chat_messages(_family_rows(spark, d), inputs.SYSTEM_PROMPT)
    return rows.select(
        "seq", F.size("messages").cast("long").alias("messages"), prompts.render(F.col("messages")).alias("text")
    )


@query
def prm2_sft_export(spark, d):
    rows = prompts.sft_export(inputs.qa(spark, d), _assigned(spark, d), "Answer briefly.", "gemma-3-1b")
    return rows.select("id", "split", prompts.render(F.col("messages")).alias("messages"), "text")


@query
def prm3_repair_attempts(spark, d):
    failed = inputs.results(spark, d).filter(tx.is_error(F.col("generated")))
    return _long(prompts.repair_attempts(failed, inputs.SYSTEM_PROMPT).select(
        "seq", "attempt", "temperature", "system", "user"
    ))


@query
def prm4_context_window(spark, d):
    return prompts.context_window(inputs.messages(spark, d), "conv_id", "id", 4).select("conv_id", "id", "role", "content")


@query
def prm4_last_user_turn(spark, d):
    return prompts.last_user_turn(inputs.messages(spark, d), "conv_id", "id").select("conv_id", "id", "content")


@query
def prm5_run_matrix(spark, d):
    return prompts.run_matrix(inputs.wide_metrics(spark, d).select("dataset"), inputs.MODELS)


# --- inference ---------------------------------------------------------------


class EchoClient:
    """Answers from the prompt alone: same messages, same answer or error."""

    def __call__(self, messages, temperature):
        user = messages[-1][1]
        if len(user) % 5 == 0 and temperature < 0.5:
            raise RuntimeError("429 rate limit: " + user)
        if len(user) % 7 == 0 and temperature < 0.6:
            return "  "
        return "<think>plan\nmore</think> reply " + user


def _no_wait(seconds):
    return None


def _generated(spark, d):
    rows = prompts.chat_messages(_family_rows(spark, d), inputs.SYSTEM_PROMPT, prefix=prompts.DATA_PREFIX)
    made = inference.generate(rows, EchoClient, retries=3, sleep=_no_wait)
    return made.select("seq", "model", F.col("input"), F.col("answer").alias("reference"), "generated", "attempts", "seconds")


@query
def inf1_generate(spark, d):
    return _generated(spark, d).select("seq", "model", "generated", "attempts")


@query
def inf2_repair(spark, d):
    # the saved errors are the first run's, so each is asked again
    saved = inputs.results(spark, d).withColumn("seconds", tx.parse_time(F.col("seconds")))
    fixed = inference.repair(saved, EchoClient, inputs.SYSTEM_PROMPT, ["seq"], sleep=_no_wait)
    return fixed.select("seq", "generated", "repaired")


def _scored(spark, d):
    rows = rowmetrics.with_seconds(inputs.results(spark, d)).drop("seconds").withColumnRenamed("Time_seconds", "seconds")
    return rowmetrics.cost_and_co2(rowmetrics.bleu(rows), _rates(spark))


@query
def inf3_run_summary(spark, d):
    return inference.run_summary(_scored(spark, d), ["model", "dataset"], ["BLEU"])


# --- row metrics -------------------------------------------------------------


@query
def met1_rouge_l(spark, d):
    rows = inputs.turn_pairs(spark, d)
    return rowmetrics.rouge_l(rows, "input", "answer").select("seq", "ROUGE_L")


@query
def met1_rouge_l_documents(spark, d):
    return rowmetrics.rouge_l(inputs.text_pairs(spark, d), scheme="unicode").select("item_id", "ROUGE_L")


@query
def met1_rouge_l_stemmed(spark, d):
    return rowmetrics.rouge_l(inputs.text_pairs(spark, d), stem_words=True).select("item_id", "ROUGE_L")


@query
def met2_bleu(spark, d):
    return rowmetrics.bleu(inputs.text_pairs(spark, d)).select("item_id", "BLEU")


@query
def met3_bleu_smoothed(spark, d):
    return rowmetrics.bleu(inputs.turn_pairs(spark, d), "input", "answer", smoothing="m1").select("seq", "BLEU")


@query
def met4_corpus_bleu(spark, d):
    return rowmetrics.corpus_bleu(inputs.text_pairs(spark, d), ["model"])


@query
def met5_meteor(spark, d):
    return rowmetrics.meteor(inputs.text_pairs(spark, d)).select("item_id", "METEOR")


@query
def met5_meteor_exact(spark, d):
    return rowmetrics.meteor(inputs.text_pairs(spark, d), stem_words=False).select("item_id", "METEOR")


@query
def met6_greedy_cosine_f1(spark, d):
    return rowmetrics.greedy_cosine_f1(inputs.token_vectors(spark, d))


@query
def met7_corpus_means(spark, d):
    rows = rowmetrics.bleu(inputs.text_pairs(spark, d))
    return rowmetrics.corpus_means(rowmetrics.meteor(rows, stem_words=False), ["model"], ["BLEU", "METEOR"])


@query
def met8_cost_and_co2(spark, d):
    return rowmetrics.cost_and_co2(inputs.results(spark, d), _rates(spark)).select(
        "seq", "Tokens_Input", "Tokens_Output", "Coste_USD", "CO2_gramos"
    )


@query
def met8_public_rates(spark, d):
    rates = runs.public_rates(spark)
    known = F.array(*[F.lit(name) for name, *_ in runs.PUBLIC_RATES], F.lit("another model"))
    rows = inputs.results(spark, d).withColumn("model", F.get(known, (F.col("conv_id") % 14).cast("int")))
    return rowmetrics.cost_and_co2(rows, rates).select("seq", "model", "Tokens_Input", "Tokens_Output", "Coste_USD", "CO2_gramos")


@query
def met9_parse_time(spark, d):
    return rowmetrics.with_seconds(inputs.results(spark, d)).select("seq", "Time_seconds")


# --- aggregations ------------------------------------------------------------


def _summary(spark, d, **asked):
    few = inputs.experiment_groups(spark)
    stats_rows = summary.summary(inputs.metric_values(spark, d), [*GROUP, "model", "ord"], weight="cnt", registry=few, **asked)
    return filters.describe_metrics(stats_rows)


@query
def agg1_summary(spark, d):
    return _summary(spark, d).select(*GROUP, "model", "mean", "median", "std", "min", "max", "n")


@query
def agg2_leaderboard_mean(spark, d):
    return summary.leaderboard(_summary(spark, d, median=False, deviation=False), GROUP).select(*GROUP, "model", "mean", "position")


@query
def agg2_leaderboard_median(spark, d):
    return summary.leaderboard(_summary(spark, d, deviation=False), GROUP, "median").select(*GROUP, "model", "median", "position")


@query
def agg3_ranking_stability(spark, d):
    return summary.ranking_stability(_summary(spark, d, deviation=False), GROUP)


@query
def agg4_totals(spark, d):
    return summary.totals(inputs.wide_metrics(spark, d), ["Coste_USD", "CO2_gramos", "Time_seconds"], ["model", "dataset"])


@query
def agg5_best_model(spark, d):
    return summary.best_model(_summary(spark, d, median=False, deviation=False), GROUP)


def _paired_long(spark, d):
    return windows.pair_models(inputs.paired_items(spark, d), CELL, registry=inputs.experiment_groups(spark))


@query
def agg6_test_rollup(spark, d):
    paired = _paired_long(spark, d)
    tests = stats.friedman(paired, CELL)
    pairs = stats.posthoc(paired, CELL).withColumnRenamed("p_adj", "p")
    return summary.test_rollup(tests, pairs, ["metric"])


@query
def agg7_by_category(spark, d):
    return summary.by_category(inputs.long_metrics(spark, d), GROUP)


@query
def agg8_inventory(spark, d):
    return summary.inventory(inputs.wide_metrics(spark, d))


@query
def agg9_length_stats(spark, d):
    return summary.length_stats(inputs.line_pairs(spark, d), ["triple", "sentence"])


@query
def agg10_training_summary(spark, d):
    return summary.training_summary(inputs.training_log(spark, d), ["run"])


@query
def agg10_best_so_far(spark, d):
    return summary.best_so_far(inputs.training_log(spark, d), ["run"]).select("run", "epoch", "loss_lm_val", "is_best")


# --- windows and distributions -----------------------------------------------

RUN = ["grp", "dataset", "metric", "model"]


@query
def win1_pair_positional(spark, d):
    return windows.pair_models(inputs.long_metrics(spark, d), GROUP, "positional", registry=inputs.experiment_groups(spark)).select(*RUN, "item_id", "value")


@query
def win1_pair_by_item(spark, d):
    partial = inputs.paired_items(spark, d).filter(~((F.col("model") == "view") & (F.col("value") < 0.05)))
    return windows.pair_models(partial, CELL).select(*CELL, "model", "item_id", "value")


@query
def win2_mean_ranks(spark, d):
    return windows.mean_ranks(inputs.paired_items(spark, d), CELL).select(
        *CELL, "model", "n", F.round("mean_rank", 6).alias("mean_rank")
    )


def _curve(spark, d):
    return windows.cumulative_time(inputs.wide_metrics(spark, d), ["dataset", "model"])


@query
def win3_cumulative_time(spark, d):
    return _curve(spark, d).select("dataset", "model", "item_id", "processed", "elapsed")


@query
def win4_log_checkpoints(spark, d):
    return windows.log_checkpoints(_curve(spark, d), ["dataset", "model"]).select("dataset", "model", "processed", "elapsed")


@query
def win5_box_stats(spark, d):
    return windows.box_stats(inputs.metric_values(spark, d), RUN, registry=inputs.experiment_groups(spark), weight="cnt")


@query
def win6_outlier_sample(spark, d):
    return windows.outlier_sample(inputs.long_metrics(spark, d), RUN, registry=inputs.experiment_groups(spark)).select(*RUN, "item_id", "value")


@query
def win7_iqr_filter_density(spark, d):
    return windows.iqr_filter(inputs.long_metrics(spark, d), RUN, registry=inputs.experiment_groups(spark)).select(*RUN, "item_id", "value")


@query
def win7_iqr_filter_violin(spark, d):
    return windows.iqr_filter(inputs.long_metrics(spark, d), RUN, 1.5, "violin", registry=inputs.experiment_groups(spark)).select(*RUN, "item_id", "value")


@query
def win8_kde(spark, d):
    few = inputs.experiment_groups(spark)
    kept = windows.iqr_filter(inputs.metric_values(spark, d), RUN, registry=few, weight="cnt")
    return windows.kde(kept, RUN, registry=few, weight="cnt")


@query
def win9_qq_points(spark, d):
    return windows.qq_points(inputs.long_metrics(spark, d), RUN).select(
        *RUN, "rank", "value", F.round("quantile", 6).alias("quantile")
    )


@query
def win9_qq_fit(spark, d):
    return windows.qq_fit(windows.qq_points(inputs.long_metrics(spark, d), RUN), RUN)


# --- statistics --------------------------------------------------------------


@query
def sta1_friedman(spark, d):
    return stats.friedman(_paired_long(spark, d), CELL).withColumn("p", F.round("p", 6))


@query
def sta2_anova(spark, d):
    return stats.anova(_paired_long(spark, d), CELL).drop("p")


@query
def sta2_anova_p(spark, d):
    return stats.anova(_paired_long(spark, d), CELL)


@query
def sta3_nemenyi_q(spark, d):
    return stats.nemenyi(_paired_long(spark, d), CELL).drop("p_adj")


@query
def sta3_nemenyi(spark, d):
    return stats.nemenyi(_paired_long(spark, d), CELL)


@query
def sta4_wilcoxon_r(spark, d):
    return stats.wilcoxon_r(joins.model_pairs(_paired_long(spark, d), CELL), CELL)


@query
def sta4_wilcoxon_r_no_ties(spark, d):
    return stats.wilcoxon_r(joins.model_pairs(_paired_long(spark, d), CELL), CELL, ties=False)


@query
def sta5_posthoc(spark, d):
    return stats.posthoc(_paired_long(spark, d), CELL)


@query
def sta5_posthoc_significant(spark, d):
    return stats.posthoc(_paired_long(spark, d), CELL).drop("p_adj", "stars")


@query
def sta6_cd_groups(spark, d):
    paired = _paired_long(spark, d)
    ranks = windows.mean_ranks(paired, CELL, ascending=True)
    return stats.cd_groups(ranks, stats.nemenyi(paired, CELL), CELL)


@query
def sta7_bootstrap_ci(spark, d):
    return stats.bootstrap_ci(inputs.paired_items(spark, d), [*CELL, "model"])


@query
def sta7_bootstrap_rows(spark, d):
    sums = stats.bootstrap_sums(inputs.paired_items(spark, d), [*CELL, "model"], 1_000)
    return sums.groupBy(*CELL, "model").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("replicates"), F.min("drawn").alias("least"), F.max("drawn").alias("most")
    )


@query
def sta7_bootstrap_mean(spark, d):
    return stats.bootstrap_ci(inputs.paired_items(spark, d), [*CELL, "model"], 100).select(*CELL, "model", "n", "mean")


# --- vocabulary --------------------------------------------------------------


@query
def voc1_pair_counts(spark, d):
    words = vocab.word_counts(inputs.turn_pairs(spark, d), ["input", "answer"])
    return vocab.pair_counts(vocab.spelled(words))


@query
def voc1_kept_characters(spark, d):
    return vocab.kept_characters(vocab.word_counts(inputs.turn_pairs(spark, d), ["input", "answer"]))


# The two vocabulary sizes.
SMALL_VOCABULARY, LARGE_VOCABULARY = 4_000, 16_000
TURNS = ["input", "answer"]


def _train_turns(spark, d):
    return splits.random_split(inputs.turn_pairs(spark, d), "seq").filter(F.col("split") == "train")


def _pieces(spark, d, size):
    rules, alphabet = vocab.learn_vocabulary(_train_turns(spark, d), TURNS, size)
    parts = {a + b: (a, b) for a, b in reversed(rules)}
    rows = [(i, piece, *parts.get(piece, (None, None))) for piece, i in vocab.vocabulary(rules, alphabet).items()]
    return small_table(spark, rows, "id long, piece string, first string, second string")


@query
def voc1_learn_4000(spark, d):
    return _pieces(spark, d, SMALL_VOCABULARY)


@query
def voc1_learn_16000(spark, d):
    return _pieces(spark, d, LARGE_VOCABULARY)


@query
def voc2_encode_bpe(spark, d):
    rules, _ = vocab.learn_vocabulary(_train_turns(spark, d), TURNS, SMALL_VOCABULARY)
    return vocab.encode_bpe(inputs.turn_pairs(spark, d), "answer", rules).select(
        "seq", F.size("pieces").cast("long").alias("n"), F.array_join("pieces", " ").alias("pieces")
    )


@query
def voc2_encode_ids(spark, d):
    rules, alphabet = vocab.learn_vocabulary(_train_turns(spark, d), TURNS, SMALL_VOCABULARY)
    unknown = vocab.RESERVED.index(vocab.UNKNOWN)
    return vocab.encode_ids(inputs.turn_pairs(spark, d), "answer", rules, alphabet).select(
        "seq", F.size("ids").cast("long").alias("n"),
        F.size(F.filter("ids", lambda i: i == unknown)).cast("long").alias("n_unknown"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"),
    )


@query
def voc2_round_trip(spark, d):
    rules, _ = vocab.learn_vocabulary(_train_turns(spark, d), TURNS, SMALL_VOCABULARY)
    text = F.replace(F.array_join("pieces", ""), F.lit(vocab.WORD_START), F.lit(" "))
    return vocab.encode_bpe(inputs.turn_pairs(spark, d), "answer", rules).select("seq", F.ltrim(text).alias("text"))


# --- chat history and token streams ------------------------------------------


@query
def cht1_list_conversations(spark, d):
    return chat.list_conversations(inputs.conversations(spark, d)).select("id", F.unix_seconds("updated_at").alias("updated"))


@query
def cht1_messages_of(spark, d):
    return chat.messages_of(inputs.messages(spark, d), 5).select("id", "role", "content")


@query
def cht2_retain_latest(spark, d):
    _, kept = chat.retain_latest(inputs.conversations(spark, d), inputs.messages(spark, d))
    return kept.select("id", "conv_id", "role")


@query
def cht3_upsert_latest(spark, d):
    m = inputs.messages(spark, d).withColumn("version", F.lit(1).cast("long"))
    edits = m.filter(F.col("role") == "user").withColumns(
        {"version": F.lit(2).cast("long"), "content": F.concat("content", F.lit(" (edited)"))}
    )
    return chat.upsert_latest(m.unionByName(edits), "id", "version").select("id", "version", "content")


@query
def cht3_delete_conversations(spark, d):
    gone = inputs.messages(spark, d).filter(F.col("role") == "system").select(F.col("conv_id").alias("id"))
    _, left = chat.delete_conversations(inputs.conversations(spark, d), inputs.messages(spark, d), gone)
    return left.select("id", "conv_id", "role")


@query
def cht4_titles(spark, d):
    return chat.titles(inputs.messages(spark, d))


@query
def str1_filter_think_batch(spark, d):
    return tk.filter_think_batch(inputs.token_stream(spark, d))


@query
def str2_needs_retry(spark, d):
    return tk.needs_retry(inputs.token_stream(spark, d))


def _landed(spark, stream):
    return tk.land(stream, f"{checkpoint_dir(spark).rstrip('/')}/texteval-stream-{uuid.uuid4().hex}")


@query
def str1_filter_think_stream(spark, d):
    tokens = inputs.token_stream(spark, d, inputs.conversation_stream(spark, d))
    return tk.visible_text(_landed(spark, tk.filter_think_stream(tokens, silence_seconds=None)))


@query
def str2_request_outcomes(spark, d):
    tokens = inputs.broken_stream(inputs.token_stream(spark, d))
    # every request has ended one way or another by then
    as_of = F.col("started_at") + F.expr("INTERVAL 1 HOUR")
    return tk.request_outcomes(inputs.requests(spark, d), tokens, as_of)


@query
def str2_request_outcomes_stream(spark, d):
    source = inputs.conversation_stream(spark, d)
    tokens = inputs.broken_stream(inputs.token_stream(spark, d, source))
    ticks = inputs.clock(source).select("request_id", F.col("ts").alias("started_at"))
    requests = inputs.requests(spark, d, source).select("request_id", "started_at").unionByName(ticks)
    return _landed(spark, tk.request_outcomes_stream(requests, tokens))


def _request_columns(metrics):
    return metrics.select(
        "request_id", F.unix_millis("timestamp").alias("started_ms"), "prompt", "tokens",
        "first_token_ms", "total_ms", "tokens_per_second", "backend",
    )


@query
def str3_request_metrics(spark, d):
    return _request_columns(tk.request_metrics(inputs.token_stream(spark, d), inputs.requests(spark, d)))


@query
def str3_request_metrics_stream(spark, d):
    source = inputs.conversation_stream(spark, d)
    # times of no request have ids below zero here; their rows go at the end
    ticks = inputs.clock(source, -1 - F.col("conv_id"))
    tokens = inputs.token_stream(spark, d, source).select("request_id", "ts").unionByName(ticks)
    requests = inputs.requests(spark, d, source).unionByName(
        ticks.withColumnRenamed("ts", "started_at"), allowMissingColumns=True
    )
    landed = _landed(spark, tk.request_metrics_stream(tokens, requests))
    return _request_columns(landed.filter("request_id >= 0"))
