"""SQL twins of the queries, for an independent check on DuckDB."""

from __future__ import annotations

from texteval.functions.special import QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, QUANTILE_TAIL
from texteval.operators.filters import METRICS, STEM_KEYWORDS
from texteval.plans.inputs import CATEGORIES, DATASETS, EPOCH_START, MODELS, RATES, SYSTEM_PROMPT

ORACLE: dict[str, str] = {}


# --- pieces ------------------------------------------------------------------

WS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def one_line(x: str, cr: str = "") -> str:
    return f"replace(replace({x}, chr(10), ' '), chr(13), '{cr}')"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


def half_up(x: str, digits: int) -> str:
    """Round half up without being led by the last bits of a product or a mean."""
    return f"(sign({x}) * floor(round(abs({x}) * 1e{digits}, 4) + 0.5) / 1e{digits})::DOUBLE"


def nine(x: str) -> str:
    """Nine significant digits, ties away from zero."""
    return f"printf('%.8e', {x}::DOUBLE * 1.000000000001::DOUBLE)::DOUBLE"


def think(x: str) -> str:
    closed = strip(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")
    return strip(f"regexp_replace({closed}, '(?s)<think>.*', '', 'g')")


def words(x: str, scheme: str) -> str:
    if scheme == "rouge":
        parts = f"string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    elif scheme == "unicode":
        parts = rf"string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    elif scheme == "whitespace":
        parts = f"string_split_regex({x}, '{WS}+')"
    else:
        t = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
        for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            t = f"replace({t}, '{entity}', '{char}')"
        t = f"(' ' || {t} || ' ')"
        for pattern, spaced in (
            (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
            (r"([^0-9])([\.,])", r"\1 \2 "),
            (r"([\.,])([^0-9])", r" \1 \2"),
            (r"([0-9])(-)", r"\1 \2 "),
        ):
            t = f"regexp_replace({t}, '{pattern}', '{spaced}', 'g')"
        parts = f"string_split_regex({t}, '{WS}+')"
    return f"list_filter({parts}, lambda w: w <> '')"


def values(rows: list[tuple]) -> str:
    def one(v):
        if isinstance(v, str):
            return lit(v)
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def horner(x: str, cs: list[float]) -> str:
    out = f"({cs[0]!r}::DOUBLE)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def quantile(p: str) -> str:
    def tail(q: str) -> str:
        return f"({horner(q, QUANTILE_C)} / ({horner(q, QUANTILE_D)} * {q} + 1.0::DOUBLE))"

    low, high = f"sqrt(-2.0::DOUBLE * ln({p}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {p}))"
    c = f"({p} - 0.5::DOUBLE)"
    sq = f"({c} * {c})"
    mid = f"({horner(sq, QUANTILE_A)} * {c} / ({horner(sq, QUANTILE_B)} * {sq} + 1.0::DOUBLE))"
    return (
        f"CASE WHEN {p} < {QUANTILE_TAIL} THEN {tail(low)} "
        f"WHEN {p} > {1 - QUANTILE_TAIL} THEN -{tail(high)} ELSE {mid} END"
    )


EV = "ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)"
WIDE = EV + """, wide AS (
SELECT event_type AS model, 'd' || CAST(user_id % 3 AS VARCHAR) AS dataset, event_id AS item_id,
  (c // 5) / 10000.0::DOUBLE AS ROUGE_L, ((c * 7) % 10007) / 10000.0::DOUBLE AS METEOR,
  ((event_id * 31) % 10000) / 10000.0::DOUBLE AS BLEU, (c % 5000 + 5000) / 10000.0::DOUBLE AS BERTScore,
  c / 1000.0::DOUBLE AS Time_seconds, length(props) + 45 AS Tokens_Input, c // 10 AS Tokens_Output,
  (c * 3) / 100000000.0::DOUBLE AS Coste_USD, c / 1000000.0::DOUBLE AS CO2_gramos
FROM ev)"""
SCORES = ["ROUGE_L", "METEOR", "BERTScore", "BLEU"]
UNIT = " AND ".join(f"{s} BETWEEN 0 AND 1" for s in SCORES)
MELTED = WIDE + ", melted AS (" + " UNION ALL ".join(
    f"SELECT dataset, model, item_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {lit(text)} AS label, '{way}' AS better"
    f" FROM wide WHERE {UNIT}" for m, text, way in METRICS
) + ")"
GROUP_ROWS = [("G1", d, m, CATEGORIES[m], i) for d in DATASETS for i, m in enumerate(MODELS, 1)]
GROUP_ROWS += [("G2", "d0", m, CATEGORIES[m], i) for i, m in enumerate(["view", "click"], 1)]
LONG = MELTED + f""", groups(grp, dataset, model, category, ord) AS {values(GROUP_ROWS)},
gm AS (SELECT g.grp, g.category, g.ord::BIGINT AS ord, m.* FROM melted m JOIN groups g USING (dataset, model)),
cells AS (SELECT grp, dataset, metric FROM (
  SELECT grp, dataset, metric, model, count(*) AS n FROM gm GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= 2 AND min(n) >= 10),
long AS (SELECT gm.* FROM gm JOIN cells USING (grp, dataset, metric))"""
SUMMARY = LONG + f""", sumry AS (
SELECT grp, dataset, metric, better, model, ord, {nine('avg(value)')} AS mean,
  {nine('quantile_cont(value, 0.5)')} AS median, {nine('stddev_samp(value)')} AS std,
  {nine('min(value)')} AS min, {nine('max(value)')} AS max, count(*) AS n
FROM long GROUP BY ALL)"""
PAIRED = EV + f""", pu AS (
SELECT user_id AS item_id, event_type AS model, sum(c)::DOUBLE AS s, count(*) AS n FROM ev GROUP BY ALL),
paired AS (
SELECT 'all' AS dataset, 'ROUGE_L' AS metric, item_id, model, list_position({MODELS!r}, model)::BIGINT AS ord,
  floor(s / (n * 50000.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS value FROM pu
UNION ALL
SELECT 'all', 'Time_seconds', item_id, model, list_position({MODELS!r}, model)::BIGINT, n::DOUBLE FROM pu)"""
COMPLETE = PAIRED + """, complete AS (
SELECT p.* FROM paired p JOIN (
  SELECT dataset, metric, item_id, count(*) AS have FROM paired GROUP BY ALL) h USING (dataset, metric, item_id)
JOIN (SELECT dataset, metric, count(DISTINCT model) AS k FROM paired GROUP BY ALL) k USING (dataset, metric)
WHERE have = k)"""
TURNS = """turns AS (
SELECT u.conv_id, u.turn, u.conv_id * 100 + u.turn AS seq, u.text AS input, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')"""
ALTERED = "replace(replace({}, ' the ', ' a '), ' de ', ' du ')"
RESULTS = TURNS + f""", results AS (
SELECT seq, conv_id, 'm' || CAST(conv_id % 3 AS VARCHAR) AS model, 'chat' AS dataset, input, answer AS reference,
  CASE WHEN conv_id % 11 = 0 THEN 'Error: ' || input ELSE {ALTERED.format('answer')} END AS generated,
  CASE WHEN turn = 2 THEN 'n/a' ELSE CAST(length(answer) / 1000.0::DOUBLE AS VARCHAR) || '";' END AS seconds
FROM turns)"""
PAIRS = f"""pairs AS (
SELECT doc_id AS item_id, lang AS model, text AS reference,
  array_to_string(list_reverse(string_split({ALTERED.format('text')}, chr(10))), chr(10)) AS generated
FROM documents)"""
QA = """qa AS (
SELECT p_partkey AS id, p_brand AS subject, p_type AS topic, p_name AS subtopic,
  ' What is ' || p_name || '? ' AS question,
  CASE WHEN p_size = 1 THEN ' ' || chr(10) || ' '
       WHEN p_size <> 2 THEN chr(9) || p_type || ' size ' || CAST(p_size AS VARCHAR) END AS answer
FROM part)"""
CLEAN_QA = QA + f""", clean AS (SELECT id, subject, {strip('question')} AS question, {strip('answer')} AS answer
FROM qa WHERE length({strip('answer')}) > 0 AND length({strip('question')}) > 0)"""
LINES = """line_pairs AS (
SELECT doc_id, i AS line_no, l[i + 1] AS triple, coalesce(l[i + 2], '') AS sentence
FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
TRIPLES = """triples AS (
SELECT doc_id, string_split(text, chr(10))[1] AS triple,
  substr(text, length(string_split(text, chr(10))[1]) + 2) AS sentence FROM documents)"""


def assigned(stratum: str = "subject", train: float = 0.70, val: float = 0.15, seed: int = 42) -> str:
    return QA + f""", ranked AS (
SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('{seed}|' || subject || '|' || topic || '|' || subtopic)) AS pos,
  count(*) OVER (PARTITION BY {stratum}) AS n FROM (SELECT DISTINCT subject, topic, subtopic FROM qa)),
want AS (SELECT *, greatest(1, floor(n * {train!r}::DOUBLE)) AS t, greatest(1, floor(n * {val!r}::DOUBLE)) AS v FROM ranked),
sized AS (SELECT *, CASE WHEN n >= 3 THEN t - CASE WHEN n - t - v < 1 THEN 1 ELSE 0 END ELSE 1 END AS nt,
  CASE WHEN n >= 3 THEN v WHEN n = 2 THEN 1 ELSE 0 END AS nv FROM want),
assigned AS (SELECT qa.id, qa.subject, qa.topic, qa.subtopic,
  CASE WHEN pos <= nt THEN 'train' WHEN pos <= nt + nv THEN 'val' ELSE 'test' END AS split
FROM qa JOIN sized USING (subject, topic, subtopic))"""


def add(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = (f"WITH {ctes} " if ctes else "") + body


# --- sources and sinks -------------------------------------------------------

add("src1_read_qa", CLEAN_QA, "SELECT id, subject, question, answer FROM clean")
add("src1_read_qa_subject_limit", CLEAN_QA,
    "SELECT id, question, answer FROM clean WHERE subject = 'Brand#2' ORDER BY id LIMIT 50")
add("src2_flatten_tables", "", """
SELECT p_partkey AS id, 'Title: ' || p_brand || ' | Section: ' || p_type || ' | Highlighted Data: ' || p_name || ' | ' ||
  CAST(p_size AS VARCHAR) || CASE p_size % 3 WHEN 0 THEN ' | ' || p_name WHEN 1 THEN ' | ' || p_type ELSE '' END AS input,
  p_name || ' by ' || p_brand AS reference FROM part WHERE p_size > 1""")
add("src3_flatten_triples", "", """
SELECT p_partkey AS id, p_name || ' brand ' || p_brand || ' | ' || p_name || ' type ' || p_type AS input,
  p_brand || ' ' || p_name AS reference FROM part""")
add("src4_normalise_pairs", PAIRS,
    f"SELECT item_id, {one_line('generated')} AS input, {one_line('reference')} AS reference FROM pairs")
add("src5_result_rows", TURNS, f"""
SELECT seq, CASE WHEN conv_id % 5 = 1 THEN 'a b' ELSE {one_line('input')} END AS input,
  CASE WHEN conv_id % 5 = 1 THEN 'c' ELSE {one_line('answer')} END AS reference,
  CASE WHEN conv_id % 5 = 1 THEN 'Error: x' ELSE {one_line('answer')} END AS generated,
  CAST(length(answer) / 1000.0::DOUBLE AS VARCHAR) AS seconds FROM turns WHERE conv_id % 5 <> 2""")
add("src5_result_footers", TURNS, """
SELECT seq, '--- TOTAL TIME ---' AS label, CAST(length(answer) / 1000.0::DOUBLE AS VARCHAR) AS time_value
FROM turns WHERE conv_id % 5 = 2""")
add("src6_load_metrics", WIDE, """
SELECT model || '_' || dataset AS run, model, dataset, item_id, ROUGE_L, METEOR, BERTScore, BLEU, Time_seconds,
  Tokens_Input::DOUBLE AS Tokens_Input, Tokens_Output::DOUBLE AS Tokens_Output, Coste_USD, CO2_gramos FROM wide WHERE model <> 'view'""")
add("src6_unmapped_runs", WIDE,
    "SELECT model || '_' || dataset AS run, count(*) AS rows FROM wide WHERE model = 'view' GROUP BY ALL")
add("src7_parse_run_names", "", """
SELECT p_partkey AS id, style, CASE style WHEN 8 THEN p_name || ' FT' WHEN 9 THEN 'Qwen 7B' WHEN 10 THEN 'Gemma 9B'
    WHEN 11 THEN 'Gemma 3 1B' WHEN 12 THEN 'GAN' ELSE p_name END AS model,
  CASE WHEN style IN (0, 5, 9) THEN 'WebNLG' WHEN style IN (1, 6) THEN 'ToTTo' WHEN style IN (2, 3, 7, 11) THEN 'KELM'
    WHEN style IN (4, 8, 12) THEN 'QA' WHEN style = 10 THEN lower(replace(p_name, ' ', '_')) ELSE 'unknown' END AS dataset
FROM part, range(14) r(style)""")
add("src7_mentioned_dataset", "", """
SELECT p_partkey AS id, style, CASE WHEN style IN (4, 8, 12) OR contains(p_name, 'qa') THEN 'QA' WHEN style IN (0, 5, 9) THEN 'WebNLG'
  WHEN style IN (1, 6) THEN 'ToTTo' WHEN style IN (2, 3, 7, 11) THEN 'KELM' ELSE 'unknown' END AS dataset
FROM part, range(14) r(style)""")
add("snk1_column_order", WIDE, "SELECT ROUGE_L, BLEU, CO2_gramos, item_id, model FROM wide")
add("snk2_split_manifest", assigned() + """, g AS (
SELECT split, count(*) AS rows FROM assigned GROUP BY split, subject, topic, subtopic)""", """
SELECT 42::BIGINT AS seed, 0.7::DOUBLE AS train_ratio, 0.15::DOUBLE AS val_ratio, round(1.0::DOUBLE - 0.7 - 0.15, 10) AS test_ratio,
  count(*) AS n_groups_total, count(*) FILTER (split = 'train') AS n_groups_train,
  count(*) FILTER (split = 'val') AS n_groups_val, count(*) FILTER (split = 'test') AS n_groups_test,
  sum(rows)::BIGINT AS n_rows_total, (sum(rows) FILTER (split = 'train'))::BIGINT AS n_rows_train,
  (sum(rows) FILTER (split = 'val'))::BIGINT AS n_rows_val, (sum(rows) FILTER (split = 'test'))::BIGINT AS n_rows_test FROM g""")

# --- filters -----------------------------------------------------------------

add("flt1_keyword_filter", TRIPLES, "SELECT doc_id FROM triples WHERE triple <> '' AND sentence <> '' AND ("
    + " OR ".join(f"contains(lower(triple || ' ' || sentence), {lit(k)})" for k in STEM_KEYWORDS) + ")")
add("flt1_keyword_filter_words", LINES, r"""
SELECT doc_id, line_no FROM line_pairs
WHERE regexp_matches(lower(triple), '(^|[^\p{L}\p{N}])(the|que|und|de la)($|[^\p{L}\p{N}])')""")
add("flt2_length_band", LINES + f""", flat AS (
SELECT doc_id, line_no, {strip(one_line('triple'))} AS triple, {strip(one_line('sentence'))} AS sentence FROM line_pairs)""",
    "SELECT * FROM flat WHERE length(triple) BETWEEN 21 AND 499 AND length(sentence) BETWEEN 16 AND 499")
add("flt3_valid_rows", RESULTS, "SELECT seq, model, generated FROM results WHERE conv_id % 11 <> 0 AND NOT starts_with(input, '---')")
add("flt4_drop_row_unit", WIDE, f"SELECT item_id, METEOR FROM wide WHERE {UNIT}")
add("flt4_null_over_100", "", "SELECT event_id, CASE WHEN value <= 100 THEN value END AS BLEU FROM events")
add("flt4_drop_over_1", "", "SELECT event_id, value AS BLEU FROM events WHERE value <= 1")
add("flt5_select_group", LONG, "SELECT grp, dataset, metric, model, category, ord, item_id, value FROM long")
add("flt6_melt_metrics", MELTED, "SELECT * FROM melted")
add("prj1_missing_metrics", "", """
SELECT n AS stored_rows, n AS result_rows, 'column absent' AS reason, metric
FROM (SELECT count(*) AS n FROM events),
  (VALUES ('METEOR'), ('BLEU'), ('BERTScore'), ('Tokens_Output'), ('Coste_USD'), ('CO2_gramos')) t(metric)""")
add("prj1_stale_metrics", WIDE, f"""
SELECT s AS stored_rows, n AS result_rows, 'row count differs' AS reason, metric
FROM (SELECT count(*) AS n, count(*) FILTER ({UNIT}) AS s FROM wide), (VALUES {", ".join(f"('{m}')" for m, _, _ in METRICS)}) t(metric)
WHERE s <> n UNION ALL
SELECT s, n, 'column absent', metric
FROM (SELECT count(*) AS n, count(*) FILTER ({UNIT}) AS s FROM wide), (VALUES {", ".join(f"('{m}')" for m, _, _ in METRICS if m != "BLEU")}) t(metric)
WHERE s = n""")

# --- joins and sets ----------------------------------------------------------

add("jn1_rows_in_split", assigned(), """
SELECT id, question FROM qa WHERE id IN (SELECT id FROM assigned WHERE split IN ('val', 'test'))""")
RESUME = RESULTS + f""", items AS (
SELECT seq, model, input, reference FROM results UNION ALL SELECT seq + 1000000000, model, input, reference FROM results),
i AS (SELECT *, row_number() OVER (PARTITION BY model, {strip('input')}, {strip('reference')} ORDER BY seq) AS occ FROM items),
s AS (SELECT *, row_number() OVER (PARTITION BY model, {strip('input')}, {strip('reference')} ORDER BY seq) AS occ
  FROM results WHERE NOT starts_with(generated, 'Error:'))"""
SAME = f"i.model = s.model AND i.occ = s.occ AND {strip('i.input')} = {strip('s.input')} AND {strip('i.reference')} = {strip('s.reference')}"
add("jn2_resume_done", RESUME, f"SELECT i.seq, i.model, s.generated, s.seconds FROM i JOIN s ON {SAME}")
add("jn2_resume_pending", RESUME, f"SELECT seq, model, input, reference FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE {SAME})")
add("jn3_compact_results", RESULTS + f""", mixed AS (
SELECT seq, model, input, reference, generated FROM results UNION ALL
SELECT seq + 1000000000, model, input, reference, 'again ' || reference FROM results WHERE model <> 'm2'),
f AS (SELECT *, starts_with(generated, 'Error:') AS failed FROM mixed),
kept AS (SELECT * FROM f a WHERE NOT failed OR NOT EXISTS (SELECT 1 FROM f b WHERE NOT b.failed AND a.model = b.model
  AND {strip('a.input')} = {strip('b.input')} AND {strip('a.reference')} = {strip('b.reference')})),
placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY failed, seq) AS rank FROM kept),
items AS (SELECT model, count(*) AS n FROM results GROUP BY model)""",
    "SELECT model, seq, rank, generated FROM placed JOIN items USING (model) WHERE rank <= n")
add("jn4_apply_repairs", RESULTS, """
SELECT seq, CASE WHEN fix THEN 'repaired ' || input ELSE generated END AS generated,
  CASE WHEN fix THEN '0.5' ELSE seconds END AS seconds, fix AS repaired
FROM (SELECT *, conv_id % 11 = 0 AND conv_id % 2 = 0 AS fix FROM results)""")
RATE_TABLE = f"rates(model, price_in, price_out, kwh_per_token) AS {values(RATES)}"
RATED = RESULTS + ", " + RATE_TABLE + """, rated AS (
SELECT r.*, coalesce(price_in, 0.0::DOUBLE) AS price_in, coalesce(price_out, 0.0::DOUBLE) AS price_out,
  coalesce(kwh_per_token, 2e-7::DOUBLE) AS kwh_per_token FROM results r LEFT JOIN rates USING (model))"""
add("jn5_with_rates", RATED, "SELECT seq, model, price_in, price_out, kwh_per_token FROM rated")
MODEL_PAIRS = """
SELECT a.dataset, a.metric, a.item_id, a.model AS model_a, b.model AS model_b, a.value AS value_a, b.value AS value_b
FROM {0} a JOIN {0} b ON a.dataset = b.dataset AND a.metric = b.metric AND a.item_id = b.item_id AND a.ord < b.ord"""
add("jn6_model_pairs", PAIRED, MODEL_PAIRS.format("paired"))
add("jn7_ci_overlaps", SUMMARY + """, ci AS (
SELECT *, round(mean - 2 * std / sqrt(n), 6) AS lo, round(mean + 2 * std / sqrt(n), 6) AS hi FROM sumry)""", """
SELECT a.grp, a.dataset, a.metric, a.model AS model_a, b.model AS model_b FROM ci a JOIN ci b
ON a.grp = b.grp AND a.dataset = b.dataset AND a.metric = b.metric AND a.ord < b.ord AND a.lo <= b.hi AND b.lo <= a.hi""")
add("set1_union_splits", assigned(), """
SELECT id, qa.subject, answer FROM qa JOIN assigned USING (id) WHERE split IN ('val', 'test')""")
add("set2_dedupe_text", "", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
add("set2_dedupe_prefix", "", """
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) = 1""")
add("set3_split_overlaps", assigned() + """, t AS (
SELECT 'ids' AS kind, CAST(id AS VARCHAR) AS k, split FROM assigned UNION ALL
SELECT 'groups', subject || '|' || topic || '|' || subtopic, split FROM assigned),
d AS (SELECT DISTINCT * FROM t),
o AS (SELECT a.kind, a.split AS x, b.split AS y FROM d a JOIN d b ON a.kind = b.kind AND a.k = b.k)""", """
SELECT kind, count(*) FILTER (x = 'train' AND y = 'val') AS train_val,
  count(*) FILTER (x = 'train' AND y = 'test') AS train_test, count(*) FILTER (x = 'val' AND y = 'test') AS val_test
FROM o GROUP BY kind""")

# --- splits and samples ------------------------------------------------------

add("spl1_group_split", assigned(), "SELECT id, split FROM assigned")
add("spl1_group_split_small_strata", assigned("subject, topic", 0.6, 0.2, 7), "SELECT id, split FROM assigned")
add("spl2_split_summary", assigned() + """, g AS (
SELECT split, count(*) AS groups, sum(n)::BIGINT AS rows FROM (
  SELECT split, subject, topic, subtopic, count(*) AS n FROM assigned GROUP BY ALL) GROUP BY split)""", """
SELECT *, round(groups * 100.0::DOUBLE / sum(groups) OVER (), 1) AS groups_pct,
  round(rows * 100.0::DOUBLE / sum(rows) OVER (), 1) AS rows_pct FROM g""")
add("spl3_random_split", "", """
SELECT p_partkey, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR))) AS pos, count(*) OVER () AS n FROM part)""")
add("spl4_sample_n", "", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)) LIMIT 500""")
add("spl5_paired_subsample", PAIRED, """
SELECT dataset, metric, item_id, model, value FROM paired
QUALIFY dense_rank() OVER (PARTITION BY dataset, metric ORDER BY md5('42|' || CAST(item_id AS VARCHAR))) <= 60""")

# --- text functions ----------------------------------------------------------

TAGGED = """tagged AS (
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || ' ' || text
  WHEN 1 THEN text || ' <think>' || chr(10) || text WHEN 2 THEN '<think>' || text || '</think>'
  ELSE ' ' || chr(9) || text || chr(10) END AS text FROM conversations)"""
add("txt1_strip_think", TAGGED, f"""
SELECT conv_id, turn, CASE WHEN c = '' THEN 'Error: modelo solo genero thinking sin respuesta' ELSE c END AS clean
FROM (SELECT conv_id, turn, {think('text')} AS c FROM tagged)""")
CLEAN = "n"
for _pattern in (r"(?is)<think>.*?</think>", r"(?i)</?think>"):
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern}', '', 'g')"
CLEAN = rf"regexp_replace({CLEAN}, '(?i)^\s*assistant\s*\n?', '')"
CLEAN = f"regexp_replace({CLEAN}, '^assistant', '')"
CLEAN = rf"regexp_replace({CLEAN}, '<\|im_start\|>\n?', '', 'g')"
CLEAN = f"replace({CLEAN}, '<|im_end|>', '')"
add("txt2_clean_output", TAGGED + """, noisy AS (
SELECT conv_id, turn, CASE WHEN turn = 0 THEN '<|im_start|>' || chr(10) || 'Assistant ' || chr(10) || text || '</Think>rest<|im_end|>' || chr(10)
  ELSE 'assistant' || chr(10) || text || '<|im_end|>' END AS n FROM tagged)""",
    f"SELECT conv_id, turn, {strip(CLEAN)} AS clean FROM noisy")


def paired_marks(parts: str, opening: str, closing: str, alone: str) -> str:
    return f"""array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN '' WHEN i % 2 = 1 THEN '{closing}'
  WHEN i < len({parts}) THEN '{opening}' ELSE '{alone}' END || p), '')"""


add("txt9_normalise_math", f"""cut AS (SELECT doc_id, string_split(text, '$$') AS parts FROM documents),
each AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM cut),
lines AS (SELECT doc_id, n, i, part, unnest(string_split(part, chr(10))) AS line, unnest(range(len(string_split(part, chr(10))))) AS row_no FROM each),
cells AS (SELECT *, string_split(line, '$') AS c FROM lines),
done AS (SELECT doc_id, n, i, part, string_agg({paired_marks('c', chr(92) + '(', chr(92) + ')', '$')}, chr(10) ORDER BY row_no) AS made
  FROM cells GROUP BY ALL),
blocks AS (SELECT doc_id, list(CASE WHEN i > 1 AND part <> '' AND part[1] NOT IN (chr(10), '$') THEN chr(10) ELSE '' END || made ||
  CASE WHEN i < n AND part <> '' AND part[-1] <> chr(10) THEN chr(10) ELSE '' END ORDER BY i) AS b FROM done GROUP BY doc_id)""",
    f"SELECT doc_id, {paired_marks('b', chr(92) + '[', chr(92) + ']', '$$')} AS text FROM blocks")
add("txt3_single_line", "t AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10)) AS t FROM documents)",
    f"SELECT doc_id, {strip(one_line('t'))} AS a, {strip(one_line('t', ' '))} AS b FROM t")
add("txt4_approx_tokens", "", """
SELECT doc_id, length(text) // 4 AS quarter, greatest(length(substr(lang, 3, 9)) // 4, 1) AS at_least_one,
  CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT) AS budget FROM documents""")
add("txt5_tokens", "", "SELECT doc_id, " + ", ".join(
    f"len({words('text', s)}) AS \"n_{s}\", md5(array_to_string({words('text', s)}, '|')) AS \"h_{s}\""
    for s in ("rouge", "unicode", "whitespace", "13a")) + " FROM documents")
add("txt6_ellipsis", "", f"SELECT conv_id, turn, {cut('text', 45)} AS title, {cut('text', 60)} AS preview FROM conversations")
IDS = TURNS + f""", ids AS (
SELECT seq, seq // 1000 AS batch, list_transform({words('input', 'whitespace')}, lambda w: length(w) + 4) AS src,
  list_transform({words('answer', 'whitespace')}, lambda w: length(w) + 4) AS tgt FROM turns)"""


def framed(n: int) -> str:
    return IDS + f""", framed AS (
SELECT seq, batch, list_concat([1], src[1:{n - 2}], [4]) AS enc_ids, list_concat([1], tgt[1:{n - 2}]) AS dec_in,
  list_concat(tgt[1:{n - 2}], [2]) AS dec_out FROM ids)"""


add("txt7_frame_sequences", framed(64), """
SELECT seq, array_to_string(enc_ids, ' ') AS enc_ids, array_to_string(dec_in, ' ') AS dec_in,
  array_to_string(dec_out, ' ') AS dec_out FROM framed""")
add("txt7_pad_batch", framed(128), "SELECT seq, " + ", ".join(f"""
  array_to_string(list_resize({c}[1:100], least(100, max(len({c})) OVER (PARTITION BY batch)), 0), ' ') AS {c}"""
    for c in ("enc_ids", "dec_in", "dec_out")) + " FROM framed")
add("txt8_labels", """e AS (SELECT event_id, pow(10.0::DOUBLE, -(event_id % 400)::DOUBLE) * 0.37::DOUBLE AS p,
  (event_id % 100) / 100.0::DOUBLE AS r FROM events)""", """
SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars,
  CASE WHEN r < 0.1 THEN 'nulo' WHEN r < 0.3 THEN 'pequeño' WHEN r < 0.5 THEN 'mediano' ELSE 'grande' END AS effect,
  CASE WHEN p < 1e-300 THEN '< 1.0e-300' WHEN p < 0.001 THEN printf('%.2e', p) ELSE printf('%.4f', p) END AS global_label,
  CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.4f', p) END AS posthoc_label FROM e""")

# --- prompts -----------------------------------------------------------------

FAMILY = TURNS + """, fam AS (
SELECT *, ['Gemma_9B', 'Qwen3_1.7B', 'DeepSeek'][conv_id % 3 + 1] AS model FROM turns)"""
add("prm1_chat_messages", FAMILY, f"""
SELECT seq, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS messages,
  CASE conv_id % 3 WHEN 0 THEN 'user: ' || {lit(SYSTEM_PROMPT)} || chr(10) || chr(10) || input
    ELSE 'system: ' || {lit(SYSTEM_PROMPT)} || chr(10) || 'user: ' || input ||
      CASE WHEN conv_id % 3 = 1 THEN chr(10) || '/no_think' ELSE '' END END AS text FROM fam""")
add("prm2_sft_export", assigned() + ", " + CLEAN_QA.split(", clean AS", 1)[1].join(["clean AS", ""]), """
SELECT id, split, 'user: Answer briefly.' || chr(10) || chr(10) || question || chr(10) || 'assistant: ' || answer AS messages,
  'Sistema: Answer briefly.' || chr(10) || 'Usuario: ' || question || chr(10) || 'Asistente: ' || answer AS text
FROM clean JOIN assigned USING (id) WHERE split IN ('train', 'val')""")
FIRM = SYSTEM_PROMPT.replace(
    "Output ONLY the final English sentence",
    "You MUST output exactly one English sentence. Never output an empty response.\nOutput ONLY the final English sentence")
add("prm3_repair_attempts", RESULTS + f""", failed AS (
SELECT seq, {one_line('input')} AS data FROM results WHERE starts_with(generated, 'Error:'))""", f"""
SELECT seq, attempt, temperature, {lit(FIRM)} AS system, CASE WHEN attempt < 3 THEN 'Data: '
  ELSE 'Data: The following is structured data. Please describe it in one sentence: ' END || data AS user
FROM failed, (VALUES (1::BIGINT, 0.3::DOUBLE), (2, 0.5), (3, 0.7)) t(attempt, temperature)""")
add("prm4_context_window", "", """
SELECT conv_id, conv_id * 100 + turn AS id, role, text AS content FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) WHERE role <> 'system'""")
add("prm4_last_user_turn", "", """
SELECT conv_id, conv_id * 100 + turn AS id, text AS content FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user' DESC, turn DESC) = 1""")
add("prm5_run_matrix", WIDE, f"""
SELECT d.dataset, m.model FROM (SELECT DISTINCT dataset FROM wide) d, {values([(m,) for m in MODELS])} m(model)""")

# --- inference ---------------------------------------------------------------

add("inf1_generate", FAMILY + f""", asked AS (
SELECT *, CASE conv_id % 3 WHEN 0 THEN {lit(SYSTEM_PROMPT)} || chr(10) || chr(10) || 'Data: ' || input
  WHEN 1 THEN 'Data: ' || input || chr(10) || '/no_think' ELSE 'Data: ' || input END AS u FROM fam)""", f"""
SELECT seq, model, CASE WHEN length(u) % 5 = 0 THEN 'Error: ' || substr('429 rate limit: ' || u, 1, 200)
  WHEN length(u) % 7 = 0 THEN 'Error: modelo devolvio respuesta vacia' ELSE {strip(one_line(strip("'reply ' || u")))} END AS generated,
  CASE WHEN length(u) % 5 = 0 OR length(u) % 7 = 0 THEN 3 ELSE 1 END::BIGINT AS attempts FROM asked""")
add("inf2_repair", RESULTS + f""", failed AS (
SELECT seq, {one_line('input')} AS data FROM results WHERE starts_with(generated, 'Error:')),
tries AS (SELECT seq, attempt, temperature, CASE WHEN attempt < 3 THEN 'Data: '
  ELSE 'Data: The following is structured data. Please describe it in one sentence: ' END || data AS u
FROM failed, (VALUES (1, 0.3), (2, 0.5), (3, 0.7)) t(attempt, temperature)),
won AS (SELECT seq, u FROM tries WHERE NOT (length(u) % 5 = 0 AND temperature < 0.5) AND NOT (length(u) % 7 = 0 AND temperature < 0.6)
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY attempt) = 1)""", f"""
SELECT r.seq, CASE WHEN u IS NULL THEN generated ELSE {strip("'reply ' || u")} END AS generated, u IS NOT NULL AS repaired
FROM results r LEFT JOIN won USING (seq)""")


def gram_stats(source: str, key: str, pred: str, ref: str, scheme: str) -> str:
    """bl(key, m1..m4, t1..t4, pl, rl): clipped n-gram matches per row."""
    per_n = ", ".join(f"coalesce(sum(m) FILTER (n = {n}), 0)::DOUBLE AS m{n}" for n in range(1, 5))
    totals = ", ".join(f"greatest(len(p) - {n - 1}, 0) AS t{n}" for n in range(1, 5))
    lead = ", ".join(f"lead(w, {j}) OVER s AS w{j}" for j in range(1, 4))
    gram = {1: "w", 2: "w || chr(1) || w1", 3: "w || chr(1) || w1 || chr(1) || w2",
            4: "w || chr(1) || w1 || chr(1) || w2 || chr(1) || w3"}
    grams = " UNION ALL ".join(f"SELECT {key}, side, {n} AS n, {g} AS g FROM ld WHERE {g} IS NOT NULL" for n, g in gram.items())
    return f"""tk AS (SELECT {key}, {words(pred, scheme)} AS p, {words(ref, scheme)} AS r FROM {source}),
un AS (SELECT {key}, 'p' AS side, unnest(p) AS w, unnest(range(len(p))) AS i FROM tk
  UNION ALL SELECT {key}, 'r', unnest(r), unnest(range(len(r))) FROM tk),
ld AS (SELECT *, {lead} FROM un WINDOW s AS (PARTITION BY {key}, side ORDER BY i)),
gr AS (SELECT {key}, n, side, g, count(*) AS c FROM ({grams}) GROUP BY ALL),
mt AS (SELECT a.{key}, a.n, sum(least(a.c, b.c)) AS m FROM gr a JOIN gr b ON a.{key} = b.{key} AND a.n = b.n AND a.g = b.g
  WHERE a.side = 'p' AND b.side = 'r' GROUP BY ALL),
ms AS (SELECT {key}, {per_n} FROM mt GROUP BY ALL),
bl AS (SELECT tk.{key}, len(p) AS pl, len(r) AS rl, {totals}, {", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, 5))}
  FROM tk LEFT JOIN ms USING ({key}))"""


BLEU = """CASE WHEN pl > 0 AND m4 > 0 THEN round(CASE WHEN pl < rl THEN exp(1 - rl::DOUBLE / pl) ELSE 1.0::DOUBLE END
  * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 4) ELSE 0.0::DOUBLE END"""


def _smooth(n: int) -> str:
    return f"ln(CASE WHEN m{n} = 0 THEN 0.1::DOUBLE ELSE m{n} END / greatest(t{n}, 1))"


SMOOTH = f"""CASE WHEN pl > 0 AND m1 > 0 THEN round(CASE WHEN pl < rl THEN exp(1 - rl::DOUBLE / pl) ELSE 1.0::DOUBLE END
  * exp(({_smooth(1)} + {_smooth(2)} + {_smooth(3)} + {_smooth(4)}) / 4), 4) ELSE 0.0::DOUBLE END"""
PARSED = f"coalesce(TRY_CAST({strip(chr(34).join(['regexp_replace(seconds, ' + chr(39) + '[', ';]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')']))} AS DOUBLE), 1.5::DOUBLE)"
ACCOUNTS = RATED + f""", accounts AS (
SELECT *, length(input) // 4 + 45 AS ti, length(generated) // 4 AS tu FROM rated),
costed AS (SELECT *, {half_up('(ti * price_in + tu * price_out)', 8)} AS cost, {half_up('((ti + tu) * kwh_per_token * 475.0::DOUBLE)', 6)} AS co2 FROM accounts)"""
add("inf3_run_summary", ACCOUNTS + ", " + gram_stats("results", "seq", "generated", "reference", "13a") + f""", full_rows AS (
SELECT c.*, {BLEU} AS bleu, {PARSED} AS secs, NOT starts_with(generated, 'Error:') AS ok FROM costed c JOIN bl USING (seq))""", """
SELECT model, dataset, round(sum(secs), 4) AS total_seconds, round(avg(secs), 4) AS mean_seconds,
  count(*) FILTER (ok) AS valid_rows, count(*) AS rows, round(avg(bleu) FILTER (ok), 4) AS "mean_BLEU",
  round(sum(cost) FILTER (ok), 6) AS total_cost, round(sum(co2) FILTER (ok), 4) AS total_co2 FROM full_rows GROUP BY ALL""")

# --- row metrics -------------------------------------------------------------

# one step per token of the prediction: the best common subsequence with each
# beginning of the reference is a running maximum
add("met1_rouge_l", TURNS + f""", tk AS (
SELECT seq, {words('input', 'rouge')} AS p, {words('answer', 'rouge')} AS r FROM turns),
hits AS (SELECT seq, len(p) AS np, len(r) AS nr, list_concat([list_transform(r, lambda x: 0)],
  list_transform(p, lambda a: list_transform(r, lambda b: CASE WHEN a = b THEN 1 ELSE 0 END))) AS h FROM tk),
dp AS (SELECT seq, np, nr, list_max(list_reduce(h, lambda acc, m: list_transform(range(1, nr + 1), lambda j:
  list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN m[i] = 1 THEN coalesce(acc[i - 1], 0) * CASE WHEN i > 1 THEN 1 ELSE 0 END + 1 ELSE acc[i] END))::INTEGER)))::DOUBLE AS lcs
  FROM hits)""", """
SELECT seq, CASE WHEN lcs > 0 THEN round(2 * (lcs / np) * (lcs / nr) / (lcs / np + lcs / nr), 4) ELSE 0.0::DOUBLE END AS "ROUGE_L" FROM dp""")
add("met2_bleu", PAIRS + ", " + gram_stats("pairs", "item_id", "generated", "reference", "13a"),
    f'SELECT item_id, {BLEU} AS "BLEU" FROM bl')
add("met3_bleu_smoothed", TURNS + ", " + gram_stats("turns", "seq", "input", "answer", "whitespace"),
    f'SELECT seq, {SMOOTH} AS "BLEU" FROM bl')
SUMS = ", ".join(f"sum({k}{n})::DOUBLE AS {k}{n}" for k in "mt" for n in range(1, 5))
add("met4_corpus_bleu", PAIRS + ", " + gram_stats("pairs", "item_id", "generated", "reference", "13a") + f""", cb AS (
SELECT model, sum(pl)::BIGINT AS pl, sum(rl)::BIGINT AS rl, {SUMS} FROM bl JOIN pairs USING (item_id) GROUP BY model)""",
    f"SELECT model, pl AS pred_len, rl AS ref_len, {BLEU} AS corpus_bleu FROM cb")


def aligned(source: str, key: str, pred: str, ref: str) -> str:
    """me(key, meteor): words pair with the same word, last with last."""

    def side(col: str, name: str) -> str:
        return f"""{name} AS (SELECT {key}, i, w, row_number() OVER (PARTITION BY {key}, w ORDER BY i DESC) AS occ
FROM (SELECT {key}, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT {key}, {words(f'lower({col})', '13a')} AS l FROM {source})))"""

    return f"""{side(pred, 'hy')}, {side(ref, 'rf')},
hl AS (SELECT {key}, count(*) AS hn FROM hy GROUP BY ALL), rl2 AS (SELECT {key}, count(*) AS rn FROM rf GROUP BY ALL),
al AS (SELECT hy.{key}, hy.i AS h, rf.i AS r FROM hy JOIN rf USING ({key}, w, occ)),
ch AS (SELECT *, lag(h) OVER (PARTITION BY {key} ORDER BY h) AS ph, lag(r) OVER (PARTITION BY {key} ORDER BY h) AS pr FROM al),
ag AS (SELECT {key}, count(*)::DOUBLE AS m, (count(*) FILTER (ph IS NULL OR ph <> h - 1 OR pr <> r - 1))::DOUBLE AS c FROM ch GROUP BY ALL),
me AS (SELECT {key}, coalesce(round((1 - 0.5::DOUBLE * pow(c / m, 3)) * ((m / hn) * (m / rn) / (0.9::DOUBLE * (m / hn) + 0.1::DOUBLE * (m / rn))), 4), 0.0::DOUBLE) AS meteor
FROM (SELECT DISTINCT {key} FROM {source}) LEFT JOIN ag USING ({key}) LEFT JOIN hl USING ({key}) LEFT JOIN rl2 USING ({key}))"""


add("met5_meteor_exact", PAIRS + ", " + aligned("pairs", "item_id", "generated", "reference"),
    'SELECT item_id, meteor AS "METEOR" FROM me')
add("met6_greedy_cosine_f1", """v AS (
SELECT label::BIGINT AS item_id, vec_id, vec_id % 2 = 0 AS cand, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.item_id, a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS s
  FROM v a JOIN v b ON a.item_id = b.item_id AND a.cand AND NOT b.cand),
p AS (SELECT item_id, avg(s) AS p FROM (SELECT item_id, x, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL),
r AS (SELECT item_id, avg(s) AS r FROM (SELECT item_id, y, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL)""", """
SELECT item_id, round(p, 4) AS precision, round(r, 4) AS recall,
  CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 4) ELSE 0.0::DOUBLE END AS f1 FROM p JOIN r USING (item_id)""")
add("met7_corpus_means", PAIRS + ", " + gram_stats("pairs", "item_id", "generated", "reference", "13a") + ", "
    + aligned("pairs", "item_id", "generated", "reference"), f"""
SELECT model, count(*) AS rows, round(avg({BLEU}), 4) AS "mean_BLEU", round(avg(meteor), 4) AS "mean_METEOR"
FROM pairs JOIN bl USING (item_id) JOIN me USING (item_id) GROUP BY model""")
add("met8_cost_and_co2", ACCOUNTS,
    'SELECT seq, ti AS "Tokens_Input", tu AS "Tokens_Output", cost AS "Coste_USD", co2 AS "CO2_gramos" FROM costed')
PRICED = RESULTS + f""", rates(place, model, price_in, price_out, kwh) AS (VALUES
  (0, 'DeepSeek', 8e-7, 2e-6, 5e-7), (1, 'Llama 70B', 5.9e-7, 7.9e-7, 8e-7), (2, 'Qwen 72B', 5.9e-7, 7.9e-7, 8e-7),
  (3, 'Gemma 9B', 2e-7, 2e-7, 2e-7), (4, 'Llama 3B', 6e-8, 6e-8, 8e-8), (5, 'Qwen 7B', 2e-7, 2e-7, 2e-7),
  (6, 'Gemma 3 1B', 3e-8, 3e-8, 3e-8), (7, 'Gemma 3 1B FT', 3e-8, 3e-8, 3e-8), (8, 'Llama 1B', 1e-8, 2e-8, 3e-8),
  (9, 'Llama 1B FT', 1e-8, 2e-8, 3e-8), (10, 'Qwen3 1.7B', 5e-8, 1e-7, 4e-8), (11, 'Qwen3 1.7B FT', 5e-8, 1e-7, 4e-8),
  (12, 'GAN', 0.0, 0.0, 1e-8), (13, 'another model', 0.0, 0.0, 2e-7)),
priced AS (SELECT seq, m.model, length(input) // 4 + 45 AS ti, length(generated) // 4 AS tu, price_in::DOUBLE AS price_in,
  price_out::DOUBLE AS price_out, kwh::DOUBLE AS kwh FROM results r JOIN rates m ON m.place = r.conv_id % 14)"""
add("met8_public_rates", PRICED, f"""
SELECT seq, model, ti AS "Tokens_Input", tu AS "Tokens_Output", {half_up('(ti * price_in + tu * price_out)', 8)} AS "Coste_USD",
  {half_up('((ti + tu) * kwh * 475.0::DOUBLE)', 6)} AS "CO2_gramos" FROM priced""")
add("met9_parse_time", RESULTS, """
SELECT seq, CASE WHEN seconds = 'n/a' THEN 1.5::DOUBLE ELSE length(reference) / 1000.0::DOUBLE END AS "Time_seconds" FROM results""")

# --- aggregations ------------------------------------------------------------

add("agg1_summary", SUMMARY, "SELECT grp, dataset, metric, model, mean, median, std, min, max, n FROM sumry")


def position(by: str, tie: str = "ord") -> str:
    return f"row_number() OVER (PARTITION BY grp, dataset, metric ORDER BY CASE WHEN better = 'higher' THEN -{by} ELSE {by} END, {tie})"


add("agg2_leaderboard_mean", SUMMARY, f"SELECT grp, dataset, metric, model, mean, {position('mean')} AS position FROM sumry")
add("agg2_leaderboard_median", SUMMARY, f"SELECT grp, dataset, metric, model, median, {position('median')} AS position FROM sumry")
add("agg3_ranking_stability", SUMMARY + f""", a AS (SELECT *, {position('mean')} AS by_mean FROM sumry),
b AS (SELECT *, {position('median', 'by_mean')} AS by_median FROM a)""", """
SELECT grp, dataset, metric, model, by_mean, by_median,
  bool_or(by_mean <> by_median) OVER (PARTITION BY grp, dataset, metric) AS order_changes FROM b""")
add("agg4_totals", WIDE, """
SELECT model, dataset, count(*) AS rows, round(sum(Coste_USD), 6) AS "total_Coste_USD",
  round(sum(CO2_gramos), 6) AS "total_CO2_gramos", round(sum(Time_seconds), 6) AS "total_Time_seconds" FROM wide GROUP BY ALL""")
add("agg5_best_model", SUMMARY, f"""
SELECT grp, dataset, metric, model AS best_model, mean AS best_mean FROM sumry QUALIFY {position('mean')} = 1""")
FRIEDMAN = COMPLETE + """, keep AS (SELECT * FROM complete),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset, metric, item_id ORDER BY value)
  + (count(*) OVER (PARTITION BY dataset, metric, item_id, value) - 1) / 2.0::DOUBLE AS rnk,
  count(*) OVER (PARTITION BY dataset, metric, item_id, value) AS tied FROM keep),
pm AS (SELECT dataset, metric, model, ord, count(*)::DOUBLE AS n, sum(rnk) AS rs, sum(tied * tied - 1)::DOUBLE AS ties FROM rk GROUP BY ALL),
pc AS (SELECT dataset, metric, count(*)::DOUBLE AS k, max(n) AS n, sum(rs * rs) AS sq, sum(ties) AS ties FROM pm GROUP BY ALL),
fr AS (SELECT dataset, metric, k::BIGINT AS k, n::BIGINT AS n,
  round((12.0::DOUBLE / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2 FROM pc)"""
# four degrees of freedom: the tail has a closed form
CHI4 = "exp(-chi2 / 2) * (1 + chi2 / 2)"
WILCOXON = f""", mp AS ({MODEL_PAIRS.format('complete')}),
df AS (SELECT *, round(value_a - value_b, 10) AS d FROM mp),
nz AS (SELECT *, rank() OVER (PARTITION BY dataset, metric, model_a, model_b ORDER BY abs(d))
  + (count(*) OVER (PARTITION BY dataset, metric, model_a, model_b, abs(d)) - 1) / 2.0::DOUBLE AS rnk,
  count(*) OVER (PARTITION BY dataset, metric, model_a, model_b, abs(d)) AS tied FROM df WHERE d <> 0),
ws AS (SELECT dataset, metric, model_a, model_b, count(*)::DOUBLE AS m, coalesce(sum(rnk) FILTER (d > 0), 0) AS up,
  coalesce(sum(rnk) FILTER (d < 0), 0) AS down, sum(tied * tied - 1)::DOUBLE AS tie FROM nz GROUP BY ALL),
al2 AS (SELECT dataset, metric, model_a, model_b, count(*) AS n, round(avg(value_a) - avg(value_b), 6) AS mean_diff FROM df GROUP BY ALL)"""


def wilcoxon(ties: bool) -> str:
    tie = "tie / 2" if ties else "0"
    z = f"abs(least(up, down) - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - {tie}) / 24)"
    least = 1 if ties else 2
    return WILCOXON + f""", wx AS (
SELECT dataset, metric, model_a, model_b, n, mean_diff, coalesce(m, 0)::BIGINT AS n_nonzero,
  CASE WHEN n >= 10 AND m >= {least} THEN round(least({z} / sqrt(n), 1.0::DOUBLE), 6) ELSE 0.0::DOUBLE END AS r
FROM al2 LEFT JOIN ws USING (dataset, metric, model_a, model_b)),
we AS (SELECT *, CASE WHEN r < 0.1 THEN 'nulo' WHEN r < 0.3 THEN 'pequeño' WHEN r < 0.5 THEN 'mediano' ELSE 'grande' END AS effect FROM wx)"""


add("agg7_by_category", LONG, f"""
SELECT grp, dataset, metric, category, count(DISTINCT model) AS models, count(*) AS n, {half_up('avg(value)', 6)} AS mean
FROM long GROUP BY ALL""")
add("agg8_inventory", WIDE, "SELECT count(*) AS rows, count(DISTINCT model) AS models, count(DISTINCT dataset) AS datasets FROM wide")
add("agg9_length_stats", LINES, """
SELECT count(*) AS rows, round(avg(length(triple)), 4) AS mean_len_triple, round(avg(length(sentence)), 4) AS mean_len_sentence FROM line_pairs""")
LOG = """lg AS (
SELECT o_orderpriority AS run, month(o_orderdate) AS epoch,
  round((sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F'))::DOUBLE / (count(*) FILTER (o_orderstatus = 'F') * 10000000.0::DOUBLE), 4) AS tr,
  round((sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O'))::DOUBLE / (count(*) FILTER (o_orderstatus = 'O') * 10000000.0::DOUBLE), 4) AS va
FROM orders GROUP BY ALL)"""
add("agg10_training_summary", LOG, """
SELECT run, count(*) AS epochs, arg_max(tr, epoch) AS last_train, arg_max(va, epoch) AS last_val,
  round(arg_max(va, epoch) - arg_max(tr, epoch), 4) AS gap, arg_min(epoch, va * 1000 + epoch / 1e6) AS best_epoch, min(va) AS best_val
FROM lg GROUP BY run""")
add("agg10_best_so_far", LOG, """
SELECT run, epoch, va AS loss_lm_val, coalesce(va < min(va) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM lg""")

# --- windows and distributions -----------------------------------------------

add("win1_pair_positional", LONG + """, placed AS (
SELECT grp, dataset, metric, model, value, row_number() OVER (PARTITION BY grp, dataset, metric, model ORDER BY item_id) AS item_id,
  count(*) OVER (PARTITION BY grp, dataset, metric, model) AS n FROM long)""", """
SELECT grp, dataset, metric, model, item_id, value FROM placed
QUALIFY item_id <= min(n) OVER (PARTITION BY grp, dataset, metric)""")
add("win1_pair_by_item", PAIRED + """, part2 AS (SELECT * FROM paired WHERE NOT (model = 'view' AND value < 0.05)),
k AS (SELECT dataset, metric, count(DISTINCT model) AS k FROM part2 GROUP BY ALL)""", """
SELECT dataset, metric, model, item_id, value FROM part2 JOIN k USING (dataset, metric)
QUALIFY count(*) OVER (PARTITION BY dataset, metric, item_id) = k""")
add("win2_mean_ranks", PAIRED + """, rk AS (
SELECT *, rank() OVER (PARTITION BY dataset, metric, item_id ORDER BY value DESC)
  + (count(*) OVER (PARTITION BY dataset, metric, item_id, value) - 1) / 2.0::DOUBLE AS rnk FROM paired)""", """
SELECT dataset, metric, model, count(*) AS n, round(avg(rnk), 6) AS mean_rank FROM rk GROUP BY ALL""")
CURVE = WIDE + """, curve AS (
SELECT dataset, model, item_id, row_number() OVER w AS processed, round(sum(Time_seconds) OVER w, 4) AS elapsed,
  count(*) OVER (PARTITION BY dataset, model) AS n FROM wide
WINDOW w AS (PARTITION BY dataset, model ORDER BY item_id ROWS UNBOUNDED PRECEDING))"""
add("win3_cumulative_time", CURVE, "SELECT dataset, model, item_id, processed, elapsed FROM curve")
add("win4_log_checkpoints", CURVE, """
SELECT DISTINCT dataset, model, processed, elapsed FROM curve, range(12) k(k)
WHERE n <= 10 OR processed - 1 = CASE WHEN k = 11 THEN n - 1 ELSE floor(pow((n - 1)::DOUBLE, k / 11.0::DOUBLE) + 1e-9) END""")
QUART = LONG + """, qs AS (
SELECT grp, dataset, metric, model, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM long GROUP BY ALL),
lq AS (SELECT * FROM long JOIN qs USING (grp, dataset, metric, model))"""
add("win5_box_stats", QUART, f"""
SELECT grp, dataset, metric, model, any_value(n) AS n, {half_up('any_value(q1)', 6)} AS q1, {half_up('any_value(median)', 6)} AS median,
  {half_up('any_value(q3)', 6)} AS q3, {half_up('any_value(iqr)', 6)} AS iqr,
  coalesce(min(value) FILTER (value >= q1 - 1.5 * iqr), any_value(q1)) AS whisker_low,
  coalesce(max(value) FILTER (value <= q3 + 1.5 * iqr), any_value(q3)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr) AS outliers FROM lq GROUP BY grp, dataset, metric, model""")
add("win6_outlier_sample", QUART + """, o AS (
SELECT *, greatest(q1 - 1.5 * iqr - value, value - (q3 + 1.5 * iqr)) AS past FROM lq
WHERE value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr),
z AS (SELECT *, iqr > 0 AND past > 0.2 * iqr AND past <= 2.5 * iqr AS near, iqr > 0 AND past <= 4 * iqr AS wide_zone FROM o),
c AS (SELECT *, count(*) FILTER (near) OVER w AS nn, count(*) FILTER (wide_zone) OVER w AS nw FROM z
  WINDOW w AS (PARTITION BY grp, dataset, metric, model)),
u AS (SELECT * FROM c WHERE CASE WHEN nn >= 4 THEN near WHEN nw > 0 THEN wide_zone ELSE true END)""", """
SELECT grp, dataset, metric, model, item_id, value FROM u
QUALIFY row_number() OVER (PARTITION BY grp, dataset, metric, model ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id) <= 4""")
DENSITY = QUART + """, bd AS (
SELECT *, CASE WHEN iqr > 0 THEN q1 - 3 * iqr ELSE p01 END AS lo, CASE WHEN iqr > 0 THEN q3 + 3 * iqr ELSE p99 END AS hi FROM lq),
dn AS (SELECT grp, dataset, metric, model, item_id, value FROM bd
  QUALIFY lo = hi OR value BETWEEN lo AND hi OR count(*) FILTER (value BETWEEN lo AND hi) OVER (PARTITION BY grp, dataset, metric, model) < 5)"""
add("win7_iqr_filter_density", DENSITY, "SELECT * FROM dn")
add("win7_iqr_filter_violin", QUART, """
SELECT grp, dataset, metric, model, item_id, value FROM lq
QUALIFY iqr <= 0 OR value BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr
  OR count(*) FILTER (value BETWEEN q1 - 1.5 * iqr AND q3 + 1.5 * iqr) OVER (PARTITION BY grp, dataset, metric, model) < 10""")
add("win8_kde", DENSITY + """, sh AS (
SELECT grp, dataset, metric, model, count(*) AS n, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h,
  min(value) - 0.08::DOUBLE * (max(value) - min(value)) AS start, (max(value) - min(value)) * 1.16::DOUBLE / 199 AS step
FROM dn GROUP BY ALL HAVING stddev_samp(value) > 0)""", """
SELECT grp, dataset, metric, model, point, round(start + point * step, 6) AS x,
  round(sum(exp(-0.5::DOUBLE * pow((start + point * step - value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM dn JOIN sh USING (grp, dataset, metric, model), range(200) p(point) GROUP BY grp, dataset, metric, model, point, start, step, n, h""")
QQ = LONG + """, od AS (
SELECT grp, dataset, metric, model, value, row_number() OVER (PARTITION BY grp, dataset, metric, model ORDER BY value) AS rank,
  count(*) OVER (PARTITION BY grp, dataset, metric, model) AS n FROM long),
fm AS (SELECT *, CASE WHEN rank = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN rank = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
  ELSE (rank - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM od WHERE n >= 10), qq AS (SELECT *, """ + quantile("p") + " AS quantile FROM fm)"
add("win9_qq_points", QQ, "SELECT grp, dataset, metric, model, rank, value, round(quantile, 6) AS quantile FROM qq")
add("win9_qq_fit", QQ, """
SELECT grp, dataset, metric, model, count(*) AS n, round(regr_slope(value, quantile), 5) AS slope,
  round(regr_intercept(value, quantile), 5) AS intercept, round(corr(value, quantile), 5) AS r FROM qq GROUP BY ALL""")

# --- statistics --------------------------------------------------------------

add("sta1_friedman", FRIEDMAN, f"SELECT dataset, metric, k, n, chi2, round({CHI4}, 6) AS p FROM fr")
add("sta2_anova", COMPLETE + """, pm AS (
SELECT dataset, metric, model, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM complete GROUP BY ALL),
g AS (SELECT dataset, metric, count(*) AS k, sum(n) AS t, sum(n * m) / sum(n) AS gm FROM pm GROUP BY ALL)""", """
SELECT dataset, metric, (any_value(k) - 1)::BIGINT AS df_between, (any_value(t) - any_value(k))::BIGINT AS df_within,
  round((sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(t) - any_value(k))), 5) AS "F"
FROM pm JOIN g USING (dataset, metric) GROUP BY dataset, metric""")
# Upper 5 % points of the studentised range, infinite degrees of freedom, from printed tables.
RANGE_05 = "CASE k WHEN 2 THEN 2.772 WHEN 3 THEN 3.314 WHEN 4 THEN 3.633 WHEN 5 THEN 3.858 END"
RANKS = COMPLETE + """, rk AS (
SELECT *, rank() OVER (PARTITION BY dataset, metric, item_id ORDER BY value)
  + (count(*) OVER (PARTITION BY dataset, metric, item_id, value) - 1) / 2.0::DOUBLE AS rnk FROM complete),
mr AS (SELECT dataset, metric, model, ord, count(*)::DOUBLE AS n, avg(rnk) AS mr FROM rk GROUP BY ALL),
kk AS (SELECT dataset, metric, count(*)::DOUBLE AS k FROM mr GROUP BY ALL),
ny AS (SELECT a.dataset, a.metric, a.model AS model_a, b.model AS model_b, a.n::BIGINT AS n, k::BIGINT AS k,
  round(abs(a.mr - b.mr) / sqrt(k * (k + 1) / (6 * a.n)) * sqrt(2.0::DOUBLE), 6) AS q
  FROM mr a JOIN mr b ON a.dataset = b.dataset AND a.metric = b.metric AND a.ord < b.ord
  JOIN kk ON a.dataset = kk.dataset AND a.metric = kk.metric)"""
add("sta3_nemenyi_q", RANKS, "SELECT * FROM ny")
add("sta4_wilcoxon_r", COMPLETE + wilcoxon(True), "SELECT * FROM we")
add("sta4_wilcoxon_r_no_ties", COMPLETE + wilcoxon(False), "SELECT * FROM we")
POSTHOC = RANKS + wilcoxon(True) + f""", ph AS (
SELECT *, q > {RANGE_05} AS significant FROM we JOIN ny USING (dataset, metric, model_a, model_b, n))"""
add("sta5_posthoc_significant", POSTHOC,
    "SELECT dataset, metric, model_a, model_b, n, mean_diff, q, significant, r, effect FROM ph")
add("agg6_test_rollup", FRIEDMAN + POSTHOC.removeprefix(COMPLETE).replace("rk AS (", "rk2 AS (").replace("FROM rk GROUP", "FROM rk2 GROUP") + f""",
t AS (SELECT coalesce(metric, '(total)') AS metric, count(*) AS tests, count(*) FILTER ({CHI4} < 0.05) AS tests_significant,
  count(*) FILTER ({CHI4} >= 0.05) AS tests_not_significant FROM fr GROUP BY ROLLUP (metric)),
p AS (SELECT coalesce(metric, '(total)') AS metric, count(*) AS pairs, count(*) FILTER (significant) AS pairs_significant,
  count(*) FILTER (significant AND effect = 'grande') AS significant_large,
  count(*) FILTER (significant AND effect = 'mediano') AS significant_medium,
  count(*) FILTER (significant AND effect = 'pequeño') AS significant_small,
  count(*) FILTER (significant AND effect = 'nulo') AS significant_none FROM ph GROUP BY ROLLUP (metric))""",
    "SELECT * FROM t JOIN p USING (metric)")
add("sta6_cd_groups", RANKS + f""", pl AS (
SELECT dataset, metric, model, row_number() OVER (PARTITION BY dataset, metric ORDER BY mr, ord) AS place FROM mr),
sp AS (SELECT ny.dataset, ny.metric, least(a.place, b.place) AS f, greatest(a.place, b.place) AS l FROM ny
  JOIN pl a ON a.dataset = ny.dataset AND a.metric = ny.metric AND a.model = model_a
  JOIN pl b ON b.dataset = ny.dataset AND b.metric = ny.metric AND b.model = model_b WHERE q < {RANGE_05}),
mx AS (SELECT * FROM sp x WHERE NOT EXISTS (SELECT 1 FROM sp y WHERE y.dataset = x.dataset AND y.metric = x.metric
  AND y.f <= x.f AND y.l >= x.l AND (y.f < x.f OR y.l > x.l)))""", """
SELECT mx.dataset, mx.metric, f AS first, l AS last, count(*) AS size, string_agg(model, ' | ' ORDER BY place) AS models
FROM mx JOIN pl ON pl.dataset = mx.dataset AND pl.metric = mx.metric AND place BETWEEN f AND l GROUP BY mx.dataset, mx.metric, f, l""")

RESAMPLED = "SELECT dataset, metric, model, {} FROM paired GROUP BY dataset, metric, model HAVING count(*) >= 10"
add("sta7_bootstrap_rows", PAIRED, RESAMPLED.format("count(*) AS n, 1000::BIGINT AS replicates, count(*) AS least, count(*) AS most"))
add("sta7_bootstrap_mean", PAIRED, RESAMPLED.format(f"count(*) AS n, {nine('avg(value)')} AS mean"))

# --- vocabulary --------------------------------------------------------------

VOCAB = TURNS + f""", wc AS (SELECT '▁' || w AS word, count(*) AS cnt FROM (
  SELECT unnest({words('input', 'whitespace')}) AS w FROM turns UNION ALL
  SELECT unnest({words('answer', 'whitespace')}) FROM turns) GROUP BY ALL),
sp AS (SELECT regexp_extract_all(word, '(?s).') AS s, cnt FROM wc)"""
add("voc1_pair_counts", VOCAB, """
SELECT a, b, sum(cnt)::BIGINT AS cnt FROM (SELECT s[i] AS a, s[i + 1] AS b, cnt FROM (
  SELECT s, cnt, unnest(range(1, len(s))) AS i FROM sp)) GROUP BY ALL""")
add("voc1_kept_characters", VOCAB + """, cc AS (
SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(s) AS ch, cnt FROM sp) GROUP BY ALL),
cu AS (SELECT *, sum(cnt) OVER (ORDER BY cnt DESC, ch ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER () AS everything FROM cc)""",
    "SELECT ch, cnt FROM cu WHERE before < everything * 0.9995::DOUBLE")
add("voc2_round_trip", TURNS, f"""
SELECT seq, ltrim(replace(array_to_string(list_transform({words('answer', 'whitespace')}, lambda w: '▁' || w), ''), '▁', ' '), ' ') AS text
FROM turns""")

# --- chat history and token streams ------------------------------------------

add("cht1_list_conversations", "", f"""
SELECT conv_id AS id, {EPOCH_START} + conv_id * 3600 + max(turn) * 60 AS updated FROM conversations GROUP BY conv_id""")
add("cht1_messages_of", "", "SELECT conv_id * 100 + turn AS id, role, text AS content FROM conversations WHERE conv_id = 5")
add("cht2_retain_latest", "", """
SELECT conv_id * 100 + turn AS id, conv_id, role FROM conversations WHERE conv_id IN (
  SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY conv_id * 3600 + max(turn) * 60 DESC, conv_id LIMIT 20)""")
add("cht3_upsert_latest", "", """
SELECT conv_id * 100 + turn AS id, CASE WHEN role = 'user' THEN 2 ELSE 1 END::BIGINT AS version,
  text || CASE WHEN role = 'user' THEN ' (edited)' ELSE '' END AS content FROM conversations""")
add("cht3_delete_conversations", "", """
SELECT conv_id * 100 + turn AS id, conv_id, role FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
add("cht4_titles", "", f"""
SELECT conv_id, {cut(strip('text'), 45)} AS title FROM conversations WHERE role = 'user' AND length({strip('text')}) > 0
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
STREAM = """said AS (
SELECT conv_id * 100 + turn AS request_id, conv_id, turn, text, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
parts AS (SELECT request_id, conv_id, turn, text, CASE WHEN conv_id % 13 = 0 THEN list_concat(['<think>'], w)
  WHEN conv_id % 2 = 0 THEN list_concat(w[1:2], ['<th', 'ink>'], w[3:6], ['</thi', 'nk>'], w[7:]) ELSE w END AS p FROM said),
tokens AS (SELECT request_id, conv_id, turn, unnest(range(len(p))) AS seq, unnest(p) AS part FROM parts),
shown AS (SELECT request_id, """ + think("string_agg(CASE WHEN part IN ('<th', '</thi') THEN part ELSE part || ' ' END, '' ORDER BY seq)") + """ AS visible
FROM tokens GROUP BY request_id)"""
add("str1_filter_think_batch", STREAM, "SELECT request_id, visible FROM shown")
add("str2_needs_retry", STREAM + """, late AS (
SELECT request_id, any_value(conv_id) % 7 = 0 AND max(seq) >= 3 AS timed_out FROM tokens GROUP BY request_id)""", """
SELECT request_id, visible = '' AS blank, timed_out, visible = '' OR timed_out AS retry FROM shown JOIN late USING (request_id)""")
OUTCOMES = STREAM + """, wanted AS (
SELECT request_id, conv_id, CASE WHEN conv_id % 17 = 0 THEN [] WHEN conv_id % 11 = 0 THEN p[:-2] ELSE p END AS sent FROM parts),
ended AS (SELECT request_id, sent, conv_id % 7 = 0 AND len(sent) > 3 AS paused,
  conv_id % 17 = 0 OR conv_id % 11 = 0 OR (conv_id % 7 = 0 AND len(sent) > 3) AS timed_out FROM wanted),
heard AS (SELECT request_id, timed_out, """ + think("""array_to_string(list_transform(CASE WHEN paused THEN sent[1:3] ELSE sent END,
  lambda part: CASE WHEN part IN ('<th', '</thi') THEN part ELSE part || ' ' END), '')""") + """ AS visible FROM ended)"""
add("str2_request_outcomes", OUTCOMES,
    "SELECT request_id, visible = '' AS blank, timed_out, visible = '' OR timed_out AS retry FROM heard")
add("str3_request_metrics", STREAM, f"""
SELECT request_id, ({EPOCH_START} + conv_id * 3600 + turn * 60) * 1000 - 200 AS started_ms, {cut('text', 60)} AS prompt,
  len(p) AS tokens, 200.0::DOUBLE AS first_token_ms, 90200.0::DOUBLE AS total_ms,
  round(len(p) / 90.2::DOUBLE, 4) AS tokens_per_second,
  ['local (Android)', 'llama-server (local)', 'remote server', 'unknown'][conv_id % 4 + 1] AS backend FROM parts""")

for batch, stream in (
    ("str1_filter_think_batch", "str1_filter_think_stream"), ("str2_request_outcomes", "str2_request_outcomes_stream"),
    ("str3_request_metrics", "str3_request_metrics_stream"),
):
    ORACLE[stream] = ORACLE[batch]
