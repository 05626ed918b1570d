"""DuckDB SQL for the training-data queries that SQL can express, by brute force in place of the operators' methods."""

from __future__ import annotations

from texteval.llm import licenses


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _license_blocks() -> str:
    """Every block of every text against every template of its scale."""
    templates = ",\n        ".join(
        f"({m['scale']}, '{m['label']}', {_list(m['tokens'])}, {m['need']})"
        for m in licenses._prepared(licenses.TEMPLATES, licenses.THRESHOLD)
    )
    return f"""
    WITH templates(scale, label, tokens, need) AS (VALUES
        {templates}),
    docs AS (
        SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
        FROM documents),
    places AS (
        SELECT rid, i - 1 AS start, CASE
            WHEN words[i:i + 1] = ['cc', 'by'] THEN 'cc-by'
            WHEN words[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl'
            WHEN words[i:i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
        FROM docs, unnest(range(1, len(words) + 1)) AS spot(i)
        WHERE words[i] IN ('cc', 'general', 'all')),
    base AS (
        SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
        FROM places WHERE label IS NOT NULL GROUP BY rid),
    blocks AS (
        SELECT rid, scale, list_distinct(words[i + 1:i + 2 * scale]) AS held
        FROM docs, (SELECT DISTINCT scale FROM templates) AS scales, unnest(range(0, len(words), scale)) AS spot(i)),
    met AS (
        SELECT rid, label, len(list_intersect(held, tokens)) AS overlap, need, len(tokens) AS size
        FROM blocks JOIN templates USING (scale)),
    every AS (
        SELECT rid, label, overlap / size AS containment FROM met WHERE overlap >= need
        UNION ALL SELECT rid, label, 1.0 FROM places WHERE label IS NOT NULL),
    named AS (
        SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
        FROM every GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
        CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM docs LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)
    """


def _variants() -> str:
    """Words one edit apart by what is left without one code point; checksums by their table of 256 entries."""
    return """
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS entries
        FROM range(0, 256) AS r(b)),
    runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
        WHERE length(run) >= 6 GROUP BY ALL),
    bytes AS (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM runs),
    summed AS (
        SELECT run, n, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
        FROM bytes, crc),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT n, CASE WHEN h % 199 = 0
            THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cut AS MATERIALIZED (
        SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS spot(i)),
    near AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cut AS c JOIN words AS w ON c.rest = w.word
        UNION SELECT w.word, c.word, c.n FROM cut AS c JOIN words AS w ON c.rest = w.word),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    led AS MATERIALIZED (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
            CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
        FROM words LEFT JOIN best USING (word)),
    way AS (
        SELECT word, word AS reached FROM led
        UNION ALL SELECT way.word, led.form FROM way JOIN led ON led.word = way.reached WHERE led.form IS NOT NULL),
    ends AS (SELECT way.word, reached AS root FROM way JOIN led ON led.word = way.reached WHERE led.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM led JOIN ends USING (word)
    """


ORACLE: dict[str, str] = {"op11_license_blocks": _license_blocks(), "op12_index_variants": _variants()}
