"""Registered queries of the text operators and the DuckDB counterparts that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import exact_dedup, filter_audit, jaccard_join, katz, license_scan, minhash_join, packing, quality_ledger, sentencepiece_spans, token_files, toxicity, url_filter, vector_codes
from panelwright.llm.bpe import public_file
from panelwright.llm.common import table
from panelwright.session import shared_folder


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_file("byte_bpe_50k.json"))
    return token_files.read_digests(spark.read.parquet(path))


def op4_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_file("piece_bpe_32k.model")
    return sentencepiece_spans.digests(sentencepiece_spans.encode_documents(table(spark, sf_dir, "documents"), model, spans=False))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.components(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.apply_policy(quality_ledger.ledger(table(spark, sf_dir, "documents")), "v1")
    base_failed = F.col("failed_bits").bitwiseAND(F.lit(quality_ledger.mask("base"))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), "kept", "failed_bits",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"), end_id=2)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_toxicity,
        op3_token_files,
        op4_sentencepiece_spans,
        op5_url_filter,
        op6_minhash_join,
        op7_license_scan,
        op8_quality_ledger,
        op9_packing,
        op10_katz,
        op11_jaccard_join,
        op12_vector_codes,
        op13_filter_audit,
    )
}

_SPACE, _LOWER = r"\x20\x09-\x0D", "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"

def _codebook_rounds(rounds: int = 2) -> str:
    """Common table expressions a0, b1, a1, ...: assignments and the codebooks that follow from them."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
        d{i} AS (
            SELECT p.vec_id, p.part, b.entry,
                   list_sum(list_transform(range(1, len(p.xs) + 1), lambda k: (p.xs[k] - b.xs[k]) * (p.xs[k] - b.xs[k]))) AS square
            FROM p JOIN b{i} b USING (part)),
        a{i} AS (SELECT vec_id, part, min(square) AS square, arg_min(entry, (square, entry)) AS entry FROM d{i} GROUP BY ALL)""")
        if i < rounds:
            out.append(f"""
        m{i} AS (
            SELECT part, entry, k, CAST(floor(sum(p.xs[k]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
            FROM a{i} JOIN p USING (vec_id, part), range(1, 257) r(k) WHERE k <= len(p.xs) GROUP BY ALL),
        b{i + 1} AS (
            SELECT part, entry, coalesce(n.xs, b.xs) AS xs
            FROM b{i} b LEFT JOIN (SELECT part, entry, list(x ORDER BY k) AS xs FROM m{i} GROUP BY ALL) n USING (part, entry))""")
    return ",".join(out)


ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER.format(_TEXT)} AS normal FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(normal) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY normal)
    """,
    "op6_minhash_join": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, '[^{_SPACE}]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws) + 1, 2)))) AS i FROM d)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, r) AS (
            SELECT a, a FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
        root AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id,
               d.doc_id = coalesce(r, d.doc_id) AS kept
        FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN root ON root.doc_id = d.doc_id
    """,
    "op8_quality_ledger": f"""
        WITH d AS (
            SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[^{_SPACE}]+') AS ws,
                   list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls
            FROM documents),
        win AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(8) r(k) WHERE n > 1 GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                   len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
            FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
        f AS (
            SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
                + 4 * CAST(100 * n_symbols > 20 * n_words AS BIGINT) + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
                + 16 * CAST(100 * n_upper > 50 * word_chars AS BIGINT) + 32 * CAST(word_chars > 40 * n_words AS BIGINT)
                + 64 * CAST(word_chars < 2 * n_words AS BIGINT) AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               failed_bits % 4 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
    """,
    "op11_jaccard_join": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format(_TEXT)}, '[^{_SPACE}]+') AS ws FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws) + 1, 2)))) AS i FROM d)),
        size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, r) AS (
            SELECT a, a FROM edge UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
        root AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id
        FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN root ON root.doc_id = d.doc_id
    """,
    "op12_vector_codes": f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT vec_id, part, xs[part * (len(xs) // 16) + 1:(part + 1) * (len(xs) // 16)] AS xs
            FROM v, (SELECT CAST(unnest(range(16)) AS INTEGER) AS part) y),
        b0 AS (
            SELECT part, entry, xs FROM p
            JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) o USING (vec_id) WHERE entry < 64),
        {_codebook_rounds()},
        e AS (
            SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(square) AS BIGINT) AS error
            FROM a2 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
        FROM e JOIN v USING (vec_id)
    """,
    "op13_filter_audit": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[^{_SPACE}]+') AS ws FROM documents),
        f AS (
            SELECT d.doc_id, part, CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER)
                + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
                + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
                + 16 * CAST(EXISTS (SELECT 1 FROM d o WHERE o.t = d.t AND o.doc_id < d.doc_id) AS INTEGER) AS bits
            FROM d),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
        o(filter_order, used, step) AS (
            SELECT '', 0, 0 UNION ALL
            SELECT filter_order || chr(65 + i), used + (1 << i), step + 1
            FROM o, (SELECT CAST(unnest(range(5)) AS INTEGER) AS i) x WHERE used & (1 << i) = 0),
        whole AS (SELECT filter_order FROM o WHERE step = 5),
        s AS (
            SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
                   list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS used
            FROM whole, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) x),
        per AS (
            SELECT part, filter_order, s.step, bit,
                   sum(n) FILTER (bits & (coalesce(used, 0) | bit) = 0) AS kept,
                   sum(n) FILTER (bits & coalesce(used, 0) = 0 AND bits & bit <> 0) AS removed,
                   sum(n) FILTER (bits & coalesce(used, 0) <> 0 AND bits & bit <> 0) AS redundant,
                   sum(n) FILTER (bits = bit) AS unique_fails,
                   sum(n_good) FILTER (bits & coalesce(used, 0) = 0 AND bits & bit <> 0) AS good_lost,
                   sum(n_toxic) FILTER (bits & coalesce(used, 0) = 0 AND bits & bit <> 0) AS toxic_lost
            FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM per
    """,
}
