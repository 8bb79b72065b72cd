"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    chat,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    filter_audit,
    language_id,
    licenses,
    line_dedup,
    mixing,
    secret_scan,
    simhash,
    substring_dedup,
)
from .common import read_documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir).select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    kept = F.array_join("kept_lines", "\n")
    return line_dedup.dedup_lines(docs).select(
        "row.doc_id",
        (F.size("kept_lines") + F.col("n_removed")).cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_passages(read_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, sf_dir).select("doc_id", "text", "source"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ",").alias("licenses"), "spans",
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    marks = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    back = chat.read_back(chat.training_examples(turns.unionByName(marks)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(read_documents(spark, sf_dir).select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_documents(spark, sf_dir).select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit_filters(read_documents(spark, sf_dir), labels)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann_search": op4_ann_search,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_filter_audit": op13_filter_audit,
}

# SQL for DuckDB. Words are split at ASCII white space; runs of 13 words are compared as text.
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
            FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
        firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
        hit AS (
            SELECT DISTINCT doc_id, i + k AS i
            FROM windows JOIN firsts USING (g), unnest(range(0, 13)) AS t(k) WHERE first < doc_id),
        lists AS (SELECT doc_id, list(i) AS gone FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
                [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN lists USING (doc_id)""",
    "op4_ann_search": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        pairs AS (
            SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.v, e.v) AS score
            FROM e AS q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank,
            vec_id, score
        FROM pairs QUALIFY rank <= 10""",
    "op5_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
        w AS (SELECT *, [5.0, 2.0, 1.0][(k % 3) + 1]::DOUBLE AS weight, 3 * source_size AS cap FROM k),
        c AS (
            SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
                coalesce(sum(cap) OVER before, 0)::DOUBLE AS cap_before,
                coalesce(sum(weight) OVER before, 0) AS weight_before
            FROM w WINDOW before AS (
                ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        p AS (SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS stopped FROM c),
        t AS (
            SELECT *, CASE WHEN stopped THEN cap::DOUBLE ELSE weight
                * (total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())
                / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target FROM p),
        q AS (SELECT source, source_size, target, least(round(target)::BIGINT, cap)::BIGINT AS quota FROM t),
        placed AS (
            SELECT doc_id, size, source_size, target, quota,
                coalesce(sum(size) OVER (
                    PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target, (
            greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start))
            + greatest(0, least(size, quota - 2 * source_size - start)))::BIGINT AS taken
        FROM placed""",
    "op7_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, length('<turn:></turn>') + 1 + 2 * length(role || text) - length(replace(replace(replace(
                role || text, '\', ''), '<', ''), '>', '')) AS chars FROM rows),
        sums AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM sized)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                AS loss_sha256,
            sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
        FROM sums GROUP BY conv_id""",
    "op10_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
            FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
        found AS (
            SELECT doc_id, i, n, item_id FROM (
                SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
                FROM d, (SELECT DISTINCT n FROM grams), unnest(range(1, len(w) - n + 2)) AS t(i))
            JOIN grams USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (
            SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || s[1:8])::BIGINT % (length(t) + 1) AS a,
                ('0x' || s[9:16])::BIGINT % (length(t) + 1) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR ('0x' || s[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || s[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        c AS (
            SELECT doc_id, t, n, form, substring(t, 1, least(a, b)) AS p, greatest(a, b) - least(a, b) AS m,
                substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid,
                substring(t, greatest(a, b) + 1) AS s
            FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN m::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid
                ELSE '<S>' || s || '<P>' || p || '<M>' || mid END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM c""",
    "op12_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept,
                count(*) OVER (PARTITION BY t)::BIGINT AS group_size
            FROM d WINDOW best AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
        l AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
                'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > first, false)} AS f
            FROM d JOIN first USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
        masks AS (
            SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END)
                || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END)
                || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed, count(*) AS n,
                count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM m GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier
            FROM orders, unnest(range(1, 6)) AS t(step)),
        judged AS (
            SELECT *, contains(failed, x) AS fails,
                earlier <> '' AND len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AS gone
            FROM masks, steps),
        report AS (
            SELECT part, filter_order, step, x,
                coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
            FROM judged GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
        FROM report""",
}
