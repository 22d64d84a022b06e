"""The queries of the operators, and SQL to compare them with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.best_fit import best_fit_packed
from rosterlens.llm.common import shared_dir, table
from rosterlens.llm.decontaminate import contamination
from rosterlens.llm.exact_dedup import exact_groups
from rosterlens.llm.labelled import held_out_rows, labelled_sample
from rosterlens.llm.language_id import fit_language, languages
from rosterlens.llm.line_dedup import line_report
from rosterlens.llm.minhash import near_groups
from rosterlens.llm.packing import packed
from rosterlens.llm.prefix_trie import conversation_trie
from rosterlens.llm.quality import fit_quality, quality_scores
from rosterlens.llm.secret_scan import count_of, digest, scan_into
from rosterlens.llm.source_audit import source_divergence
from rosterlens.llm.token_counts import token_counts
from rosterlens.llm.toxicity import fit_toxicity, toxicity_scores


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = held_out_rows(F.col("doc_id"), 5, 0)
    model = fit_quality(labelled_sample(docs, table(spark, folder, "labels"), "quality", ~held_out, "doc_id", "text"))
    return quality_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = held_out_rows(F.col("doc_id"), 4, 2)
    model = fit_toxicity(labelled_sample(docs, table(spark, folder, "labels"), "toxic", ~held_out, "doc_id", "text"))
    return toxicity_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs, ledger = table(spark, folder, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    # Two scans with one ledger: the second one scans no blob that the first has seen.
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    found = scan_into(ledger, docs.where(~second), "doc_id", "text").union(scan_into(ledger, docs.where(second), "doc_id", "text"))
    spans = F.col("found")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(digest(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "n_near",
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
    )


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = held_out_rows(F.col("doc_id"), 4, 2)
    return languages(docs, fit_language(docs, ~held_out)).select(
        F.col("id").alias("doc_id"), held_out_rows(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score"
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), with_ids=False).withColumnRenamed("id", "doc_id").drop("ids")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"), largest=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = F.col("items")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, folder, "benchmark")).select(
        "row.doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = best_fit_packed(table(spark, folder, "documents"), with_ids=False)
    return packed.withColumnRenamed("id", "doc_id").drop("ids")


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_toxicity, op3_secret_scan, op4_line_dedup, op5_language_id, op6_packing, op7_token_counts, op8_exact_dedup, op9_minhash_dedup,
    op10_decontamination, op11_best_fit, op12_source_audit, op13_prefix_trie,
)}

SQL = {
    "op4_line_dedup": """
        WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
        l AS (
          SELECT doc_id, i AS no, x[i + 1] AS line, length(x[i + 1]) AS n
          FROM (SELECT doc_id, x, unnest(range(len(x))) AS i FROM t)
        ), place AS (SELECT line, n, {'d': doc_id, 'i': no} AS p FROM l WHERE n >= 24),
        node AS (SELECT line, n, min(p) AS own FROM place GROUP BY 1, 2),
        link AS (
          SELECT a.line AS a, b.line AS b FROM node a JOIN node b ON b.n BETWEEN a.n - 1 AND a.n + 1
          WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= 1
        ), reach AS (
          SELECT DISTINCT a AS line, a AS other FROM link UNION SELECT reach.line, link.b FROM reach JOIN link ON other = a
        ), keep AS (
          SELECT r.line, min(own) AS keeper FROM reach r JOIN node ON node.line = r.other GROUP BY 1
        ), gone AS (
          SELECT p.d AS doc_id, p.i AS no, p = own AS near
          FROM place JOIN node USING (line) LEFT JOIN keep USING (line) WHERE p <> coalesce(keeper, own)
        ), per AS (
          SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (near) AS n_near,
                 string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS dropped FROM gone GROUP BY 1
        )
        SELECT doc_id, len(x) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near,
               coalesce(dropped, '') AS dropped
        FROM t LEFT JOIN per USING (doc_id)
    """,
    "op8_exact_dedup": """
        WITH n AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op9_minhash_dedup": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        link AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id
          JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ), reach AS (
          SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON other = a
        ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM least LEFT JOIN n USING (doc_id)
    """,
    "op10_decontamination": """
        WITH t AS (
          SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
        ), s AS (
          SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
        ), item AS (
          SELECT id AS item_id, list_slice(w, i, i + 9) AS win
          FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM s WHERE side = 'b' AND len(w) > 0)
        ), place AS (
          SELECT id AS doc_id, i, n, list_slice(w, i, i + n - 1) AS win
          FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM s, (SELECT DISTINCT len(win) AS n FROM item) WHERE side = 'd' AND len(w) >= n)
        ), hit AS (SELECT doc_id, i, n, item_id FROM place JOIN item USING (win)),
        spots AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1
        ), items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1
        )
        SELECT s.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM s LEFT JOIN spots ON s.id = spots.doc_id LEFT JOIN items ON s.id = items.doc_id WHERE side = 'd'
    """,
    "op12_source_audit": """
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), t AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
        cell AS (
          SELECT lang, source, term, coalesce(n, 0) AS n, v
          FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ), p AS MATERIALIZED (
          SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS HUGEINT) AS p,
                 CAST(1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)
                      // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS HUGEINT) AS q
          FROM cell
        ), part AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
            FROM p x JOIN p y USING (lang, term) GROUP BY ALL
          ) z ON z.lang = a.lang AND z.s = a.source AND z.o = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM part QUALIFY part = 'pair' OR rank <= 10
    """,
    "op13_prefix_trie": """
        WITH o AS (
          SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
        ), h AS (
          SELECT c, l, xor(list_reduce(
            list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)),
            lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda k: k::UBIGINT)),
              lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::UBIGINT) % 4 AS h FROM o
        ), s AS (
          SELECT h.c, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20
        ), p AS MATERIALIZED (
          SELECT c, d, md5(CAST(s[1:d] AS VARCHAR)) AS p, s[d].x AS x, len(s) AS n
          FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM s)
        ), name AS MATERIALIZED (SELECT c, d, x, n, min(c) OVER (PARTITION BY d, p) AS v FROM p),
        node AS (
          SELECT v, d, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(x), ''), '[^\x20\x09-\x0D]+')) AS saved,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM name GROUP BY 1, 2
        ), tree AS MATERIALIZED (SELECT node.*, name.v AS parent FROM node LEFT JOIN name ON name.c = node.v AND name.d = node.d - 1),
        child AS (SELECT parent AS v, d - 1 AS d, count(*) AS k FROM tree WHERE d > 0 GROUP BY 1, 2),
        own AS MATERIALIZED (SELECT tree.*, coalesce(k, 0) AS k FROM tree LEFT JOIN child USING (v, d)),
        total AS (
          SELECT name.v, name.d, sum(own.saved) AS saved, count(*) FILTER (own.k = 0) AS leaves
          FROM own JOIN name ON name.c = own.v AND name.d <= own.d GROUP BY 1, 2
        )
        SELECT v AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, k AS n_children, leaves AS n_leaves,
               CAST(total.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
        FROM own JOIN total USING (v, d)
    """,
}
