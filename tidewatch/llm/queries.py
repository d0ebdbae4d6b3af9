"""The operators of this package as registered queries, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from tidewatch.llm import (
    chat, common, decontaminate, exact_dedup, language, line_dedup, maxent, packing, personal_data,
    ranked_search, simhash, substring_dedup, token_files, whitening,
)
from tidewatch.session import prepare


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(common.documents(prepare(spark), folder))


def op2_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(common.documents(prepare(spark), folder))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(common.documents(prepare(spark), folder))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages: documents train the text model and are told by text and source,
    pages by text, markup, suffix and host."""
    docs = common.documents(prepare(spark), folder)
    languages, table = language.train(docs)
    columns = ["doc_id", "page_id", "lang", "confidence", "text_lang", "kept"]
    parts = []
    for view, key in (
        (language.document_evidence(docs.select("doc_id", "text", "source")), "doc_id"),
        (language.page_evidence(spark.read.parquet(f"{folder}/pages.parquet")), "page_id"),
    ):
        scored = common.stored(language.score_text(view, table).drop("text"), "text-evidence")
        told = language.fuse(scored, languages)
        other = "page_id" if key == "doc_id" else "doc_id"
        parts.append(told.withColumn(other, F.lit(None).cast("long")).select(*columns))
    return parts[0].union(parts[1])


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(prepare(spark), folder))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(common.documents(prepare(spark), folder),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contamination(common.documents(prepare(spark), folder), items).drop("n_near")


def op8_preference_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = prepare(spark).read.parquet(f"{folder}/conversations.parquet")
    return chat.preference_pairs(*chat.variants(turns))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(common.documents(prepare(spark), folder))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.tokens_in_files(common.documents(prepare(spark), folder),
                                       public_tokenizers.path("word_bpe_49k.json"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    items = prepare(spark).read.parquet(f"{folder}/benchmark.parquet")
    return ranked_search.rank(common.documents(spark, folder), items)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(prepare(spark).read.parquet(f"{folder}/embeddings.parquet"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_frequent_lines(common.documents(prepare(spark), folder), with_text=False)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_maxent_scores, op3_personal_data, op4_language_id, op5_simhash, op6_packing,
    op7_decontamination, op8_preference_chat, op9_substring_dedup, op10_token_files, op11_ranked_search,
    op12_whitening, op13_line_dedup)}

# The pipeline stands at the top of the repository and belongs to this package.
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
      WITH n AS (SELECT doc_id,
          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
      g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
      FROM n JOIN g USING (t)""",
    "op8_preference_chat": r"""
      WITH n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            coalesce(text, '')) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
      e AS (SELECT conv_id, max(k) AS final, arg_min(text, k) AS reply FROM n
        WHERE role = 'assistant' GROUP BY conv_id),
      c AS (SELECT n.conv_id AS pair_id, k, role, text, k = e.final AS is_last,
          coalesce(f.reply, '') AS other
        FROM n JOIN e ON n.conv_id = e.conv_id AND n.k <= e.final
        LEFT JOIN e f ON f.conv_id = e.conv_id + 1),
      r AS (SELECT *, CASE WHEN is_last THEN other ELSE text END AS bad FROM c),
      p AS (SELECT pair_id, coalesce(min(CASE WHEN text <> bad THEN k END), max(k) + 1) AS pre
        FROM r GROUP BY pair_id),
      t AS (SELECT r.*, pre, '<|' || role || '|>' || chr(10) AS head,
          '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS good_r,
          '<|' || role || '|>' || chr(10) || bad || chr(10) || '<|end|>' || chr(10) AS bad_r
        FROM r JOIN p USING (pair_id)),
      o AS (SELECT *, coalesce(sum(CASE WHEN k >= pre THEN length(good_r) END) OVER w, 0) AS gs,
          coalesce(sum(CASE WHEN k >= pre THEN length(bad_r) END) OVER w, 0) AS bs
        FROM t WINDOW w AS (PARTITION BY pair_id ORDER BY k
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT pair_id, CAST(pre AS BIGINT) AS prefix_turns,
        coalesce(string_agg(good_r, '' ORDER BY k) FILTER (k < pre), '') AS prompt,
        coalesce(string_agg(good_r, '' ORDER BY k) FILTER (k >= pre), '') AS chosen,
        coalesce(string_agg(CAST(gs + length(head) AS BIGINT) || ':'
            || CAST(gs + length(good_r) AS BIGINT), ',' ORDER BY k)
          FILTER (k >= pre AND role = 'assistant'), '') AS chosen_mask,
        coalesce(string_agg(bad_r, '' ORDER BY k) FILTER (k >= pre), '') AS rejected,
        coalesce(string_agg(CAST(bs + length(head) AS BIGINT) || ':'
            || CAST(bs + length(bad_r) AS BIGINT), ',' ORDER BY k)
          FILTER (k >= pre AND role = 'assistant'), '') AS rejected_mask
      FROM o GROUP BY pair_id, pre""",
    "op7_decontamination": r"""
      WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
      i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
      v AS (SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
              FROM i WHERE len(w) > 0)),
      p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
      m AS (SELECT p.doc_id, p.s, v.n, v.item_id FROM p
        JOIN (SELECT DISTINCT n FROM v) l ON p.s + l.n - 1 <= len(p.w)
        JOIN v ON v.n = l.n AND v.k = array_to_string(p.w[p.s:p.s + l.n - 1], ' ')),
      h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
          SELECT doc_id, unnest(range(s, s + n)) AS q FROM m) GROUP BY doc_id),
      t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (
          SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
        coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_ranked_search": r"""
      WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
      i AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
      q AS (SELECT item_id, text, term, count(*) AS reps FROM (
          SELECT item_id, text, unnest(regexp_extract_all(translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
      s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
      p AS (SELECT doc_id, n, term, count(*) AS tf FROM (
          SELECT doc_id, len(w) AS n, translate(unnest(w),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM p, s GROUP BY term, docs),
      c AS (SELECT q.item_id, q.text, p.doc_id, CAST(sum(reps * f.w * ((1000000000 * tf)
            // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
        FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS k
        FROM c WHERE score > 0)
      SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10""",
    "op13_line_dedup": r"""
      WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
          FROM documents),
      l AS (SELECT row, doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i],
            '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
      f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT row) >= 10)
      SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
        count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN f ON l.k = f.k GROUP BY row""",
}
