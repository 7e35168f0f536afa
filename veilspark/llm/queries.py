"""The registered queries of the operators, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, imatch, language, lattice, license_scan, line_index, mixing, page_text, prefix_trie, ranked_search, simhash, token_files, toxicity
from veilspark.llm.common import id_remainder, run_folder, staged, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.with_crc32(token_files.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 10) == 0
    return lattice.score_documents(table(spark, sf_dir, "documents"), held_out, lattice.vocabulary(public_tokenizers.path(PIECES)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(staged(docs, "sizes"), F.col("size"))
    return mixed.select("doc.doc_id", F.col("doc_size").alias("size"), "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scanned(docs, table(spark, sf_dir, "benchmark"))
    return scanned.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled documents whose id leaves a remainder by five."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score_texts(docs, model, "doc_id")
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "passages")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out).select("lang", "text"))
    found = language.predict(docs.select("doc_id", "text"), model, "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = staged(prefix_trie.conversation_paths(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(paths))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_index.LineIndex.create(spark, run_folder(spark, "lines"), docs.schema["doc_id"].dataType.simpleString())
    index.insert(docs)
    return index.kept(docs).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_lattice_scores,
        op3_license_scan,
        op4_source_mix,
        op5_simhash,
        op6_decontamination,
        op7_page_text,
        op8_toxicity,
        op9_imatch,
        op10_language,
        op11_prefix_trie,
        op12_ranked_search,
        op13_line_dedup,
        pipeline,
    )
}

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, weight * max(level) OVER ())::DOUBLE AS target FROM levels),
cut AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM cut
"""

_HITS_SQL = """
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM folded, sizes WHERE len(words) >= n)),
hits AS (SELECT DISTINCT r, i, p.n, item_id FROM places p JOIN windows w ON p.n = w.n AND p.gram = w.gram),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

_TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
original AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) AS turns
  FROM turns GROUP BY conv_id),
headed AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base, CAST(xor(list_reduce(
           list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)),
           lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 4 AS INT) AS h
  FROM original),
rebuilt AS (
  SELECT x.conv_id, list_concat(coalesce(b.turns[1 : x.h], []), x.turns[x.h + 1 :]) AS turns
  FROM headed x LEFT JOIN original b ON b.conv_id = x.base),
members AS (
  SELECT conv_id, len(turns) AS n, d AS depth, turns[1 : d] AS path, CASE WHEN d > 0 THEN turns[1 : d - 1] END AS above
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
         CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM members GROUP BY path, depth),
kept AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.above),
below AS (
  SELECT path[1 : d] AS top, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM kept) GROUP BY path[1 : d])
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       n_leaves, saved_tokens, ends_sha256
FROM kept JOIN below ON below.top = kept.path
"""

_LINES_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) > 1),
marked AS (
  SELECT lines.*, repeated.key IS NOT NULL AND (doc_id IS NULL OR doc_id > first) AS dropped
  FROM lines LEFT JOIN repeated ON lines.key = repeated.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

_SEARCH_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM documents),
sizes AS (SELECT r, doc_id, words, len(words) AS n FROM docs WHERE len(words) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark),
postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM sizes)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, n_docs),
scores AS (
  SELECT item_id, p.r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length))))) AS BIGINT) AS score
  FROM items i JOIN postings p ON i.term = p.term JOIN weights x ON x.term = p.term JOIN sizes s ON s.r = p.r, totals
  GROUP BY item_id, p.r, doc_id),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM placed WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op12_ranked_search": _SEARCH_SQL, "op13_line_dedup": _LINES_SQL, "op11_prefix_trie": _TRIE_SQL, "op4_source_mix": _MIX_SQL, "op6_decontamination": _HITS_SQL}
