"""The operators' registered queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, crossalign, decontam, digest_index, jaccard, langid, linedup, quality, sharding, urlfilter, warc
from .common import small_batches, stored
from .stages import held_out, learning_rows, piece_file, tokenizer_file

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant, with mask spans."""
    views = chat.rotate(_read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return views.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), F.col("char_offset").cast("long").alias("char_offset"), F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask_spans"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(warc.responses(_read(spark, sf_dir, "pages")))


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    counts = langid.fit(learning_rows(docs))
    return langid.identify(docs, counts).select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items found in them."""
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_minhash_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and number of links of every document."""
    return jaccard.similar(_read(spark, sf_dir, "documents"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    done = _read(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), tokenizer_file()).alias("done"))
    return done.select(
        "doc_id", (F.octet_length("done.ids") / 4).cast("long").alias("n_tokens"), F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("done.text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication deletes from every document."""
    done = linedup.deduplicate(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "deduped.n_lines", "deduped.n_deleted", "deduped.copy_of", F.sha2(F.encode("deduped.text", "UTF-8"), 256).alias("text_sha256"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on every page's URL."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r)]) for r in RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)))
    return urlfilter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op9_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, decided through an index that starts empty."""
    docs = _read(spark, sf_dir, "documents")
    index = digest_index.new_index(spark, docs.count())
    judged = index.add(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    index.close(delete=True)
    return judged


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 16, and its shard among 17."""
    return sharding.shard(_read(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text and whether the rules keep it."""
    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"]
    return judged.select("doc_id", *[f"quality.{c}" for c in told], F.array_join("quality.broken", ",").alias("broken"))


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 2000 collocations of each language."""
    return collocations.top(collocations.mine(_read(spark, sf_dir, "documents")), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens meet in every document, with counts of linked ids."""
    files = tokenizer_file(), piece_file()
    done = crossalign.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), *files).select("doc_id", "aligned")
    digest = F.when(F.col("aligned.groups") == "", "").otherwise(F.sha2(F.encode("aligned.groups", "UTF-8"), 256))
    # Row numbers hold once they are written.
    kept = stored(done.select(F.monotonically_increasing_id().alias("row"), "doc_id", "aligned.n_a", "aligned.n_b", digest.alias("groups_sha256"), "aligned.links"), compression="zstd")
    counts = stored(crossalign.pair_counts(kept.select("links"), *files))
    scored = crossalign.with_counts(kept, counts, *files)
    n = F.floor(F.octet_length("links") / crossalign.link_bytes(*files)).cast("long")
    return scored.select("doc_id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_chat_perspectives, op2_warc_derivatives, op3_ppm_language, op4_template_decontamination, op5_minhash_jaccard, op6_trie_bpe, op7_line_alignment, op8_url_rules, op9_digest_index, op10_jump_shards, op11_quality_rules, op12_son_collocations, op13_token_alignment)}

ORACLE = {
    "op1_chat_perspectives": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 64 AS part FROM t),
p AS (
  SELECT n.conv_id, s.perspective, n.part, n.turn, n.role, n.text, n.role = s.perspective AS own,
    CASE WHEN n.role = s.perspective THEN '<|assistant|>' || chr(10) WHEN n.role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || regexp_replace(regexp_replace(regexp_replace(n.role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g'), '[\r\n]', ' ', 'g') || '|>' || chr(10) END AS head,
    regexp_replace(n.text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS till FROM p),
v AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
    coalesce(string_agg(CASE WHEN own THEN CAST(CAST(till - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(till - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask_spans
  FROM q GROUP BY conv_id, perspective, part)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part,
  CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset,
  CAST(n_turns AS BIGINT) AS n_turns, text, mask_spans
FROM v
""",
    "op8_url_rules": """
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op9_digest_index": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op11_quality_rules": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM h, range(8) AS x(o) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: list_contains(string_split('STOP', ' '), lower(x)))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022\u25cf]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$'))) AS n_ellipses
  FROM t LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    array_to_string(list_filter([
      CASE WHEN n_words < 20 THEN 'too_few_words' END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_windows' END,
      CASE WHEN n_words > 1000000 THEN 'too_many_words' END, CASE WHEN 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words THEN 'word_length' END,
      CASE WHEN 100 * n_symbols > 10 * word_chars THEN 'symbols' END, CASE WHEN 100 * n_stop_words < 5 * n_words THEN 'stop_words' END,
      CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 'duplicate_lines' END, CASE WHEN 100 * n_bullets > 90 * n_lines THEN 'bullet_lines' END,
      CASE WHEN 100 * n_ellipses > 30 * n_lines THEN 'ellipsis_lines' END], lambda x: x IS NOT NULL), ',') AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken = '' AS kept, n_stop_words, n_lines, broken FROM b
""".replace("STOP", " ".join(quality.STOP_WORDS)),
    "op12_son_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS x(k) WHERE len(words) >= k),
f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, words, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS rest FROM c, range(1, 5) AS x(j) WHERE j < k),
s AS (
  SELECT u.lang, u.phrase, u.a, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * u.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, j
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.head JOIN f r ON r.lang = u.lang AND r.phrase = u.rest JOIN n ON n.lang = u.lang),
b AS (SELECT lang, phrase, a, unnest(best) FROM (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, n := n, score := score), struct_pack(score := score, j := j)) AS best FROM s GROUP BY lang, phrase, a)),
e AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS o ON o.lang = c.lang AND o.a = c.a AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN e USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
""",
}
