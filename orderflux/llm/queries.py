"""One query for each corpus operator, with SQL where SQL states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflux.llm import (chat, chunks, collocations, decontaminate, edit_fingerprint, language, licenses, line_dedup,
                           mixing, pii, prefix_trie, quality, simhash)
from orderflux.llm.common import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return wrap


@query("""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
shown AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM line
          WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
win AS (
  SELECT doc_id, pos, lead(pos, 1) OVER w AS pos1, lead(pos, 2) OVER w AS pos2,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM win WHERE body IS NOT NULL),
cut AS (
  SELECT doc_id, pos FROM ranked WHERE nth > 1 UNION SELECT doc_id, pos1 FROM ranked WHERE nth > 1
  UNION SELECT doc_id, pos2 FROM ranked WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text, count(c.pos) AS n_removed
  FROM line l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)


_TEMPLATE_ROWS = ",\n".join(
    f"({k}, {i}, '{w}', {i in t.must}, '{t.label}', {t.base}, {len(t.words)}, {len(t.must)})"
    for k, t in enumerate(licenses.TEMPLATES) for i, w in enumerate(t.words))


@query(f"""
WITH tpl(t, q, word, must, label, base, size, n_must) AS (VALUES {_TEMPLATE_ROWS}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM words),
place AS (
  SELECT doc_id, t, label, base, pos - q AS start, count(*) / size::DOUBLE AS share
  FROM word JOIN tpl USING (word) GROUP BY doc_id, t, label, base, pos - q, size, n_must
  HAVING count(*) FILTER (must) = n_must AND count(*) / size::DOUBLE >= {licenses.LEAST_SHARE}),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
         max(start) FILTER (base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM place GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM words w LEFT JOIN found f ON f.doc_id = w.doc_id
""")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query()
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query()
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query()
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passage_report(table(spark, sf_dir, "documents"))


_GUARDED = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


@query(f"""
WITH row_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT conv_id, row_number() OVER (ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM row_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length('<|im_end|>') + 2
           + length(replace(replace(regexp_replace(role, '{_GUARDED}', '\\1\\\\\\2\\3', 'g'), '%', '%25'), chr(10), '%0A'))
           + length(regexp_replace(text, '{_GUARDED}', '\\1\\\\\\2\\3', 'g')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
""")
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as events in the order of their turns, and conversation -1, whose texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.chat_digest(chat.format_chats(rows.withColumn("kind", F.lit("message")), seq="turn", place="turn"))


@query("""
WITH turn_ AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, turn
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS d FROM turn_),
conv AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
           4294967295) % 4 AS h
  FROM turns GROUP BY conv_id),
fork AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM conv c LEFT JOIN conv b ON b.conv_id = c.base),
built AS (
  SELECT f.conv_id, t.d, t.g, t.w FROM fork f JOIN turns t ON t.conv_id = f.base AND t.d <= f.taken
  UNION ALL SELECT f.conv_id, t.d - f.h + f.taken, t.g, t.w FROM fork f JOIN turns t ON t.conv_id = f.conv_id AND t.d > f.h),
path AS (
  SELECT conv_id, d, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS p, w FROM built
  UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
member AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS pp,
                  lead(p) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS stops FROM path),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, min(pp) AS pp, count(*) AS n_convs, min(w) AS w, bool_and(stops) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256
  FROM member GROUP BY p, d),
below AS (
  SELECT m.p, m.d, count(*) FILTER (y.leaf) AS n_leaves, sum((y.n_convs - 1) * y.w) AS saved_tokens
  FROM node y JOIN member m ON m.conv_id = y.conv_id AND m.d <= y.d GROUP BY m.p, m.d),
child AS (SELECT pp AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY pp)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM node x JOIN below b ON b.p = x.p AND b.d = x.d LEFT JOIN child c ON c.p = x.p
LEFT JOIN node up ON up.p = x.pp
""")
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.forked(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


@query("""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
size AS (SELECT k FROM range(1, 6) t(k)),
gram AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, size)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cut AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS left_,
         array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS right_
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
scored AS (
  SELECT cut.lang, cut.k, cut.phrase, a, c, x.f AS l, y.f AS r, n,
         ((1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_ AND x.k = c
           JOIN f y ON y.lang = cut.lang AND y.phrase = right_ AND y.k = cut.k - c JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, phrase, a, s, unnest(range(1, k - s + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS s FROM best)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
         WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
