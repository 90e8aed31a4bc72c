"""The contract queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, jaccard, language, licences, packing, quality, tokens, toxicity, urls
from .shared import held_out

BPE, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> bytes:
    """A public tokenizer file's bytes, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    back = chat.parse_chats(chat.format_chats(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def pack(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, packed with the production limits."""
    import public_tokenizers

    added = tokens.Vocabulary(vocabulary(BPE)).added
    return packing.pack_documents(docs, vocabulary(RANKS), public_tokenizers.PATTERN, added)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocab = table(spark, sf_dir, "documents"), vocabulary(BPE)
    lexicon = tokens.build_lexicon(docs, vocab)
    back = tokens.decode_ids(tokens.encode_texts(docs, vocab, lexicon), vocab)
    return back.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan_licences(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.fit(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge_urls(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


QUERIES = {"op1_chat": op1_chat, "op2_packing": op2_packing, "op3_licences": op3_licences, "op5_quality": op5_quality, "op6_tokens": op6_tokens, "op4_jaccard": op4_jaccard, "op8_embeddings": op8_embeddings, "op7_toxicity": op7_toxicity, "op9_language": op9_language, "op10_urls": op10_urls}

_ESCAPED = rf"regexp_replace(replace(%s, '\', '\\'), '{chat.ESCAPE_PATTERN}', '\1\\\2', 'g')"
_WS = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_chat": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS follows FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length({_ESCAPED % "text"}) + CASE WHEN follows THEN {len(chat.SEG)}
    ELSE {len(chat.ROLE) + len(chat.TEXT) + len(chat.END)} + length({_ESCAPED % "role"}) END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
    "op5_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
win2 AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS x FROM win),
rep AS (SELECT r, i FROM win2 QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY r),
m AS (SELECT w.doc_id, w.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > {quality.SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {quality.DUP_LINE_PERCENT} * n_lines
  OR word_chars < {quality.WORD_CHARS[0]} * n_words OR word_chars > {quality.WORD_CHARS[1]} * n_words AS bad FROM b),
h AS (SELECT source, count(*) AS n, sum(CAST(bad AS INT)) AS failed, sum(CAST(bad AS INT)) / count(*) AS rate FROM f GROUP BY source),
q AS (SELECT sum(failed) / sum(n) AS m, sum(n * rate * rate) / sum(n) AS q FROM h),
p AS (SELECT m, CASE WHEN q - m * m > 1e-12 THEN greatest(1.0, least(1e6, m * (1 - m) / (q - m * m) - 1)) ELSE 1e6 END AS k FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT bad AND (failed + m * k) / (n + k) <= m + {quality.HOST_LIMIT} * (1 - m) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p""",
    "op4_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
    "op8_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id JOIN c ON c.node = vec_id""",
}
