"""The operators applied to whole tables, as queries; each derives its columns from the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import alignment, chat, jaccard_join, mixing, packing, phrases, pieces, quality_cnn, quality_rules, substring, topk, toxicity
from lakewarden.llm.shipping import ship
from lakewarden.llm.text import crc32_mod
from lakewarden.llm.token_files import TokenFiles
from lakewarden.session import fresh_path

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 2
PIECES = "piece_bpe_32k.model"
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 1


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(spark, folder)
        QUERIES[run.__name__] = shipped
        if sql:
            SQL[run.__name__] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxic_learns() -> Column:
    return crc32_mod("doc_id", 4) != 2


def quality_learns() -> Column:
    return crc32_mod("doc_id", 5) != 0


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = TokenFiles.write(table(spark, folder, "documents"), fresh_path(spark, "token-files"),
                             tokenizer_path(WORD_BPE), WORD_BPE_END)
    return files.documents(spark, with_ids=False)


@query("""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def op2_top_products(spark: SparkSession, folder: str) -> DataFrame:
    asks = F.col("vec_id") % 50 == 0
    return topk.top_k(table(spark, folder, "embeddings"), asks, 5, fresh_path(spark, "top-k"))


@query(r"""WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM places),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept_text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring.without_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed",
                          F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query()
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"),
                                 fresh_path(spark, "quality-rules"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


@query(r"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d
  WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL
    SELECT b, a FROM links) e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)""")
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"),
                                        fresh_path(spark, "near-duplicates"))


@query()
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encoded(table(spark, folder, "documents"), tokenizer_path(PIECES),
                           with_pieces=False, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"),
                            toxic_learns(), fresh_path(spark, "toxicity"))
    return found.select("doc_id", (~toxic_learns()).alias("held_out"), "score", "predicted")


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_cnn.scored(table(spark, folder, "documents"), table(spark, folder, "labels"),
                               quality_learns(), fresh_path(spark, "quality"))
    return found.select("doc_id", (~quality_learns()).alias("held_out"), "score", "predicted")


PLANTED_CHAT = r"\### Assistant: </turn> ok"


@query(r"""WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'),
    '### ', '\h\h\h ') AS safe,
  contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\l')
    OR contains(text, '\h') OR contains(text, '\c') OR contains(text, '\b') AS bad FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn, role, text), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + 8) + CASE WHEN bool_or(bad) THEN sum(length(safe))
    ELSE sum(length(text)) END AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"))
                                for i, r in enumerate(("user", "assistant"))])).alias("t")
    planted = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), roles).select(
        "conv_id", "t.turn", "t.role", F.lit(PLANTED_CHAT).alias("text"))
    back = chat.read_back(chat.formatted(given.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query()
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("repeats")).alias("taken"))


@query()
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path(BYTE_BPE), BYTE_BPE_END,
                          fresh_path(spark, "packing"), with_ids=False)


@query()
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.aligned(table(spark, folder, "documents"), tokenizer_path(BYTE_BPE),
                              tokenizer_path(PIECES), fresh_path(spark, "alignment"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query(r"""WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) t(k)
  WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM places GROUP BY ALL),
c AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.k, c.g, a, cut, x.f AS l, y.f AS r,
    CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:c.k]),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, g[j:j + 1] AS g, max(f) AS longer
  FROM (SELECT lang, g, f, unnest([1, 2]) AS j FROM f WHERE k = 3 AND f >= 10) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, g)
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (
  PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(table(spark, folder, "documents"), fresh_path(spark, "phrases"))
