"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import bound_batches, remainder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.suffix import remove_repeats

    found = remove_repeats(_documents(spark, sf_dir), words=51, cut=False)
    covered = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s.hi - s.lo)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id", size.alias("n_bytes"), covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        covered("passages").alias("n_passage_words"),
    )


def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.toxicity import fit_index, held_out, score_toxicity

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, fit_index(docs, labels, ~held_out()))
    predicted = F.when(F.col("tox_score") >= 0.3, 1).otherwise(0).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), predicted.alias("predicted"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfspark.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.lm import score_texts

    held_out = remainder("doc_id", 7) == 2
    found = score_texts(_documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir), words=4, num=85, den=100).drop("row")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.neardup import near_duplicates

    return near_duplicates(_embeddings(spark, sf_dir))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.topk import top_k

    return top_k(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.langid import identify, train_language_model

    docs = _documents(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    found = identify(docs, train_language_model(docs, ~held_out), reject=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.sharding import pack_shards

    placed = pack_shards(_documents(spark, sf_dir))
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", none)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.trie import rebuild, sequences, trie

    bound_batches(spark)
    return trie(rebuild(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.lines import batches_of, drop_lines, shared_lines

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = drop_lines(docs, shared_lines(spark, batches_of(docs, 4), min_docs=10, least=1))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfspark.llm.spelling import spelling_forms, word_counts

    return spelling_forms(word_counts(_documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (op1_repeat_removal, op2_toxicity_neighbours, op3_retrieval_packing, op4_lm_scoring, op5_jaccard_join, op6_source_mix, op7_embedding_neardup, op8_exact_topk, op9_language_id, op10_vector_packing, op11_conversation_trie, op12_line_dedup, op13_spelling_variants)
}
#: ASCII letters, and one ASCII character for each letter from U+00C0 to U+00FF, for functions that count bytes.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = _UPPER + "0123456789" + "!#$%&()*+,-./:;<=>?@[]^_`{|}"


def _crc32(text: str) -> str:
    """Oracle text: CRC-32 of the UTF-8 bytes of a text of ASCII and U+00C0 to U+00FF, bit by bit."""
    bits = ", ".join(["-1"] * 8)
    data = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN unicode(substr({text}, i, 1)) < 128 THEN [unicode(substr({text}, i, 1))::BIGINT, {bits}] ELSE [195, {bits}, unicode(substr({text}, i, 1))::BIGINT - 64, {bits}] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_conversation_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE i <= h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, string_agg(md5(concat(length(role), ':', role, text)), '/') OVER w AS prefix FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, lag(prefix, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT prefix, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY prefix),
e AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(prefix, d) AS prefix FROM m GROUP BY conv_id) GROUP BY prefix),
k AS (SELECT parent AS prefix, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.prefix, count(*) FILTER (k.prefix IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens FROM n a JOIN n b ON a.prefix = '' OR b.prefix = a.prefix OR starts_with(b.prefix, a.prefix || '/') LEFT JOIN k ON k.prefix = b.prefix GROUP BY a.prefix)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON u.prefix = n.parent LEFT JOIN k ON k.prefix = n.prefix LEFT JOIN e ON e.prefix = n.prefix JOIN s ON s.prefix = n.prefix""",
    "op12_line_dedup": f"""
WITH l AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN f ON gone = key GROUP BY r, doc_id""",
    "op13_spelling_variants": f"""
WITH RECURSIVE u AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS t, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, n, {_crc32("t")} AS crc FROM u),
v AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_LATIN}', '{_PLAIN}') AS code FROM (SELECT n, CASE WHEN crc % 199 = 0 THEN substr(w, 1, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (SELECT DISTINCT word, other, n, m FROM (
  SELECT a.word, b.word AS other, a.n, b.n AS m, a.code AS x, b.code AS y FROM v a JOIN v b ON a.code[1:3] = b.code[1:3] UNION ALL SELECT a.word, b.word, a.n, b.n, a.code, b.code FROM v a JOIN v b ON a.code[-3:] = b.code[-3:])
  WHERE abs(length(x) - length(y)) <= 1 AND x <> y AND levenshtein(x, y) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN g ON g.word = v.word AND place = 1),
o AS (SELECT word, word AS tip, form AS up FROM f UNION ALL SELECT o.word, o.up, f.form FROM o JOIN f ON f.word = o.up)
SELECT f.word, form, tip AS root, n, n_near, form_n FROM f JOIN o ON o.word = f.word WHERE up IS NULL""",
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
