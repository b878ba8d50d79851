"""One query per operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import byte_bpe, embedding_dedup, fim, html_extract, license_scan, line_dedup, mixing, packing, quality_lm, simhash_dedup, spelling, topk_search, toxicity
from rippleframe.llm.base import WORD

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"
HELD_OUT = 5
#: One in so many runs of letters of a document loses a letter.
LOSSY = 199


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of removed chunks and the MD5 of what is left of each document."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "removed_chunks", "removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % {line_dedup.MODULUS} AS h, len(regexp_extract_all(line, '{WORD}')) >= {line_dedup.LONG_WORDS} AS long FROM l),
q AS (SELECT *, ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {line_dedup.BASE} + h) % {line_dedup.MODULUS})
  % {line_dedup.HIT_LINES} = 0 AS hit FROM h),
r AS (SELECT *, long OR lead(long, 1, false) OVER w OR (hit AND NOT lag(hit OR long, 1, true) OVER w) AS ends FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM r),
k AS (SELECT doc_id, no, count(*) AS n, bool_or(long) AS long, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY doc_id, no),
m AS (SELECT *, (n >= {line_dedup.MIN_LINES} OR long) AND row_number() OVER (PARTITION BY t, n ORDER BY doc_id, no) > 1 AS gone FROM k)
SELECT doc_id, count(*) AS n_chunks, count_if(gone)::BIGINT AS removed_chunks, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines,
  md5(coalesce(string_agg(t, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_md5
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.MIN_COSINE}),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source/lang; one whose first line names a licence stands as a licence file above its neighbours."""
    docs = read(spark, sf_dir, "documents")
    header = F.coalesce(F.substring_index("text", "\n", 1).rlike(r"(?i)licen[cs]e"), F.lit(False))
    above = F.concat_ws("/", F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(header, F.concat(above, F.lit("/LICENSE-"), F.col("doc_id"))).otherwise(F.concat_ws("/", above, F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")))
    return license_scan.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
o AS (SELECT *, {mixing.MAX_RATE}::DOUBLE * source_size AS most, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS amount,
  row_number() OVER (ORDER BY {mixing.MAX_RATE}::DOUBLE * source_size / weight, source NULLS LAST) AS i FROM w),
p AS (SELECT *, (amount - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
g AS (SELECT level FROM p WHERE weight * level <= most ORDER BY i LIMIT 1),
t AS (SELECT w.source, source_size, least(weight * (SELECT level FROM g), {mixing.MAX_RATE}::DOUBLE * source_size) AS target FROM w),
x AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM x
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.classes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk_search.K}
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that never sees the labels of the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    labels = read(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.train(docs, labels)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lm.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", "perplexity", "threshold", "keep")


def _lossy(runs: DataFrame) -> DataFrame:
    """Runs of letters of which one in LOSSY, by the CRC-32 of document and run, has lost the letter that the remainder names."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "word").cast("binary"))
    at = F.pmod(h, F.length("word").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return runs.select(F.when(h % LOSSY == 0, cut).otherwise(F.col("word")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(read(spark, sf_dir, "documents"))
    return spelling.variants(spelling.frequent_words(_lossy(runs)))


OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
b AS (SELECT run, k, list_transform(range(length(x) // 2), lambda p: ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) AS bytes FROM g),
h AS (SELECT run, k, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
c AS (SELECT CASE WHEN h % {LOSSY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1),
w AS (SELECT word, n FROM c WHERE length(word) >= {spelling.MIN_LETTERS} AND n >= {spelling.MIN_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.cut = w.word),
m AS (SELECT p.a, w.word, w.n, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, w.word) AS i, count(*) OVER (PARTITION BY p.a) AS n_near FROM p JOIN w ON p.b = w.word),
f AS (SELECT w.word, w.n, coalesce(m.n_near, 0)::BIGINT AS n_near, CASE WHEN m.n >= {spelling.RATIO} * w.n THEN m.word END AS form, CASE WHEN m.n >= {spelling.RATIO} * w.n THEN m.n END AS form_n
  FROM w LEFT JOIN m ON m.a = w.word AND m.i = 1),
s(word, root) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f e ON s.root = e.word WHERE e.form IS NULL
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every text, and of the bytes that they decode to."""
    path = public_tokenizers.path(BYTE_TOKENIZER)
    out = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every transformed text and of the text rebuilt from it."""
    out = fim.restore(fim.transform(read(spark, sf_dir, "documents")))
    sha = {f"{new}_sha256": F.sha2(F.col(old).cast("binary"), 256) for new, old in (("output", "output"), ("restored", "restored"))}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[column.alias(name) for name, column in sha.items()])


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS x,
  CASE WHEN text IS NULL OR text = '' THEN [] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(x, 8 * k + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {100 - fim.PLAIN_SHARE} THEN 'plain'
  WHEN h[4] % 100 < {fim.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_embedding_dedup, op3_license_scan, op4_source_mixing, op5_html_extraction, op6_simhash_dedup, op7_topk_search, op8_best_fit_packing, op9_toxicity, op10_quality, op11_spelling_variants, op12_byte_bpe, op13_fill_in_middle)
}
SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op4_source_mixing": OP4_SQL, "op7_topk_search": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
