"""The queries of this subpackage: thin, over whole tables. Their digest columns come from the operators' own results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import covertree, decontaminate, interpolated_lm, langid, lengths, linededup, mixing, sharding, simhash, toxicity
from textloom.llm.common import in_fold, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(langid.learned_rows()), F.col("text"), F.col("lang"))
    rows = documents.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return langid.with_language(rows, model, F.col("text")).select("doc_id", "held_out", "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    state = materialise(linededup.reference_counts(documents, F.col("text")), "references")
    return linededup.drop_lines(documents.select("doc_id", "text"), state).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("text")
    counted = materialise(lengths.with_tokens(documents, F.col("text")).groupBy("n_tokens").agg(F.count("*").alias("n")), "lengths")
    return lengths.histogram(counted, weight="n")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(documents, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), toxicity.learned_rows())
    scored = toxicity.with_score(documents, model, F.col("text"), "score")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_sharding, op3_line_dedup, op4_token_counts, op5_lm_scoring, op6_mixing, op7_decontamination, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same results in DuckDB's SQL. The others need CRC-32, XXH64, tokenizers, compression or learning, which it lacks.
ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.k IS NULL), '')) AS kept_sha256 FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY r, doc_id""",
    "op6_mixing": r"""WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS rnd FROM documents),
sized AS (SELECT source, sum(size) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM docs GROUP BY source),
steps AS (SELECT (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER before, 0)) / sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit, 2.0 * n / w AS ratio FROM sized WINDOW before AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, CAST(n AS BIGINT) AS n, CAST(least((SELECT arg_min(unit, ratio) FROM steps WHERE unit <= ratio) * w, 2.0 * n) AS DOUBLE) AS target FROM sized),
placed AS (SELECT d.*, g.n, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY rnd, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start, CASE WHEN g.n > 0 THEN floor(floor(target) / g.n) ELSE 0 END AS whole FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target, CAST(whole * size + greatest(0, least(size, floor(target) - whole * n - start)) AS BIGINT) AS taken FROM placed""",
    "op7_decontamination": f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOW)} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format(LOW)} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT item, w, least(8, len(w)) AS s, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM items WHERE len(w) > 0)),
found AS (SELECT DISTINCT r, i, s, item FROM (SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM docs, (SELECT DISTINCT s FROM windows))) JOIN windows USING (s, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM found) GROUP BY r), held AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)""",
    "op8_embedding_near_dedup": """WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT r, vec_id, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM vectors WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT r, r AS o FROM vectors UNION SELECT reach.r, y FROM reach JOIN links ON o = x),
least AS (SELECT reach.r, min(vec_id) AS c FROM reach JOIN vectors ON o = vectors.r GROUP BY reach.r), degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept FROM vectors JOIN least USING (r) LEFT JOIN degrees ON r = x""",
}
