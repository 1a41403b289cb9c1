"""The contract queries of the ten operators and of the pipeline."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import best_fit_packing, common, curriculum_mix, language_id, maxscore_topk, nn_descent, pii_semicrf, quote_threads, residue_whitening, simhash_gray, sst_shards, suffix_pieces, toxicity_mil, vantage_codes

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.conversations(common.table(spark, sf_dir, "conversations"))


def op3_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coded = suffix_pieces.coded(docs, model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def fold(n: int):
    """The remainder by which the contracts hold documents out; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(4) != 2).select("text", "lang"))
    return language_id.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity_mil.InstanceModel:
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity_mil.fit(docs.where(fold(5) != 0), marks)


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    return toxicity_mil.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    parts = best_fit_packing.pieces(docs, public_tokenizers.path(WORDS)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return best_fit_packing.pack(common.keep(parts, "pieces"))


def op7_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maxscore_topk.quantised(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = common.keep(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    return maxscore_topk.top_k(rows, rows.where("id % 50 = 0"))


def op8_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    manifest = sst_shards.write_shards(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORDS))
    return sst_shards.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = pii_semicrf.find(docs, pii_semicrf.fit(docs), "found")
    listed = lambda name: F.array_join(F.transform(F.col(f"found.{name}"), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(F.col("found.base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii_semicrf.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op11_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = residue_whitening.fit(rows)
    explained = [float(e / model.trace) if model.trace else None for e in model.variances]
    each = F.posexplode(F.arrays_zip(F.col("whitening.whitened").alias("whitened"), F.array(*(F.lit(e).cast("double") for e in explained)).cast("array<double>").alias("explained"))).alias("place", "of")
    white = residue_whitening.whiten(rows, model).select("vec_id", F.col("whitening.deviation").alias("deviation"), each)
    return white.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("of.whitened").alias("whitened"),
        F.col("of.explained").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_vantage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vantage_codes.codebooks(rows)
    coded = vantage_codes.encode(rows, books).select("vec_id", "label", F.lower(F.hex("coded.entries")).alias("code"), F.col("coded.error").alias("error"))
    summed = vantage_codes.labelled(common.keep(coded, "codes"))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vantage_codes.digest(books)).alias("codebooks_sha256"))


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum_mix.mixed(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    at = lambda i: F.get("takes", F.lit(i))["position"]
    rows = mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), at(0).alias("position"), at(1).alias("repeat_position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _codes_sql() -> str:
    """The codebooks' rounds one after the other, each part compared with every entry."""
    kept = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE {kept})",
        "w AS (SELECT (max(len(embedding)) + 3) // 4 AS w FROM v)",
        "x AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, coalesce(floor(1024 * embedding[i + 1]::DOUBLE), 0)::BIGINT AS x FROM (SELECT r, embedding, w, unnest(range(4 * w)) AS i FROM v, w))",
        "b0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM x WHERE r < 256)",
    ]
    for k in range(5):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, min(256 * d + entry) AS m FROM (SELECT x.r, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS d FROM x JOIN b{k} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)")
        if k < 4:
            means = f"(SELECT x.part, m % 256 AS entry, pos, floor(sum(x) / count(*))::BIGINT AS mean FROM x JOIN a{k} USING (r, part) GROUP BY ALL)"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(mean, x) AS x FROM b{k} LEFT JOIN {means} USING (part, entry, pos))")
    steps.append("c AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY r)")
    hashed = "(SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4)"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {hashed} AS codebooks_sha256 FROM v JOIN c USING (r)"


#: Ops 2 and 7 over all pairs, which DuckDB does for some thousand vectors.
ORACLE = {
    "op2_nn_descent": """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS component_id, (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) = v.vec_id AS kept, 1::DOUBLE AS recall FROM v""",
    "op7_maxscore_topk": """WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5""",
    "op12_vantage_codes": _codes_sql(),
    "op13_curriculum_mix": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][turn]::DOUBLE AS weight, [0.5, 1, 1.5][turn]::DOUBLE AS a, [1.5, 1, 0.5][turn]::DOUBLE AS b FROM s),
o AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, a, b, least(cap::DOUBLE, (SELECT min_by(level, cap / weight) FROM o WHERE cap >= level * weight) * weight) AS target FROM w),
p AS (SELECT d.*, t.source_size, t.target, a, b, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - first)) AS once, greatest(0, least(size, floor(target)::BIGINT - source_size - first)) AS again, first / target AS y, (source_size + first) / target AS z FROM p)
SELECT doc_id, size, source_size, target, (once + again)::BIGINT AS taken,
CASE WHEN once > 0 THEN least(1, 2 * y / (a + sqrt(greatest(0, a * a + 2 * (b - a) * y)))) END AS position,
CASE WHEN again > 0 THEN least(1, 2 * z / (a + sqrt(greatest(0, a * a + 2 * (b - a) * z)))) END AS repeat_position FROM k""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
