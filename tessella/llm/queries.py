"""The queries of the training-data operators over the tables of a folder, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import embed_dedup, exact, hard_negatives, langid, mixing, ngram_join, packing, periodic, pii, quality, secrets, substring, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str, n: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(_fold("doc_id", 4) != 2))
    got = langid.predict_languages(docs, model)
    return got.select(F.col("row_id").alias("doc_id"), (_fold("row_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), str(path), limit=4096).withColumnRenamed("row_id", "doc_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_embeddings(_table(spark, sf_dir, "embeddings"), least=0.93, within="label").withColumnRenamed("row_id", "vec_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return got.select(F.col("row_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = _fold("doc_id", 5) != 0
    model = quality.fit_quality(docs.filter(learn), labels.filter(learn & (F.col("quality") == 1)))
    got = quality.score_quality(docs, model)
    return got.select(
        F.col("row_id").alias("doc_id"), (_fold("row_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    kinds = list(pii.PATTERNS)
    return found.select(
        F.col("row_id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(pii.listed(kinds), 256).alias("base_sha256"),
        pii.listed([*kinds, "term"]).alias("spans"), F.size("term").cast("long").alias("n_term"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_sequences(_table(spark, sf_dir, "documents"), str(path), sequence=1024, end_id=0).withColumnRenamed("row_id", "doc_id")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85).withColumnRenamed("row_id", "doc_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit_secrets(secrets.labelled_samples(docs)))
    base, spans = list(secrets.PATTERNS), F.col("spans")
    count = {k: secrets.number_of(spans, k).alias(f"n_{k}") for k in (*base, secrets.RANDOM)}
    return found.select(
        F.col("row_id").alias("doc_id"), *(count[k] for k in base), F.sha2(secrets.listed(spans, base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"), count[secrets.RANDOM]
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, percent=80)


def repeating_words(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's texts of op13. In a tenth of the documents the words from some place on repeat a stretch that begins there."""
    h, n, g = F.crc32(F.col("doc_id").cast("string")), F.size("w"), F.floor(F.col("h") / 10)
    words = docs.select("doc_id", "text", h.alias("h"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")).filter((F.col("h") % 10 == 0) & (n > 0))
    words = words.select("doc_id", "w", (g % n).cast("int").alias("a"), g.alias("g"))
    words = words.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    stretch = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    repeated = words.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(stretch, F.lit(1), n - F.col("a"))), " ").alias("text"))
    others = docs.filter(F.coalesce(h % 10 != 0, F.lit(True)) | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return others.select("doc_id", "text").unionByName(repeated)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(repeating_words(_table(spark, sf_dir, "documents")))
    # The greatest exact length / period: of two runs, length times the other's period decides.
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.withColumn("best", best).withColumn("lines", lines)
    return found.select(
        F.col("row_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), "collapsed_sha256",
    )


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_token_counts, op3_source_mix, op4_embedding_dedup, op5_substring_dedup, op6_exact_dedup, op7_quality, op8_personal_data, op9_packing, op10_ngram_join,
            op11_secrets, op12_hard_negatives, op13_periodic_runs,
        )
    }


SQL: dict[str, str] = {
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce('s' || source, 'n') AS source_key,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS draw, coalesce(doc_id::VARCHAR, '') AS mark
  FROM documents),
keyed AS (SELECT *, floor(10240000 / (1024 + size))::BIGINT AS shortness FROM sized),
sources AS (SELECT source_key, sum(size)::BIGINT AS source_size, sum(size::HUGEINT * shortness) AS short_words FROM keyed GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (ORDER BY source_key = 'n', source_key) - 1 AS turn FROM sources),
weighted AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM turns),
levels AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (10 // weight), turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY source_size * (10 // weight), turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted),
filled AS (SELECT *, 3 * source_size * open_weight <= weight * (total - capped) AS is_full FROM levels),
rests AS (
  SELECT *, total - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0) AS rest, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS rest_weight
  FROM filled),
targets AS (
  SELECT source_key, source_size, short_words,
         CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / rest_weight::DOUBLE END AS target FROM rests),
plans AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)::DOUBLE)::BIGINT, 0) AS whole, short_words::DOUBLE / nullif(source_size, 0)::DOUBLE AS mean_shortness FROM targets),
lefts AS (SELECT *, target - whole * source_size AS to_sample FROM plans),
chances AS (
  SELECT k.doc_id, k.size, k.mark, k.draw, l.*, to_sample / nullif(l.source_size, 0)::DOUBLE AS f, k.shortness
  FROM keyed k JOIN lefts l USING (source_key)),
tilted AS (SELECT *, f + least(f, 1.0::DOUBLE - f) * 0.5::DOUBLE * ((shortness - mean_shortness) / 10000.0::DOUBLE) AS chance, (draw + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM chances),
ranked AS (
  SELECT *, CASE WHEN to_sample > 0 THEN u * (1.0::DOUBLE - chance) / (u * (1.0::DOUBLE - chance) + (1.0::DOUBLE - u) * chance) END AS rnk FROM tilted),
units AS (SELECT source_key, rnk, mark, size, sum(size) AS words, any_value(to_sample) AS to_sample FROM ranked WHERE rnk IS NOT NULL GROUP BY ALL),
runs AS (SELECT *, sum(words) OVER (PARTITION BY source_key ORDER BY rnk, mark, size) AS upto FROM units),
picked AS (SELECT source_key, rnk, mark, size FROM runs WHERE upto - words / 2.0::DOUBLE <= to_sample)
SELECT r.doc_id, r.size, r.source_size, r.target, ((r.whole + CASE WHEN p.mark IS NULL THEN 0 ELSE 1 END) * r.size)::BIGINT AS taken
FROM ranked r LEFT JOIN picked p ON r.source_key = p.source_key AND r.rnk = p.rnk AND r.mark = p.mark AND r.size = p.size""",
    "op4_embedding_dedup": r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.93::DOUBLE ELSE false END),
reached(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reached JOIN links ON a = v),
named AS (SELECT v, min(c) AS component_id FROM reached GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v = component_id AS kept FROM named LEFT JOIN counted ON a = v""",
    "op5_substring_dedup": r"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
two AS (SELECT *, word || ' ' || lead(word) OVER o AS s2, lead(word, 34) OVER o AS s1 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
four AS (SELECT *, s2 || ' ' || lead(s2, 2) OVER o AS s4, lead(s2, 32) OVER o AS t2 FROM two WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
eight AS (SELECT *, s4 || ' ' || lead(s4, 4) OVER o AS s8 FROM four WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sixteen AS (SELECT *, s8 || ' ' || lead(s8, 8) OVER o AS s16 FROM eight WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, word, s16 || ' ' || lead(s16, 16) OVER o || ' ' || t2 || ' ' || s1 AS s35 FROM sixteen WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, word, CASE WHEN s35 IS NOT NULL AND count(*) OVER (PARTITION BY s35) > 1 THEN i END AS head FROM windows),
covered AS (SELECT doc_id, i, word, coalesce(i - max(head) OVER (PARTITION BY doc_id ORDER BY i) < 35, false) AS gone FROM counted),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS said FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op10_ngram_join": r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM lists),
spans AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS s FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
members AS (
  SELECT DISTINCT doc_id, s FROM spans WHERE s IS NOT NULL
  UNION SELECT doc_id, array_to_string(w, ' ') FROM lists WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM members x JOIN members y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reached(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reached JOIN links ON a = v),
named AS (SELECT v, min(c) AS component_id FROM reached GROUP BY v)
SELECT v AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM named LEFT JOIN sizes ON sizes.doc_id = v""",
    "op12_hard_negatives": r"""
WITH sound AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM sound a JOIN sound r ON a.id % 100 = 0 AND a.id <> r.id AND len(a.e) = len(r.e)),
near AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
windows AS (
  SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM near JOIN scored s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 5""",
    "op6_exact_dedup": r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM plain""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
