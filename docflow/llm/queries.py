"""One query per operator over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collisions, graphs, jaccard, langid, licenses, lm, media, mixing, negatives, packing, pii, ranked, warc
from .common import fold, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    got = warc.read(spark, path)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(_table(spark, sf_dir, "documents")))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), order=3, folds=7, held_out=2)


def op4_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    profiles = langid.learn(docs.where(~held_out))
    got = langid.predict(docs.select("doc_id", "text"), profiles)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def mix_levels() -> tuple[dict, dict]:
    """The query's tree (domain from the source's number, language, source) and its target weights."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    domain = F.concat(F.lit("d"), F.pmod(F.when(number != "", number).otherwise("0").cast("int"), F.lit(4)).cast("string"))
    weights = {
        "domain": F.when(F.col("mix_domain") == "d0", 4.0).otherwise(2.0),
        "lang": F.when(F.col("mix_lang") == "en", 4.0).when(F.col("mix_lang") == "de", 3.0).otherwise(2.0),
    }
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, weights


def op6_mixing_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, weights = mix_levels()
    return mixing.mix(_table(spark, sf_dir, "documents"), levels, share=0.7, weights=weights, max_epochs=3, seed=17, whole_rows=False)


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: Spark renders one from each vector (see ``media.rendered``)."""
    return media.copies(media.rendered(_table(spark, sf_dir, "embeddings")))


def op11_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_pii_contexts": op2_pii_contexts,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_language_profiles": op4_language_profiles,
    "op5_collision_counting": op5_collision_counting,
    "op6_mixing_budgets": op6_mixing_budgets,
    "op7_tiered_packing": op7_tiered_packing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_license_scan": op9_license_scan,
    "op10_media_copies": op10_media_copies,
    "op11_graph_neighbours": op11_graph_neighbours,
    "op12_term_pipeline": op12_term_pipeline,
    "op13_secondary_sort_negatives": op13_secondary_sort_negatives,
}

ORACLES = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
              substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(h, CAST(1 + 5 * g AS INT), 5))::BIGINT >> (15 - 5 * k)) & 31) AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to, true AS intact FROM o""",
    "op5_collision_counting": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach AS (WITH RECURSIVE t(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.id WHERE t.root < l.b) SELECT id, min(root) AS root FROM t GROUP BY id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, root = vec_id AS kept FROM embeddings JOIN reach ON id = vec_id""",
    "op6_mixing_budgets": """
        WITH d AS (SELECT doc_id, 'd' || CAST(CAST(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) <> '' THEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) ELSE '0' END AS INT) % 4 AS VARCHAR) AS mix_domain,
              coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
              CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
        leaf AS (SELECT mix_domain, mix_lang, mix_source, count(*) AS docs, sum(tokens) AS t, CAST(sum(tokens) * 3 AS DOUBLE) AS cap FROM d GROUP BY ALL),
        n1 AS (SELECT mix_domain, sum(cap) AS cap, CASE WHEN mix_domain = 'd0' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
              (SELECT least(sum(t) * 0.7::DOUBLE, sum(cap)) FROM leaf) AS b FROM leaf GROUP BY mix_domain),
        f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, mix_domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= w * (b - coalesce(sum(cap) OVER (ORDER BY cap / w, mix_domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n1),
        g1 AS (SELECT mix_domain, CASE WHEN full_ THEN cap ELSE least(cap, w * (b - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()) END AS b FROM f1),
        n2 AS (SELECT mix_domain, mix_lang, sum(cap) AS cap, CASE mix_lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS w, any_value(b) AS b FROM leaf JOIN g1 USING (mix_domain) GROUP BY mix_domain, mix_lang),
        f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY mix_domain ORDER BY cap / w, mix_lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= w * (b - coalesce(sum(cap) OVER (PARTITION BY mix_domain ORDER BY cap / w, mix_lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n2),
        g2 AS (SELECT mix_domain, mix_lang, CASE WHEN full_ THEN cap ELSE least(cap, w * (b - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY mix_domain)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY mix_domain)) END AS b FROM f2),
        n3 AS (SELECT leaf.*, 1.0::DOUBLE AS w, b FROM leaf JOIN g2 USING (mix_domain, mix_lang)),
        f3 AS (SELECT *, cap * sum(w) OVER (PARTITION BY mix_domain, mix_lang ORDER BY cap / w, mix_source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= w * (b - coalesce(sum(cap) OVER (PARTITION BY mix_domain, mix_lang ORDER BY cap / w, mix_source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n3),
        g3 AS (SELECT mix_domain, mix_lang, mix_source, t, CAST(floor(CASE WHEN full_ THEN cap ELSE least(cap, w * (b - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY mix_domain, mix_lang)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY mix_domain, mix_lang)) END + 1e-6) AS BIGINT) AS leaf_budget FROM f3),
        e AS (SELECT *, CASE WHEN t > 0 THEN leaf_budget // t ELSE 0 END AS epochs FROM g3),
        o AS (SELECT d.*, leaf_budget, epochs, leaf_budget - epochs * t AS rest,
              ('0x' || substr(md5('17:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS place FROM d JOIN e USING (mix_domain, mix_lang, mix_source)),
        c AS (SELECT *, CAST(epochs AS BIGINT) + CASE WHEN rest > 0 AND sum(tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY place, doc_id) <= rest THEN 1 ELSE 0 END AS copies FROM o)
        SELECT doc_id, mix_domain, mix_lang, mix_source, tokens, leaf_budget, copies FROM c WHERE copies > 0""",
    "op8_ngram_jaccard": """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.s) + len(sb.s) - n)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM s),
        reach AS (WITH RECURSIVE t(id, root) AS (SELECT id, root FROM r UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.id WHERE t.root < l.b) SELECT id, min(root) AS root FROM t GROUP BY id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, root AS component_id FROM s JOIN reach ON reach.id = s.doc_id""",
    "op12_term_pipeline": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        g AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM t WHERE len(w) > 0),
        f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f WHERE term IN (SELECT term FROM q) GROUP BY term),
        m AS (SELECT r, doc_id, 100 - 90 + (90 * CAST(len(w) AS BIGINT) * (SELECT n FROM g)) // (SELECT l FROM g) AS m FROM t WHERE len(w) > 0),
        s AS (SELECT q.item_id, f.r, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY q.item_id, f.r),
        o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN m USING (r) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_secondary_sort_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
