"""Registered queries for vectors and schema matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profile, similar_pairs, similarity
from plumbline.plans.registry import query, table


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The mean of all vectors with label 3: one short row, used as the question's vector."""
    parts = table(spark, sf_dir, "embeddings").filter("label = 3").select(F.posexplode("embedding"))
    means = parts.groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    return [r["m"] for r in means.orderBy("pos").collect()]


_PROBE = """
    SELECT list(m ORDER BY i) AS v FROM (
      SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
        FROM embeddings WHERE label = 3) GROUP BY i)
"""
_SCORED = f"""
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, ({_PROBE}) p
"""


@query("vector_relevance", f"SELECT vec_id, greatest(0.0::DOUBLE, similarity) AS relevance FROM ({_SCORED})")
def vector_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = similarity.relevance(table(spark, sf_dir, "embeddings"), "embedding", _probe(spark, sf_dir))
    return scored.select("vec_id", F.round("relevance", 6).alias("relevance"))


@query(
    "vector_find_similar",
    f"SELECT vec_id, similarity FROM ({_SCORED}) WHERE similarity >= 0.25 ORDER BY similarity DESC, vec_id LIMIT 1",
)
def vector_find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.find_similar(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _probe(spark, sf_dir), threshold=0.25
    )
    return best.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "vector_knn",
    """
    WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (
      SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i,
        unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) GROUP BY label),
    s AS (SELECT c.label AS query_id, vec_id AS base_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s
          FROM c, embeddings)
    SELECT query_id, base_id, round(s, 6) AS similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, base_id)::INTEGER AS place
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, base_id) <= 5
    """,
)
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to the centre of every label."""
    base = table(spark, sf_dir, "embeddings")
    parts = base.select("label", F.posexplode("embedding"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    # one entry per dimension is gathered per label
    centres = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("v")
    )
    found = similarity.knn(centres, "label", "v", base, "vec_id", "embedding", 5)
    return found.withColumn("similarity", F.round("similarity", 6))


def _user_columns(events: DataFrame) -> DataFrame:
    """Each user stands for a dataset whose columns are the event types seen, by weekday and size of value."""
    kind = F.when(F.col("value") < 20, "metric").otherwise("currency")
    return events.select(
        F.col("user_id").alias("dataset"),
        F.concat("event_type", F.lit("_"), F.weekday("ts")).alias("name"),
        kind.alias("semantic"),
    )


_TEXTS = """
    SELECT dataset, string_agg(part, ' ' ORDER BY part) AS schema_text FROM (
      SELECT DISTINCT user_id AS dataset, event_type || '_' || (isodow(ts) - 1) || ':'
        || CASE WHEN value < 20 THEN 'metric' ELSE 'currency' END AS part FROM events) GROUP BY 1
"""


@query(
    "schema_vectors",
    f"""
    WITH t AS ({_TEXTS}),
    h AS (SELECT dataset, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot
          FROM (SELECT dataset, unnest(string_split(schema_text, ' ')) AS w FROM t)),
    c AS (SELECT dataset, slot, count(*) AS n FROM h GROUP BY 1, 2),
    l AS (SELECT dataset, sqrt(sum(n * n)) AS len FROM c GROUP BY 1)
    SELECT c.dataset, t.schema_text, c.slot::INTEGER AS slot, round(n / len, 6) AS weight
    FROM c JOIN l ON c.dataset = l.dataset JOIN t ON c.dataset = t.dataset
    """,
)
def schema_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = similarity.schema_vectors(_user_columns(table(spark, sf_dir, "events")), "dataset", "name", "semantic")
    long = vectors.select("dataset", "schema_text", F.posexplode("vector").alias("slot", "weight"))
    return long.filter("weight > 0").withColumn("weight", F.round("weight", 6))


def _parts(name: str, when: str) -> str:
    """Texts, slot counts and vector lengths of the datasets seen in one half of the month."""
    texts = _TEXTS.replace("FROM events)", f"FROM events WHERE {when})")
    return f"""
    {name}_t AS ({texts}),
    {name}_c AS (SELECT dataset, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
                 FROM (SELECT dataset, unnest(string_split(schema_text, ' ')) AS w FROM {name}_t) GROUP BY 1, 2),
    {name}_l AS (SELECT dataset, sqrt(sum(n * n)) AS len FROM {name}_c GROUP BY 1)"""


@query(
    "schema_matches",
    f"""
    WITH {_parts('old', "ts < '2024-01-16'")}, {_parts('new', "ts >= '2024-01-16'")},
    same AS (SELECT f.dataset, min(k.dataset) AS matched FROM new_t f JOIN old_t k ON f.schema_text = k.schema_text GROUP BY 1),
    sims AS (SELECT a.dataset, b.dataset AS other, round(sum(a.n * b.n) / any_value(la.len * lb.len), 12) AS s
             FROM new_c a JOIN old_c b ON a.slot = b.slot JOIN new_l la ON la.dataset = a.dataset
             JOIN old_l lb ON lb.dataset = b.dataset GROUP BY 1, 2),
    near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY s DESC, other) = 1)
    SELECT f.dataset, CASE WHEN same.matched IS NOT NULL THEN same.matched WHEN near.s >= 0.7 THEN near.other END AS matched,
      CASE WHEN same.matched IS NOT NULL THEN 1.0::DOUBLE WHEN near.s >= 0.7 THEN round(near.s, 6) END AS similarity,
      CASE WHEN same.matched IS NOT NULL THEN 'exact' WHEN near.s >= 0.7 THEN 'similar' ELSE 'none' END AS match_kind
    FROM new_t f LEFT JOIN same ON f.dataset = same.dataset LEFT JOIN near ON f.dataset = near.dataset
    """,
)
def schema_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas seen in the first half of the month are the known ones, those of the second half the newcomers."""
    middle = F.lit("2024-01-16").cast("timestamp_ntz")

    def catalog(events: DataFrame) -> DataFrame:
        columns = _user_columns(events)
        prints = profile.fingerprint_catalog(columns, "dataset", "name", "semantic")
        vectors = similarity.schema_vectors(columns, "dataset", "name", "semantic")
        return vectors.join(prints, "dataset").select("dataset", "fingerprint", "vector")

    events = table(spark, sf_dir, "events")
    matches = similarity.match_schemas(
        catalog(events.filter(F.col("ts") >= middle)), catalog(events.filter(F.col("ts") < middle)), threshold=0.7
    )
    return matches.withColumn("similarity", F.round("similarity", 6))


@query(
    "vector_similar_pairs",
    """
    WITH RECURSIVE v AS (
      SELECT min(vec_id) AS id, count(*) AS n, embedding::DOUBLE[] AS e FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY embedding),
    links AS MATERIALIZED (
      SELECT a.id AS a, b.id AS b, b.n FROM v a JOIN v b ON a.id <> b.id
        AND round(list_cosine_similarity(a.e, b.e), 12) >= 0.92),
    reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    g AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
    s AS (SELECT a, count(*) AS n_links, sum(n)::BIGINT AS linked_rows FROM links GROUP BY a)
    SELECT v.id AS class_id, v.n AS n_rows, coalesce(n_links, 0) AS n_links, coalesce(linked_rows, 0) AS linked_rows, group_id
    FROM v JOIN g ON g.a = v.id LEFT JOIN s ON s.a = v.id
    """,
)
def vector_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs.similar_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
