"""Queries over topics, themes and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callweave.catalog import density_sql, inputs
from callweave.catalog.transcript_queries import STOPWORDS, _tokens
from callweave.functions import text, vectors
from callweave.operators import density, hierarchy, neighbors, scan, spectral, vector_index
from callweave.plans import store, themes, topics, upstream
from callweave.session import drop_at_exit, scratch_dir


LETTERS = "héüó"


def _points(spark, folder):
    """Vectors as sentences of eleven firms; label 0 plays the noise topic -1."""
    return inputs.table(spark, folder, "embeddings").select(
        "vec_id", "embedding", (F.col("label") - 1).cast("int").alias("topic_id"), (F.col("vec_id") % 11).alias("firm_id"),
        F.abs(F.col("embedding")[0].cast("double")).alias("probability"),
    )


def topic_members(spark, folder):
    rows = topics.topic_members(_points(spark, folder), ["firm_id"], "topic_id", "vec_id", "probability", "vec_id")
    ids = F.array_join(F.transform("members", lambda m: m.cast("string")), ",")
    return rows.select("firm_id", "topic_id", "part", "size", ids.alias("members"))


def topics_per_firm_stats(spark, folder):
    per_firm = _points(spark, folder).groupBy("firm_id").agg(F.count_distinct("topic_id").alias("n"))
    return per_firm.agg(
        F.round(F.avg("n"), 6).alias("mean_topics"), F.round(F.stddev_samp("n"), 6).alias("std_topics"),
        F.min("n").alias("min_topics"), F.max("n").alias("max_topics"),
    )


def topic_centroids(spark, folder):
    rows = topics.centroids(_points(spark, folder), ["firm_id"])
    return rows.select("firm_id", "topic_id", F.posexplode("centroid").alias("place", "x")).select(
        "firm_id", "topic_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x")
    )


def nearest_centroid(spark, folder):
    rows = topics.nearest_topics(_points(spark, folder), ["firm_id"])
    return rows.select("vec_id", "topic_id", "assigned_topic", F.round("similarity", 6).alias("similarity"))


def topic_distribution(spark, folder):
    rows = topics.topic_shares(_points(spark, folder), [])
    pairs = F.arrays_zip(F.col("topics").alias("topic"), F.col("probabilities").alias("share"))
    return rows.select("vec_id", F.inline(pairs)).select("vec_id", "topic", F.round("share", 6).alias("share"))


def similar_topics(spark, folder):
    """Rows nearest to the mean vector of the whole table."""
    points = _points(spark, folder)
    center = topics.centroids(points.withColumn("topic_id", F.lit(0)), []).select("centroid").scalar()
    found = store.similar(points, center, 10, "vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def cosine_pairs(spark, folder):
    """Similarity and distance of every vector to its topic's centroid."""
    points = _points(spark, folder)
    joined = points.join(topics.centroids(points, []), "topic_id")
    return joined.select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"),
        F.round(vectors.cosine_distance(F.col("embedding"), F.col("centroid")), 6).alias("distance"),
        vectors.has_dimension(F.col("embedding"), 64).alias("right_size"),
    )


def neighbors_per_topic(spark, folder):
    """The five vectors nearest to each topic centroid, over the whole table."""
    points = _points(spark, folder)
    queries = topics.centroids(points, [])
    found = neighbors.nearest(
        queries.withColumnRenamed("centroid", "embedding"), points, 5, "topic_id", "vec_id"
    )
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def _index(spark, folder):
    """Index over all vectors; it goes when the application ends."""
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    vector_index.build(inputs.table(spark, folder, "embeddings"), path, "vec_id")
    return path


def approximate_neighbors(spark, folder):
    """The ten vectors nearest to every fiftieth one, from the index with its usual probes."""
    asked = inputs.table(spark, folder, "embeddings").filter("vec_id % 50 = 0")
    found = vector_index.search(asked, _index(spark, folder), 10, "vec_id")
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def index_neighbors(spark, folder):
    """The five vectors nearest to each topic centroid, from the index with all lists probed, which is exact."""
    centers = topics.centroids(_points(spark, folder), []).withColumnRenamed("centroid", "embedding")
    rows = inputs.table(spark, folder, "embeddings").count()
    found = vector_index.search(centers, _index(spark, folder), 5, "topic_id", probes=vector_index.MOST_LISTS, rerank=rows)
    return found.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


def _words(spark, folder):
    return inputs.texts(spark, folder, "documents").select("lang", text.content_tokens(F.col("text"), STOPWORDS).alias("words"))


def _weights(spark, folder):
    counts = topics.term_counts(_words(spark, folder), ["lang"], F.col("words"), 1, 2, min_df=2)
    return topics.class_tfidf(counts, ["lang"])


def ctfidf_keywords(spark, folder):
    top = topics.top_terms(_weights(spark, folder), ["lang"], 10)
    return top.select("lang", "term", "tf", "rank", F.round("weight", 4).alias("weight"))


def keyword_lists(spark, folder):
    top = topics.top_terms(_weights(spark, folder), ["lang"], 10)
    return topics.keyword_lists(top, ["lang"]).select("lang", F.array_join("keywords", "|").alias("keywords"))


def topic_labels(spark, folder):
    """Labels from two keyword lists: first three of each, distinct, at most eight."""
    weights = _weights(spark, folder)
    by_weight = topics.keyword_lists(topics.top_terms(weights, ["lang"], 10), ["lang"], "heavy")
    by_count = topics.keyword_lists(scan.top_k(weights, ["lang"], [F.desc("tf"), F.desc("term")], 10), ["lang"], "frequent")
    both = by_weight.join(by_count, "lang")
    name = topics.label([F.col("heavy"), F.col("frequent")], F.concat(F.lit("Topic "), F.col("lang")))
    return both.select("lang", name.alias("label"))


def window_distribution(spark, folder):
    """Shares of the languages as topics in every document, from windows of four words."""
    words = text.content_tokens(F.col("text"), STOPWORDS)
    rows = topics.window_shares(inputs.texts(spark, folder, "documents"), "doc_id", words, _weights(spark, folder), topic="lang")
    return rows.select("doc_id", "lang", F.round("share", 5).alias("share"))


def _candidates(spark, folder):
    top = topics.top_terms(_weights(spark, folder), ["lang"], 30)
    embedded = topics.hashed_embeddings(_words(spark, folder).withColumn("topic_id", F.lit(0)), F.col("words"))
    centers = topics.centroids(embedded, ["lang"]).select("lang", "centroid")
    return topics.similar_terms(top, centers, ["lang"])


def similar_keywords(spark, folder):
    return _candidates(spark, folder).select("lang", "term", "rank", F.round("similarity", 6).alias("similarity"))


def diverse_keywords(spark, folder):
    return topics.diverse_terms(_candidates(spark, folder), ["lang"]).select("lang", F.array_join("terms", "|").alias("terms"))


def hashed_embeddings(spark, folder):
    docs = inputs.texts(spark, folder, "conversations").select("conv_id", "turn", "text")
    found = topics.hashed_embeddings(docs, text.content_tokens(F.col("text"), STOPWORDS), 32)
    spread = found.select("conv_id", "turn", F.posexplode_outer("embedding").alias("place", "x"))  # never empty
    return spread.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("x"))


def _letter_shares(spark, folder):
    """Documents by the shares of four letters, which their languages use differently."""
    size = F.length("text")
    shares = [(size - F.length(F.replace("text", F.lit(c), F.lit("")))) / size for c in LETTERS]
    docs = inputs.texts(spark, folder, "documents").filter("text <> ''")
    return docs.select("doc_id", (F.col("doc_id") % 3).alias("firm_id"), F.array(*shares).alias("shares"))


def density_clusters(spark, folder):
    """Clusters of the documents of each of three firms, last splits."""
    points = _letter_shares(spark, folder)
    return density.density_clusters(points, ["firm_id"], "doc_id", "shares", 4, min_cluster_size=6, min_samples=2)


def density_themes(spark, folder):
    """Clusters of all documents together, most mass."""
    points = _letter_shares(spark, folder)
    return density.density_clusters(points, [], "doc_id", "shares", 4, min_cluster_size=20, min_samples=6, selection="eom")


def tree_clusters(spark, folder):
    """Clusters of all vectors of each of eleven firms in all 64 dimensions, most mass."""
    found = hierarchy.tree_clusters(_points(spark, folder), ["firm_id"], "vec_id", "embedding", 5, 2, "eom")
    return found.select("firm_id", "vec_id", "cluster")


def spectral_layout(spark, folder):
    """Two coordinates of every vector inside its firm."""
    found = spectral.layout(_points(spark, folder), ["firm_id"], "vec_id", "embedding", 2)
    return found.select("firm_id", "vec_id", F.round(F.col("reduced")[0], 4).alias("x"), F.round(F.col("reduced")[1], 4).alias("y"))


def topic_model(spark, folder):
    """Topics of all turns, the roles as firms: embedded, laid out, clustered, reassigned and described."""
    turns = inputs.texts(spark, folder, "conversations").select(
        F.col("role").alias("firm_id"), F.concat_ws(":", "conv_id", "turn").alias("sentence_id"), F.col("text").alias("raw_text"),
        F.array_join(text.content_tokens(F.col("text"), STOPWORDS), " ").alias("cleaned_text"), F.col("turn").alias("position"),
    )
    _, described = upstream.model_topics(turns)
    return described.select("firm_id", "topic_id", "size", "representation", F.array_join("keywords", "|").alias("keywords"))


def _assigned(spark, folder):
    """Orders as topics: customers as themes, priorities as firms."""
    return inputs.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("theme"), F.col("o_orderpriority").alias("firm_id"), F.col("o_orderkey").alias("topic_id"),
        F.col("o_orderstatus").alias("representation"), F.col("o_orderstatus").alias("summary"), F.lit(1).alias("size"),
    )


def theme_groups(spark, folder):
    rows = themes.theme_groups(_assigned(spark, folder))
    return rows.select("theme", "n_topics", "n_firms", F.round("dominance", 6).alias("dominance"))


def theme_validation(spark, folder):
    rows = themes.valid_themes(themes.theme_groups(_assigned(spark, folder)))
    return rows.select("theme", "n_topics", "n_firms", F.round("dominance", 6).alias("dominance"))


def theme_ids(spark, folder):
    rows = themes.aggregate_themes(_assigned(spark, folder), F.lit("2024-03-01").cast("date"))
    return rows.select("theme", "ordinal", "theme_id")


def theme_topics(spark, folder):
    assigned = _assigned(spark, folder)
    rows = themes.theme_topics(assigned, themes.valid_themes(themes.theme_groups(assigned)))
    listed = F.transform("topics", lambda t: F.concat_ws(":", t["firm_id"], t["topic_id"].cast("string"), t["summary"]))
    return rows.select("theme", "part", F.array_join(listed, ",").alias("topics"))


def topic_documents(spark, folder):
    d = inputs.table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit("")).when(F.col("lang") == "de", F.col("source")).alias("summary"),
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("lang")).alias("representation"),
    )
    return themes.topic_documents(d).select("doc_id", "document", "representation")


def theme_heatmap(spark, folder):
    """Vectors per firm and topic, absent cells 0; the topics are those that the data have."""
    points = _points(spark, folder)
    counts = points.groupBy("firm_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.collect_set("topic_id")).scalar()
    cells = points.select("firm_id").distinct().select("firm_id", F.explode(found).alias("topic_id"))
    return cells.join(counts, ["firm_id", "topic_id"], "left").select("firm_id", "topic_id", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_members, topics_per_firm_stats, topic_centroids, nearest_centroid, topic_distribution, similar_topics,
        cosine_pairs, neighbors_per_topic, approximate_neighbors, index_neighbors, ctfidf_keywords, keyword_lists, topic_labels, similar_keywords, window_distribution,
        diverse_keywords, hashed_embeddings, density_clusters, density_themes, tree_clusters,
        spectral_layout, topic_model, theme_groups, theme_validation, theme_ids,
        theme_topics, topic_documents, theme_heatmap,
    )
}

_POINTS = """points AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label - 1 AS topic_id, vec_id % 11 AS firm_id,
           abs(CAST(embedding[1] AS DOUBLE)) AS probability FROM embeddings),
    cells AS (SELECT vec_id, topic_id, firm_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM points)"""


def _centers(keys: str) -> str:
    """Mean vectors per key as lists."""
    return f"""centers AS (
        SELECT {keys}, list(x ORDER BY i) AS c FROM (
            SELECT {keys}, i, avg(x) AS x FROM cells WHERE topic_id <> -1 GROUP BY {keys}, i) GROUP BY {keys})"""


_GRAMS = f"""words AS (SELECT lang, {_tokens("text")} AS w FROM documents),
    grams AS (
        SELECT lang, unnest(w) AS term FROM words
        UNION ALL
        SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
    counted AS (SELECT lang, term, count(*) AS tf FROM grams GROUP BY 1, 2),
    common AS (SELECT term FROM counted GROUP BY 1 HAVING count(*) >= 2),
    kept AS (SELECT lang, term, tf FROM counted WHERE term IN (SELECT term FROM common)),
    weights AS (
        SELECT lang, k.term, tf, tf * ln(1 + (SELECT avg(n) FROM (SELECT sum(tf) AS n FROM kept GROUP BY lang)) / f) AS weight
        FROM kept k JOIN (SELECT term, sum(tf)::DOUBLE AS f FROM kept GROUP BY 1) t ON k.term = t.term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM weights)"""
_THEMES = """per_firm AS (SELECT o_custkey AS theme, o_orderpriority AS firm, count(*) AS n FROM orders GROUP BY 1, 2),
    groups AS (
        SELECT theme, CAST(sum(n) AS BIGINT) AS n_topics, count(*) AS n_firms, max(n)::DOUBLE / sum(n) AS dominance
        FROM per_firm GROUP BY 1),
    valid AS (SELECT * FROM groups WHERE n_firms >= 2 AND dominance <= 0.4)"""

_SHARES = "SELECT doc_id AS id, doc_id % 3 AS firm_id, [" + ", ".join(
    f"(length(text) - length(replace(text, '{c}', ''))) / length(text)" for c in LETTERS
) + "] AS v FROM documents WHERE text <> ''"



def _hashed(words: str, size: int) -> str:
    """SQL for the hashed counts of a word list."""
    places = f"[CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {size} for w in {words}]"
    return f"[CAST(len([p for p in {places} if p = i]) AS DOUBLE) for i in range(0, {size})]"


def _unit(counts: str) -> str:
    return f"[CAST(CASE WHEN list_sum({counts}) = 0 THEN 0 ELSE x / sqrt(list_dot_product({counts}, {counts})) END AS FLOAT) for x in {counts}]"


_NEAR = f"""{_GRAMS},
        vectors AS (SELECT lang, {_unit("c")} AS v FROM (SELECT lang, {_hashed("w", 64)} AS c FROM words)),
        center AS (
            SELECT lang, list(x ORDER BY i) AS m FROM (
                SELECT lang, i, avg(x) AS x FROM (
                    SELECT lang, CAST(unnest(v) AS DOUBLE) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY lang, i) GROUP BY lang),
        terms AS (
            SELECT lang, term, [CAST(x AS DOUBLE) for x in {_unit("c")}] AS v
            FROM (SELECT lang, term, {_hashed("string_split(term, ' ')", 64)} AS c FROM ranked WHERE rank <= 30)),
        alike AS (SELECT lang, term, v, coalesce(list_cosine_similarity(v, m), 0) AS similarity FROM terms JOIN center USING (lang)),
        near AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY similarity DESC, term) AS rank FROM alike)"""


def _greedy(k: int, diversity: float) -> str:
    """CTEs that take one term after the other: similar to the centre, unlike those taken."""
    steps = ["chosen1 AS (SELECT lang, term, v, 1 AS step FROM near QUALIFY row_number() OVER (PARTITION BY lang ORDER BY similarity DESC, rank) = 1)"]
    for i in range(2, k + 1):
        steps.append(f"""open{i} AS (
            SELECT n.lang, n.term, any_value(n.v) AS v, any_value(rank) AS rank,
                   {1 - diversity} * any_value(similarity) - {diversity} * max(coalesce(list_cosine_similarity(n.v, c.v), 0)) AS score
            FROM near n JOIN chosen{i - 1} c ON n.lang = c.lang GROUP BY n.lang, n.term HAVING count(*) FILTER (c.term = n.term) = 0),
        chosen{i} AS (
            SELECT * FROM chosen{i - 1} UNION ALL
            SELECT lang, term, v, {i} FROM (
                SELECT * FROM open{i} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, rank) = 1))""")
    return ",\n        ".join(steps)


ORACLE = {
    "topic_members": f"""
        WITH {_POINTS}
        SELECT firm_id, topic_id, 0::BIGINT AS part, count(*) AS size,
               string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY probability DESC, vec_id) AS members
        FROM points GROUP BY 1, 2""",
    "topics_per_firm_stats": f"""
        WITH {_POINTS}, n AS (SELECT firm_id, count(DISTINCT topic_id) AS n FROM points GROUP BY 1)
        SELECT round(avg(n), 6) AS mean_topics, round(stddev_samp(n), 6) AS std_topics, min(n) AS min_topics, max(n) AS max_topics FROM n""",
    "topic_centroids": f"""
        WITH {_POINTS}
        SELECT firm_id, topic_id, i - 1 AS place, round(avg(x), 6) AS x FROM cells WHERE topic_id <> -1 GROUP BY 1, 2, 3""",
    "nearest_centroid": f"""
        WITH {_POINTS}, {_centers("firm_id, topic_id")},
        best AS (
            SELECT p.vec_id, p.topic_id, c.topic_id AS near, list_cosine_similarity(p.v, c.c) AS sim
            FROM points p JOIN centers c ON p.firm_id = c.firm_id
            QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY sim DESC, c.topic_id) = 1)
        SELECT vec_id, topic_id, CASE WHEN topic_id = -1 THEN near ELSE topic_id END AS assigned_topic, round(sim, 6) AS similarity FROM best""",
    "topic_distribution": f"""
        WITH {_POINTS}, {_centers("topic_id")},
        sims AS (
            SELECT vec_id, c.topic_id AS topic, greatest(list_cosine_similarity(v, c), 0) AS s FROM points, centers c)
        SELECT vec_id, topic, round(CASE WHEN sum(s) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE s / sum(s) OVER w END, 6) AS share
        FROM sims WINDOW w AS (PARTITION BY vec_id)""",
    "similar_topics": f"""
        WITH {_POINTS}, center AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM cells GROUP BY i))
        SELECT vec_id, round(list_cosine_similarity(v, (SELECT c FROM center)), 6) AS similarity FROM points
        ORDER BY list_cosine_similarity(v, (SELECT c FROM center)) DESC, vec_id LIMIT 10""",
    "cosine_pairs": f"""
        WITH {_POINTS}, {_centers("topic_id")}
        SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS similarity, round(1 - list_cosine_similarity(v, c), 6) AS distance,
               len(v) = 64 AS right_size
        FROM points JOIN centers USING (topic_id)""",
    "neighbors_per_topic": f"""
        WITH {_POINTS}, {_centers("topic_id")}
        SELECT * FROM (
            SELECT CAST(c.topic_id AS BIGINT) AS query_id, vec_id AS item_id,
                   row_number() OVER (PARTITION BY c.topic_id ORDER BY list_cosine_similarity(v, c) DESC, vec_id) AS rank,
                   round(list_cosine_similarity(v, c), 6) AS similarity
            FROM points, centers c)
        WHERE rank <= 5""",
    "index_neighbors": f"""
        WITH {_POINTS}, {_centers("topic_id")}
        SELECT CAST(c.topic_id AS BIGINT) AS query_id, vec_id AS item_id,
               row_number() OVER (PARTITION BY c.topic_id ORDER BY list_cosine_similarity(v, c) DESC, vec_id) AS rank,
               round(list_cosine_similarity(v, c), 6) AS similarity
        FROM points, centers c QUALIFY rank <= 5""",
    "ctfidf_keywords": f"WITH {_GRAMS} SELECT lang, term, tf, rank, round(weight, 4) AS weight FROM ranked WHERE rank <= 10",
    "keyword_lists": f"WITH {_GRAMS} SELECT lang, string_agg(term, '|' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 10 GROUP BY 1",
    "topic_labels": f"""
        WITH {_GRAMS},
        places AS (
            SELECT lang, term, rank AS place FROM ranked WHERE rank <= 3
            UNION ALL
            SELECT lang, term, 10 + row_number() OVER (PARTITION BY lang ORDER BY tf DESC, term DESC) FROM ranked
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY tf DESC, term DESC) <= 3)
        SELECT lang, string_agg(term, ', ' ORDER BY place) AS label
        FROM (SELECT lang, term, min(place) AS place FROM places GROUP BY 1, 2) GROUP BY 1""",
    "window_distribution": f"""
        WITH {_GRAMS},
        docs AS (SELECT doc_id, {_tokens("text")} AS w FROM documents),
        cuts AS (
            SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS spot, w FROM docs),
        pieces AS (SELECT doc_id, spot, w[spot:spot + 3] AS c FROM cuts),
        terms AS (
            SELECT doc_id, spot, unnest(c) AS term FROM pieces
            UNION ALL
            SELECT doc_id, spot, unnest(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) FROM pieces),
        idf AS (SELECT term, max(weight / tf) AS idf FROM weights GROUP BY 1),
        bags AS (SELECT doc_id, spot, term, count(*) * any_value(idf) AS x FROM terms JOIN idf USING (term) GROUP BY 1, 2, 3),
        lengths AS (SELECT doc_id, spot, sqrt(sum(x * x)) AS l FROM bags GROUP BY 1, 2),
        units AS (SELECT lang, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY lang)) AS u FROM weights),
        sims AS (
            SELECT doc_id, spot, lang, sum(x * u) / any_value(l) AS s
            FROM bags JOIN units USING (term) JOIN lengths USING (doc_id, spot) GROUP BY 1, 2, 3 HAVING sum(x * u) / any_value(l) >= 0.1),
        sums AS (SELECT doc_id, lang, sum(s) AS s FROM sims GROUP BY 1, 2),
        cells AS (
            SELECT doc_id, lang, coalesce(s, 0) AS s
            FROM docs CROSS JOIN (SELECT DISTINCT lang FROM weights) LEFT JOIN sums USING (doc_id, lang))
        SELECT doc_id, lang, round(CASE WHEN sum(s) OVER d > 0 THEN s / sum(s) OVER d ELSE 1.0 / count(*) OVER d END, 5) AS share
        FROM cells WINDOW d AS (PARTITION BY doc_id)""",
    "density_clusters": density_sql.clusters(_SHARES, "firm_id", 4, 6, 2, "leaf", "k AS firm_id, id AS doc_id"),
    "density_themes": density_sql.clusters(_SHARES, "0", 4, 20, 6, "eom", "id AS doc_id"),
    "hashed_embeddings": f"""
        WITH w AS (SELECT conv_id, turn, {_tokens("text")} AS w FROM conversations),
        counts AS (SELECT conv_id, turn, {_hashed("w", 32)} AS c FROM w)
        SELECT conv_id, turn, unnest(range(0, 32)) AS place, round(CAST(unnest({_unit("c")}) AS DOUBLE), 5) AS x FROM counts""",
    "similar_keywords": f"WITH {_NEAR} SELECT lang, term, rank, round(similarity, 6) AS similarity FROM near",
    "diverse_keywords": f"""
        WITH {_NEAR}, {_greedy(10, 0.3)}
        SELECT lang, string_agg(term, '|' ORDER BY step) AS terms FROM chosen10 GROUP BY lang""",
    "theme_groups": f"WITH {_THEMES} SELECT theme, n_topics, n_firms, round(dominance, 6) AS dominance FROM groups",
    "theme_validation": f"WITH {_THEMES} SELECT theme, n_topics, n_firms, round(dominance, 6) AS dominance FROM valid",
    "theme_ids": f"""
        WITH {_THEMES}, placed AS (SELECT theme, row_number() OVER (ORDER BY n_topics DESC, theme) - 1 AS ordinal FROM valid)
        SELECT theme, ordinal, 'theme_20240301_' || printf('%03d', ordinal) AS theme_id FROM placed""",
    "theme_topics": f"""
        WITH {_THEMES}
        SELECT o_custkey AS theme, 0::BIGINT AS part,
               string_agg(o_orderpriority || ':' || o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderpriority, o_orderkey) AS topics
        FROM orders WHERE o_custkey IN (SELECT theme FROM valid) GROUP BY 1""",
    "topic_documents": """
        SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN source END, CASE WHEN lang = 'fr' THEN '' ELSE lang END) AS document,
               CASE WHEN lang = 'fr' THEN '' ELSE lang END AS representation
        FROM documents WHERE lang <> 'fr'""",
    "theme_heatmap": f"""
        WITH {_POINTS}
        SELECT firm_id, topic_id, count(vec_id) AS n
        FROM (SELECT DISTINCT firm_id FROM points) CROSS JOIN (SELECT DISTINCT topic_id FROM points)
        LEFT JOIN points USING (firm_id, topic_id) GROUP BY 1, 2""",
}
