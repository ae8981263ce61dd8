"""From transcript components to stored topics and themes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import schemas
from callweave.functions import text
from callweave.functions.fixed import CANDIDATE_TERMS
from callweave.operators import hierarchy, spectral
from callweave.plans import sentences as sentence_plan
from callweave.plans import summaries, themes, topics
from callweave.plans.store import Store
from callweave.session import materialize
from callweave.sources.documents import Config

HASHED_SIZE = 64


def _embedded(rows: DataFrame, column: str, encoder: Callable | None, size: int) -> DataFrame:
    if encoder is not None:
        return topics.encoded(rows, column, encoder, size)
    return topics.hashed_embeddings(rows, F.split(column, " "), size)


def model_topics(
    sentences: DataFrame, config: dict | None = None, encoder: Callable | None = None, size: int = HASHED_SIZE
) -> tuple[DataFrame, DataFrame]:
    """Topic of every sentence, and the topics of every firm with keywords and label.

    The reduction is a spectral layout of the neighbour graph, the clusters come from a condensed tree of mutual
    reachability; the settings of cluster size, samples, selection, n-grams and diversity keep their meaning.
    """
    topics.check_backend((config or {}).get("model", "density"))
    settings = topics.merged_config(config)
    grid, words = settings["hdbscan"], settings["vectorizer"]
    embedded = sentences if "embedding" in sentences.columns else _embedded(sentences, "cleaned_text", encoder, size)
    embedded = materialize(embedded)
    dims = min(size, settings["umap"]["n_components"])
    reduced = spectral.layout(embedded, ["firm_id"], "sentence_id", "embedding", dims)
    clusters = hierarchy.tree_clusters(
        reduced, ["firm_id"], "sentence_id", "reduced", grid["min_cluster_size"], grid["min_samples"], grid["cluster_selection_method"]
    )
    raw = embedded.join(clusters.withColumnRenamed("cluster", "topic_id"), ["firm_id", "sentence_id"])
    placed = topics.nearest_topics(raw, ["firm_id"], similarity=False).withColumn("topic_id", F.col("assigned_topic"))
    # stored, as both the centroids and the shares read it
    assigned = materialize(topics.own_shares(materialize(placed.drop("assigned_topic")), ["firm_id"]))
    return assigned, _described(assigned, words, settings["representation"], size if encoder is None else None)


def _described(assigned: DataFrame, words: dict, representation: dict, hashed: int | None) -> DataFrame:
    group = ["firm_id", "topic_id"]
    kept = assigned.filter(F.col("topic_id") != topics.NOISE)
    low, high = words["ngram_range"]
    counts = topics.term_counts(kept, group, F.split("cleaned_text", " "), low, high, words["min_df"], ["firm_id"])
    ranked = materialize(topics.top_terms(topics.class_tfidf(counts, group, ["firm_id"]), group, CANDIDATE_TERMS))
    keywords = topics.keyword_lists(ranked.filter(F.col("rank") <= topics.TOPIC_KEYWORDS), group)
    sources = [F.col("keywords")]
    sized = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    described = sized.join(keywords, group, "left")
    if hashed is not None:
        near = topics.similar_terms(ranked, topics.centroids(kept, ["firm_id"]), group, hashed)
        similar = topics.keyword_lists(near.filter(F.col("rank") <= topics.TOPIC_KEYWORDS), group, "similar")
        diverse = topics.diverse_terms(near, group, diversity=representation["mmr_diversity"])
        described = described.join(similar, group, "left").join(diverse, group, "left")
        sources = [F.col("similar"), F.col("terms")]
    fallback = F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))
    labelled = described.withColumn("representation", topics.label(sources, fallback))
    centers = topics.centroids(kept, ["firm_id"]).withColumnRenamed("centroid", "embedding")
    return labelled.join(centers, group, "left").select(*group, "representation", "keywords", "size", "embedding")


def prompt_sentences(assigned: DataFrame, limit: int = 50) -> DataFrame:
    """The topic's most probable sentences, as many as a prompt takes."""
    from callweave.operators import scan

    group = ["firm_id", "topic_id"]
    kept = assigned.filter(F.col("topic_id") != topics.NOISE).select(*group, "probability", "position", "raw_text")
    best = scan.top_k(kept, group, [F.desc("probability"), F.col("position")], limit)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "raw_text")))
    return best.groupBy(*group).agg(pairs.alias("_p")).select(*group, F.col("_p.raw_text").alias("sentences"))


def process_firms(
    components: DataFrame,
    store: Store,
    batch: str,
    config: Config,
    stopwords: Sequence[str] | None = None,
    encoder: Callable | None = None,
    generate: Callable | None = None,
) -> None:
    """Clean, model and store all firms of the batch that are not stored yet.

    Firms without sentences are stored and marked too, so that they do not come back.
    """
    firms = components.groupBy(F.col("firm_id").alias("company_id")).agg(F.min("firm_name").alias("name"))
    todo = materialize(store.unprocessed(firms.select("company_id")))
    if todo.isEmpty():
        return
    if store.finished(batch):
        raise ValueError(f"batch {batch} is complete; new firms need a new batch name")
    fresh = components.join(todo.withColumnRenamed("company_id", "firm_id"), "firm_id", "left_semi")
    rows = sentence_plan.sentences(fresh, text.default_stopwords() if stopwords is None else stopwords)
    assigned, described = model_topics(materialize(rows), config.firm_model, encoder)
    described = described.withColumn("summary", F.lit(None).cast("string"))
    if generate is not None:
        asked = described.drop("summary").join(prompt_sentences(assigned), ["firm_id", "topic_id"], "left")
        asked = asked.withColumn("prompt", summaries.topic_prompt(F.col("keywords"), F.col("sentences")))
        described = summaries.generated(asked.drop("sentences"), "prompt", generate, "summary", log=f"{store.path}/answers").drop("prompt")
    described = summaries.with_fallback(described, "summary", "representation")
    store.write_firms(
        batch,
        firms.join(todo, "company_id").withColumns(
            {
                "ticker": F.lit(None).cast("string"),
                "quarter": F.lit(None).cast("string"),
                "earnings_call_date": F.lit(None).cast("date"),
            }
        ),
        described.select(
            F.col("firm_id").alias("company_id"), F.col("topic_id").alias("local_topic_id"), "representation", "summary",
            "keywords", F.col("size").alias("n_sentences"), "embedding",
        ),
        assigned.select(
            F.col("firm_id").alias("company_id"), "sentence_id", "raw_text", "cleaned_text", "position", "speaker_type",
            F.col("topic_id").alias("local_topic_id"), "probability", "embedding",
        ),
    )


def process_themes(
    store: Store,
    config: Config,
    run_date: Column,
    encoder: Callable | None = None,
    generate: Callable | None = None,
    size: int = HASHED_SIZE,
) -> None:
    """Group the stored topics of all firms into themes and replace the stored themes."""
    settings = topics.merged_config(config.theme_model)
    grid, words = settings["hdbscan"], settings["vectorizer"]
    docs = themes.topic_documents(store.table("topics").drop("embedding"))
    if docs.isEmpty():
        empty = [store.spark.createDataFrame([], schemas.STORE[t]) for t in ("themes", "topic_themes")]
        store.write_themes(*empty)
        return
    cleaned = docs.withColumn("words", text.content_tokens(F.col("document"), []))
    embedded = materialize(_embedded(cleaned.withColumn("_text", F.array_join("words", " ")), "_text", encoder, size))
    dims = min(size, settings["umap"]["n_components"])
    clusters = hierarchy.tree_clusters(
        spectral.layout(embedded, [], "id", "embedding", dims), [], "id", "reduced",
        grid["min_cluster_size"], grid["min_samples"], grid["cluster_selection_method"],
    )
    raw = embedded.join(clusters.withColumnRenamed("cluster", "theme"), "id")
    assigned = materialize(topics.nearest_topics(raw, [], "theme").withColumn("theme", F.col("assigned_topic")))
    low, high = words["ngram_range"]
    kept = assigned.filter(F.col("theme") != topics.NOISE)
    counts = topics.term_counts(kept, ["theme"], F.col("words"), low, high, words["min_df"])
    ranked = topics.top_terms(topics.class_tfidf(counts, ["theme"]), ["theme"])
    numbered = themes.aggregate_themes(assigned, run_date, config.min_firms, config.max_dominance)
    named = numbered.join(topics.keyword_lists(ranked, ["theme"]), "theme", "left").withColumn(
        "name", topics.label([F.col("keywords")], F.concat(F.lit("Theme "), F.col("theme").cast("string")))
    )
    centers = topics.centroids(assigned, [], "theme").withColumnRenamed("centroid", "embedding")
    named = named.join(centers, "theme", "left").withColumn("description", F.lit(None).cast("string"))
    if generate is not None:
        texts = assigned.select(F.col("theme"), F.lit(0).alias("probability"), F.col("id").alias("position"), "summary")
        from callweave.operators import scan

        best = scan.top_k(texts, ["theme"], [F.col("position")], 10).groupBy("theme").agg(
            F.array_sort(F.collect_list(F.struct("rank", "summary"))).alias("_p")
        )
        asked = named.drop("description").join(best.select("theme", F.col("_p.summary").alias("_s")), "theme")
        asked = asked.withColumn("prompt", summaries.theme_prompt(F.col("name"), F.col("keywords"), F.col("_s"))).drop("_s")
        named = summaries.generated(asked, "prompt", generate, "description", log=f"{store.path}/answers").drop("prompt")
    named = materialize(summaries.with_fallback(named, "description", "name"))
    # all themes are replaced at once, so their place in the run numbers them
    number = F.col("ordinal") + 1
    rows = named.withColumns({"id": number, "created_at": F.current_timestamp()})
    links = assigned.join(named.select("theme", number.alias("theme_id")), "theme").select(
        F.col("id").alias("topic_id"), "theme_id"
    )
    store.write_themes(rows, links)


def run(
    components: DataFrame,
    store: Store,
    batch: str,
    config: Config,
    run_date: Column,
    encoder: Callable | None = None,
    generate: Callable | None = None,
) -> None:
    """Both stages: the batch's firms, then the themes of all firms."""
    store.create()
    process_firms(components, store, batch, config, None, encoder, generate)
    process_themes(store, config, run_date, encoder, generate)
