"""Text, topics, density clusters and neighbours."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import text, vectors
from callweave.operators import density, neighbors
from callweave.operators.ball_tree import BallTree
from callweave.plans import sentences, summaries, themes, topics


def test_sentences_are_numbered_across_transcripts(spark):
    rows = [
        ("f1", "One", "T2", 1, "CEO", "Alpha beta gamma. Short. Delta epsilon zeta!"),
        ("f1", "One", "T1", 2, None, "Second component here.\nMore words follow? Yes."),
        ("f1", "One", "T1", 1, "CFO", "First component text."),
        ("f2", "Two", "T9", 1, "CEO", "The and of."),
    ]
    comps = spark.createDataFrame(rows, "firm_id string, firm_name string, transcript_id string, component_order int, speaker_type string, text string")
    got = sentences.sentences(comps, ["the", "and", "of", "yes"]).orderBy("position").collect()
    assert [r.sentence_id for r in got] == [f"f1_{t}_{i:04d}" for i, t in enumerate(["T1", "T1", "T1", "T2", "T2"])]
    assert [r.raw_text for r in got][:3] == ["First component text.", "Second component here.", "More words follow?"]
    assert got[1].speaker_type is None and got[4].cleaned_text == "delta epsilon zeta"


def test_transcripts_go_by_number(spark):
    rows = [("f", "One", t, 1, "CEO", f"Words of {t} here.") for t in ("10", "9", "x", "100")]
    comps = spark.createDataFrame(rows, "firm_id string, firm_name string, transcript_id string, component_order int, speaker_type string, text string")
    got = sentences.sentences(comps, []).orderBy("position").collect()
    assert [r.transcript_id for r in got] == ["9", "10", "100", "x"]


def test_cleaning_drops_numbers_and_stop_words(spark):
    df = spark.createDataFrame([("We grew 12.5% to $4.2 on 01/02/2023, the 3rd time (again)!",)], "t string")
    stop = text.default_stopwords()
    assert df.select(text.clean(F.col("t"), stop)).first()[0] == "grew time"
    assert {"thank", "operator", "the"} <= set(stop)


def test_words_that_skip_the_pattern_are_those_it_leaves(spark):
    rng = np.random.default_rng(5)
    signs = list("azAZÉé1٣$€£+-%.,:/()'{`&\u0085\u2028\U0001d400 \t\n")
    rows = [("".join(rng.choice(signs, rng.integers(0, 30))),) for _ in range(3000)] + [(None,), ("",), ("the $5 5% 3rd a$ $ -5.- a. .a z",)]
    d = spark.createDataFrame(rows, "t string")
    words = F.transform(F.split(F.lower("t"), r"\s+"), lambda w: F.regexp_replace(w, text.EDGE_PUNCTUATION, ""))
    plain = F.filter(words, lambda w: w != "")
    kept = F.filter(plain, lambda w: ~w.rlike(text.NUMERIC_TOKEN))
    assert d.filter(~text.tokens(F.col("t")).eqNullSafe(plain)).isEmpty()
    assert d.filter(~text.content_tokens(F.col("t"), []).eqNullSafe(kept)).isEmpty()


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(text.ngrams(F.col("w"), 1, 2)).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_vector_rules(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(
        vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("n"), vectors.cosine(F.col("a"), F.col("z")).alias("c"),
        vectors.row_shares(F.col("z")).alias("even"), vectors.row_shares(F.col("a")).alias("s"),
    ).first()
    assert r.u == pytest.approx([0.6, 0.8]) and r.n is None and r.c is None
    assert r.even == [0.5, 0.5] and r.s == pytest.approx([3 / 7, 4 / 7])


def _blobs(spark, seed=0, firms=2):
    rng = np.random.default_rng(seed)
    rows = []
    for firm in range(firms):
        centers = rng.permutation([[0, 0], [12, 0], [0, 12]]) + firm
        for label, (n, c) in enumerate(zip((120, 60, 40), centers)):
            rows += [(firm, len(rows) + i, label, [float(v) for v in p]) for i, p in enumerate(rng.normal(c, 0.6, (n, 2)))]
        rows.append((firm, len(rows), -1, [60.0, 60.0]))
    return spark.createDataFrame(rows, "firm int, id int, label int, v array<double>")


@pytest.mark.parametrize("selection", ["leaf", "eom"])
def test_density_finds_the_blobs(spark, selection):
    points = _blobs(spark)
    got = density.density_clusters(points, ["firm"], "id", "v", 2, min_cluster_size=15, min_samples=3, selection=selection)
    both = got.join(points, ["firm", "id"]).toPandas()
    assert len(both) == 442
    assert (both[both.label == -1].cluster == -1).all()
    for _, firm in both[both.label >= 0].groupby("firm"):
        kept = firm[firm.cluster >= 0]
        assert len(kept) > 0.8 * len(firm)
        # no cluster mixes blobs, and cluster 0 is the largest
        assert (kept.groupby("cluster").label.nunique() == 1).all()
        assert set(kept[kept.cluster == 0].label) == {0}
    with pytest.raises(ValueError):
        density.density_clusters(points, ["firm"], "id", "v", 2, selection="best")


def _rand_index(a, b):
    """Adjusted Rand index of two labellings."""
    pairs = lambda counts: float((counts * (counts - 1) / 2).sum())
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    both, one, other = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected = one * other / (len(a) * (len(a) - 1) / 2)
    return (both - expected) / ((one + other) / 2 - expected)


@pytest.mark.parametrize("selection", ["leaf", "eom"])
@pytest.mark.parametrize("n", [400, 4_000, 40_000])
@pytest.mark.parametrize("dims", [2, 4])
def test_clusters_do_not_depend_on_the_number_of_points(spark, selection, n, dims):
    rng = np.random.default_rng(n)
    centers = np.array([[0, 0], [8, 0], [0, 8], [8, 8]])
    label = rng.integers(0, 4, n)
    found = rng.normal(0, 1, (n, dims))
    found[:, :2] += centers[label]
    points = spark.createDataFrame(
        spark.sparkContext.parallelize([(i, [float(x) for x in v]) for i, v in enumerate(found)], 4), "id long, v array<double>"
    )
    got = density.density_clusters(points, [], "id", "v", dims, min_cluster_size=15, min_samples=3, selection=selection).toPandas()
    cluster = got.sort_values("id")["cluster"].to_numpy()
    assert set(cluster) - {-1} == {0, 1, 2, 3}
    assert _rand_index(label, cluster + 1) > 0.9


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2)) if a != b] + [(i, i + 1) for i in range(200, 260)]
    nodes = sorted({n for p in pairs for n in p} | {500})
    root = {n: n for n in nodes}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    got = density.connected(spark.createDataFrame([(n,) for n in nodes], "node long"), edges)
    assert {r.node: r.root for r in got.collect()} == root


@pytest.mark.parametrize("tile_rows", [2048, 20])
def test_neighbors_are_exact(spark, monkeypatch, tile_rows):
    rng = np.random.default_rng(6)
    data, asked = rng.normal(size=(90, 8)), rng.normal(size=(25, 8))
    monkeypatch.setattr(neighbors, "TILE_ROWS", tile_rows)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "i long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "q long, embedding array<double>")
    got = neighbors.nearest(queries, items, 4, "q", "i").toPandas().sort_values(["query_id", "rank"])
    sims = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (data / np.linalg.norm(data, axis=1, keepdims=True)).T
    assert got.item_id.tolist() == np.argsort(-sims, axis=1)[:, :4].ravel().tolist()


def test_bounds_skip_tiles_of_clustered_items(spark, monkeypatch):
    """Exact, and fewer (query, tile) pairs than all; null and zero vectors take no part."""
    rng = np.random.default_rng(2)
    data = 6 * rng.normal(size=(12, 8))[rng.integers(0, 12, 600)] + 0.5 * rng.normal(size=(600, 8))
    monkeypatch.setattr(neighbors, "TILE_ROWS", 50)
    pairs, reach = [], neighbors._reach
    monkeypatch.setattr(neighbors, "_reach", lambda *a: (lambda f: (pairs.append(f.count()), f)[1])(reach(*a)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    items = spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8)], "i long, embedding array<double>")
    got = neighbors.nearest(items.filter("i % 5 = 0").withColumnRenamed("i", "q"), items, 3, "q", "i").toPandas().sort_values(["query_id", "rank"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert got.item_id.tolist() == np.argsort(-np.round(unit[::5] @ unit.T, 12), axis=1, kind="stable")[:, :3].ravel().tolist()
    assert pairs[0] == 120 and sum(pairs) < 0.6 * 120 * 12
    assert neighbors.nearest(items, items.filter("i < 0"), 3, "i", "i").count() == 0


def test_equal_items_go_by_id(spark):
    items = spark.createDataFrame([(i, [1.0, float(i > 5)]) for i in range(12)], "i long, embedding array<double>")
    asked = spark.createDataFrame([(3, [1.0, 0.0])], "q long, embedding array<double>")
    got = neighbors.nearest(asked, items, 8, "q", "i").orderBy("rank").collect()
    assert [r.item_id for r in got] == list(range(8))


def test_members_and_outliers(spark):
    """Three topics of 3, 2 and 3 members by falling probability, two outliers."""
    topic = [0, 0, 0, 1, 1, 2, 2, 2, -1, -1]
    prob = [0.5, 0.9, 0.5, 0.1, 0.2, 0.3, 0.3, 0.8, 0.1, 0.1]
    df = spark.createDataFrame([("f", i, t, p) for i, (t, p) in enumerate(zip(topic, prob))], "firm_id string, i long, topic_id int, p double")
    got = {r.topic_id: r for r in topics.topic_members(df, ["firm_id"], "topic_id", "i", "p", "i").collect()}
    assert {t: r["size"] for t, r in got.items()} == {0: 3, 1: 2, 2: 3, -1: 2}
    assert (got[0].members, got[2].members, got[-1].members) == ([1, 0, 2], [7, 5, 6], [8, 9])


def test_labels(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["c", "x", "a", "y"], 1), ([], None, 2)], "p array<string>, q array<string>, t int")
    got = df.select(topics.label([F.col("p"), F.col("q")], F.concat(F.lit("Topic "), F.col("t").cast("string")))).collect()
    assert [r[0] for r in got] == ["a, b, c, x", "Topic 2"]


def test_diverse_terms_match_the_greedy_definition(spark):
    rng = np.random.default_rng(8)
    v, sim = rng.normal(size=(6, 4)), rng.uniform(0, 1, 6)
    rows = [("t", i + 1, f"w{i}", float(sim[i]), [float(x) for x in v[i]]) for i in range(6)]
    near = spark.createDataFrame(rows, "topic_id string, rank long, term string, similarity double, term_vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = [int(np.argmax(sim))]
    while len(chosen) < 4:
        rest = [i for i in range(6) if i not in chosen]
        chosen.append(max(rest, key=lambda i: 0.6 * sim[i] - 0.4 * max(u[i] @ u[j] for j in chosen)))
    got = topics.diverse_terms(near, ["topic_id"], 4, 0.4).first().terms
    assert got == [f"w{i}" for i in chosen]


def test_settings_merge():
    merged = topics.merged_config({"hdbscan": {"min_cluster_size": 20}})
    assert merged["hdbscan"]["min_cluster_size"] == 20 and merged["hdbscan"]["min_samples"] == 2
    assert topics.merged_config()["hdbscan"]["min_cluster_size"] == 6
    for unread in ({"device": "cuda"}, {"umap": {"min_dist": 0.1}}):
        with pytest.raises(ValueError, match="without effect"):
            topics.merged_config(unread)


def test_theme_rules(spark):
    rows = [(0, f"f{i % 3}") for i in range(6)] + [(1, "f1"), (1, "f2")] + [(2, "f1")] * 3 + [(3, f"f{i}") for i in range(5)] + [(-1, "f9")]
    df = spark.createDataFrame(rows, "theme int, firm_id string")
    groups = {r.theme: r for r in themes.theme_groups(df).collect()}
    assert set(groups) == {0, 1, 2, 3} and groups[1].dominance == 0.5 and groups[2].n_firms == 1
    got = themes.aggregate_themes(df, F.lit("2024-03-01").cast("date")).orderBy("ordinal").collect()
    assert [(r.theme, r.theme_id) for r in got] == [(0, "theme_20240301_000"), (3, "theme_20240301_001")]


def test_generated_texts_retry_and_fall_back(spark):
    def failing_service():
        """Text generator that fails as told by the prompt; nested, so that workers get it by value."""
        calls = {}

        async def answer(prompt):
            n = calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "busy" and n < 3:
                raise summaries.Unavailable(429)
            if prompt == "bad":
                raise summaries.Unavailable(400 if n == 1 else 500)
            if prompt == "down":
                raise summaries.Unavailable()
            return f"{prompt}:{n}"

        return answer

    df = spark.createDataFrame([("ok", "k1"), ("busy", "k2"), ("bad", "k3"), ("down", "k4")], "prompt string, representation string")
    got = summaries.generated(df, "prompt", failing_service, "summary", wait=0.01)
    rows = {r.prompt: r.summary for r in got.collect()}
    assert rows == {"ok": "ok:1", "busy": "busy:3", "bad": None, "down": None}
    filled = {r.prompt: r.summary for r in summaries.with_fallback(got, "summary", "representation").collect()}
    assert filled["down"] == "k4" and filled["ok"].startswith("ok")


def test_entities(spark):
    df = spark.createDataFrame([("s1", {"ORG": [("Acme", 0.9), ("Beta", None)], "PRODUCT": []})], "sentence_id string, entities map<string,array<struct<name:string,confidence:double>>>")
    assert sorted((r.entity_type, r.value) for r in summaries.entity_rows(df).collect()) == [("ORG", "Acme"), ("ORG", "Beta")]


def test_encoder_runs_in_batches_and_checks_its_size(spark):
    docs = spark.createDataFrame([("aa",), ("b",)], "t string")
    got = topics.encoded(docs, "t", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert sorted(list(r.embedding) for r in got.collect()) == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="expected 3"):
        topics.encoded(docs, "t", lambda: lambda ts: [[1.0, 1.0] for _ in ts], 3).collect()


def test_ball_tree_is_exact():
    """Fifty thousand centroids, with copies, zero points and a tree of one; most balls are not opened."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(400, 12))[rng.integers(0, 400, 50_000)] + 0.1 * rng.normal(size=(50_000, 12))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    centres[900] = centres[17]
    ids = rng.permutation(50_000)
    tree = BallTree(ids.tolist(), centres)
    points = np.concatenate([centres[rng.integers(0, 50_000, 200)] * 3 + 0.1 * rng.normal(size=(200, 12)), centres[[17]], np.zeros((1, 12))])
    who, dot = tree.nearest(points)
    full = np.round(points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None] @ centres.T, 12)
    for i in range(len(points)):
        best = np.flatnonzero(full[i] == full[i].max())
        assert tree.ids[who[i]] == ids[best].min()
    assert np.allclose(dot, (points * tree.vectors[who]).sum(axis=1))
    assert BallTree([5], centres[:1]).nearest(points[:3])[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("per_row", [500, 2])
@pytest.mark.parametrize("keys", [[], ["firm"]])
def test_nearest_topic_and_shares(spark, monkeypatch, per_row, keys):
    """Centroids that tasks cannot hold are compared part by part with the same result as trees."""
    monkeypatch.setattr(topics, "CENTROIDS_PER_ROW", per_row)
    monkeypatch.setattr(topics, "TREE_BYTES", 64 << 20 if per_row > 2 else 0)
    rng = np.random.default_rng(11)
    v, topic, firm = rng.normal(size=(60, 5)), rng.integers(-1, 6, 60), rng.integers(0, 2, 60)
    rows = [(i, int(firm[i]), int(topic[i]), [float(x) for x in v[i]]) for i in range(60)]
    points = spark.createDataFrame(rows, "i int, firm int, topic_id int, embedding array<double>")
    got = {r.i: r for r in topics.nearest_topics(points, keys).collect()}
    shares = {r.i: r for r in topics.topic_shares(points, keys).collect()}
    for i in range(60):
        pool = (firm == firm[i]) if keys else np.ones(60, bool)
        ids = sorted(set(topic[pool & (topic >= 0)]))
        centers = np.array([v[pool & (topic == t)].mean(axis=0) for t in ids])
        sims = centers @ v[i] / np.linalg.norm(centers, axis=1) / np.linalg.norm(v[i])
        want = ids[int(np.argmax(sims))] if topic[i] == -1 else topic[i]
        assert got[i].assigned_topic == want and got[i].similarity == pytest.approx(sims.max())
        assert shares[i].topics == ids
        positive = np.maximum(sims, 0)
        share = positive / positive.sum() if positive.any() else np.full(len(ids), 1 / len(ids))
        assert shares[i].probabilities == pytest.approx(list(share))


@pytest.mark.parametrize("keys", [["firm"], []])
def test_own_shares_are_those_of_the_whole_list(spark, monkeypatch, keys):
    rng = np.random.default_rng(3)
    rows = [(int(i), "ab"[i % 2], int(rng.integers(-1, 7)), rng.normal(size=5).tolist()) for i in range(700)]
    rows += [(700, "a", -1, None), (701, "a", 2, [0.0] * 5), (702, "c", -1, [1.0] * 5), (703, None, 2, [1.0] * 5)]
    points = spark.createDataFrame(rows, "id long, firm string, topic_id int, embedding array<float>").coalesce(1)
    every = topics.topic_shares(points, keys).collect()
    want = {r.id: dict(zip(r.topics, r.probabilities)).get(r.topic_id) for r in every}
    for limit in (topics.TREE_BYTES, 0):
        monkeypatch.setattr(topics, "TREE_BYTES", limit)
        got = {r.id: r.probability for r in topics.own_shares(points, keys).collect()}
        assert got.keys() == want.keys()
        for i, share in want.items():
            assert got[i] == (None if share is None else pytest.approx(share, abs=1e-12)), i


def test_hashed_embeddings_take_the_words_once(spark, tmp_path):
    from callweave.catalog.topic_queries import hashed_embeddings

    rows = [(1, 0, "user", "Alpha beta, beta gamma!"), (1, 1, "user", ""), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = hashed_embeddings(spark, str(tmp_path))
    # a plan that copies the list of hashed words into each of 32 counts repeats the work a word 64 times a copy
    assert found._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    cells = {(r.conv_id, r.turn): [] for r in found.collect()}
    for r in found.orderBy("conv_id", "turn", "place").collect():
        cells[r.conv_id, r.turn].append(r.x)
    assert {len(v) for v in cells.values()} == {32} and len(cells) == 3
    assert sum(x * x for x in cells[1, 0]) == pytest.approx(1, abs=1e-4) and not any(cells[1, 1]) and not any(cells[2, 0])


def test_windows_shuffle_no_row_each(spark):
    docs = spark.createDataFrame([(1, "a b a c d e a b".split()), (2, ["b"]), (3, [])], "doc long, words array<string>")
    weights = spark.createDataFrame(
        [("x", "a", 2, 3.0), ("x", "a b", 1, 1.0), ("x", "d", 1, 2.0), ("y", "b", 2, 2.0), ("y", "d", 1, 2.0)], "topic_id string, term string, tf long, weight double"
    )
    found = topics.window_shares(docs, "doc", F.col("words"), weights)
    # an occurrence comes to its text once; windows are made there and not in a generator
    assert "transform(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc"], r.topic_id): r.share for r in found.collect()}
    idf = {"a": 1.5, "a b": 1.0, "d": 2.0, "b": 1.0}
    length = {"x": 14**0.5, "y": 8**0.5}
    unit = {("x", "a"): 3 / length["x"], ("x", "a b"): 1 / length["x"], ("x", "d"): 2 / length["x"], ("y", "b"): 2 / length["y"], ("y", "d"): 2 / length["y"]}
    for doc, words in ((1, "a b a c d e a b".split()), (2, ["b"]), (3, [])):
        sums = {"x": 0.0, "y": 0.0}
        for i in range(max(len(words) - 3, 1)):
            cut = words[i : i + 4]
            grams = [g for g in cut + [f"{a} {b}" for a, b in zip(cut, cut[1:])] if g in idf]
            size = sum((grams.count(g) * idf[g]) ** 2 for g in set(grams)) ** 0.5
            for t in sums:
                s = sum(idf[g] * unit.get((t, g), 0.0) for g in grams) / size if size else 0.0
                sums[t] += s if s >= 0.1 else 0.0
        whole = sum(sums.values())
        for t, s in sums.items():
            assert got[doc, t] == pytest.approx(s / whole if whole else 0.5)


def test_terms_of_a_scope_are_weighed_in_many_tasks(spark):
    """No shuffle sends all terms of a firm to one task, and null topics keep their weights."""
    rows = [(f"f{i % 2}", i % 5 if i % 7 else None, f"w{i % 11}", 1 + i % 4, 20 + i % 11) for i in range(70)]
    counts = spark.createDataFrame(rows, "firm string, topic int, term string, tf long, term_total long").dropDuplicates(["firm", "topic", "term"])
    keys = ["firm", "topic"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = topics.top_terms(topics.class_tfidf(counts, keys, ["firm"]), keys, 100)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        got = {(r.firm, r.topic, r.term): r.weight for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(firm#" in x and "topic#" not in x]
    table = counts.toPandas()
    words = table.groupby(keys, dropna=False)["tf"].sum().groupby("firm").mean()
    want = table["tf"] * np.log(1 + table["firm"].map(words) / table["term_total"])
    assert got == {(f, None if np.isnan(t) else t, w): pytest.approx(x) for f, t, w, x in zip(table["firm"], table["topic"], table["term"], want)}


def test_rows_that_cannot_move_are_not_compared(spark, monkeypatch):
    """Without the similarity the same topics are assigned, and the trees see the noise alone."""
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(-1, 4)), rng.normal(size=5).tolist()) for i in range(80)]
    points = spark.createDataFrame(rows, "i int, topic_id int, embedding array<double>")
    want = {r.i: r.assigned_topic for r in topics.nearest_topics(points, []).collect()}
    asked, trees = [], topics._from_trees
    monkeypatch.setattr(topics, "_from_trees", lambda df, unit, keys, topic, vector: (asked.append(df.filter(F.col(vector).isNotNull()).count()), trees(df, unit, keys, topic, vector))[1])
    got = topics.nearest_topics(points, [], similarity=False)
    assert got.columns == [*points.columns, "assigned_topic"] and {r.i: r.assigned_topic for r in got.collect()} == want
    assert asked == [sum(t == -1 for _, t, _ in rows)]


def test_diverse_terms_break_ties_by_rank(spark):
    """Zero vectors overlap with nothing; equal scores go by rank; a topic with fewer terms gives them all."""
    rows = [("t", 3, "c", 0.5, [0.0, 0.0]), ("t", 1, "a", 0.5, [1.0, 0.0]), ("t", 2, "b", 0.5, [2.0, 0.0]), ("u", 1, "z", 0.1, [1.0, 1.0])]
    near = spark.createDataFrame(rows, "topic_id string, rank long, term string, similarity double, term_vector array<float>")
    assert {r.topic_id: r.terms for r in topics.diverse_terms(near, ["topic_id"], 3, 0.3).collect()} == {"t": ["a", "c", "b"], "u": ["z"]}
