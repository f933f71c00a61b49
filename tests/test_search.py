"""Keyword, facet, vector and fused search against hand-built expectations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import embedding_job, fusion, search, vector
from evalspark.operators.catalog import write_examples
from evalspark.operators.vector_store import VectorStore
from evalspark.operators.search import SearchRequest
from evalspark.plans import search as plans

EXAMPLES = (
    "id long, dataset_id long, question string, answer string, choices array<string>, "
    "example_metadata string, created_at timestamp"
)


@pytest.fixture(scope="module")
def seed(spark):
    import datetime as dt

    def meta(subject):
        return None if subject is None else '{"subject":"%s","split":"test"}' % subject

    data = [
        (1, 1, "What is the capital of France?", "Paris", "geography"),
        (2, 1, "What is photosynthesis?", "a process", "biology"),
        (3, 2, "What is 2+2?", None, "math"),
        (4, 2, "What is the capital of Germany?", "Berlin", "geography"),
        (5, 1, "50% of x_y", "path\\to", None),
    ]
    examples = spark.createDataFrame(
        [(i, d, q, a, None, meta(s), dt.datetime(2024, 1, i)) for i, d, q, a, s in data], EXAMPLES
    )
    datasets = spark.createDataFrame(
        [(1, "zeta", "multiple_choice"), (2, "alpha", "open_ended"), (3, "empty", "open_ended")],
        "id long, name string, task_type string",
    )
    return examples, datasets


def found(seed, query, **options):
    rows, total = search.keyword_search(*seed, query, **options)
    return [r["id"] for r in rows.collect()], total.first()["total"]


def test_keyword_matching(seed):
    assert found(seed, "CAPITAL") == ([1, 4], 2)
    assert found(seed, "berlin") == ([4], 1)
    assert found(seed, "nothing here") == ([], 0)
    # A NULL answer does not hide a question hit.
    assert found(seed, "2+2") == ([3], 1)


def test_wildcards_and_backslashes(seed):
    assert found(seed, "capital%germany")[0] == [4]
    assert found(seed, "2_2")[0] == [3]
    assert found(seed, "capital%germany", literal=True)[0] == []
    assert found(seed, "50%", literal=True)[0] == [5]
    assert found(seed, "x_y", literal=True)[0] == [5]
    assert search.like_pattern("a\\b\\%c\\") == "%ab\\%c%"
    assert found(seed, "path\\to", literal=True)[0] == [5]


def test_filters_orders_and_pages(seed):
    assert found(seed, "what", dataset_name="alpha") == ([3, 4], 2)
    assert found(seed, "what", subject="geography") == ([1, 4], 2)
    assert found(seed, "what", task_type="open_ended", subject="math") == ([3], 1)
    assert found(seed, "what", sort_by="newest")[0] == [4, 3, 2, 1]
    assert found(seed, "what", sort_by="dataset")[0] == [3, 4, 2, 1]
    assert found(seed, "what", limit=2, offset=1) == ([2, 3], 4)
    with pytest.raises(ValueError):
        found(seed, "what", sort_by="score")
    with pytest.raises(ValueError):
        found(seed, "what", limit=101)
    with pytest.raises(ValueError):
        found(seed, "x" * 501)


def test_filters_of_all_requests_reach_the_scan(spark, seed, tmp_path):
    examples, datasets = seed
    subject = F.get_json_object("example_metadata", "$.subject")
    write_examples(examples.withColumn("subject", subject), str(tmp_path / "examples"))
    datasets.write.parquet(str(tmp_path / "datasets"))
    stored = [spark.read.parquet(str(tmp_path / name)) for name in ("examples", "datasets")]
    asked = [SearchRequest("a", "what", dataset_name="alpha", subject="geography"), SearchRequest("b", "what", dataset_name="zeta", subject="biology")]
    rows = search.match_requests(*stored, asked)
    plan = rows._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    pushed = [line for line in plan.splitlines() if "FileScan parquet" in line and "question" in line]
    assert all("In(subject, [biology,geography])" in line for line in pushed) and pushed
    assert sorted((r["query_id"], r["id"]) for r in rows.collect()) == [("a", 4), ("b", 2)]
    # One open request keeps the scan whole.
    mixed = search.match_requests(*stored, [*asked, SearchRequest("c", "what")])
    assert mixed.where("query_id = 'c'").count() == 4


def test_batch_equals_single_requests(seed):
    requests = [
        SearchRequest("a", "what"),
        SearchRequest("b", "capital", dataset_name="alpha"),
        SearchRequest("c", "What", subject="geography", task_type="multiple_choice"),
        SearchRequest("d", "absent"),
    ]
    lists = search.keyword_lists(*seed, requests, 3).collect()
    totals = {r["query_id"]: r["total"] for r in search.keyword_totals(*seed, requests).collect()}
    for r in requests:
        filters = {n: getattr(r, n) for n in ("dataset_name", "subject", "task_type")}
        ids, total = found(seed, r.query, limit=3, **filters)
        mine = sorted((x["rank"], x["id"]) for x in lists if x["query_id"] == r.query_id)
        assert [i for _, i in mine] == ids and totals[r.query_id] == total


def test_answers_kept_apart_give_the_same(seed):
    examples, datasets = seed
    apart, answers = examples.drop("answer"), examples.select("id", "answer").where("answer is not null")
    requests = [SearchRequest("a", "what"), SearchRequest("b", "berlin"), SearchRequest("c", "p", subject="biology")]

    def listed(df):
        return sorted((r["query_id"], r["rank"], r["id"], r["answer"], r["dataset_name"]) for r in df.collect())

    assert listed(search.keyword_lists(*seed, requests, 3)) == listed(
        search.keyword_lists(apart, datasets, requests, 3, answers)
    )
    for options in ({"sort_by": "newest"}, {"sort_by": "dataset"}, {"limit": 2, "offset": 1}, {"subject": "geography"}):
        rows, total = search.keyword_search(apart, datasets, "a", answers=answers, **options)
        mine = sorted(r["id"] for r in rows.collect()), total.first()["total"]
        ids, count = found(seed, "a", **options)
        assert mine == (sorted(ids), count)
    for query in ("berlin", "a", "zzz"):
        mine = {tuple(r) for r in search.facets(apart, datasets, query, answers).collect()}
        assert mine == {tuple(r) for r in search.facets(examples, datasets, query).collect()}


def facet_rows(seed, query=None):
    return {
        (r["facet"], r["name"], r["dataset"]): r["n"] for r in search.facets(*seed, query).collect()
    }


def test_facets(seed):
    got = facet_rows(seed)
    assert got[("total", None, None)] == 5
    assert got[("dataset", "zeta", None)] == 3 and got[("dataset", "alpha", None)] == 2
    assert got[("subject", "geography", "zeta")] == 1 and got[("subject", "geography", "alpha")] == 1
    assert got[("task_type", "open_ended", None)] == 2
    assert not any(k[0] == "subject" and k[1] is None for k in got)
    assert facet_rows(seed, "zzz") == {("total", None, None): 0}
    for query in ("capital", "what", "2"):
        assert facet_rows(seed, query)[("total", None, None)] == found(seed, query)[1]


def ranked(spark, ids):
    data = [("q", i, n + 1, f"p{i}") for n, i in enumerate(ids)]
    return spark.createDataFrame(data, "query_id string, id long, rank long, note string")


def fused(spark, keyword, semantic, **weights):
    out = fusion.reciprocal_rank_fusion(ranked(spark, keyword), ranked(spark, semantic), **weights)
    return [(r["id"], r["score"]) for r in out.orderBy("rank").collect()]


def test_rank_fusion(spark):
    out = fused(spark, [1, 2, 3], [4, 2, 5])
    assert out[0][0] == 2 and len(out) == 5
    assert out[0][1] == pytest.approx(0.4 / 62 + 0.6 / 62)
    assert fused(spark, [1, 2], [])[0][0] == 1 and fused(spark, [], [9])[0][0] == 9
    assert fused(spark, [], []) == []
    assert fused(spark, [1], [2], keyword_weight=0.9, semantic_weight=0.1)[0][0] == 1
    assert fused(spark, [1], [2], keyword_weight=0.1, semantic_weight=0.9)[0][0] == 2
    # Equal scores keep the keyword list first.
    tie = fused(spark, [7, 8], [5, 6], keyword_weight=0.5, semantic_weight=0.5)
    assert [i for i, _ in tie] == [7, 5, 8, 6]


def test_applied_ranking(spark):
    results = ranked(spark, [10, 20, 30, 40])
    ranks = spark.createDataFrame(
        [("q", 30, 0), ("q", 99, 1), ("q", 10, 2), ("q", 30, 3)], "query_id string, id long, position int"
    )
    out = fusion.apply_ranking(results, ranks).orderBy("final_rank").collect()
    assert [r["id"] for r in out] == [30, 10, 20, 40]


def test_passes_merge(spark):
    hits = spark.createDataFrame(
        [
            ("q", 0, 1, 1, None), ("q", 0, 2, 2, None), ("q", 1, 1, 2, 0.9), ("q", 1, 2, 3, 0.5),
            ("q", 2, 1, 4, 0.7), ("q", 2, 2, None, 0.8), ("q", 2, 3, 3, 0.99),
        ],
        "query_id string, pass_no int, rank long, id long, score double",
    )
    out = fusion.merge_passes(hits, 3).orderBy("position").collect()
    # id 2 keeps its first, unscored occurrence; id 3 keeps 0.5.
    assert [r["id"] for r in out] == [4, 3, 1] and out[0]["total"] == 4


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(400, 8)).astype("float32")
    matrix[11] = matrix[3]
    data = [(f"c{i % 2}", i, [float(x) for x in matrix[i]], "ab"[i % 3 == 0]) for i in range(400)]
    frame = spark.createDataFrame(
        data, "collection string, example_id long, vector array<float>, subject string"
    )
    return matrix, frame.repartition(5)


@pytest.mark.parametrize("metric", ["COSINE", "EUCLID", "DOT"])
def test_nearest_equals_brute_force(points, metric):
    matrix, frame = points
    requests = [
        SearchRequest("x", "x", vec_id=3, collection="c1"),
        SearchRequest("y", "y", vector=tuple(float(v) for v in matrix[8]), collection="c0"),
    ]
    out = vector.nearest(frame, requests, 10, metric=metric).collect()
    for request, probe, half in ((requests[0], 3, 1), (requests[1], 8, 0)):
        ids = np.arange(half, 400, 2)
        block, q = matrix[ids].astype(float), matrix[probe].astype(float)
        score = {
            "COSINE": block @ q / np.linalg.norm(block, axis=1) / np.linalg.norm(q),
            "DOT": block @ q,
            "EUCLID": -np.linalg.norm(block - q, axis=1),
        }[metric].round(6)
        want = sorted(zip(-score, ids))[:10]
        mine = sorted((r["rank"], r["example_id"], r["score"]) for r in out if r["query_id"] == request.query_id)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        shown = [abs(s) if metric == "EUCLID" else -s for s, _ in want]
        assert np.allclose([s for _, _, s in mine], shown, atol=1e-5)


def test_vector_filters_act_before_ranking(points):
    _, frame = points
    requests = [SearchRequest("x", "x", vec_id=3, collection="c1", subject="b")]
    out = vector.nearest(frame, requests, 10, filters=("subject",)).collect()
    assert len(out) == 10 and all(r["example_id"] % 3 == 0 for r in out)
    near = vector.nearest(frame, requests, 100, threshold=0.5).collect()
    assert near and all(r["score"] >= 0.5 for r in near)
    close = vector.nearest(frame, requests, 100, threshold=2.5, metric="EUCLID").collect()
    assert 1 < len(close) < 100 and all(0 <= r["score"] <= 2.5 for r in close)
    assert vector.nearest(frame, [SearchRequest("z", "z", vec_id=9999, collection="c0")], 5).count() == 0


def test_hybrid_falls_back_without_vectors(spark, seed, points):
    examples, datasets = seed
    corpus = plans.Corpus(examples, datasets, points[1].drop("subject"), vector.payload_of(examples, datasets))
    requests = [
        SearchRequest("has", "capital", vec_id=4, collection="c0"),
        SearchRequest("none", "capital", vec_id=4, collection="missing"),
    ]
    out = plans.hybrid_with_fallback(corpus, requests, limit=5).collect()
    modes = {(r["query_id"], r["mode"]) for r in out}
    assert modes == {("has", "hybrid"), ("none", "keyword")}
    rest = sorted((r["rank"], r["id"], r["score"]) for r in out if r["query_id"] == "none")
    assert rest == [(1, 1, None), (2, 4, None)]
    first = min((r for r in out if r["query_id"] == "has"), key=lambda r: r["rank"])
    # Found by both sides; the keyword row supplies the answer.
    assert first["id"] == 4 and first["answer"] == "Berlin"
    strict = [
        SearchRequest("s", "capital", vec_id=4, collection="c0", dataset_name="alpha", task_type="open_ended")
    ]
    out = plans.hybrid_search(corpus, strict, limit=5, strict_filters=True).collect()
    assert {r["id"] for r in out} == {4} and out[0]["total"] == 1


def test_hybrid_and_fallback_count_all_matches(spark, seed, points):
    examples, datasets = seed
    corpus = plans.Corpus(examples, datasets, points[1].drop("subject"), vector.payload_of(examples, datasets))
    requests = [SearchRequest("has", "a", vec_id=4, collection="c0"), SearchRequest("none", "a", vec_id=4, collection="missing")]
    whole = found(seed, "a", limit=1)[1]
    assert whole > 2
    for offset in (0, 1):
        out = plans.hybrid_with_fallback(corpus, requests, limit=1, offset=offset).collect()
        assert {(r["query_id"], r["keyword_total"]) for r in out} == {("has", whole), ("none", whole)}
        assert {r["total"] for r in out if r["mode"] == "keyword"} == {whole}
    assert {r["keyword_total"] for r in plans.hybrid_search(corpus, requests[:1], limit=1).collect()} == {whole}


def test_points_ahead_equal_brute_force():
    rng = np.random.default_rng(2)
    ids, scores = rng.permutation(300), np.round(rng.normal(size=300), 1)
    chosen = sorted(zip((-scores[:40]).tolist(), ids[:40].tolist()))
    probes = (np.array([i for _, i in chosen]), np.array([-s for s, _ in chosen]))
    ranks = np.cumsum(vector._ahead(ids, scores, probes))[:-1]
    whole = sorted(zip((-scores).tolist(), ids.tolist()))
    assert ranks.tolist() == [whole.index(hit) for hit in chosen]


@pytest.fixture(scope="module")
def wide(spark, points):
    """Examples beside 400 points: some matched by text, some by both sides, some by neither."""
    texts = [f"needle {i}" if i % 5 in (0, 3) or i > 380 else f"hay {i}" for i in range(420)]
    rows = [(i, 1 + i % 2, text, None, None, f'{{"subject":"{"ab"[i % 3 == 0]}"}}') for i, text in enumerate(texts)]
    schema = "id long, dataset_id long, question string, answer string, choices array<string>, example_metadata string"
    datasets = spark.createDataFrame([(1, "one", "t"), (2, "two", "t")], "id long, name string, task_type string")
    examples = spark.createDataFrame(rows, schema).repartition(3)
    return texts, plans.Corpus(examples, datasets, points[1].drop("subject"), vector.payload_of(examples, datasets))


def fused_by_hand(texts, matrix, request, subject=None):
    """The whole fused order: ids, best first."""
    inside = lambda i: subject is None or "ab"[i % 3 == 0] == subject
    keyword = [i for i, t in enumerate(texts) if request.query in t and inside(i)]
    half = [i for i in range(int(request.collection[1]), 400, 2) if inside(i)]
    block, q = matrix[half].astype(float), matrix[request.vec_id].astype(float)
    scores = np.round(block @ q / np.linalg.norm(block, axis=1) / np.linalg.norm(q), 9)
    near = [i for _, i in sorted(zip(-scores, half))]
    part = {}
    for order, (hits, weight) in enumerate(((keyword, request.keyword_weight), (near, request.semantic_weight))):
        for rank, i in enumerate(hits, 1):
            score, first = part.get(i, (0.0, (order, rank)))
            part[i] = (score + weight / (60 + rank), first)
    return sorted(part, key=lambda i: (-part[i][0], part[i][1])), len(keyword)


@pytest.mark.parametrize("weights", [(0.4, 0.6), (1.0, 0.0), (0.0, 0.0)])
def test_hybrid_pages_are_cuts_of_one_order(wide, points, weights):
    texts, corpus = wide
    requests = [
        SearchRequest("x", "needle", vec_id=3, collection="c1", keyword_weight=weights[0], semantic_weight=weights[1]),
        SearchRequest("y", "needle", vec_id=8, collection="c0", subject="b", keyword_weight=weights[0], semantic_weight=weights[1]),
        SearchRequest("z", "nothing like it", vec_id=8, collection="c0", keyword_weight=weights[0], semantic_weight=weights[1]),
    ]
    for limit, offset in ((7, 13), (40, 230)):
        out = plans.hybrid_search(corpus, requests, limit, offset).collect()
        for request in requests:
            order, matches = fused_by_hand(texts, points[0], request, request.subject)
            mine = sorted((r["rank"], r["id"]) for r in out if r["query_id"] == request.query_id)
            assert mine == list(enumerate(order, 1))[offset : offset + limit]
            assert {(r["total"], r["keyword_total"]) for r in out if r["query_id"] == request.query_id} <= {(len(order), matches)}


def test_rankings_reorder_what_was_shown(spark, wide, points):
    texts, corpus = wide
    request = SearchRequest("x", "needle", vec_id=3, collection="c1")
    order, _ = fused_by_hand(texts, points[0], request)
    ranks = spark.createDataFrame([("x", order[7], 0), ("x", order[60], 1), ("x", 10_000, 2), ("x", order[2], 3)], "query_id string, id long, position int")
    want = [order[7], order[2], *[i for i in order if i not in (order[7], order[2])]]
    for limit, offset in ((5, 0), (20, 40)):
        out = plans.assisted_search(corpus, [request], ranks, limit, offset).collect()
        assert [i for _, i in sorted((r["final_rank"], r["id"]) for r in out)] == want[offset : offset + limit]
        assert {r["total"] for r in out} == {len(order)}


def test_upsert_last_write_wins(spark):
    schema = "collection string, example_id long, vector array<float>, batch int"
    stored = spark.createDataFrame([("c", 1, [1.0, 1.0], 0), ("c", 2, [2.0, 2.0], 0)], schema)
    incoming = spark.createDataFrame(
        [("c", 2, [3.0, 3.0], 1), ("c", 2, [4.0, 4.0], 2), ("c", 5, [5.0, 5.0], 1)], schema
    )
    out = {r["example_id"]: r["vector"][0] for r in vector.upsert(stored, incoming, 2).collect()}
    assert out == {1: 1.0, 2: 4.0, 5: 5.0}
    with pytest.raises(Exception, match="vector width"):
        vector.upsert(stored, incoming, 3).collect()


def test_embedding_text_and_provider(spark, seed):
    examples = spark.createDataFrame(
        [(1, "q", ["A: x", "B: y"]), (2, "q", []), (3, "q", None)],
        "id long, question string, choices array<string>",
    )
    texts = examples.select(vector.embedding_text(F.col("question"), F.col("choices"))).collect()
    assert [r[0] for r in texts] == ["q A: x B: y", "q", "q"]
    out = {r["example_id"]: r["vector"] for r in vector.embed(examples, vector.HashingProvider).collect()}
    want = vector.HashingProvider().embed_batch(["q A: x B: y", "q"])
    assert np.allclose(out[1], want[0]) and np.allclose(out[2], want[1]) and out[2] == out[3]


def counting(missing=0):
    """A model that allows two texts a call. A class of a function is sent to the workers by value."""

    class Counting(vector.HashingProvider):
        def embed_batch(self, texts):
            assert 0 < len(texts) <= 2 and all(isinstance(t, str) for t in texts)
            return super().embed_batch(texts)[missing:]

    return lambda: Counting(8)


def test_embedding_job(spark, seed, tmp_path):
    examples, datasets = seed[0], seed[1]
    names = {r["id"]: r["name"] for r in datasets.collect()}
    store = VectorStore(spark, str(tmp_path / "store"))
    row = embedding_job.embed_dataset(store, names[1], examples, datasets, counting(), batch_size=2).first()
    name = embedding_job.collection_of(names[1])
    mine = {r["id"]: r["question"] for r in examples.where("dataset_id = 1").collect()}
    assert (row["collection"], row["model"], row["dims"]) == (name, "hashing-8", 8)
    assert row["embedded"] == row["stored"] == len(mine) == 3 and row["buckets"] == 3
    assert row["elapsed_seconds"] > 0 and abs(row["examples_per_second"] * row["elapsed_seconds"] - 3) < 1e-6
    points = {r["example_id"]: r for r in store.points().collect()}
    assert {i: p["question"] for i, p in points.items()} == mine
    assert all(p["dataset_name"] == names[1] and p["dataset_id"] == 1 for p in points.values())
    assert points[1]["subject"] == "geography" and points[5]["subject"] is None
    assert np.allclose(points[2]["vector"], vector.HashingProvider(8).embed_batch([mine[2]])[0])
    # The job again, over changed and new examples: points are replaced by id, the others stay.
    later = examples.where("id in (2, 3)").withColumn("question", F.when(F.col("id") == 2, F.lit("changed")))
    row = embedding_job.embed_into(store, name, later, datasets, counting(), batch_size=1).first()
    assert (row["embedded"], row["stored"]) == (2, 4)
    points = {r["example_id"]: r for r in store.points().collect()}
    assert points[2]["question"] == "changed" and points[5]["question"] == mine[5]
    assert list(points[3]["vector"]) == [0.0] * 8 and points[3]["question"] is None
    row = embedding_job.embed_into(store, "empty", examples.where("id < 0"), datasets, counting()).first()
    assert (row["embedded"], row["stored"], row["buckets"]) == (0, 0, 0)
    with pytest.raises(ValueError, match="no dataset"):
        embedding_job.embed_dataset(store, "unheard of", examples, datasets, counting())
    with pytest.raises(ValueError, match="holds 8 dims"):
        embedding_job.embed_into(store, name, examples, datasets, vector.HashingProvider)
    with pytest.raises(Exception, match="vectors for 1 texts"):
        embedding_job.embed_into(store, name, examples, datasets, counting(1), batch_size=1)
    assert store.points().count() == 4


def test_audit_of_many_collections(spark):
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(600, 6))
    rows = [(f"c{i % 150}", i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    rows += [("c0", 9000, [1.0, 2.0]), ("none", 1, None), ("zero", 5, [0.0, 0.0]), ("zero", 6, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "collection string, example_id long, vector array<double>")
    out = vector.audit(frame).collect()
    for c in (0, 7, 149):
        mine = sorted((r["rank"], r["neighbour_id"]) for r in out if r["collection"] == f"c{c}")
        block = matrix[np.arange(c, 600, 150)]
        scores = block @ matrix[c] / np.linalg.norm(block, axis=1) / np.linalg.norm(matrix[c])
        want = [c + 150 * int(i) for i in np.argsort(-scores)[:3]]
        assert mine == list(enumerate(want, 1))
    facts = {r["collection"]: (r["points"], r["min_dims"], r["max_dims"]) for r in out}
    assert facts["c0"] == (5, 2, 6) and len(facts) == 152 and facts["none"][0] == 1


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no collection"):
        store.upsert("a", spark.createDataFrame([(1, [1.0], 0)], "example_id long, vector array<float>, batch int"))
    store.create("a", 2, buckets=4)
    store.create("a", 2, buckets=4)
    store.create("b", 3, "DOT", buckets=2)
    for dims, metric in ((3, "COSINE"), (2, "DOT")):
        with pytest.raises(ValueError, match="holds 2 dims"):
            store.create("a", dims, metric)
    with pytest.raises(ValueError, match="metric"):
        store.create("c", 2, "HAMMING")
    assert store.metric("b") == "DOT" and store.registry().count() == 2
    schema = "example_id long, vector array<float>, batch int, subject string, question string"
    rows = [(i, [float(i), 1.0], 0, "xy"[i % 2], f"q{i}") for i in range(20)]
    assert store.upsert("a", spark.createDataFrame(rows, schema)) == [0, 1, 2, 3]
    files = {str(f) for f in (tmp_path / "store" / "points").rglob("*.parquet")}
    late = [(4, [7.0, 7.0], 1, "x", "old"), (4, [9.0, 9.0], 2, "y", "new"), (24, [1.0, 1.0], 1, None, None)]
    assert store.upsert("a", spark.createDataFrame(late, schema)) == [0]
    now = {str(f) for f in (tmp_path / "store" / "points").rglob("*.parquet")}
    assert {f for f in files if "bucket=0" not in f} <= now and not {f for f in files if "bucket=0" in f} & now
    found = {r["example_id"]: (list(r["vector"]), r["subject"], r["question"]) for r in store.points().collect()}
    assert len(found) == 21 and found[4] == ([9.0, 9.0], "y", "new") and found[24] == ([1.0, 1.0], None, None) and found[8][2] == "q8"
    with pytest.raises(Exception, match="vector width differs from 2"):
        store.upsert("a", spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, None, None)], schema))
    assert store.points().count() == 21
    # With the payload beside the vector a filtered search joins and shuffles nothing before the scorer.
    request = [SearchRequest("q", "q", vector=(1.0, 1.0), collection="a", subject="x")]
    hits = vector.semantic_search(store.points(), store.payload(), request, 3)
    assert {r["id"] for r in hits.collect()} <= {i for i in range(20) if i % 2 == 0 and i != 4}
    vectors, used = vector.with_filters(store.points(), store.payload(), request, ("subject",))
    scored = vectors.where("collection = 'a'").select("collection", "example_id", "vector", *used)
    plan = scored.mapInArrow(vector._scorer(request, used, 3, None, "COSINE"), vector.HIT_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert used == ("subject",) and "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan
