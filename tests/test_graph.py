import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessergraph.functions.stemmer import stem
from tessergraph.functions.text import bpe_tokens, estimated_tokens, similarity, tokenize, tokens, word_set
from tessergraph.graph import Graph
from tessergraph.operators import fusion, pagerank, selection
from tessergraph.operators.diff import affected_subgraph, diff_graphs
from tessergraph.operators.evaluation import run_benchmark, summarise
from tessergraph.operators.ignore import Ignore, apply_ignore
from tessergraph.operators.lexical import BM25Index, BM25Retriever, max_normalised
from tessergraph.operators.pagerank import adjacency, global_pagerank, personalized_pagerank
from tessergraph.operators.scoring import score_nodes, score_nodes_detailed
from tessergraph.operators.selection import first_fit, greedy, knapsack, select_subgraph, token_costs
from tessergraph.operators.semantic import DenseRetriever, EmbeddingRetriever, Retriever
from tessergraph.operators.traverse import k_hop, neighbours, shortest_path
from tessergraph.sources.artifacts import artifacts_path


def nodes(*ids, **more):
    return [{"id": i, **more} for i in ids]


def links(text):
    """``a>b c>d`` as edges."""
    return [dict(zip(("source", "target"), x.split(">"))) for x in text.split()]


def values(df, column="score"):
    return {r["id"]: r[column] for r in df.collect()}


AUTH = [
    dict(id="auth", label="AuthService", type="class", description="user authentication and login", importance=9.0, is_god=True, community=1),
    dict(id="login", label="login", type="function", description="log a user in", community=1),
    dict(id="logout", label="logout", type="function", description="end the session", community=1),
    dict(id="db", label="Database", type="class", description="connection pool", community=2),
    dict(id="ui", label="Button", type="class", description="draw a button", community=3),
]
AUTH_LINKS = [dict(source="auth", target="login"), dict(source="auth", target="logout", weight=0.9), dict(source="login", target="db", weight=0.8)]


@pytest.fixture(scope="module")
def auth(spark):
    return Graph.from_records(spark, AUTH, AUTH_LINKS)


def test_stems_and_tokens():
    assert [stem(w) for w in ("stats", "module", "authentication", "authenticate")] == ["stat", "modul", "authent", "authent"]
    assert tokenize("recalcularPlayerStats") == ["recalcular", "player", "stat", "recalcularplayerstat"]
    assert tokenize("HTTPServerError")[:3] == ["http", "server", "error"]
    assert tokenize("recalcular_player.stats-module") == ["recalcular", "player", "stat", "modul"]
    assert tokenize("player") == ["player"]
    assert tokenize("player player player") == ["player"] and len(tokenize("player player", stemmed=False)) == 2


def test_spark_tokens_equal_python_tokens(spark):
    texts = ["recalcularPlayerStats HTTPServer", "", None, "snake_case kebab-case x2Y", "Ünïcode naïve ABCdef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for stemmed in (True, False):
        got = {r["i"]: r["x"] for r in df.select("i", tokens(F.col("t"), stemmed).alias("x")).collect()}
        assert [got[i] for i in range(len(texts))] == [tokenize(t or "", stemmed) for t in texts]


def test_merging_and_defaults(spark):
    g = Graph.from_records(
        spark,
        [dict(id="a", label="old", community=3, is_god=True), dict(id="b", file_type="weird"), dict(id="a", label="new")],
        [dict(source="a", target="b", weight=1.0, extra=dict(k='"v"')), dict(source="a", target="b", weight=2.0), *links("a>zz")],
    )
    a = g.nodes.filter("id = 'a'").first()
    assert (a["label"], a["community"], a["is_god"], a["ord"]) == ("new", 3, True, 0)
    b = g.nodes.filter("id = 'b'").first()
    assert (b["label"], b["file_type"]) == ("b", "concept")
    e = g.edges.collect()
    assert len(e) == 1 and e[0]["weight"] == 2.0 and e[0]["extra"] == dict(k='"v"')


def test_cliques_and_induced(spark):
    g = Graph.from_records(spark, nodes("a", "b", "c"), links("a>b b>c"), [dict(id="h", nodes=["a", "b", "gone"], confidence_score=0.8), dict(id="one", nodes=["a"])])
    assert sorted(map(tuple, g.clique_edges().collect())) == [("a", "b", 0.4), ("b", "a", 0.4)]
    assert {(r["src"], r["dst"]): round(r["w"], 6) for r in adjacency(g).collect()} == {("a", "b"): 1.4, ("b", "a"): 0.4, ("b", "c"): 1.0}
    sub = g.induced(spark.createDataFrame([("a",), ("b",)], "id string"))
    assert sub.edges.count() == 1 and sub.nodes.count() == 2 and [r["id"] for r in sub.hyperedges.collect()] == ["one"]


def plain_bm25(texts, query):
    docs = {i: tokenize(t) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = dict.fromkeys(docs, 0.0)
    for term in set(tokenize(query)):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if f := d.count(term):
                out[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / mean))
    return out


def test_bm25(spark, tmp_path):
    texts = dict(n1="recalcularPlayerStats recompute player statistics after a match", n2="renderScoreboard draw the match scoreboard on screen", n3="loadConfig read settings from disk", n4="")
    index = BM25Index.build(spark.createDataFrame(list(texts.items()), "id string, text string"))
    for query in ("match", "player match match", "nothing here", ""):
        got, want = values(index.scores(query)), plain_bm25(texts, query)
        assert got == pytest.approx(want)
    assert values(index.normalised("player"))["n1"] == 1.0
    seeds = values(index.seeds("match", 2))
    assert set(seeds) == {"n1", "n2"} and sum(seeds.values()) == pytest.approx(1)
    many = index.matches(spark.createDataFrame([(1, "match"), (2, "settings")], "query_id int, text string"))
    assert {(r["query_id"], r["id"]) for r in many.collect()} == {(1, "n1"), (1, "n2"), (2, "n3")}
    index.save(str(tmp_path / "index"))
    assert values(BM25Index.load(spark, str(tmp_path / "index")).scores("match")) == pytest.approx(values(index.scores("match")))
    empty = BM25Index.build(spark.createDataFrame([], "id string, text string"))
    assert empty.scores("match").count() == 0


def plain_rank(ids, weights, restart, alpha=0.85, rounds=100, tol=1e-6):
    out = {i: sum(w for (u, _), w in weights.items() if u == i) for i in ids}
    r = dict(restart)
    for _ in range(rounds):
        lost = sum(r[i] for i in ids if not out[i])
        new = {i: (alpha * lost + 1 - alpha) * restart[i] for i in ids}
        for (u, v), w in weights.items():
            new[v] += alpha * r[u] * w / out[u]
        moved, r = sum(abs(new[i] - r[i]) for i in ids), new
        if moved < len(ids) * tol:
            break
    return r


@pytest.mark.parametrize("local", [0, 5_000_000])
def test_pagerank_equals_plain_version(spark, monkeypatch, local):
    monkeypatch.setattr(pagerank, "LOCAL_LINKS", local)
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(12)]
    pairs = {(rng.choice(ids), rng.choice(ids[:9])): rng.randint(1, 5) / 2 for _ in range(25)}
    g = Graph.from_records(spark, nodes(*ids), [dict(source=u, target=v, weight=w) for (u, v), w in pairs.items()])
    uniform = {i: 1 / 12 for i in ids}
    assert values(global_pagerank(g, max_iter=4, tol=0)) == pytest.approx(plain_rank(ids, pairs, uniform, rounds=4, tol=0))
    seeds = spark.createDataFrame([("n1", 1.0), ("n3", 3.0), ("zz", 9.0), ("n4", -1.0)], "id string, score double")
    restart = dict.fromkeys(ids, 0.0) | dict(n1=0.25, n3=0.75)
    assert values(personalized_pagerank(g, seeds, max_iter=4, tol=0)) == pytest.approx(plain_rank(ids, pairs, restart, rounds=4, tol=0))


def test_pagerank_of_tiny_graphs(spark):
    assert global_pagerank(Graph.from_records(spark, [])).count() == 0
    assert values(global_pagerank(Graph.from_records(spark, nodes("a")))) == dict(a=1.0)
    assert values(global_pagerank(Graph.from_records(spark, nodes("a", "b")))) == pytest.approx(dict(a=0.5, b=0.5))


def test_fusion(spark):
    table = lambda d: spark.createDataFrame(list(d.items()), "id string, score double")
    fused = values(fusion.fuse(table(dict(a=1.0, b=1.0, c=0.0)), table(dict(c=1.0)), global_pr=table(dict(a=0.2, b=1.0, c=1.0))))
    assert fused["b"] > fused["a"] and fused["c"] == 0
    rrf = values(fusion.reciprocal_rank_fusion([table(dict(a=0.9, b=0.1, c=0.05)), table(dict(b=0.95, a=0.2, c=0.1))]))
    assert min(rrf, key=rrf.get) == "c" and rrf["a"] == pytest.approx(1 / 61 + 1 / 62)
    assert values(max_normalised(table(dict(a=2.0, b=1.0)))) == dict(a=1.0, b=0.5)
    assert values(max_normalised(table(dict(a=0.0)))) == dict(a=0.0)
    rows = [(r, f"n{i:03}", float(i * 7 % 10)) for r in (0, 1) for i in range(300)] + [(2, "x", 1.0)]
    got = {(r["ranking"], r["id"]): r["rank"] for r in fusion.ranked(spark.createDataFrame(rows, "ranking int, id string, score double")).collect()}
    assert got == {(r, i): k for q in (0, 1, 2) for k, (r, i, _) in enumerate(sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1])), 1)}
    prior = fusion.importance_prior(Graph.from_records(spark, [dict(id="a", importance=2.0), dict(id="b", importance=5.0), dict(id="g", importance=0.1, is_god=True)]))
    assert values(prior) == dict(a=0.4, b=1.0, g=1.0)


def test_scores(spark, auth):
    s = values(score_nodes(auth, "user login authentication", max_iter=20))
    assert max(s, key=s.get) in ("auth", "login") and s["ui"] == 0 and len(s) == 5
    assert set(values(score_nodes(auth, "щзх")).values()) == {0.0}
    semantic = spark.createDataFrame([("ui", 1.0), ("db", 0.5)], "id string, score double")
    d = score_nodes_detailed(auth, "login", "local", semantic=semantic, max_iter=5).collect()
    assert {r["id"] for r in d if r["final"] > 0} >= {"ui", "login"} and all(r["semantic"] == 1 for r in d if r["id"] == "ui")


def test_embeddings(spark, auth):
    # Local, so that it travels to the workers by value.
    def embed(texts):
        return [[float("auth" in t.lower()), float("db" in t.lower()), float("button" in t.lower())] for t in texts]

    s = values(EmbeddingRetriever(embed).score(auth, "auth"))
    assert s["auth"] == 1 and s["ui"] == 0
    assert isinstance(BM25Retriever(), Retriever) and isinstance(DenseRetriever(embed_fn=embed), Retriever)
    with pytest.raises(ValueError):
        DenseRetriever("other")


def chain(spark, n=12):
    return Graph.from_records(spark, [{"id": f"n{i}", "label": f"node{i}", "description": f"does thing number {i} with widgets", "community": i % 3} for i in range(n)], links(" ".join(f"n{i}>n{i + 1}" for i in range(n - 1))))


def test_selection_keeps_the_budget(spark):
    g = chain(spark)
    scores = spark.createDataFrame([(f"n{i}", 1 - i / 20) for i in range(12)], "id string, score double")
    cost = values(token_costs(g), "cost")
    for budget in (0, 10, 50, 100, 10_000):
        for strategy in ("greedy", "exact"):
            s = select_subgraph(g, scores, budget, strategy)
            ids = [r["id"] for r in s.chosen.collect()]
            assert sum(cost[i] for i in ids) == s.stats["tokens_used"] <= max(0, budget)
            assert s.graph.nodes.count() == len(ids) == s.stats["nodes_selected"]
    assert s.stats["coverage_pct"] == 100.0


def slow_greedy(ids, rel, cost, words, community, near, budget, lam=0.3, mu=0.2):
    left, out, rest = budget, [], set(range(len(ids)))
    sim = lambda a, b: 0.5 * (community[a] is not None and community[a] == community[b]) + (0.5 * len(set(words[a]) & set(words[b])) / len(set(words[a]) | set(words[b])) if words[a] and words[b] else 0)
    while True:
        best = None
        for i in sorted(rest, key=lambda i: ids[i]):
            if cost[i] <= left:
                gain = (rel[i] - lam * max((sim(i, j) for j in out), default=0) + mu * any(ids[i] in near[j] or ids[j] in near[i] for j in out)) / cost[i]
                if best is None or gain > best[0]:
                    best = (gain, i)
        if best is None:
            break
        out.append(best[1])
        rest.discard(best[1])
        left -= cost[best[1]]
    top = max(range(len(ids)), key=lambda i: rel[i])
    return [top] if rel[top] > sum(rel[i] for i in out) else out


def test_greedy_equals_slow_version():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 14)
        ids = rng.sample([f"x{i}" for i in range(30)], n)
        rel, cost = [rng.choice([0.1, 0.5, 1.0, rng.random()]) for _ in ids], [rng.randint(3, 20) for _ in ids]
        words, community = [rng.sample("abcdefg", rng.randint(0, 4)) for _ in ids], [rng.choice([None, 1, 2]) for _ in ids]
        pairs = {(a, b) for a in ids for b in ids if a < b and rng.random() < 0.2}
        near = [[b for b in ids if (a, b) in pairs or (b, a) in pairs] for a in ids]
        args = (ids, rel, cost, words, community, near, rng.randint(5, 120))
        assert greedy(*args) == slow_greedy(*args)


def test_knapsack_and_first_fit():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 9)
        value, cost, budget = [rng.randint(1, 9) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)], rng.randint(0, 25)
        best = max(sum(v for i, v in enumerate(value) if m >> i & 1) for m in range(1 << n) if sum(c for i, c in enumerate(cost) if m >> i & 1) <= budget)
        took = knapsack(value, cost, budget)
        assert sum(value[i] for i in took) == best and sum(cost[i] for i in took) <= budget
    assert first_fit([6, 5, 1], [3, 3, 1], 4) == [0, 2]


def test_knapsack_in_halves_is_exact(monkeypatch):
    rng = random.Random(3)
    for _ in range(20):
        n, budget = rng.randint(2, 40), rng.randint(5, 60)
        value, cost = [rng.random() for _ in range(n)], [rng.randint(1, 12) for _ in range(n)]
        whole = knapsack(value, cost, budget)
        with monkeypatch.context() as m:
            m.setattr(selection, "DP_CELLS", 50)
            parts = knapsack(value, cost, budget)
        assert sum(value[i] for i in parts) == pytest.approx(sum(value[i] for i in whole)) and sum(cost[i] for i in parts) <= budget


def test_best_single_item_survives():
    assert greedy(["p", "q"], [0.6, 1.0], [5, 50], [[], []], [None, None], [[], []], 52) == [1]


def test_repair_joins_parts(spark):
    g = Graph.from_records(spark, nodes("n0", "n1", "n2"), links("n0>n1 n1>n2"))
    scores = spark.createDataFrame([("n0", 1.0), ("n1", 0.0), ("n2", 1.0)], "id string, score double")
    cost = values(token_costs(g), "cost")
    total = sum(cost.values())
    assert {r["id"] for r in select_subgraph(g, scores, total, connected=True).chosen.collect()} == {"n0", "n1", "n2"}
    assert {r["id"] for r in select_subgraph(g, scores, total - 1, connected=True).chosen.collect()} == {"n0", "n2"}


def test_walks(spark):
    g = Graph.from_records(spark, nodes(*"abcdefz"), links("a>b b>c c>d d>e e>f a>c"))
    assert values(k_hop(g, spark.createDataFrame([("c",), ("none",)], "id string"), 1), "distance") == dict(c=0, b=1, d=1, a=1)
    assert shortest_path(g, "a", "d") == (["a", "c", "d"], True)
    assert shortest_path(g, "d", "a") == (["d", "c", "a"], False)
    assert shortest_path(g, "a", "z") is None and shortest_path(g, "a", "a") == (["a"], True)
    with pytest.raises(KeyError):
        shortest_path(g, "a", "none")
    assert {(r["direction"], r["id"]) for r in neighbours(g, "c").collect()} == {("in", "a"), ("in", "b"), ("out", "d")}


def test_diff(spark):
    old = Graph.from_records(spark, [*nodes("a", "c"), dict(id="b", description="x")], links("a>b b>c"))
    new = Graph.from_records(spark, [*nodes("a", "d"), dict(id="b", description="y", importance=2.0)], links("a>b b>d"))
    d = diff_graphs(old, new)
    assert {(r["kind"], r["id"] or f"{r['src']}>{r['dst']}") for r in d.collect()} == {("added", "d"), ("removed", "c"), ("modified", "b"), ("added", "b>d"), ("removed", "b>c")}
    assert {r["id"] for r in affected_subgraph(d, new, 0).nodes.collect()} == {"b", "d"}
    assert diff_graphs(old, old).count() == 0


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("tests/", ["tests/a.py", "x/tests/a.py"], ["tests", "mytests/a"]), ("/src", ["src", "src/a"], ["x/src"]), ("a/*/c", ["a/b/c", "a/b/c/d"], ["a/b/x/c"]),
        ("a/**/c", ["a/c", "a/b/x/c"], ["b/a/c"]), ("**/x", ["x", "a/b/x"], ["xx"]), ("f?o", ["fao"], ["f/o", "faao"]), ("[a-c]x", ["ax"], ["dx"]), ("[!a]x", ["bx"], ["ax"]), ("\\#x", ["#x"], ["x"]), ("node:test", ["node:test"], ["node:tests"]),
    ],
)
def test_ignore_patterns(spark, pattern, hits, misses):
    rule = Ignore.from_lines(["# comment", "", pattern])
    assert [rule.matches(p) for p in hits + misses] == [True] * len(hits) + [False] * len(misses)
    df = spark.createDataFrame([(p,) for p in hits + misses], "p string")
    assert {r["p"] for r in df.filter(rule.column(F.col("p"))).collect()} == set(hits)


def test_ignore_negation_and_graph(spark):
    rule = Ignore.from_lines(["*.py", "!keep.py"])
    assert rule.matches("a.py") and not rule.matches("keep.py")
    g = Graph.from_records(spark, [dict(id="m", source_file="src/main.py"), dict(id="k", source_file="keep.py"), dict(id="n")], links("m>k k>n"))
    assert {r["id"] for r in apply_ignore(g, rule).nodes.collect()} == {"k", "n"}
    assert apply_ignore(g, None) is g


def test_benchmark(spark, auth):
    rows = run_benchmark(auth, ["login", "щзх"], (20, 1000), max_iter=10)
    got = {(r["query"], r["budget"]): r for r in rows.collect()}
    assert len(got) == 4 and got["login", 1000]["recall_at_budget"] == 1.0 and got["login", 20]["recall_at_budget"] <= 1.0
    assert got["login", 20]["token_savings"] >= got["login", 1000]["token_savings"]
    assert got["щзх", 1000]["recall_at_budget"] == 0.0
    assert summarise(rows.limit(0)).first()["mean_recall"] == 0.0


def test_similarity_and_counts(spark):
    df = spark.createDataFrame([("a_b c", "A b", 1, 1), ("", "x", None, None), ("x", "x", 1, 2)], "a string, b string, c int, d int")
    got = [r[0] for r in df.select(similarity(word_set(F.col("a")), word_set(F.col("b")), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([0.5 + 0.5 * 2 / 3, 0.0, 0.5])
    assert [r[0] for r in df.select(estimated_tokens(F.col("a"))).collect()] == [4, 0, 1]
    assert callable(bpe_tokens)


def test_fingerprint(spark, auth):
    again = Graph.from_records(spark, AUTH[::-1], AUTH_LINKS)
    assert auth.fingerprint() == again.fingerprint()
    other = Graph.from_records(spark, [{**AUTH[0], "description": "changed"}, *AUTH[1:]], AUTH_LINKS)
    assert auth.fingerprint() != other.fingerprint()
    # Whatever changes a cost or a rank changes the key of what is kept.
    path = lambda p: Graph.from_records(spark, [{**AUTH[0], "extra": {"file_path": json.dumps(p)}}, *AUTH[1:]], AUTH_LINKS)
    short, long = path("a.py"), path("a/much/longer/path/to/the/file.py")
    assert values(token_costs(short), "cost") != values(token_costs(long), "cost") and short.fingerprint() != long.fingerprint()
    keys = {artifacts_path(auth, "x", 1), artifacts_path(auth, "x", 100), artifacts_path(short, "x", 100)}
    assert len(keys) == 3


def test_contenders_and_neighbours_of_candidates_only(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(60)]
    g = Graph.from_records(spark, [dict(id=i, label=rng.choice(["", "a b", "a b c d"]), description="") for i in ids], [dict(source=a, target=rng.choice(ids)) for a in ids], [dict(id=f"h{i}", nodes=rng.sample(ids, 4)) for i in range(20)])
    costs = {r["id"]: r["cost"] for r in token_costs(g).collect()}
    score = {i: rng.choice([0.01, 0.1, 0.2, 0.2, 0.3, 0.7]) for i in ids}
    s = spark.createDataFrame([("q", i, x) for i, x in score.items()], "query string, id string, score double")
    budgets = spark.createDataFrame([("q", 45), ("q", 90)], "query string, budget int")
    fit = [i for i in ids if score[i] >= 0.05]
    for strategy, plain in (("exact", knapsack), ("density", first_fit)):
        kept = selection.contenders(g, s, token_costs(g), budgets, strategy)
        assert kept.count() < 2 * len(fit)
        got = selection.select_many(g, s, budgets, strategy).orderBy("budget", "place").collect()
        assert [(r["budget"], r["id"]) for r in got] == [(b, fit[i]) for b in (45, 90) for i in plain([score[i] for i in fit], [costs[i] for i in fit], b)]
    # Only candidates are paired, whatever else their hyperedges have.
    monkeypatch.setattr(Graph, "clique_edges", lambda self: pytest.fail("all pairs"))
    for few in (0, 1000):
        monkeypatch.setattr(selection, "FEW", few)
        near = {r["id"]: set(r["near"] or ()) for r in selection.candidates(g, s, token_costs(g), budgets.filter("budget = 90")).collect()}
        want = {i: set() for i in fit}
        for a, b in [(r["src"], r["dst"]) for r in g.edges.collect()] + [(a, b) for r in g.hyperedges.collect() for a in r["nodes"] for b in r["nodes"]]:
            if a != b and a in want and b in want:
                want[a].add(b)
                want[b].add(a)
        assert near == want


@pytest.mark.parametrize("size", [3, 1000])
def test_pagerank_in_blocks_equals_plain_version(spark, monkeypatch, size):
    monkeypatch.setattr(pagerank, "LOCAL_LINKS", 0)
    monkeypatch.setattr(pagerank.blocks, "BLOCK_LINKS", size)
    # Cliques are not written out as pairs.
    monkeypatch.setattr(pagerank, "adjacency", lambda graph: pytest.fail("all pairs"))
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(14)]
    pairs = {(rng.choice(ids[:11]), rng.choice(ids[:12])): rng.randint(1, 5) / 2 for _ in range(25)}
    hyper = [dict(id=f"h{i}", nodes=[rng.choice([*ids[:9], "gone"]) for _ in range(rng.randint(1, 5))], confidence_score=rng.choice([0.0, 0.5, 1.0])) for i in range(6)]
    g = Graph.from_records(spark, nodes(*ids), [dict(source=u, target=v, weight=w) for (u, v), w in pairs.items()], hyper)
    for h in hyper:
        for i, a in enumerate(h["nodes"]):
            for j, b in enumerate(h["nodes"]):
                if i != j and "gone" not in (a, b) and h["confidence_score"]:
                    pairs[a, b] = pairs.get((a, b), 0) + h["confidence_score"] / (len(h["nodes"]) - 1)
    seeds = spark.createDataFrame([("n1", 1.0), ("n3", 3.0), ("zz", 9.0), ("n4", -1.0)], "id string, score double")
    restart = dict.fromkeys(ids, 0.0) | dict(n1=0.25, n3=0.75)
    links = pagerank.links_of(g)
    for rounds in (0, 1, 6):
        assert values(global_pagerank(g, max_iter=rounds, tol=0, links=links)) == pytest.approx(plain_rank(ids, pairs, {i: 1 / 14 for i in ids}, rounds=rounds, tol=0))
        got, want = values(personalized_pagerank(g, seeds, max_iter=rounds, tol=0, links=links)), plain_rank(ids, pairs, restart, rounds=rounds, tol=0)
        assert got == pytest.approx(want) and {i for i in ids if got[i] > 0} == {i for i in ids if want[i] > 0}


def test_term_stats_and_top_matches_equal_plain_versions(spark, monkeypatch):
    from tessergraph.operators import lexical

    rng = random.Random(3)
    words = ["running", "runs", "ran", "blue", "ring", "fooBar", "x1", "asia"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for i in range(50)} | {50: None, 51: "blue blue ring", 52: "blue blue ring"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    stats = {r["term"]: (r["df"], r["tf"]) for r in lexical.term_stats(docs.select(tokens(F.col("text"), False).alias("t"))).collect()}
    plain = {i: tokenize(t or "", False) for i, t in texts.items()}
    assert stats == {w: (sum(w in t for t in plain.values()), sum(t.count(w) for t in plain.values())) for t in plain.values() for w in t}
    asked = {7: "blue ring ring", 8: "running fooBar", 9: "nothing", 3: "x1 asia ran"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    for stemmed, digits in ((True, None), (False, 8)):
        index = BM25Index.build(docs, stemmed=stemmed).matches(queries).collect()
        want = {}
        for q in asked:
            found = sorted((-(r["score"] if digits is None else round(r["score"], digits)), r["id"]) for r in index if r["query_id"] == q)
            want |= {(q, k): (i, pytest.approx(-s)) for k, (s, i) in enumerate(found[:4], 1)}
        # The tasks' own index, in small slices, and the general one.
        for cells, sent in ((4_000_000, 1_000_000), (7, 1_000_000), (7, 0)):
            monkeypatch.setattr(lexical, "CELLS", cells)
            monkeypatch.setattr(lexical, "SENT_TERMS", sent)
            got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in lexical.top_matches(docs, queries, 4, stemmed, digits).collect()}
            assert got == want


def test_large_graphs_are_not_paired_or_joined_in_vain(spark, monkeypatch):
    from tessergraph import graph as graphs
    from tessergraph.operators.ignore import ignored

    ids = [f"n{i}" for i in range(40)]
    g = Graph.from_records(spark, nodes(*ids), [dict(source=a, target=ids[i * 7 % 40]) for i, a in enumerate(ids)], [dict(id=f"h{i}", nodes=ids[i : i + 4]) for i in range(0, 30, 3)]).stored()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rules = Ignore.from_lines(["n1*", "!n12"])
    assert {r["id"] for r in ignored(g, rules).collect()} == {"n1", "n10", "n11", *(f"n{i}" for i in range(13, 20))}
    assert "Exchange" not in plan(ignored(g, rules)) and "Exchange" not in plan(apply_ignore(g, rules).nodes)
    # Pairs are made after the shuffle, where their sources are together.
    for df in (g.clique_edges().groupBy("src", "dst").agg(F.sum("w")), adjacency(g)):
        text = plan(df)
        assert "hashpartitioning(src" in text and "hashpartitioning(src#0, dst" not in text and not any("hashpartitioning(src" in x and "dst" in x.partition("hashpartitioning(")[2] for x in text.splitlines())
    monkeypatch.setattr(graphs, "SORTED", 5)
    kept = spark.createDataFrame([(i,) for i in ids[:20]], "id string")
    assert "9), REPARTITION_BY_NUM" in plan(g.induced(kept).edges)
    assert {(r["src"], r["dst"]) for r in g.induced(kept).edges.collect()} == {(a, ids[i * 7 % 40]) for i, a in enumerate(ids[:20]) if i * 7 % 40 < 20}
