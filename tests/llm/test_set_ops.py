"""Near-duplicates, neighbours, mixing, URL rules, components and the pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.ann import AnnOptions, balanced_parts, learn, nearest, neighbour_graph
from helixframe.llm.components import components
from helixframe.llm.embed_dedup import CrossPolytopeOptions, embedding_dedup, hadamard
from helixframe.llm.minhash import MinHashOptions, drop_near_duplicates, least_matches, minhash_dedup
from helixframe.llm.mixing import MixOptions, mix_sources, mixed_documents
from helixframe.llm.url_filter import filter_urls
from helixframe.llm.workspace import Workspace, shared_dir

DIR = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles_of(t, k):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_dedup(rows, k):
    sets = {i: shingles_of(t, k) for i, t in rows}
    got = Sets(sets)
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                got.join(i, j)
    return {i: (len(sets[i]), got.find(i)) for i in ids}


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    passage = [word() for _ in range(40)]
    texts = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([1, 3, 60, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += passage
            texts.append(" ".join(t))
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_equals_brute_force(spark, k):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("key", F.lit(1.5))
    got = minhash_dedup(df, options=MinHashOptions(shingle=k, block=16)).collect()
    want = brute_dedup(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_chain_below_threshold(spark):
    """Neighbours in a chain link, its ends do not; and near copies under the threshold stay apart."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    chain = []
    for i in range(30):
        chain.append((100 - i, " ".join(base)))
        base[i * 3 % 100] = f"z{i}"
    rows = chain + [(1000 + i, " ".join([f"v{j}" if rng.random() < 0.87 else f"u{i}_{j}" for j in range(120)])) for i in range(40)]
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), options=MinHashOptions(shingle=2, block=8)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_dedup(rows, 2)


def test_minhash_odd_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A  b\tc d"), (None, "a b c d"), (4, None), (5, ""), (6, " \n"), (8, "one"), (9, "ONE"), (None, None), (10, "lorem ipsum dolor " * 30_000)]
    got = sorted(map(repr, map(tuple, minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), options=MinHashOptions(shingle=2)).collect())))
    want = [(7, 3, 3, False), (7, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (8, 1, 8, True), (9, 1, 8, False), (None, 0, None, False), (10, 3, 10, True)]
    assert got == sorted(map(repr, want))
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_repeated_ids(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (4, "p q r s t"), (5, "p q r s t"), (5, "k l m n o"), (5, "f g h i j")]
    for parts in (1, 5):
        got = sorted(tuple(r) for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), options=MinHashOptions(shingle=2)).collect())
        assert got == [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 4, True), (5, 4, 4, False), (5, 4, 5, True), (5, 4, 5, True)]


def test_drop_near_duplicates(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (4, "p q r s t"), (5, "p q r s t"), (5, "k l m n o"), (5, "f g h i j")]
    rows += [(5, "f g h i j"), (None, "A b c d e"), (None, "null id here"), (None, "NULL id here"), (None, "null  id here"), (6, None), (6, None), (None, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("doc", F.lit(2.0))
    for parts in (1, 4):
        out = drop_near_duplicates(df.repartition(parts), options=MinHashOptions(shingle=2))
        assert out.columns == df.columns
        got = sorted(((r["doc_id"], (r["text"] or "").lower().replace("  ", " ")) for r in out.collect()), key=repr)
        want = [(1, "a b c d e"), (1, "v w x y z"), (4, "p q r s t"), (5, "k l m n o"), (5, "f g h i j"), (None, "null id here"), (6, ""), (6, ""), (None, ""), (7, " ")]
        assert got == sorted(want, key=repr)
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_minhash_blocks_by_shingles(spark):
    """Long documents of one bucket are compared in blocks of few shingles, with the same links."""
    rng = random.Random(12)
    passage = [f"p{j}" for j in range(400)]
    rows = []
    for i in range(24):
        own = [f"q{i % 12}_{j}" for j in range(300)]
        own[rng.randrange(300)] = f"r{i}"
        rows.append((i, " ".join(passage + own)))
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), options=MinHashOptions(block_shingles=1500)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_dedup(rows, 5)


def test_posterior_bound():
    """Pairs at the threshold are given up in about as many cases as asked for."""
    least = least_matches(128, 0.8, 1e-3)
    draws = np.random.default_rng(0).binomial(128, 0.8, 200_000)
    assert (draws < least).mean() < 2e-3 and least > 80


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 360)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long"), Workspace(spark, "t")).collect()}
    want = Sets({x for p in links for x in p})
    for a, b in links:
        want.join(a, b)
    assert all(want.find(n) == c for n, c in got.items()) and {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_hadamard():
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(hadamard(x), x @ h / 4)


def vectors(seed=3, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(60, 200):  # near copies of row 5, around the threshold
        x[i] = x[5] + rng.normal(size=dim) * np.linalg.norm(x[5]) / np.sqrt(dim) * rng.choice([0.05, 0.2, 0.3])
    x[210:215] = x[9]
    x[220] = 3 * x[9]
    return x


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    return s


def test_embedding_dedup_equals_brute_force(spark):
    x = vectors()
    df = spark.createDataFrame([(1000 - i, [float(v) for v in r], "q") for i, r in enumerate(x)], "vec_id long, embedding array<double>, id string")
    s = brute_links(x)
    want = Sets(range(len(x)))
    comp = Sets([1000 - i for i in range(len(x))])
    for a, b in zip(*np.nonzero(s), strict=True):
        comp.join(1000 - a, 1000 - b)
    for block in (1024, 16):
        got = embedding_dedup(df, options=CrossPolytopeOptions(block=block)).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1000 - i: (int(s[i].sum()), comp.find(1000 - i)) for i in range(len(x))}
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    del want


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-300, 0.0]), (12, [0.0, 1.0]), (12, [0.0, -1.0]), (13, [0.0, -2.0])]
    got = sorted(map(repr, map(tuple, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    want = [(1, 3, 1, True), (1, 3, 1, True), (8, 3, 1, False), (11, 3, 1, False), (None, 0, None, False)] + [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 9, 10, 12)] + [(12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted(map(repr, want))
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 2
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r], i) for i, r in enumerate(x)], "vec_id long, embedding array<double>, part int")
    got = nearest(df, F.col("vec_id") % 100 == 0, options=AnnOptions(block=128)).collect()
    hit = 0
    for q in range(0, 3000, 100):
        far = np.linalg.norm(x - x[q], axis=1)
        far[q] = np.inf
        best = set(np.lexsort((np.arange(3000), far))[:10].tolist())
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and np.allclose([m[2] for m in mine], [far[m[1]] for m in mine])
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hit += len(best & {m[1] for m in mine})
    assert hit / 300 >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (200, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0, 1.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_repeated_ids_and_lengths(spark):
    """Rows that share an id but not the vector are all candidates, and each vector length is searched."""
    rows = [(0, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 3.0]), (100, [5.0, 0.0]), (100, [6.0, 0.0]), (200, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("part", F.lit(1)).withColumn("v", F.lit(None).cast("string"))
    for options in (AnnOptions(), AnnOptions(learned=1, block=2, queries=1)):
        got = nearest(df, F.col("vec_id") % 100 == 0, options=options).collect()
        of = lambda q: [(r["vec_id"], round(r["score"], 6)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]  # noqa: E731, B023
        assert of(0) == [(7, 1.0), (7, 2.0), (100, round(17**0.5, 6)), (100, round(26**0.5, 6))]
        assert of(200) == [(8, 2.0)] and len(of(100)) == 8 and (100, 1.0) in of(100)


def test_parts_grow_with_the_rows():
    x = np.random.default_rng(4).normal(size=(3000, 6))
    assert learn(x, AnnOptions(steps=5), 3000).weights.shape[1] == 16
    assert learn(x, AnnOptions(steps=5), 100_000).weights.shape[1] == 25
    assert learn(x, AnnOptions(steps=5), 10**9).weights.shape[1] == 60


def test_recall_of_the_registered_query(spark):
    """op5 on its whole table against brute force: recall, exact scores, order, ties."""
    from helixframe.llm.queries import op5_nearest_neighbours

    folder = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding.to_list()).astype(np.float64)
    got = {}
    for r in op5_nearest_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert np.allclose([f[2] for f in found], [far[ids == f[1]][0] for f in found], rtol=1e-14)
        hit += len({int(i) for i in ids[np.lexsort((ids, far))[:10]]} & {f[1] for f in found})
    assert hit / (10 * len(got)) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1600, 8))
    x[:800] += 6
    part = balanced_parts(x, neighbour_graph(x, 10), 8, rng)
    assert np.bincount(part, minlength=8).max() <= 1.06 * 200 and np.bincount(part, minlength=8).min() > 100


def mix_oracle(rows):
    """Targets by the words of the definition: cap, share the excess out again, until none is above."""
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return sizes, {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["b", "a", "É", None, "a", "a", "z", "tiny"][: 7 + (i % 50 == 0)]), " ".join("x" * rng.randint(1, 30))) for i in range(900)]
    rows += [(7000 + i % 3, "b", "same words here") for i in range(60)] + [(8001, None, None), (None, "z", "null id"), (8002, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mix_sources(df).collect()
    sizes, target = mix_oracle(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["mix_source"]] and abs(r["target"] - target[r["mix_source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["mix_source"]] = taken.get(r["mix_source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert sorted(map(repr, map(tuple, mix_sources(df.repartition(5)).collect()))) == sorted(map(repr, map(tuple, got)))
    for options in (MixOptions(slots=4, open_rows=3), MixOptions(slots=16, open_rows=1)):
        assert sorted(map(repr, map(tuple, mix_sources(df, options=options).collect()))) == sorted(map(repr, map(tuple, got)))
    odd = df.withColumn("d", F.lit(1)).withColumn("tag", F.lit("x")).withColumn("took", F.lit(1)).withColumn("mix_source", F.lit("y"))
    copies = mixed_documents(odd)
    assert copies.columns == odd.columns
    words = {}
    for r in copies.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(words_of(r["text"]))
    assert words == {s: n for s, n in taken.items() if n}
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(df.where("text = ''")).collect()[0]["taken"] == 0


def test_mixing_inclusion_odds(spark):
    """Documents are taken beyond their certain copies with chances in proportion to the digits of their sizes."""
    sizes = [1, 3, 7, 15, 31]
    rows = [(i, "a" if i < 500 else "b", f"w{i} " * sizes[i % 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counts, wanted = np.zeros(1000), None
    for seed in range(10):
        got = mix_sources(df, options=MixOptions(seed=str(seed))).collect()
        for r in got:
            counts[r["doc_id"]] += r["taken"] / r["size"]
        words = sum(r["taken"] for r in got if r["mix_source"] == "b")
        wanted = next(r["target"] for r in got if r["mix_source"] == "b")
        assert abs(words - wanted) < 2
    mean = np.array([[counts[[i for i in range(500 * s, 500 * s + 500) if i % 5 == k]].mean() / 10 for k in range(5)] for s in (0, 1)])
    for s, target in enumerate((11_400 * 5 / 7, 11_400 * 2 / 7)):
        copies = target // 5700
        scale = (target - copies * 5700) / sum((k + 1) * sizes[k] * 100 for k in range(5))
        assert np.allclose(mean[s], [copies + scale * (k + 1) for k in range(5)], atol=0.06)
    del wanted


def test_mixing_takes_long_documents_for_certain(spark):
    """Where a chance would be above 1 the document is taken whole, and the rest is shared among the others."""
    rows = [(i, "a", f"x{i} " * 1000) for i in range(50)] + [(100 + i, "a", f"y{i}") for i in range(5000)] + [(10_000 + i, "b", f"z{i} " * 110) for i in range(165)]
    got = {r["doc_id"]: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    taken = sum(r["taken"] for r in got.values() if r["mix_source"] == "a")
    assert abs(taken - got[0]["target"]) < 1 and all(got[i]["taken"] == 1000 for i in range(50))
    assert abs(sum(got[100 + i]["taken"] for i in range(5000)) - (got[0]["target"] - 50_000)) < 1


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.search("[/?#]", rest)
        host = rest[: m.start()] if m else rest
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7198#x", "https://example.com/en/8", "x://com/en/", "http://net/de/", "http://q.example.net/de/81?y", "http://notexample.net/de/81", "http://example.org/es", "http://example.org/es/?a=://b", "http://org?/es/", "nothing", "", None, "http://", "://com/en/z", "http://a\n.com/en/", "http://É.com/en/x://y", "http://com./en/", "http://x..com/en/1", "a" * 50 + "://" + "b." * 3000 + "com/en/" + "c" * 50_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(3)).withColumn("rule", F.lit("r"))
    got = sorted(map(repr, map(tuple, filter_urls(df, RULES).collect())))
    assert got == sorted(repr((i, *brute_url(u))) for i, u in rows)
    assert {r["verdict"] for r in filter_urls(df, []).collect()} == {"allow"} and filter_urls(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize("name", ["op3_url_filter", "op8_mixing"])
def test_queries_with_sql(spark, name):
    from helixframe.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(map(tuple, got.select(*names).collect())) == plain(want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    names = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    ws = Workspace(spark, "stages")
    stage = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    kept = docs
    for name, f in corpus_pipeline.STAGES[:2]:
        out = ws.table(f(spark, kept, DIR))
        assert out.columns == names and out.exceptAll(kept).count() == 0
        kept = out
        del name
    one = ws.table(stage["MinHash near-dedup"](spark, kept, DIR))
    want = brute_dedup([(r["doc_id"], r["text"]) for r in kept.collect()], 5)
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in want.items() if i == c} and one.columns == names
    mixed = ws.table(stage["mixing sources to target weights"](spark, one, DIR))
    assert mixed.columns == names and mixed.count() == sum(r["taken"] // r["size"] for r in mix_sources(one).collect() if r["size"])
    assert mixed.select("doc_id").distinct().exceptAll(one.select("doc_id")).count() == 0
    last = stage["BPE encoding and decoding"](spark, mixed, DIR)
    assert last.count() == mixed.count() and set(before) >= {r["doc_id"] for r in last.collect()}


def test_pipeline_odd_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "the then there", None, "s", None), (9002, "the then there", None, "s", None), (None, "this that with from", "en", "s", 3)], docs.schema)
    for source in (docs.limit(60).unionByName(odd), odd.limit(0)):
        kept = source
        ws = Workspace(spark, "odd")
        for _, f in corpus_pipeline.STAGES:
            kept = ws.table(f(spark, kept, DIR))
        assert "ids" in kept.columns


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    ws = Workspace(spark, "w")
    ws.table(spark.range(3))
    assert ws.finish(spark.range(5)).count() == 5
