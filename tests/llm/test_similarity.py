"""Near duplicates and nearest neighbours against brute force, and odd rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.llm import ann, common, graph, jaccard, near_vectors, shingles

DOCS = "doc_id long, text string, batch string, cls string, n string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
            rows.append(text if r.random() < 0.7 else text.upper() if r.random() < 0.3 else f"{text}\n{shared}" if g % 2 else text + " end")
    rows += ["", None, "  \t", "Q", "q", "a b c d", "A B C D", "a b c d e", shared, shared.replace("w1 ", "w2 "), "tail " * 3000, "tail " * 3001]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("leaf", [jaccard.LEAF_BYTES, 2000])
def test_components_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF_BYTES", leaf)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 4000)
    monkeypatch.setattr(jaccard, "RANGE_HASHES", 500)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS)
    sets = {i: shingle_set(t) for i, t in rows}
    want = components(list(sets), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_on_odd_rows(spark):
    rows = [(1, None), (1, None), (2, "same text of five words"), (2, "same text of five words"), (None, "same text of five words"), (None, None), (3, ""), (9, "Same Text of five WORDS")]
    got = jaccard.jaccard_components(spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, 0, 1), (1, 0, 1), (2, 1, 2), (2, 1, 2), (None, 1, 2), (None, 0, None), (3, 0, 3), (9, 1, 2)])
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_tree_links_join_what_brute_force_joins():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(15):
        base = r.integers(0, 1 << 60, 150).astype(np.uint64)
        sets += [np.unique(np.where(r.random(150) < share, r.integers(0, 1 << 60, 150).astype(np.uint64), base)) for share in (0, 0.02, 0.06, 0.1, 0.15, 0.3)]
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    links = jaccard.tree_links(sets)
    assert all(linked(i, j) for i, j in links)
    found = set(map(frozenset, links))
    assert components(range(len(sets)), linked) == components(range(len(sets)), lambda i, j: frozenset((i, j)) in found)


def test_packed_keys_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 5, 1000):
        keys = np.unique(r.integers(0, 1 << 50, n).astype(np.uint64))
        assert (jaccard.unpack(jaccard.pack(keys)) == keys).all()


def test_shingles_do_not_depend_on_batches():
    texts = [t for _, t in corpus()]
    together = shingles.shingle_sets(texts)
    assert all((a == shingles.shingle_sets([t])[0]).all() for a, t in zip(together, texts, strict=True))
    assert [len(s) for s in together] == [len(shingle_set(t)) for t in texts]


def test_graph_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(900, i) for i in range(901, 960)] + [(7, 7)]
    want = components(sorted({x for e in links for x in e}), lambda i, j: (i, j) in {tuple(sorted(e)) for e in links})
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if sum(v == c for v in want.values()) > 1}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(8)
    x = r.standard_normal((300, 16))
    for i in range(0, 90, 3):
        x[i + 1] = x[i] + 0.1 * r.standard_normal(16)
        x[i + 2] = 3 * x[i + 1] + 0.2 * r.standard_normal(16)
    x[200:260] = x[200] + 0.05 * r.standard_normal((60, 16))
    x[290:295] = x[290]
    return x.astype(np.float32)


BAD = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (1100, []), (1120, [1.0])]
SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string"


def frame(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors())]
    return spark.createDataFrame([(i, v, 1, "x", "x") for i, v in [*rows, rows[40], *BAD]], SCHEMA)


def test_nearest(spark):
    x = vectors().astype(np.float64)
    got = collections.defaultdict(list)
    for r in ann.nearest(frame(spark)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert all(f[2] == pytest.approx(s[f[1]], rel=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]
        hit += len({i for _, i in best} & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(frame(spark).where("vec_id in (0, 1, 2, 1000)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert ann.nearest(frame(spark).limit(0)).count() == 0 and ann.nearest(frame(spark).where("vec_id >= 1000 and vec_id < 1100")).count() == 0


def test_visiting_all_cells_is_exact(spark):
    x = vectors().astype(np.float64)
    for r in ann.nearest(frame(spark).where("vec_id < 300").dropDuplicates(["vec_id"]), visit=2.0).where("rank <= 3").collect():
        s = x @ x[r["query_id"]]
        best = sorted((-v, i) for i, v in enumerate(s) if i != r["query_id"])
        assert r["vec_id"] == best[r["rank"] - 1][1]


@pytest.mark.parametrize("block", [near_vectors.BLOCK, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "PART", 64)
    x = vectors().astype(np.float64)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = n @ n.T
    want = components(range(300), lambda i, j: cos[i, j] >= 0.9)
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors.near_vectors(frame(spark)).collect()}
    assert got.pop(None) == (0, None, True)
    for i, v in BAD:
        if i is not None:
            assert got.pop(i) == (0, i, True)
    assert got == {i: (int((cos[i] >= 0.9).sum() - 1), want[i], want[i] == i) for i in range(300)}


def test_near_vectors_of_nothing(spark):
    assert near_vectors.near_vectors(frame(spark).limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(frame(spark).where("vec_id = 1020")).collect()] == [(1020, 0, 1020, True)]


def groups_of_copies(copy_noise):
    """40 pairs of groups of 40 copies or near copies each; the groups of a pair are linked at 0.93 only."""
    r = np.random.default_rng(21)
    out = []
    for _ in range(40):
        q = np.linalg.qr(r.standard_normal((32, 2)))[0].T
        for v in (q[0], 0.93 * q[0] + np.sqrt(1 - 0.93**2) * q[1]):
            out.append(v + copy_noise * r.standard_normal((40, 32)))
    return np.concatenate(out)


@pytest.mark.parametrize("noise", [0, 1e-4])
@pytest.mark.parametrize("part", [near_vectors.PART, 16])
def test_links_between_groups_of_copies(spark, monkeypatch, noise, part):
    monkeypatch.setattr(near_vectors, "PART", part)
    x = groups_of_copies(noise)
    rows = [(i, v.tolist(), 1, "x", "x") for i, v in enumerate(x)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))).collect()}
    assert got == {i: (79, i // 80 * 80, i % 80 == 0) for i in range(len(x))}


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal(24) + 0.001 * r.standard_normal((200, 24)), np.repeat(r.standard_normal((20, 24)), 2, axis=0) + 0.01 * r.standard_normal((40, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "vec_id long, v binary")
    found = spark.createDataFrame([(i, 0 if i < 200 else i // 2 * 2) for i in range(240)], "node long, component long")
    assert near_vectors.missed(rows, found, 240, 24) == 0
    assert near_vectors.missed(rows, found.where("node < 200"), 240, 24) == 1
    assert near_vectors.missed(rows, found.where("node >= 200 or node % 2 = 0"), 240, 24) > 0.1


def test_tables_grow_with_bits():
    for bits in (4, 12, 20):
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - same) ** near_vectors.n_tables(bits) >= 0.99


def test_what_the_graph_misses_is_found_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "n_tables", lambda bits: 1)
    monkeypatch.setattr(near_vectors, "DESCENTS", 0)
    monkeypatch.setattr(near_vectors, "AUDITS", 1)
    monkeypatch.setattr(near_vectors, "BUCKET", 0.01)
    monkeypatch.setattr(near_vectors, "PART", 64)
    x = vectors().astype(np.float64)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = n @ n.T
    want = components(range(300), lambda i, j: cos[i, j] >= 0.9)
    got = {r["vec_id"]: r["component_id"] for r in near_vectors.near_vectors(frame(spark).where("vec_id < 300")).collect()}
    assert got == want


def ran(df):
    """The plan as Spark ran it in the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_with_the_texts_are_joined_by_shuffling(spark):
    rows = spark.createDataFrame([(i, i % 500) for i in range(1000)], "v long, k long")
    told = common.cut(rows.selectExpr("k").groupBy("k").count().withColumnRenamed("count", "n"))
    assert "Broadcast" not in ran(common.spread_join(rows, told, "k"))
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i // 2}" for j in range(40)), None, None, None) for i in range(40)], DOCS)
    counted, keyed, _, bits = jaccard.class_table(docs)
    assert "Broadcast" not in ran(jaccard.class_links(jaccard.members(counted, keyed, bits)))


def test_hot_keys_are_joined_without_a_broadcast(spark):
    rows = spark.createDataFrame([(i, bytes([i % 40 if i % 3 else 7]), i % 2) for i in range(3000)] + [(-1, None, 0)], "v long, k binary, level int")
    for keys in (["k"], ["k", "level"]):
        told = common.cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("v").alias("most")))
        joined = common.salted_join(rows, told, keys if len(keys) > 1 else keys[0])
        assert sorted(joined.columns) == sorted([*rows.columns, "most"])
        assert sorted(map(tuple, joined.select("v", "most").collect())) == sorted(map(tuple, common.spread_join(rows, told, keys).select("v", "most").collect()))
        assert "Broadcast" not in ran(joined)
    star = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(i, i + 1) for i in range(3000, 3020)], "a long, b long")
    found = graph.connected_components(star)
    assert found.groupBy("component").count().orderBy("component").collect() == [(0, 3000), (3000, 21)]
    both = common.cut(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    assert "Broadcast" not in ran(graph._star(both, True))
