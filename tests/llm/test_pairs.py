import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import graph, minhash, permutation_index
from tests.llm.conftest import words


def shingles(text, k):
    w = (text or "").encode().translate(minhash.LOWER).split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, percent, ids=None):
    sets, ids = [shingles(t, k) for t in texts], ids or list(range(len(texts)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), []).append(ids[i])
    return [min(least[find(i)]) for i in range(len(texts))], [len(s) for s in sets]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, make, odd_texts, k, percent):
    rng = random.Random(1)
    texts = list(odd_texts)
    for n in (40, 150, 400):
        base = words(rng, n)
        texts += [base, base.upper(), *(edited(rng, base, rng.randint(0, n // 15)) for _ in range(40))]
    texts += ["a b", "A  b", "a b c", "b a", *(" ".join(rng.choice("pq") for _ in range(12)) for _ in range(20))]
    chain = words(rng, 100)
    for _ in range(15):  # each links with the one before, but the first not with the last
        texts.append(chain)
        chain = edited(rng, chain, 3)
    ids = rng.sample(range(10_000), len(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(make(texts, ids=ids), k=k, percent=percent).collect()}
    expected, sizes = brute_components(texts, k, percent, ids)
    assert [got[i].component_id for i in ids] == expected and [got[i].n_shingles for i in ids] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_one_template(spark, make):
    """Many documents share half of their text and are not linked; some of them have a near copy, far from the star's centre."""
    rng = random.Random(6)
    shared, texts = words(rng, 60), []
    for _ in range(80):
        texts.append(f"{shared} {words(rng, rng.randint(10, 40))}")
    texts += [edited(rng, rng.choice(texts[:80]), 1) for _ in range(40)] + [edited(rng, shared, 2) for _ in range(10)]
    ids = rng.sample(range(10_000), len(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(texts, ids=ids), k=3, percent=85).collect()}
    expected, _ = brute_components(texts, 3, 85, ids)
    assert [got[i] for i in ids] == expected and 20 < len(set(expected)) < 110


@pytest.mark.parametrize(("own", "many"), [(10, 400), (14, 400)])
def test_documents_of_one_template_do_not_meet(spark, make, own, many):
    """Pairs grow as the documents: 80 common words, some own ones, nothing linked, one star."""
    rng = random.Random(own)
    shared = words(rng, 80)
    met = {}
    for n in (many // 2, many):
        docs = make([f"{shared} {words(rng, own)}" for _ in range(n)])
        texts = docs.select(F.col("doc_id").alias("cls"), "text")
        stars = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        spokes = minhash.compared(stars, texts, 3, 85)
        meeting = minhash._meeting(minhash._waiting(spokes, spark.createDataFrame([], "node long, comp long")), 85)
        pairs = meeting.where("asks").alias("x").join(meeting.where("not asks").alias("y"), ["a", "kind", "edit"]).where("x.b <> y.b")
        met[n] = pairs.count()
    assert met[many] <= 10 * many and met[many] <= 3 * max(met[many // 2], many)


def test_near_copies_on_both_sides_of_the_threshold(spark, make):
    """A star's spokes share 70 to 95 % with each other, by words of a small vocabulary; few pairs of them are compared, and no link is lost."""
    rng = random.Random(8)
    base, some = words(rng, 150).split(), words(rng, 12).split()
    met = {}
    for n in (150, 300):
        texts = [" ".join(base)]
        for k in range(1, n):  # some far from the centre, some of these with a near copy
            text = list(base) if k % 10 else texts[-1].split()
            for _ in range(rng.randint(1, 9) if k % 10 else 1):
                text[rng.randrange(len(text))] = rng.choice(some)
            texts.append(" ".join(text))
        docs = make(texts)
        stars = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        spokes = minhash.compared(stars, docs.select(F.col("doc_id").alias("cls"), "text"), 3, 85)
        linked = spokes.where("linked").select("a", "b")
        comps = graph.components(linked)
        waiting = minhash.written(minhash._waiting(spokes, comps))
        meeting = minhash.written(minhash._meeting(waiting, 85))
        met[n] = minhash._pairs(minhash._labelled(meeting, comps), 85, False).count()
        for star in (True, False):
            linked = linked.union(minhash._met(meeting, waiting, comps, 85, star))
            comps = graph.components(linked)
        got = {r["node"]: r["comp"] for r in comps.collect()}
        expected, _ = brute_components(texts, 3, 85)
        assert [got.get(i, i) for i in range(n)] == expected and n // 10 < len(set(expected)) < n
    assert met[150] <= 150 and met[300] <= 300


def test_near_duplicates_edges(spark, make, odd_texts):
    twice = minhash.near_duplicates(make([odd_texts[9]] * 3 + [None], ids=[5, 5, 3, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in twice) == [("3", "3"), ("5", "3"), ("5", "3"), ("None", "None")]
    assert minhash.near_duplicates(make([])).count() == 0
    docs = make([odd_texts[9], odd_texts[9] + " more", odd_texts[10], odd_texts[10]], ids=[1, 2, 3, 3])
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_one_of_each_goes_by_id_and_text(spark, make):
    rng = random.Random(2)
    texts = [words(rng, 80) for _ in range(6)]
    rows = [texts[0], texts[1], texts[1], texts[2] + " more", None, texts[3], texts[4], texts[5], texts[2]]
    kept = minhash.one_of_each(make(rows, ids=[None] * 5 + [7, 7, None, 9])).collect()
    expected = [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[3]), (7, texts[4]), (None, texts[5]), (9, texts[2])]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in expected)


def test_sketch_agrees_with_similarity():
    rng = random.Random(2)
    assert minhash.rows_of_band(85) == 8 and minhash.rows_of_band(80) == 6
    s = minhash.Shingler(3)
    for n in (1, 4, 30, 500):
        a = words(rng, n + 2)
        b = edited(rng, a, max(1, n // 30)) if n > 4 else a
        x, y = s(a), s(b)
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((minhash.sketch(x) == minhash.sketch(y)).mean() - exact) < 0.15


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 400)]
    pairs = [*path, *star, (140, 7), (900, 901), (901, 900)]
    rng.shuffle(pairs)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[x] for x in (100, 140, 7, 399)} == {7} and got[900] == got[901] == 900 and len(got) == 41 + 201 + 2
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[99]  # a common vector
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(x)] + [(1000, None, "", ""), (1100, [0.0] * 16, "", ""), (1200, [float("nan")] * 16, "", ""), (1300, [None] * 16, "", ""), (1400, [], "", ""), (1500, [1.0, 2.0], "", "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string")
    found = permutation_index.search(df, F.col("vec_id") % 100 == 0, block_rows=200, rerank=60).collect()
    exact = permutation_index.search(df, F.col("vec_id") % 100 == 0, block_rows=200, rerank=200, visits=64).collect()
    hits = 0
    for q in range(0, 600, 100):
        got = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(best) & {i for i, _ in got})
        assert len(got) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got) and got == sorted(got, key=lambda g: (g[1], g[0]))
    assert hits / 60 >= 0.9
    assert {r.query_id for r in found} == set(range(0, 600, 100))  # one vector of another width has no candidate
    for q in range(0, 600, 100):
        best = [i for i in np.lexsort((np.arange(600), np.sqrt(((x - x[q]) ** 2).sum(1)))) if i != q][:10]
        assert [r.vec_id for r in sorted(exact, key=lambda r: r["rank"]) if r.query_id == q] == best
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in permutation_index.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert permutation_index.search(few.limit(0), F.lit(True)).count() == 0


def test_nearest_neighbours_of_several_widths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(8, 12, 5)[min(i % 7, 2)]).tolist()) for i in range(300)] + [(1000 + i, [1.0] * (20 + i)) for i in range(60)]
    found = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    sizes = {i: len(v) for i, v in rows}
    for q in (0, 100, 200):
        got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        d = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q][1])) ** 2).sum())), i) for i, v in rows if len(v) == sizes[q] and i != q)
        assert got == [i for _, i in d[:10]]


def test_layout_splits_large_files():
    of = permutation_index.layout(np.array([3, 50, 4, 200, 5]), 60)
    assert of.first.tolist() == [0, 0, 0, 1, 5] and of.count.tolist() == [1, 1, 1, 4, 1] and not of.whole
    assert permutation_index.layout(np.array([3, 4]), 60).whole


def test_one_row_more_than_a_block_changes_nothing(spark):
    """The files that a query visits go by how many rows they hold, not by whether the table fits a block."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1001, [1000.0] * 16)]
    schema = "vec_id long, embedding array<double>"
    found = [permutation_index.search(spark.createDataFrame(rows[:n], schema), F.col("vec_id") % 100 == 0, block_rows=400, rerank=400, visits=4) for n in (400, 401)]
    few, more = (sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in f.collect()) for f in found)
    assert few == more and len(few) == 40
