import pytest
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import LONG, base_rows, frame

from foliate.llm import neardup as N
from foliate.llm.components import components
from foliate.llm.words import split

NONE = N.Weights(np.zeros(0, np.uint64), np.zeros(0), 2.0)


def test_samples_agree_as_often_as_the_similarity_says():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(words)]
    for share in (0.02, 0.1, 0.3):
        texts.append(" ".join(w if rng.random() > share / 5 else "x" + w for w in words))
    for i in (1, 2, 3):
        exact = N.similarities(pa.array(texts[:1]), pa.array([texts[i]]), NONE)[0]
        rates = []
        for k in range(40):  # other words, the same similarity
            a, b = (" ".join(f"{k}{w}" for w in t.split()) for t in (texts[0], texts[i]))
            s = N.sample(*N.weighted_sets(pa.array([a, b]), NONE), 2)
            rates.append((s[:, 0] == s[:, 1]).mean())
        assert abs(np.mean(rates) - exact) < 0.03


def test_samples_follow_weights():
    """With one set's weights doubled, the similarity is a half."""
    rng = np.random.default_rng(2)
    rates = []
    for _ in range(60):
        h = np.sort(rng.integers(0, 1 << 63, 50, np.uint64))
        doc, both = np.repeat([0, 1], 50), np.concatenate((h, h))
        s = N.sample(doc, both, np.concatenate((np.full(50, 1.0), np.full(50, 2.0))), 2)
        rates.append((s[:, 0] == s[:, 1]).mean())
    assert abs(np.mean(rates) - 0.5) < 0.04


def test_planted_copies_and_clean_documents(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(60):
        words = [f"g{g}w{rng.randrange(4000)}" for _ in range(120 + g)]
        for c in range(1 + g % 5):
            own = list(words)
            if c:
                own[rng.randrange(len(own))] = f"edit{g}{c}"
            i = len(rows)
            rows.append((i, " ".join(own), "en", "a", 0))
            want[i] = min(want.get(j, i) for j in range(i - c, i + 1))
    shared = " ".join(f"passage{i}" for i in range(60))
    for k in range(30):  # a passage that many documents share doesn't make them near duplicates
        i = len(rows)
        rows.append((i, shared + " " + " ".join(f"p{k}x{j}" for j in range(60)), "en", "a", 0))
        want[i] = i
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())
    kept = N.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_chains_link_through_their_middle(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(6):  # each is near to the next, the first not to the last
        own = base[:]
        for e in range(step * 3):
            own[e * 11 % 200] = f"s{e}"
        rows.append((step, " ".join(own), "en", "a", 0))
    assert {r.class_id for r in N.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_odd_rows(spark):
    got = {}
    for r in N.near_duplicates(frame(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert sum(map(len, got.values())) == len(base_rows())
    assert got[0] == [(0, True)] and got[30] == [(30, True)]  # nulls stand alone
    assert got[10] == [(9, False)] and got[9] == [(9, True)]
    assert got[20] == [(20, True)] * 3 and got[1] == [(1, True)] and got[2] == [(2, True)]
    docs = frame(spark)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(str(i) for i in ids if i in (0, 9, 20, 30)) == ["0", "20", "30", "9"] and 10 not in ids
    assert N.near_duplicates(frame(spark, [])).collect() == []


def test_long_texts_are_compared_whole(spark):
    rows = [(1, LONG, "en", "a", 0), (2, LONG + " tail", "en", "a", 0), (3, " ".join(LONG.split()[:20_000]), "en", "a", 0)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (3, 1), (30, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, label in got.items():
        groups.setdefault(label, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6, 7, 8, 9], [20, 21]]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_classes(texts, threshold=N.THRESHOLD):
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        near = N.similarities(pa.array(texts[:i]), pa.array([texts[i]] * i), NONE) if i else []
        for j in range(i):
            if near[j] >= threshold:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        share = rng.choice([0.0, 0.01, 0.03, 0.06, 0.1])
        out.append(" ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base))
    return out


def test_blocks_find_what_pairs_would(spark, monkeypatch):
    texts = edited_copies(250, 4)
    want = brute_classes(texts)
    found = N._near_within(pa.array(texts), np.zeros(len(texts), np.int64), np.arange(len(texts)), NONE, N.THRESHOLD)
    assert len(found) <= len(texts)
    got = list(range(len(texts)))
    for _ in texts:
        for a, b in found:
            got[a] = got[b] = min(got[a], got[b])
    assert got == want


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    texts = edited_copies(250, 4)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    # Others keep the copies' shingles rare, so that all have one weight.
    rows += [(10_000 + i, " ".join(f"o{i}x{j}" for j in range(20)), "en", "a", 0) for i in range(26_000 // 100)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, rows), rare=1 + 1e-9).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_class_id_is_never_a_null_that_stands_beside_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "a", 0), (4, text + " x", "en", "a", 0), (5, text + " y", "en", "a", 0)]
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {4} and [r.doc_id for r in got if r.kept] == [4]


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_full_filters_change_nothing(spark, monkeypatch, most):
    """A filter that lets everything through gives the same rows."""
    monkeypatch.setattr(N, "LEAST_WORDS", 1)
    monkeypatch.setattr(N, "MOST_WORDS", most)
    docs = frame(spark).selectExpr("*", "1 AS maybe", "2 AS `row`")
    out = N.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.kept for r in N.near_duplicates(docs).dropDuplicates(["doc_id", "digest", "kept"]).collect() if r.digest) + docs.where("text is null").count()


def test_document_frequencies_are_of_every_row(spark):
    """Of 5,400 documents, in two parts of several chunks: what only the last hundred hold counts, to the document."""
    n = 5400
    texts = [" ".join(f"o{i}x{j}" for j in range(6)) for i in range(n)]
    for words, holders in (("just frequent as one of hundred", range(n - 54, n)), ("one document short of frequent", range(n - 53, n)), ("spread evenly over all parts", range(0, n, 20)), ("at the front of them", range(70))):
        for i in holders:
            texts[i] += f" {words} {words}"
    counts = Counter(g for t in texts for g in set(zip(*(t.split()[k:] for k in range(N.WORDS)))))
    want = {N.shingles(split(pa.array([" ".join(g)]), lower=True))[1][0]: N.idf(c / n) for g, c in counts.items() if c * N.RARE >= n}
    assert len(want) > 10 and Counter(counts.values())[53] > 0
    weights = N.frequent_weights(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2))
    assert weights.hashes.tolist() == sorted(weights.hashes.tolist())
    assert dict(zip(weights.hashes.tolist(), weights.idf.tolist(), strict=True)) == pytest.approx({int(h): x for h, x in want.items()}, rel=1e-12)
