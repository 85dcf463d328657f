import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import base_rows, frame, words

from foliate.llm import language_model as L


def seatings(c):
    """All ways to seat c customers, as tuples of table sizes in order of arrival, with how customers sat down."""
    if c == 0:
        yield []
        return
    for s in seatings(c - 1):
        for k in range(len(s)):
            yield [*s[:k], s[k] + 1, *s[k + 1 :]]
        yield [*s, 1]


def test_table_counts_follow_the_seatings():
    c, p, others, d, theta = 5, 0.3, 4, 0.6, 1.0
    weight = Counter()
    for s in seatings(c):
        w = 1.0
        for i, n in enumerate(s):
            w *= (theta + d * (others + i)) * p
            for k in range(1, n):
                w *= k - d
        weight[len(s)] += w
    want = np.array([weight[t] for t in range(1, c + 1)]) / sum(weight.values())
    rng, n = np.random.default_rng(3), 60_000
    t = L.sample_tables(np.full(n, c), np.full(n, p), np.full(n, others), d, theta, L._log_stirling(d), rng)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - want).max() < 0.01


@pytest.mark.parametrize("lanes, error", [(32, 0.15), (1024, 0.04)])
@pytest.mark.parametrize("p, others", [(0.02, 30), (0.3, 4), (0.001, 5000)])
def test_large_dishes_seat_as_the_exact_distribution_says(monkeypatch, lanes, error, p, others):
    """Beyond what is seated at once the seating comes near the exact distribution, the nearer the more lanes there are."""
    monkeypatch.setattr(L, "LANES", lanes)
    c, d, theta, n = 700, 0.5, 1.0, 1000
    rng = np.random.default_rng(5)
    args = (np.full(n, c), np.full(n, p), np.full(n, others), d, theta)
    exact = L.sample_tables(*args, L._log_stirling(d, c), rng)
    grown = L.sample_tables(*args, L._log_stirling(d, 64), rng)
    assert abs(exact.mean() - grown.mean()) < error * exact.mean() + 0.08
    assert abs(exact.std() - grown.std()) < (error + 0.05) * exact.std() + 0.08


def held_ids():
    return (i for i in range(10**9) if zlib.crc32(str(i).encode()) % 7 == 2)


def train_ids():
    return (i for i in range(10**9) if zlib.crc32(str(i).encode()) % 7 != 2)


def zipf_rows(n_words=40, n_texts=150):
    rng = np.random.default_rng(4)
    ids, share = train_ids(), 1 / np.arange(1, n_words + 1)
    draw = lambda: " ".join(f"{'xyz'[k % 3]}{k}" for k in rng.choice(n_words, 30, p=share / share.sum()))
    return [(next(ids), draw(), "en", "a", 0) for _ in range(n_texts)]


@pytest.mark.parametrize("hot, chunk, task", [(1000, 10**6, 10**6), (10, 500, 700)])
def test_probabilities_sum_to_one(spark, monkeypatch, hot, chunk, task):
    """After the operator's own sweeps, over all words after a context, the end and one unknown word."""
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(L, "TASK_TOKENS", task)
    rows = zipf_rows()
    vocabulary = sorted({w for r in rows for w in r[1].split()})
    ids, asked = held_ids(), {}
    for u in [*vocabulary[:3], "y1", "never-seen"]:
        for w in [*vocabulary, "also-never-seen", ""]:
            asked[i := next(ids)] = u
            rows.append((i, f"{u} {w}", "en", "a", 0))
    mass = Counter()
    got = L.score_documents(frame(spark, rows).coalesce(2), precise=True, token_scores=True).collect()
    for r in got:
        assert math.isclose(sum(r.token_scores), r.score) and len(r.token_scores) == r.n_tokens
        if r.doc_id in asked:
            mass[asked[r.doc_id]] += 10 ** r.token_scores[1]
    assert len(mass) == 5 and all(abs(m - 1) < 1e-9 for m in mass.values()), mass
    # What follows the beginning of a text sums to one as well.
    first = {r.doc_id: r.token_scores[0] for r in got}
    ids = held_ids()
    rows = [*zipf_rows(), *((next(ids), w, "en", "a", 0) for w in [*vocabulary, "never-seen", ""])]
    got = [r for r in L.score_documents(frame(spark, rows).coalesce(2), precise=True, token_scores=True).collect() if r.held_out]
    assert abs(sum(10 ** r.token_scores[0] for r in got) - 1) < 1e-9 and first


def test_precision(spark):
    rows = zipf_rows()
    exact = {r.doc_id: r.score for r in L.score_documents(frame(spark, rows).coalesce(2), precise=True).collect()}
    for r in L.score_documents(frame(spark, rows).coalesce(2)).collect():
        assert abs(r.score - exact[r.doc_id]) <= 1e-6 * r.n_tokens


def test_chunks_and_tasks_change_no_count(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in base_rows()]
    monkeypatch.setattr(L, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(L, "TASK_TOKENS", 5000)
    monkeypatch.setattr(L, "HOT", 50)
    check(rows, L.score_documents(frame(spark)).collect())


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check(rows, got):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(i, [*words(low(t)), "\n"]) for i, t in rows]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3)) for i, t in tokens)
    assert sorted((-1 if r[0] is None else r[0], *r[1:5], round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_counts_and_base_on_odd_rows(spark):
    rows = [(r[0], r[1]) for r in base_rows()]
    check(rows, L.score_documents(frame(spark)).collect())
    assert L.score_documents(frame(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    # Without a training token the unknown word is all there is, and certain.
    r = L.score_documents(frame(spark, [(only, "all held out", "en", "a", 0)])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (4, 0, 0, 0.0, 0.0)


def test_learns_what_follows_what(spark):
    # Every word but the first is fixed by the one before it: the model must come to use the context.
    pairs = {f"w{i}": f"w{(i * 17 + 5) % 40}" for i in range(40)}
    rows = []
    for i in range(300):
        w = f"w{i % 40}"
        text = [w := pairs[w] for _ in range(60)]
        rows.append((i, " ".join(text), "en", "a", 0))
    got = [r for r in L.score_documents(frame(spark, rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.4 * sum(r.base_score for r in got)


def test_reruns_agree(spark):
    key = lambda: sorted((str(r.doc_id), r.score) for r in L.score_documents(frame(spark).coalesce(1)).collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * abs(a[1]) for a, b in zip(key(), key(), strict=True))


def test_stirling_numbers_of_an_empty_discount():
    s = L._log_stirling(0.0, 6)
    assert [round(math.exp(x)) for x in s[5, 1:6]] == [24, 50, 35, 10, 1]


def test_rare_words_have_contexts_of_their_own(spark):
    # Every word is rarer than one of HOT tokens and all end alike, so that one class holds them: only the word itself tells
    # what follows.
    n = 1500
    rows = [(i, " ".join(f"w{(i * 7 + j) % n:04d}xx" for j in range(40)), "en", "a", 0) for i in range(1400)]
    got = [r for r in L.score_documents(frame(spark, rows)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.4 * sum(r.base_score for r in got)
