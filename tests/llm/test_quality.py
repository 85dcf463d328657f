import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import base_rows, frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from foliate.llm import quality as Q
from foliate.llm.words import split


def counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered, seen, again = set(), set(), 0
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t|#\x1c\x85", max_size=40)), max_size=6))
def test_counts_of_any_texts(texts):
    b = split(pa.array(texts, pa.string()))
    got = Q.base_counts(b, b.hashes())
    assert list(zip(*(got[n].tolist() for n in NAMES))) == [counts(t) for t in texts]


def corpus():
    good = [(i, " ".join(f"plain{(i * 13 + j * 7) % 90}" for j in range(80 + i % 40)), "en", "a", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"$$junk{(i * 11 + j * 5) % 70}%%" for j in range(80 + i % 40)), "en", "a", 0) for i in range(60)]
    return good, bad


def test_rejects_what_is_unlike_the_trusted(spark):
    good, bad = corpus()
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[:200]] + [(r[0], 0, 0) for r in bad] + [(5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert all(got[r[0]].kept for r in good) and not any(got[r[0]].kept for r in bad)
    assert all(r.kept == (not r.base_failed and r.score >= r.threshold) for r in got.values())
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in good}


def test_odd_rows_without_labels(spark):
    docs = frame(spark)
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = Q.judge(docs, model).collect()
    want = Counter((r[0], *counts(r[1])) for r in base_rows())
    assert Counter((r.doc_id, *(r[n] for n in NAMES)) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)
    empty = frame(spark, [])
    assert Q.judge(empty, Q.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


def test_every_trusted_document_is_learnt_from(spark):
    """More than 5,000 of them: the ratio counts all, and the threshold is a quantile of all their scores out of fold."""
    n, trusted = 5600, 5400
    texts = [" ".join(f"{'good' if i < trusted else 'raw'}{(i * 13 + j * j) % 61 + i // 900}" for j in range(45 + i % 20)) for i in range(n)]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, texts[0])], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < trusted), 0) for i in range(n)] * 2, "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels, 1 << 12)

    rows = texts + [texts[7], texts[0]]
    b = split(pa.array(rows))
    at, doc = Q._features(b, b.hashes(), 1 << 12)
    half = {r.id: r.fold for r in Q._halves(labels).collect()}
    assert len(half) == trusted and abs(sum(half.values()) - trusted / 2) <= 1
    fold = np.array([half.get(i, 2) for i in [*range(n), 7, None]])
    sums = [np.bincount(at[fold[doc] == i], minlength=1 << 12) for i in range(3)]
    assert np.allclose(model.ratio, Q._log_ratio(sums[0] + sums[1], sum(sums)), rtol=0, atol=1e-12)
    scores = [Q._scores(b, b.hashes(), Q._log_ratio(sums[1 - i], sum(sums)))[(fold == i) & (b.counts() >= Q.MIN_WORDS)] for i in range(2)]
    assert np.isclose(model.threshold, np.quantile(np.concatenate(scores), Q.LOWEST_SHARE, method="lower") - Q.MARGIN, rtol=0, atol=1e-12)


def test_places_of_scores(spark):
    x = np.concatenate((np.random.default_rng(5).normal(0, 1, 300), [0.0, -1e-300, 1e-300, -9.5, -9.5, 7.25], np.full(40, -0.125)))
    keys = spark.createDataFrame([(k,) for k in Q._sortable(x).tolist()], "key long")
    for place in (0, 1, 2, 150, len(x) - 1):
        key = np.array([Q._at_place(keys, place)])
        assert Q._sortable(key.view(np.float64)).view(np.float64)[0] == np.sort(x)[place]
