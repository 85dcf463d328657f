import hashlib
from collections import defaultdict

from cases import base_rows, frame, words

from foliate.llm.mixing import MAX_EPOCHS, WEIGHTS, fair_mix, repeat_rows


def brute(rows):
    """Water filling by rounds, and a queue served one document at a time."""
    docs = [(i, s, len(words(t))) for i, t, _, s, _ in rows]
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > MAX_EPOCHS * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: float(MAX_EPOCHS * sizes[s]) for s in over}
    return sizes, target


def test_targets_and_nearness(spark):
    rows = base_rows()
    sizes, target = brute(rows)
    got = fair_mix(frame(spark)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, *_ in rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r["__source"]]
        assert abs(r.target - target[r["__source"]]) < 1e-6
        assert 0 <= r.taken <= MAX_EPOCHS * r.size and r.taken == r.repeats * r.size
        taken[r["__source"]] += r.taken
        most[r["__source"]] = max(most[r["__source"]], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s]


def test_queue_order_against_a_loop(spark):
    rows = [(i, "x " * (1 + i * i % 17), "en", "abcd"[i % 4], 0) for i in range(200)]
    sizes, target = brute(rows)
    rank = {s: i for i, s in enumerate(sorted(sizes))}
    events = []
    for s in sizes:
        own = sorted((hashlib.md5(f"{i}/20250/{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, len(words(t))) for i, t, _, src, _ in rows if src == s)
        cum = 0
        for round_ in range(MAX_EPOCHS):
            for h, i, n in own:
                cum += n
                events.append((cum / target[s], rank[s], round_, h, i, n))
    served, total, want = 0, sum(target.values()), defaultdict(int)
    for _, _, _, _, i, n in sorted(e for e in events if e[0] - e[5] / target["abcd"[e[1]]] < 1):
        if served + n > total + 1e-6:
            break
        served += n
        want[i] += n
    assert {r["__doc_id"]: r.taken for r in fair_mix(frame(spark, rows)).collect() if r.taken} == want


def test_reruns_agree_whatever_the_partitions(spark):
    key = lambda df: sorted(map(str, fair_mix(df).collect()))
    assert key(frame(spark)) == key(frame(spark).repartition(7))


def test_empty_and_wordless(spark):
    assert fair_mix(frame(spark, [])).collect() == []
    got = fair_mix(frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
    assert repeat_rows(frame(spark, [])).collect() == []


def test_rows_are_repeated_as_taken(spark):
    docs = frame(spark)
    want = sum(r.repeats for r in fair_mix(docs).collect())
    out = repeat_rows(docs)
    assert out.columns == docs.columns and out.count() == want
    rows = [(i // 5, f"{'word ' * (1 + i // 5 % 4)}", "en", "abc"[i % 3], 0) for i in range(120)] + [(None, "of none", "en", None, 0)] * 30
    got = sorted((str(r.doc_id), str(r.source)) for r in repeat_rows(frame(spark, rows)).collect())
    assert got == sorted((str(r["__doc_id"]), str(r["__source"])) for r in fair_mix(frame(spark, rows)).collect() for _ in range(r.repeats))


def test_any_column_names_and_rows_without_ids(spark):
    docs = frame(spark).selectExpr("*", "'mine' AS __d", "'mine' AS row", "'mine' AS rounds", "'mine' AS k")
    out = repeat_rows(docs).collect()
    assert {(r["__d"], r["row"], r["rounds"], r["k"], r["__size"]) for r in out} == {("mine", "mine", "mine", "mine", 7)}
    rows = [(None, f"word {'x ' * (i % 9)}{i}", "en", "a", 0) for i in range(200)]
    got = fair_mix(frame(spark, rows)).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got)
    assert sorted(r.text for r in repeat_rows(frame(spark, rows)).collect()) == sorted(r[1] for r in rows)
