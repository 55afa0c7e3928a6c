import random
from collections import Counter, defaultdict

from quire.llm import packing as P


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_small_cases_are_optimal():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([10, 20, 100])
        sizes = [rng.randint(max(1, capacity // 8), int(capacity * 0.7)) for _ in range(rng.randint(0, 9))]
        boxes = P.pack(sizes, capacity)
        assert sorted(i for b in boxes for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in boxes)
        assert len(boxes) == optimum(sizes, capacity)
        assert P.lower_bound(sizes, capacity) <= len(boxes)


def test_search_beats_best_fit():
    sizes = [4, 4, 3, 3, 3, 3]  # 4+3+3 twice; best fit decreasing needs a third
    assert len(P.best_fit(sizes, 10)) == 3
    assert len(P.pack(sizes, 10)) == 2


def test_corpus(spark):
    rows = [(i, "a", "word " * (i % 40 + 1)) for i in range(60)] + [(100, "a", "word " * 700), (101, "a", None), (102, "a", ""), (103, None, "x"), (104, "zz", "x"), (5, "a", "word " * 6), (200, "b", "x" * 5000)]
    documents = spark.createDataFrame(rows, "doc_id long, provider string, text string").selectExpr("*", "1 as container", "2 as n_tokens", "3 as _cap")
    limits = spark.createDataFrame([("a", 256, 9), ("b", 64, 9), ("c", 10, 9), ("d", None, 1)], "provider string, capacity_tokens int, overlap_chars int")
    got = P.pack_corpus(documents, limits, shard_items=20).collect()
    caps, used, parts = {"a": 256, "b": 64}, Counter(), defaultdict(list)
    for r in got:
        used[r.provider, r.container] += r.token_to - r.token_from
        parts[r.doc_id].append((r.token_from, r.token_to, r.provider))
    assert all(n <= caps[p] for (p, _), n in used.items())
    assert set(parts) == {r[0] for r in rows if r[2] and r[1] in caps}
    for key, spans in parts.items():
        if key == 5:  # a repeated id: two items
            assert len(spans) == 2
            continue
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or spans[-1][1] > caps[spans[0][2]]
    assert P.pack_corpus(documents.limit(0), limits).count() == 0
    assert P.pack_corpus(documents, limits.limit(0)).count() == 0


def test_given_sizes(spark):
    items = spark.createDataFrame([("a", 1, 7), ("a", 2, 3), ("a", 3, 0), ("a", 4, None), ("a", 5, 25)], "provider string, doc_id long, n_tokens int")
    got = P.pack_sized(items, spark.createDataFrame([("a", 10)], "provider string, capacity_tokens int")).collect()
    assert len({r.container for r in got}) == 4 and {r.doc_id for r in got} == {1, 2, 5}
