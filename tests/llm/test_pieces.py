import random

from quire.llm import pieces as P


def check(text, limit, least, overlap):
    out = P.split(text, limit, least, overlap)
    assert out[0][1] == 0 and out[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(out, out[1:]))
    assert all(0 <= s <= c <= e and e - s <= limit for s, c, e in out)
    return out


def test_random_texts():
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(["word ", "a", "bb. ", "\n\n", "\n", "x" * rng.randint(1, 40), ", "]) for _ in range(rng.randint(0, 80)))
        limit = rng.randint(1, 60)
        out = check(text, limit, rng.randint(0, limit), rng.choice([0, 0, 3, 10, 80]))
        if not P.has_long_run(text, limit):
            assert all(text[e - 1].isspace() or text[e].isspace() for _, _, e in out[:-1])


def test_sentences_are_kept_whole_and_overlap_is_met():
    text = "".join(f"Sentence number {i:02d} stands right here. " for i in range(30))
    out = check(text, 200, 100, 40)
    assert all(text[:e].rstrip().endswith(".") for _, _, e in out)
    assert all(30 <= c - s <= 50 for s, c, _ in out[1:])
    assert all(e - s >= 100 for s, _, e in out)


def test_minimum_is_met_where_it_can_be():
    text = "".join("x" * 48 + ". " for _ in range(15))  # fifteen atoms of 50
    assert sorted(e - s for s, _, e in check(text, 300, 200, 0)) == [250, 250, 250]


def test_long_text():
    text = ("A sentence of some length, with a clause; and another one. " * 20_000) + "y" * 5000
    out = check(text, 1000, 700, 80)
    assert len(out) < 2000 and P.has_long_run(text, 1000)


def test_frame(spark):
    long = "One sentence here. " * 20
    groups = spark.createDataFrame(
        [(1, "a", [long]), (2, "a", ["x" * 150]), (3, "a", ["short"]), (4, "b", [long]), (5, "none", [long]), (6, "a", None), (7, None, [long]), (8, "a", [long, None, "end"]), (1, "a", [long])],
        "group_id long, job_id string, source array<string>",
    ).selectExpr("*", "1 as piece", "2 as provider", "3 as id")
    jobs = spark.createDataFrame([("a", "p", 100, 50, None), ("b", "p", None, None, None), ("c", "p", 0, 0, None)], "id string, provider string, chunk_max_chars int, chunk_min_chars int, updated_at timestamp")
    limits = spark.createDataFrame([("p", 20)], "provider string, overlap_chars int")
    got = P.split_groups(groups, jobs, limits)
    assert {r.group_id for r in got.collect()} == {1, 2, 8}
    assert all(len(r.piece) <= 100 for r in got.collect())
    assert sorted(tuple(r) for r in P.split_kinds(got).collect()) == [(1, "natural"), (2, "forced"), (8, "natural")]
    assert P.split_groups(groups.limit(0), jobs, limits).count() == 0
    assert P.split_groups(groups, jobs.limit(0), limits).count() == 0
    assert P.split_groups(groups, jobs, limits.limit(0)).select("group_id").distinct().count() == 3


def test_minimum_is_met_wherever_the_sizes_and_words_allow_it():
    rng = random.Random(8)
    for _ in range(150):
        text = "".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(rng.randint(30, 120)))
        limit = rng.randint(60, 120)
        least = rng.randint(10, limit // 2)
        out = check(text, limit, least, 0)
        # Brute force over the word boundaries: the fewest short pieces there can be.
        ends = [e for e, _ in P.boundaries(text, P.WORD)] + [len(text)]
        best = {0: 0}
        for e in ends:
            ways = [n + (e - a < least) for a, n in best.items() if e - a <= limit]
            if ways:
                best[e] = min(ways)
        assert sum(e - s < least for s, _, e in out) == best[len(text)]


def test_an_overlap_beyond_half_the_limit_is_kept():
    text = " ".join(f"w{i:03d}" for i in range(200))
    out = check(text, 100, 0, 70)
    assert all(66 <= c - s <= 74 for s, c, _ in out[1:])
