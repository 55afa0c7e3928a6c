import random
from collections import Counter

import numpy as np
import pytest

from quire.functions.sentences import is_abbreviation
from quire.llm import align as A
from quire.llm.sentences import sentences



def vocabulary(seed, size):
    """Invented words of one language with an invented rendering each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    return {word() + "x": word() + "q" for _ in range(size)}


NOUNS, VERBS, ADJS = vocabulary(1, 80), vocabulary(2, 30), vocabulary(3, 30)
SEED = [*list(NOUNS.items())[:40], *list(VERBS.items())[:10], *list(ADJS.items())[:15]]


def pair(rng):
    a, b = rng.sample(list(NOUNS), 2)
    v, p, q = rng.choice(list(VERBS)), rng.choice(list(ADJS)), rng.choice(list(ADJS))
    return f"The {p} {a} {v} the {q} {b}.", f"{ADJS[p].capitalize()} {NOUNS[a]} {ADJS[q]} {NOUNS[b]} {VERBS[v]}."


def group(rng):
    """Source and target sentences and the true pairs: omissions, additions, merges, divisions, one moved."""
    source, target, true = [], [], set()
    for _ in range(rng.randint(3, 9)):
        s, t = pair(rng)
        kind = rng.random()
        if kind < 0.1:
            source.append(s)
        elif kind < 0.2:
            target.append(t)
        elif kind < 0.3:
            s2, t2 = pair(rng)
            source += [s, s2]
            target.append(t[:-1] + ", ama " + t2.lower())
            true |= {(len(source) - 2, len(target) - 1), (len(source) - 1, len(target) - 1)}
        elif kind < 0.4:
            s2, t2 = pair(rng)
            source.append(s[:-1] + ", but " + s2.lower())
            target += [t, t2]
            true |= {(len(source) - 1, len(target) - 2), (len(source) - 1, len(target) - 1)}
        else:
            source.append(s)
            target.append(t)
            true.add((len(source) - 1, len(target) - 1))
    if len(target) > 3 and rng.random() < 0.3:
        target = [target[-1], *target[:-1]]
        true = {(i, 0 if j == len(target) - 1 else j + 1) for i, j in true}
    return source, target, true


def sides(spark, groups):
    return spark.createDataFrame([("\n".join(g[0]), "\n".join(g[1])) for g in groups], "s string, t string")


def lexicon_of(spark, words):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(words)], "word_id int, en string, tr string")


def aligned(groups, table, **steps):
    return set(A.align_block(A.match([g[0] for g in groups], [g[1] for g in groups], table), **steps))


def named(rng, n):
    """Groups in which every other source sentence holds a number that its rendering repeats."""
    out = []
    for _ in range(n):
        s, t, true = group(rng)
        for i, j in sorted(true):
            if rng.random() < 0.5:
                mark = str(rng.randrange(1000, 9999))
                s[i], t[j] = f"{s[i][:-1]} {mark}.", f"{t[j][:-1]} {mark}."
        out.append((s, t, true))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    return A.train(sides(spark, named(random.Random(4), 600)), lexicon_of(spark, SEED))


def shares(groups, got):
    true = {(k, i, j) for k, g in enumerate(groups) for i, j in g[2]}
    return len(got & true) / len(true), len(got & true) / max(1, len(got))


def test_learned_table_aligns_held_out_groups(learnt):
    held = [group(random.Random(k)) for k in range(200)]
    assert min(shares(held, aligned(held, learnt))) > 0.9


def test_every_step_decides(spark, learnt):
    held = named(random.Random(9), 200)
    full, sure = shares(held, aligned(held, learnt))
    assert full > 0.95 and sure > 0.95
    assert shares(held, aligned(held, learnt, use_program=False))[0] < 0.6
    assert shares(held, aligned(held, learnt, moved=False))[0] < full - 0.02
    # With the lexicon alone, and with words of which none is known, the chain is what finds the pairs.
    bare = A.train(sides(spark, []), lexicon_of(spark, SEED[:20]))
    assert shares(held, aligned(held, bare, use_chain=False))[0] < shares(held, aligned(held, bare))[0] - 0.1


def test_words_are_learnt_through_the_chain(spark, monkeypatch):
    groups = named(random.Random(5), 300)
    lexicon = lexicon_of(spark, [])
    learnt = A.train(sides(spark, groups), lexicon)
    monkeypatch.setattr(A, "sure_pairs", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    counts = A.Counts()
    counts.add([g[0] for g in groups], [g[1] for g in groups])
    assert len(learnt.entries) > 100 and "b" not in set(counts.rows()["kind"])


def test_path_is_the_strongest():
    rng = random.Random(2)

    def brute(pairs):
        best = [0.0] * len(pairs)
        for k, (i, j, v) in enumerate(pairs):
            best[k] = v + max([0.0, *(best[m] - A.AGAIN * (pairs[m][0] == i or pairs[m][1] == j) for m in range(k) if pairs[m][1] <= j)])
        return max(best, default=0.0)

    def worth(pairs, way):
        return sum(pairs[k][2] for k in way) - sum(A.AGAIN for a, b in zip(way, way[1:]) if pairs[a][0] == pairs[b][0] or pairs[a][1] == pairs[b][1])

    for size in [*range(8)] * 20 + [450, 600]:
        pairs = sorted({(rng.randrange(size + 2), rng.randrange(size + 2)): rng.random() for _ in range(size)}.items())
        pairs = [(*p, v) for p, v in pairs]
        way = A.path(pairs)
        assert all(pairs[a][0] <= pairs[b][0] and pairs[a][1] <= pairs[b][1] for a, b in zip(way, way[1:]))
        assert abs(worth(pairs, way) - brute(pairs)) < 1e-9
    dense = sorted((i, j, rng.random()) for i in range(30) for j in range(30))
    assert abs(worth(dense, A.path(dense)) - brute(dense)) < 1e-9


def test_a_large_table_is_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARED_ROWS", 50)
    groups = named(random.Random(6), 150)
    frame = spark.createDataFrame([(k, True, g[0], [" " + t for t in g[1]]) for k, g in enumerate(groups)], "group_id long, parity_check boolean, source array<string>, translated array<string>")
    rows, lexicon = A.texts_of(frame), lexicon_of(spark, SEED)
    small, large = A.train(rows, lexicon), A.train(rows, lexicon, most=10)
    assert isinstance(small, A.Table) and not isinstance(large, A.Table)
    assert sorted(A.align_groups(frame, small).collect()) == sorted(A.align_groups(frame, large).collect())


def test_chain_is_the_longest():
    rng = random.Random(1)
    for _ in range(200):
        pairs = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randint(0, 9))})
        best = 0
        for mask in range(1 << len(pairs)):
            take = [p for k, p in enumerate(pairs) if mask >> k & 1]
            if all(a[1] <= b[1] for a, b in zip(take, take[1:])):
                best = max(best, len(take))
        got = A.chain(pairs)
        assert len(got) == best and all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_anchors_alone_align_numbers_and_names():
    s = ["Harlo measured 1,679.2 kg.", "Nothing of note.", "Figure 3.20 shows Kasmar."]
    t = ["Harlo 1.679,2 kg ölçtü.", "Şekil 3.20 Kasmar'ı gösterir."]
    assert set(A.align_block(A.match([s], [t], A.Table()))) == {(0, 0, 0), (0, 2, 1)}


def test_sentences():
    assert sentences("- One. “Two!” 3\n\n1. Three… four\n[^2]: Five? six") == ["- One.", " “Two!”", " 3", "1. Three…", " four", "[^2]: Five?", " six"]
    assert sentences("See Fig. 3 by A. Smith. End") == ["See Fig. 3 by A. Smith.", " End"]
    assert sentences("") == [] and sentences(" \n\t\n") == []


def test_frame(spark):
    rows = [(1, True, ["Harlo saw 12 ships.", " Then Kasmar left 77."], ["Harlo 12 gemi gördü. Kasmar 77 bıraktı."]), (2, False, ["Harlo 12."], ["Harlo 12."]), (3, None, ["Harlo 12."], ["Harlo 12."]), (4, True, ["Harlo 12."], []), (5, True, None, ["x"]), (6, True, [None, "Harlo saw 12."], ["Harlo 12 gördü."]), (None, True, [""], [""]), (8, True, ["Harlo 5 " * 5000], ["Harlo 5 " * 5000])]
    df = spark.createDataFrame([*rows, rows[0]], "group_id long, parity_check boolean, source array<string>, translated array<string>").selectExpr("*", "1 as s", "2 as source_no")
    lexicon = spark.createDataFrame([(1, "saw", "gördü"), (2, None, None)], "word_id int, en string, tr string")
    table = A.train(A.texts_of(df), lexicon)
    got = sorted(tuple(r) for r in A.align_groups(df, table).collect())
    assert [r for r in got if r[0] == 1] == [(1, 0, 0), (1, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert {r[0] for r in got} <= {1, 6, 8} and (6, 0, 0) in got
    assert A.align_groups(df.limit(0), A.train(A.texts_of(df.limit(0)), lexicon)).count() == 0


def test_all_pairs_of_words_are_counted(monkeypatch):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("al", "em", "in", "ol", "ur")]
    common = [([" ".join(["zon", *rng.sample(words, 4)])], [" ".join(["qar", *rng.sample(words, 4)])]) for _ in range(300)]
    letters = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmnprst"]
    long = [([" ".join(f"{w}x" for w in letters)], [" ".join(f"{w}q" for w in letters)])]
    brute = Counter((a, b) for s, t in [*common, *long] for a in {*s[0].split()} for b in {*t[0].split()})
    for at_once in (A.AT_ONCE, 1000):
        monkeypatch.setattr(A, "AT_ONCE", at_once)
        counts = A.Counts()
        counts.add([s for s, _ in common], [t for _, t in common])
        counts.add([s for s, _ in long], [t for _, t in long])
        got = counts.rows()
        assert {(r.a, r.b): r.n for r in got[got.kind == "b"].itertuples()} == brute and len(letters) ** 2 > 250_000
    monkeypatch.setattr(A, "HELD_PAIRS", 3000)
    counts, parts = A.Counts(), []
    for _ in counts.parts([s for s, _ in long], [t for _, t in long]):
        assert counts.held <= 5000
        parts.append(counts.rows(False))
    assert len(parts) > 50 and sum(len(x) for x in parts) == len(letters) ** 2


def test_all_renderings_of_enough_share_are_kept(spark):
    fill = [(f"{a}{b}n kol{k} mor{k}", f"{a}{b}t kel{k} mer{k}") for k in range(200) for a, b in [("bcdfg"[k % 5], "aeiou"[k // 40])]]
    rows = [(f"{w}a", "tek") for w in ("bir", "iki", "uch", "dor", "bes", "alt") for _ in range(5)] + fill
    table = A.train(spark.createDataFrame(rows, "s string, t string"), lexicon_of(spark, []))
    assert {a for a, _ in table.entries["tek"]} == {"bira", "ikia", "ucha", "dora", "besa", "alta"}


def test_tokens_of_long_texts():
    rng = random.Random(1)
    some = "ab1٣2.,.,\n  -_ç²ıǅ😀´́Ⅷ½中_\x00 \x1c"
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert A._split(text) == A._token.findall(text)


def test_sentences_end_after_words_that_only_end_like_abbreviations():
    for text in ("Went to the Xyzetc. Then", "Said abc.e.g. Then", "......e.g. Then", "approximately approx. Then", "It was preapprox. Then", "Aa A. Smith", "Ça. Then", "translation. Then", "x.translate. Then"):
        at = text.rindex(". ")
        assert (len(sentences(text)) == 1) == is_abbreviation(text, at), text
