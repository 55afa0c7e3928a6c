import numpy as np

from quire.llm import repetition as R


def brute(text):
    words, cur = [], ""
    for ch in text:
        kind = R._class(ord(ch))
        if kind == R._DROP:
            continue
        if kind == R._GAP or kind & R._ALONE:
            words += [cur] * bool(cur)
            cur = ""
            words += [chr(kind & 0xFFFFFF)] * (kind != R._GAP)
        else:
            cur += chr(kind)
    words += [cur] * bool(cur)
    seen, marks = set(), [False] * len(words)
    for i in range(len(words) - 4):
        gram = tuple(words[i : i + 5])
        if gram in seen:
            marks[i : i + 5] = [True] * 5
        seen.add(gram)
    return len(words), sum(marks)


TEXTS = [
    "", "a", "one two three four five. One, TWO three​ four five!", "a a a a a a a a", "12 34 56", "It measured 12.5 kg on the old scale. It measured 7 kg on the OLD scale.",
    "Kış IŞIK ılık şık kapı; kış ışık ILIK şık KAPI", "éte là bas tout près été là bas tout près", "中文字句很长中文字句很长", "no repetition here at all in these words " + " ".join(f"w{chr(97 + i)}x" for i in range(26)),
]


def test_against_brute_force():
    _, count, covered = R.measure(TEXTS)
    assert [tuple(x) for x in zip(count.tolist(), covered.tolist())] == [brute(t) for t in TEXTS]
    assert covered[2] == 5 and covered[3] == 7 and covered[6] == 5 and covered[7] == 5 and covered[8] == 6


def test_passages_do_not_cross_texts():
    _, _, covered = R.measure(["one two three four five", "one two three four five"])
    assert covered.tolist() == [0, 0]


def test_long_text():
    _, count, covered = R.measure(["spam and eggs again now " * 100_000])
    assert count[0] == 500_000 and covered[0] == 499_995


def test_one_class_gives_no_model():
    assert R.fit(np.zeros((30, 5)), np.zeros(30)) is None


def corpus(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, 60))
        if i % 10 == 0:
            text = "\n".join([text.upper(), text, text.replace(" ", "  ")])
        elif i % 10 == 1:
            text += " " + " ".join(text.split()[:8])  # repeated, but too little of it
        rows.append((i, text))
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "…"), (None, rows[0][1]), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as share", "2 as probability")


def test_classifier_finds_what_the_exact_measure_finds(spark):
    df = corpus(spark)
    model = R.train(df, rows=300)
    assert model is not None
    exact = sorted(str(r.doc_id) for r in R.repeated_share(df).where("n_words > 0 and share >= 0.3").collect())
    assert sorted(str(r.doc_id) for r in R.repeated_share(df, model=model, found=True).collect()) == exact
    assert exact.count("0") == 2 and "None" in exact and len(exact) == 42
    scored = R.repeated_share(df, model=model).where("doc_id < 400").collect()
    hit = [r.probability for r in scored if r.share >= 0.3]
    miss = [r.probability for r in scored if r.share < 0.3]
    assert min(hit) > 0.3 > max(miss)


def test_texts_below_the_threshold_are_not_measured(spark):
    df = corpus(spark)
    model = R.train(df, rows=300)
    assert R.repeated_share(df, model=model, found=True, low=1.1).count() == 0
    # Buckets of hashed n-grams carry the decision, not one column that is the label itself.
    assert np.count_nonzero(model.weights[: R.KINDS * R.BUCKETS]) > 100 and R.PASSAGE not in R.WORD_GRAMS


def test_recall_and_calibration_on_held_out_texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    texts = []
    for i in range(1500):
        own = rng.choice(words, rng.integers(20, 200)).tolist()
        again = int(rng.choice([0, 0, 0.1, 0.5, 0.9]) * len(own))
        texts.append(" ".join(own + own[:again]))
    w, count, covered = R.measure(texts)
    label = covered >= R.SHARE * count
    table = R.dense(R.features(w), len(texts))
    model = R.fit(table[:900], label[:900])
    p = model.probability(R.features(w), len(texts))[900:]
    assert (p[label[900:]] >= R.LOW).mean() > 0.99 and (p >= R.LOW).mean() < 0.8
    assert abs(p.mean() - label[900:].mean()) < 0.05


def test_long_texts_give_a_part_of_their_grams():
    rng = np.random.default_rng(6)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(20_000))
    w = R.read([long, long + " " + long])
    table = R.dense(R.features(w), 2)
    assert table[0, R.KINDS * R.BUCKETS + 2] < 0.01 and abs(table[1, R.KINDS * R.BUCKETS + 2] - 0.5) < 0.05
    assert R.exact(w.of(np.array([False, True]))).tolist() == [20_000]


def test_defined_results(spark):
    df = corpus(spark)
    got = {r.doc_id: r for r in R.repeated_share(df).collect()}
    assert got[900].n_words == got[901].n_words == got[902].n_words == 0 and got[900].share == 0 and got[1].probability is None
    assert R.train(df.limit(0)) is None and R.repeated_share(df.limit(0), found=True).count() == 0
    assert R.repeated_share(df, model=None, found=True).count() == 42


def test_features_look_at_every_position():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(900)]
    texts = [" ".join(rng.choice(words, size)) for size in (3, 40, 700, 3000)] + ["", "Ab, cd. " * 40, "é x"]
    texts.append(texts[3] + " " + texts[3][2000:2600])
    table = R.dense(R.features(R.read(texts)), len(texts))
    for text, row in zip(texts, table):
        points = R._folded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        points = points[points != R._DROP].tolist()
        own = "".join(chr(p) if p != R._GAP else " " for p in points).split()
        for kind, (of, size) in enumerate([*((own, n) for n in R.WORD_GRAMS), (points, R.CHAR_GRAM)]):
            grams = [tuple(of[i : i + size]) for i in range(len(of) - size + 1)]
            again = (len(grams) - len(set(grams))) / max(1, len(grams))
            assert np.isclose(row[R.KINDS * R.BUCKETS + kind], again) and np.isclose(row[kind * R.BUCKETS : (kind + 1) * R.BUCKETS].sum(), again)
    # And what a text gives doesn't hang on the texts beside it.
    alone = np.vstack([R.dense(R.features(R.read([t])), 1) for t in texts])
    assert np.array_equal(alone, table)
