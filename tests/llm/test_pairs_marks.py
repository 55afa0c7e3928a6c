"""The marks of the sorted responses, and what they decide."""

from datetime import datetime

import pandas as pd
import pytest

from quire.llm import pairs as P

from test_pairs import FULL, SOURCE, TABLE, WORDS, frame, sides

AT = datetime(2025, 1, 1)
PART = "Eski çark kırmızı haritayı sattı. Yeni saat derin nehri buldu."


@pytest.mark.parametrize("target, shortened, at_limit, defect", [
    ("Mavi kedi.", False, False, None), ("Mavi kedi.", True, False, "truncated"), (FULL, True, False, None), (FULL[:-1], False, True, None),
    ("Mavi kedi" + " mavi kedi" * 10 + ".", True, False, None), (PART, True, False, "truncated"), (FULL.replace("kırmızı ", "").replace("derin ", "").replace("yeni ", ""), True, False, None),
])
def test_the_mark_is_a_candidate_and_the_length_confirms(target, shortened, at_limit, defect):
    rows = pd.DataFrame({"source_text": [SOURCE], "translated_text": [target], "shortened": [shortened], "at_limit": [at_limit]})
    assert P.judge(rows, TABLE) == [defect]


@pytest.mark.parametrize("target, template, defect", [
    ("Kurallarım bu satırları işlememe izin vermiyor, başka metin gönderin.", False, None), ("Kurallarım bu satırları işlememe izin vermiyor, başka metin gönderin.", True, "refusal"),
    (FULL, True, None), ("Das alte Rad verkaufte die rote Karte.", False, "wrong_language"), ("Darf ich nicht bearbeiten, bitte teilen Sie mehr mit.", True, "refusal"),
])
def test_a_template_that_renders_nothing_declines(target, template, defect):
    rows = pd.DataFrame({"source_text": [SOURCE], "translated_text": [target], "shortened": [False], "at_limit": [False], "template": [template]})
    assert P.judge(rows, TABLE) == [defect]


def test_templates_are_told_from_renderings_of_like_sources(spark):
    rows = [(1, "The old wheel sold the map.", "Kurallarım çark geçen satırları işlememe izin vermiyor."), (2, "A new clock found rivers.", "Kurallarım saat geçen satırları işlememe izin vermiyor. Lütfen gönderin.")]
    rows += [(3, "As a rule, the old wheel turned.", "Kural olarak eski çark döndü."), (4, "As a rule, the old clock turned.", "Kural olarak eski saat döndü."), (5, "x", None)]
    got = {r.entry_id: r.template for r in P.neighbours(sides(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_edges_of_partitions_and_long_runs_of_equal_texts(spark):
    equal = [(i, "s", "Aynı metin burada durur") for i in range(2000)]
    rows = equal + [(5000 + i, f"s{i}", f"Aynı metin burada durur ve uzar {i:04d}") for i in range(1000)]
    got = P.neighbours(sides(spark, rows).repartition(7)).collect()
    assert len(got) == 3000 and {r.entry_id for r in got if r.shortened} == {i for i, _, _ in equal}


def test_broken_pairs_uses_the_mark(spark):
    lexicon = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(WORDS.items())], "word_id int, en string, tr string")
    rows = [(i, "fragment", SOURCE, FULL, AT) for i in range(40)] + [(100, None, SOURCE, "Mavi kedi.", AT), (101, "kept_original", "Other words", "Mavi kedi uyudu.", AT), (102, None, "Some other words stand here.", "Mavi kedi uyudu ve sonra gitti.", AT)]
    got = {tuple(r) for r in P.broken_pairs(frame(spark, rows), lexicon).collect()}
    assert (100, "truncated") in got


def test_equal_texts_of_many_sources_go_on_across_partitions(spark):
    rows = [(i, f"s{i}", "Aynı metin burada durur") for i in range(2000)] + [(5000, "x", "Aynı metin burada durur ve uzar")]
    got = P.neighbours(sides(spark, rows).repartition(7)).collect()
    assert len(got) == 2001 and {r.entry_id for r in got if r.shortened} == set(range(2000))


def test_a_template_is_found_beyond_the_neighbours(spark):
    lexicon = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(WORDS.items())], "word_id int, en string, tr string")
    rows = [(i, "fragment", SOURCE, FULL, AT) for i in range(40)]
    # What stands between the two in the order of the texts has but the first word in common with them.
    rows += [(100 + i, None, f"The deep river lost {i} bells.", f"Kurallarım d{i:03} kayıp.", AT) for i in range(60)]
    rows += [(1, None, "The old wheel sold the map of Selrin.", "Kurallarım araba geçen satırları işlememe izin vermiyor.", AT), (2, None, "New bells found rivers near Tannes.", "Kurallarım zil geçen satırları işlememe izin vermiyor.", AT)]
    rows = [(k + 1000 * (k < 40 and s == SOURCE), r, s, t, at) for k, r, s, t, at in rows]
    got = dict(tuple(r) for r in P.broken_pairs(frame(spark, rows), lexicon).collect())
    assert got[1] == got[2] == "refusal" and "refusal" not in {got.get(100 + i) for i in range(60)}


def test_the_search_agrees_with_comparing_all(spark):
    import random

    rng = random.Random(8)
    rows = sorted({(" ".join(rng.choices(["the", "old", "map", "red", "bell", "sun", "of"], k=rng.randint(2, 4))), " ".join(rng.choices("abc", k=rng.randint(1, 9)))) for _ in range(150)})
    near = [P._Near(b, s) for s, b in rows]
    for i, x in enumerate(near):
        for y in near[:i]:
            x.compare(y)
    df = spark.createDataFrame([(s, b, *P._Near(b, s).begins()) for s, b in rows], "s string, bare string, head string, small long")
    got = {tuple(r) for r in P.begins_alike(df, df).collect()}
    assert got == {(x.source, x.bare) for x in near if x.like >= P.TEMPLATE} and 0 < len(got) < len(rows)
