from datetime import datetime

import pandas as pd
import pytest

from quire.llm import pairs as P
from quire.llm.align import Table

AT = datetime(2025, 1, 1)
WORDS = {"old": "eski", "tank": "tank", "red": "kırmızı", "map": "haritayı", "lost": "kaybetti", "wheel": "çark", "sold": "sattı", "new": "yeni", "bell": "zili", "clock": "saat", "found": "buldu", "deep": "derin", "river": "nehri", "the": "o"}
TABLE = Table({t.replace("ı", "i"): [(s, 1.0)] for s, t in WORDS.items()}, {s: 0.4 for s in WORDS}, set(WORDS))
SOURCE = "The old wheel sold the red map. The new clock found the deep river. The old wheel lost the new bell."
FULL = "Eski çark kırmızı haritayı sattı. Yeni saat derin nehri buldu. Eski çark yeni zili kaybetti."


@pytest.mark.parametrize("source, target, defect", [
    (SOURCE, FULL, None), (SOURCE, None, "empty"), (SOURCE, " […] “—” ", "empty"), (SOURCE, "​", "empty"),
    (SOURCE, "Eski çark kırmızı haritayı sattı.", "truncated"), (SOURCE, "Eski çark kırmızı haritayı sattı. Yeni saat…", "truncated"),
    ("The old wheel sold the red map.", "Eski çark…", "truncated"), (SOURCE, FULL.rsplit(".", 2)[0] + ". Eski çark yeni zili kaybetti.", None),
    (SOURCE, SOURCE, "copy"), (SOURCE, f"Translation: {SOURCE.upper()}", "copy"), (SOURCE, SOURCE.replace("river", "nehir"), "copy"),
    (SOURCE, "I'm sorry, but I can't translate this passage.", "refusal"), (SOURCE, "Üzgünüm, bu metni çeviremiyorum.", "refusal"), (SOURCE, "Leider kann ich diesen Abschnitt nicht übersetzen.", "refusal"),
    (SOURCE, "Das alte Rad verkaufte die rote Karte. Die neue Uhr fand den tiefen Fluss.", "wrong_language"), (SOURCE, "La vieille roue a vendu la carte rouge dans le port.", "wrong_language"),
    ("“I'm sorry,” said the old clock.", "Eski saat “Üzgünüm,” dedi.", None), ("He read “Der runde Tank” on the old map.", "Eski haritayı “Der runde Tank” diye okudu.", None),
    ("Old map", "x", None), ("Selrin 87; Tannes 88; Narlo 89", "Selrin 87; Tannes 88; Narlo 89", None), ("25.3 kW 17 bar 9 rpm", None, None),
])
def test_defects(source, target, defect):
    rows = pd.DataFrame({"source_text": [source], "translated_text": [target], "shortened": [False], "at_limit": [False]})
    assert P.judge(rows, TABLE) == [defect]


def test_copy_measure():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / len(a)

    a = "the red fox ran over the red hill".split()
    for b in (a, a[::-1], a[1:], ["x", *a], a[:4] + ["y"] + a[5:]):
        assert P.in_order(a, b) == pytest.approx(plain(a, b)) or P.in_order(a, b) == 0.0 and plain(a, b) < P.COPY


def frame(spark, rows):
    return spark.createDataFrame(rows, "entry_id long, reason string, source_text string, translated_text string, loaded_at timestamp")


def sides(spark, rows):
    return spark.createDataFrame(rows, "entry_id long, s string, t string")


def test_neighbours_and_limits(spark):
    rows = [(i, "s", "Kısa metin") for i in range(3)] + [(8, "s", "Kısa metin…"), (9, "s", "Kısa metin devam eder"), (10, "other", "Kısa"), (11, "s", None), (12, "s", " …")]
    rows += [(100 + i, "s", f"{'abcdefgh' * 6}{i:02d}") for i in range(60)] + [(200 + i, "s", f"{i:02d}" + "x" * (38 + i % 20) + ".") for i in range(40)]
    df = sides(spark, rows)
    got = {r.entry_id: r for r in P.neighbours(df).collect()}
    assert {k for k, r in got.items() if r.shortened} == {0, 1, 2, 8, 10} and len(got) == len(rows)
    assert all((r.bare + r.tail if r.tail is not None else None) == dict((i, t) for i, _, t in rows)[k] for k, r in got.items())
    assert [r["size"] for r in P.limits(df).collect()] == [50]
    assert P.neighbours(df.limit(0)).count() == 0 and P.limits(df.limit(0)).count() == 0


def test_frame(spark):
    lexicon = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(WORDS.items())], "word_id int, en string, tr string")
    rows = [(i, "fragment", SOURCE, FULL, AT) for i in range(40)]
    rows += [(100, None, SOURCE, None, AT), (101, "kept_original", SOURCE, None, AT), (102, "could_not_fit", None, None, AT), (None, None, SOURCE, None, AT), (103, "x", SOURCE, SOURCE, AT), (104, "x", "", "", AT)]
    rows += [(105, None, SOURCE, SOURCE, AT), (105, None, SOURCE, FULL, datetime(2026, 1, 1)), (106, None, SOURCE * 400, SOURCE * 400, AT), (100, None, SOURCE, None, AT)]
    df = frame(spark, rows).selectExpr("*", "1 as defect", "2 as shortened", "3 as size")
    assert sorted(tuple(r) for r in P.broken_pairs(df, lexicon).collect()) == [(100, "empty"), (103, "copy"), (106, "copy")]
    assert P.broken_pairs(df.limit(0), lexicon.limit(0)).count() == 0
