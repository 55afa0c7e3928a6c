import random

import pytest

from quire.llm import tokens as T

PATH = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
HARD = ["", "a", " ", " x", "it's  we're\n\n\n  end ", "中文字" * 3000, "q" * 20_000, " " * 7000 + "x", "\n" * 6000, "word " * 9000, "é ﬁ 𝛼😀 ​"]


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BITS", 4)
    monkeypatch.setattr(T, "CHUNK_MIN", 3)
    monkeypatch.setattr(T, "CHUNK_MAX", 64)


def plain(tool, text):
    return tool.encoding.encode_ordinary(text)


def test_chunked_ids_equal_plain_ids(small_chunks):
    tool = T.Encoder(PATH)
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ab's re ,.\n\t 19çğ中  😀-_") for _ in range(rng.randint(1, 4000))) for _ in range(120)]
    assert list(T.encode_texts(tool, texts)) == [plain(tool, t) for t in texts]


def test_equal_passages_are_encoded_once():
    tool = T.Encoder(PATH)
    passage = " ".join(f"word{i} stands here" for i in range(900))
    list(T.encode_texts(tool, [passage]))
    before = len(tool.cache)
    list(T.encode_texts(tool, ["Another beginning. " + passage]))
    assert len(tool.cache) - before <= 3


def test_json_file_gives_the_same_ids():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    tool = T.encoder(PATH)
    for text in ["Hello <|endoftext|> world", "  two  spaces", "Şekil 3.20 ıslak vanayı gösterir…"]:
        assert list(T.encode_texts(tool, [text]))[0] == other.encode(text, add_special_tokens=False).ids


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "abc", "z"), (3, "abc", "z"), (3, "abc", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (None, [39305]), (3, [39305]), (3, [39305])], key=str)
    assert T.encode_corpus(df.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in T.encode_corpus(df).schema] == ["bigint", "array<int>"]
    counts = T.count_tokens(df.withColumnRenamed("ids", "n_tokens"), ["doc_id"])
    assert sorted(r.n_tokens for r in counts.collect()) == [0, 0, 1, 1, 1]
