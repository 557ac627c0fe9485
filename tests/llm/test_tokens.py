import pytest

from tidemark.llm import tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return t


TEXTS = [
    None, "", " ", "a", "Hello world's end, it'll'RE  \n\n  x\t", "x = 12345 + 0xFF  # naïve café ß 漢字かな 한국어 עברית", "<|endoftext|> is text", "\x00\x1c\x1d\x85\xa0 　z", "aaaaaaa" * 9,
    "é̈ 🧑‍🌾🛠 ½²٣", "\r\n\r\n  \r", "'s't'LL 'x", "a" * 3000 + "Hello" * 300 + " " * 700 + "é" * 900,
]


def ids(encoder, texts):
    flat, offsets = encoder.encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_equals_the_library(library):
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert ids(tokens.Encoder(), TEXTS) == want


def test_every_single_character_and_pairs(library):
    texts = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [a + b for a in " a1'\n" for b in " a1'\n"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(tokens.Encoder(), texts) == want


def test_a_full_cache_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    e = tokens.Encoder()
    for t in ["one two three four", "two five six seven eight", "one"]:
        assert ids(e, [t]) == [library.encode(t, add_special_tokens=False).ids]


def test_table(spark, library):
    data = [(n, t, "clash") for n, t in enumerate(TEXTS)] + [(None, "a", "x"), (1, "a", "x"), (1, "a", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    out = tokens.encode_texts(df).collect()
    assert len(out) == len(data)
    got = {r.doc_id: r.ids for r in out if r.doc_id not in (1, None)}
    assert got == {n: library.encode(t or "", add_special_tokens=False).ids for n, t in enumerate(TEXTS) if n != 1}
    assert tokens.encode_texts(df.limit(0)).count() == 0
