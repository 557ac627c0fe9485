import random

import numpy as np
import pytest

from tidemark.llm import garbled

SYLLABLES = {
    "german": "schö grün über weiß äpfel straße müde haus baum licht", "french": "é très à çon élève forêt où naïf chat porte", "polish": "łódź żaba ść kręt dąb wę ćma dom kot ryba",
    "russian": "лес дом река щёки ты вор преда мост небо ночь", "greek": "λόγος καλό θήρα μέρα δες σύν πρι των ρα βο", "japanese": "橋木雨流 カタミれ 結ぶ木の 雨をれ 流カソ",
}


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        words = SYLLABLES[rnd.choice(list(SYLLABLES))].split()
        lines = ["# " + " ".join(rnd.choices(words, k=8)) for _ in range(4)] + ["x = compute(y) + 1"]
        if k % 4 == 0:  # marks that occur by themselves in code
            lines.append("# " + " ".join(rnd.sample("½ ° ´ … ™ │ × → ─".split(), 3)))
        out.append("\n".join(lines))
    return out


def sloppy(raw: bytes, codec: str) -> str:
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


GARBLE = {
    "utf-8 as cp1252": lambda s: sloppy(s.encode(), "cp1252"), "utf-8 as latin-1": lambda s: s.encode().decode("latin-1"), "utf-8 as cp437": lambda s: s.encode().decode("cp437"), "utf-8 as mac-roman": lambda s: s.encode().decode("mac-roman"),
    "utf-8 as koi8-r": lambda s: s.encode().decode("koi8-r"), "twice": lambda s: sloppy(sloppy(s.encode(), "cp1252").encode(), "cp1252"),
}


@pytest.fixture(scope="module")
def labeller():
    texts = corpus()
    return garbled.Labeller(garbled.CleanModel(*garbled.counted(texts)))


@pytest.mark.parametrize("kind", list(GARBLE))
def test_garbled_lines_are_found_and_restored(labeller, kind):
    rnd = random.Random(2)
    clean = corpus(seed=9, n=80)
    texts, want = [], []
    for t in clean:
        lines = t.split("\n")
        k = rnd.randrange(4)
        if lines[k].isascii():
            continue
        texts.append("\n".join([*lines[:k], GARBLE[kind](lines[k]), *lines[k + 1 :]]))
        want.append(t)
    found = labeller.label(texts)
    assert sum(f is not None for f in found) >= 0.95 * len(texts)
    assert sum(f is not None and f[0] == w for f, w in zip(found, want)) >= 0.9 * len(texts)


def test_single_byte_pairs(labeller):
    ru = "\n".join("# " + w for w in ["лес дом река щёки ты вор", "мост небо ночь преда"])
    found = labeller.label([ru.encode("cp1251").decode("koi8-r"), ru.encode("koi8-r").decode("cp1251"), ru])
    assert found[0][0] == ru and found[1][0] == ru and found[2] is None


def test_lost_bytes_are_garbled_but_not_restored(labeller):
    text = "# sch�n gr�n �ber m�de"
    (restored, chars, lost), = labeller.label([text])
    assert restored == text and chars == lost == 4


def test_clean_texts_stay_clean(labeller):
    odd = ["", "plain ASCII only", "# ½ ° ´ … ™ │ ×", "# é", "﻿x", "a b"]
    assert not any(labeller.label(odd))
    clean = corpus(seed=11, n=200)
    assert sum(f is not None for f in labeller.label(clean)) == 0


def test_utf8_parser():
    text = "aé漢🛠z"
    b = np.frombuffer(text.encode() + b"\xff\xc3", np.uint8).astype(np.int32)
    cp, inner = garbled.parse_utf8(b)
    assert [chr(x) for x, i in zip(cp, inner) if x >= 0 and not i] == list(text)
    assert cp[-1] == -1 and not inner[-1]
    assert (garbled.parse_utf8(np.array([0xED, 0xA0, 0x80, 0xC0, 0x80]))[0] == -1).all()


def test_long_texts_are_labelled_in_pieces(labeller, monkeypatch):
    from tidemark.llm.texts import portions

    texts = corpus(seed=21, n=30)
    bad = GARBLE["utf-8 as cp1252"]("# schön grün über müde weiß\n")
    long = "\n".join(texts[:10]) + "\n" + bad + "\n".join(texts[10:20])
    monkeypatch.setattr(garbled, "PIECE", 300)
    found = labeller.label_all([long, "", *texts[20:]])
    assert found[0][0] == long.replace(bad, "# schön grün über müde weiß\n") and found[1:] == [None] * 11
    assert list(portions(["aa", None, "bbb", "c" * 9, "d"], 4)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(portions([])) == []


def test_table(spark):
    texts = corpus(n=120)
    bad = GARBLE["utf-8 as cp1252"](texts[0].split("\n")[0]) + "\n" + texts[0]
    data = [(n, t) for n, t in enumerate(texts)] + [(1000, bad * 3), (1000, bad * 3), (1001, None), (1002, ""), (1003, "ascii")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS k", "2 AS restored")
    out = garbled.find_garbled(df).collect()
    assert {r.doc_id for r in out} == {1000} and len(out) == 2
    assert garbled.find_garbled(df.limit(0)).count() == 0
