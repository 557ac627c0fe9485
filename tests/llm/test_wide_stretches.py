"""UTF-8 that was read with two bytes a character, beside ASCII that could be second bytes."""

import random

import pytest

from tidemark.llm import garbled

WORDS = "schön grün über weiß äpfel straße müde haus baum licht 橋木雨流 結ぶ木の 流カソ の世 カタミ x=[n] {k|v} café".split()


@pytest.fixture(scope="module")
def labeller():
    rnd = random.Random(4)
    texts = ["# " + " ".join(rnd.choices(WORDS, k=8)) for _ in range(1500)]
    return garbled.Labeller(garbled.CleanModel(*garbled.counted(texts)))


def candidates(labeller, stretch):
    first = 1 + len(garbled.PAIRS) - len(garbled.WIDE_READ)
    return {(garbled.PAIRS[s - 1][1], text) for s, _, text in labeller.wide(stretch) if s >= first}


def test_ascii_in_a_stretch_is_kept(labeller):
    assert ("gbk", "schön") in candidates(labeller, "sch枚n")
    assert "[銈裤伄]".encode("gbk").decode() == "[タの]"
    assert ("gbk", "[タの]") in candidates(labeller, "[銈裤伄]")
    assert ("gbk", "タの") in candidates(labeller, "銈裤伄")  # as before
    assert not candidates(labeller, "n橋木m")  # clean text has no reading as UTF-8


def test_labels(labeller):
    texts = ["# sch枚n", "# [銈裤伄]", "# schön x", "# [橋木雨流] n", "# a橋木 b流カソc"]
    found = labeller.label(texts)
    assert [f and f[0] for f in found] == ["# schön", "# [タの]", None, None, None]
