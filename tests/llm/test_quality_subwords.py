"""Subwords are n-grams of characters, whatever the script and the length of a word."""

import zlib

import pytest

from foliant.llm import quality


@pytest.mark.parametrize("word", ["a", "né", "été", "straße", "языка", "言語処理", "plain", "x" * 63, "ab" * 60, "éa" * 200, "😀😀😀"])
def test_subwords_by_hand(word):
    w = f"<{word}>"
    want = [zlib.crc32(w.encode()) % quality.BUCKETS]
    for seed, n in ((0, 3), (1, 4)):
        want += [zlib.crc32(w[i : i + n].encode(), seed) % quality.BUCKETS for i in range(len(w) - n + 1)]
    assert quality.subwords(word.encode()) == want


def test_long_words_with_equal_parts_share_subwords():
    one, two = (set(quality.subwords(b"https://site.example/" + b"same-part-of-a-path/" * 3 + end)) for end in (b"one", b"two"))
    assert len(one & two) > 50
