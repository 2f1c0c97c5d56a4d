"""Ids of the memoized encoder against the library's."""

from array import array

import pytest

from foyer.llm import queries, tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_ascii_words_need_no_pattern(name):
    path = queries.tokenizer_path(name)
    own, library = tokens.SegmentEncoder(path), tokens.tokenizer(path)
    texts = ["Plain words, new ones; and again: words, Words! x y. a", "one", "", "Zwölf Wörter, l'été"]
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert own.encode(texts) == want
    own = tokens.SegmentEncoder(path)
    own.encode(["x"])  # a text's first word has a mark of its own
    own.word = None  # plain words and marks are told without the first pattern
    text = "words, Words! x y. a"
    assert own.encode([f"x {text}"])[0] == array("I", library.encode(f"x {text}", add_special_tokens=False).ids).tobytes()
