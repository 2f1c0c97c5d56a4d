"""Token ids of whole texts, by the tokenizers library with a memo for words.

A byte-level BPE never joins pieces across a plain space or a lone line break,
so a text's ids are the ids of its segments in order.  Segments recur; each
worker keeps the ids of those it has met (up to MEMO of them) and asks the library
only for the others.  Segments or texts outside the plain alphabet below
go to the library as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

#: Segments whose ids a worker keeps; later ones are encoded again when they recur.
MEMO = 500_000
# The byte-level alphabet of published byte BPE vocabularies, and its splitting pattern.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that both families of patterns split off after letters.
_ENDS = ".,;:!?"


def _byte_alphabet() -> dict[int, str]:
    rest = (b for b in range(256) if b not in set(_PLAIN_BYTES))
    return {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """What make() gives for a key, made when a key is first looked up: one lookup for each segment, no set of new ones before it."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    """One for each worker process and file, so that its memo lives longer than a task."""
    return SegmentEncoder(path)


class SegmentEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    A text that contains the string of a special token goes to the library whole,
    which gives it that token's id.
    """

    def __init__(self, path: str):
        self.whole = tokenizer(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        pre = json.loads(self.whole.to_str())["pre_tokenizer"]
        self.spaced = pre["type"] == "ByteLevel"  # a piece keeps the space before it
        pattern = _BYTE_PATTERN if self.spaced else next(p["pattern"]["Regex"] for p in pre["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.alphabet = str.maketrans(_byte_alphabet())
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.plain = re.compile("[ \n]?[!-~À-ÖØ-öø-ÿŒœ]*")
        self.word = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([{_ENDS}]?)")
        self.odd_space = re.compile(f"[{_SPACES}]".replace(" ", "").replace(r"\t-\r", r"\x00-\x09\x0b-\x1f"))
        self.coarse = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        self.memo = Memo(self._new)
        self.piece_memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (ids := self.piece_memo.get(piece)) is None:
            # printable ASCII but the space stands for itself in the byte alphabet
            text = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
            four = self.four
            ids = b"".join([four[t.id] for t in self.model.tokenize(text)])
            if len(self.piece_memo) < MEMO // 2:
                self.piece_memo[piece] = ids
        return ids

    def _segment(self, text: str) -> bytes:
        if not self.plain.fullmatch(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._piece, self.pieces.findall(text if self.spaced else text.lower())))

    def _split(self, text: str) -> list[str]:
        """Segments in the form of the memo's keys: without the space that stands before most."""
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or self.odd_space.search(text):
            return [s[1:] if s[0] == " " and self.plain.fullmatch(s) and len(s) > 1 else "\0" + s for s in self.coarse.findall(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def _new(self, key: str) -> bytes:
        # most new segments are ASCII words, for which the pattern isn't needed
        if key.isascii():
            if key.isalpha():
                return self._piece(" " + key if self.spaced else key.lower())
            if (word := key[:-1]).isalpha() and key[-1] in _ENDS:
                return self._piece(" " + word if self.spaced else word.lower()) + self._piece(key[-1])
        if found := self.word.fullmatch(key):
            word, mark = found.groups()
            ids = self._piece(" " + word if self.spaced else word.lower())
            return ids + self._piece(mark) if mark else ids
        if not self.spaced:
            return self._segment(key) if key else b""
        if key[:1] == "\0":
            return self._segment(key[1:]) if len(key) > 1 else b""
        return self._segment(key if key[:1] == "\n" else " " + key)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        memo = self.memo
        get = memo.__getitem__
        found = [b"".join(map(get, self._split(t))) if t and i not in whole else b"" for i, t in enumerate(texts)]
        for _ in range(len(memo) - MEMO):  # the latest go first; frequent segments came early
            memo.popitem()
        for i in whole:
            found[i] = array("I", self.whole.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return found
