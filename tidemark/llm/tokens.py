"""Token ids of whole texts through the tokenizers library, with a bounded memo of words.

A byte-level pre-tokenizer of this family never lets a token cross the place before a single space that a
non-space follows. Texts are cut there, each distinct piece is encoded once for each Python worker, and a
document's ids are gathered from the memo. The memo starts anew when it is full, so memory is bounded and
results never depend on it. Ids are those of the library's encode(text, add_special_tokens=False): a text that
holds an added token's own string, and every text where the file describes another kind of tokenizer, goes to it whole.

Defined cases: an empty text has no ids; a text of any length is held in memory once, with its ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack

from tokenizers import Tokenizer

from .common import alone

#: Words of the memo: more take memory, fewer time.
MOST = 700_000
#: Pre-tokens that are the same whatever the version of Unicode: letters, marks, one line end before a non-space.
_PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[.,;:!?#$%&*|()\-]+|\n(?=\S)")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_SPACED = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-to-letter table of byte-level BPE: printable Latin-1 stays, other bytes follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + k) for k, b in enumerate(moved)}


class Encoder:
    """one(text) -> the ids of the text as little-endian unsigned 32-bit integers, one after another."""

    def __init__(self, path: str, most: int = MOST) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        strings = [re.escape(t["content"]) for t in about.get("added_tokens") or []]
        self.added = re.compile("|".join(strings)) if strings else None
        before = about.get("pre_tokenizer") or {}
        cut_alike = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.by_words = bool(cut_alike and about["model"]["type"] == "BPE" and not about.get("normalizer") and not about["model"].get("dropout"))
        self.model, self.most = self.tokenizer.model, most
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.memo: dict[str, bytes] = {}  # words, without the space before them, to their packed ids
        self.older: dict[str, bytes] = {}
        self.parts = _Parts(self)
        self.one_id = [pack("<I", i) for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]  # at once, so that no id keeps a page of forgotten words

    def forget(self) -> None:
        self.memo, self.older = {}, {}
        self.parts.clear()

    def packed(self, piece: str) -> bytes:
        parts = _PARTS.findall(piece)
        if sum(map(len, parts)) == len(piece):
            return b"".join([self.word(x[1:]) if _SPACED(x) else self.parts[x] for x in parts])
        return self.whole(piece)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def part(self, x: str) -> bytes:
        if not x.isascii():
            x = x.encode().decode("latin-1")
        one = self.one_id
        return b"".join([one[t.id] for t in self.model.tokenize(x.translate(self.letters))])

    def word(self, word: str) -> bytes | None:
        """The ids of the word after a space; None for what is not a word."""
        ids = self.memo.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                if _LETTERS(word):
                    ids = self.part(" " + word)
                elif not word or word[0].isspace():
                    return None
                else:
                    ids = self.packed(" " + word)
            self.memo[word] = ids
        return ids

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words or self.added and self.added.search(text):
            return self.whole(text)
        if len(self.memo) > self.most:
            self.older, self.memo = self.memo, {}  # words that come again move back from there
            self.parts.clear()
        first, *rest = text.split(" ")
        found = list(map(self.memo.get, rest))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = ids = self.word(rest[k])
                if ids is None:  # runs of white space: pieces of several words
                    return b"".join([self.packed(p) for p in _pieces(first, rest)])
        return (self.packed(first) if first else b"") + b"".join(found)


def _pieces(first: str, rest: list[str]) -> list[str]:
    """The text cut before each single space that a non-space follows."""
    pieces = [first]
    for word in rest:
        if word and not word[0].isspace():
            pieces.append(" " + word)
        else:
            pieces[-1] += " " + word
    return [p for p in pieces if p]


class _Parts(dict):
    """Pre-tokens other than a word after a space to their packed ids: words that differ in the marks around them share these."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, x: str) -> bytes:
        self[x] = ids = self.encoder.part(x)
        return ids


@lru_cache(maxsize=2)
def _made(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str, most: int = MOST) -> Encoder:
    """One for each Python worker; workers serve many tasks. Its memo goes when another operator's task begins."""
    found = _made(path)
    found.most = most
    alone(f"tokens {path}", found.forget)
    return found
