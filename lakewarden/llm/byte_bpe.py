"""Byte-level BPE over a tokenizer file of the tokenizers library.

The file's vocabulary, read back as bytes, serves tiktoken as merge ranks, which gives the same ids
in a fifth of the time (the tests compare the two on odd texts). Two kinds of text go to the
tokenizers library itself: those with a special token, where these count, and those with a run of
LONG_BLANK blanks or more, which tiktoken's regular expression cannot take.

One encoder per worker process and file; it is read again after a restart.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

LONG_BLANK = 1000
# Fixed value: how this family of tokenizers splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)
_encoders: dict[tuple[str, bool], ByteEncoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one of
    those from U+0100 on, in order."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Encodes texts; `tokens` are the bytes of each id."""

    def __init__(self, path: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i
                 for word, i in parsed["model"]["vocab"].items() if word not in added}
        self.size = max(*ranks.values(), *added.values()) + 1
        self.tokens = [b""] * self.size
        for word, i in ranks.items():
            self.tokens[i] = word
        self.path, self.ranks = path, ranks
        self.takes_special = special
        self.special = list(added) if special else []

    @cached_property
    def fast(self):
        import tiktoken
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = not self.takes_special
        return whole

    @classmethod
    def of(cls, path: str, special: bool) -> ByteEncoder:
        """`special`: strings of special tokens inside a text become these tokens."""
        key = (path, special)
        if key not in _encoders:
            _encoders[key] = cls(path, special)
        return _encoders[key]

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or _BLANKS.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
