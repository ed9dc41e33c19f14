"""Byte-level BPE ids of whole texts, for the operators that need token ids.

The vocabulary file (a ``tokenizers`` JSON) is a parameter; ids always equal those of the ``tokenizers`` library. Texts of
Latin script and common punctuation go through ``tiktoken`` with the same vocabulary (merge ranks equal ids), which is
several times faster; texts with any other character, or with an added token's literal string, go through ``tokenizers``.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

EOS = 2
#: The pattern of byte-level BPE pre-tokenisation (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which both libraries' Unicode tables are known to agree (tests compare them).
PLAIN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) -> list of ids, without special tokens added."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = list(added)
        self.spaced = np.zeros(max([*ranks.values(), *added.values()]) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def plain(self, text: str) -> bool:
        """Whether tiktoken may read text."""
        return (text.isascii() or not PLAIN.search(text)) and not any(x in text for x in self.added)

    def ids(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.plain(text) else self.exact.encode(text, add_special_tokens=False).ids

    def array(self, text: str) -> np.ndarray:
        return np.asarray(self.ids(text), dtype=np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)
