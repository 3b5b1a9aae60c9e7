"""A byte-level BPE vocabulary, read from a tokenizer file in JSON; never trained here."""

from __future__ import annotations

import json
from functools import lru_cache

import regex
import tiktoken

# Fixed value: how this family of vocabularies splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """byte_bpe_50k.json of the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_by_letter() -> dict[str, int]:
    """Vocabulary files write a byte as a visible character: itself if printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """ranks: token bytes to id, in merge order; specials: strings that stand for one id each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _bytes_by_letter()
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in self.specials}
        for k, (left, right) in enumerate(content["model"]["merges"]):
            if content["model"]["vocab"][left + right] != 256 + k:
                raise ValueError("ids don't follow the order of merges")
        self.longest = max(map(len, self.ranks))
        self.splitter = regex.compile(SPLIT)
        self.coder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens=self.specials)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings: ordinary text at even places, special strings at odd ones."""
        if self._special is None or not any(s in text for s in self.specials):
            return [text]
        return self._special.split(text)

    def merge(self, piece: bytes) -> list[int]:
        """BPE of the bytes of one piece."""
        return self.coder._encode_single_piece(piece)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    return Vocabulary(path)
