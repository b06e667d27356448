"""What the byte-pair operators share: tokenizer files, special strings, pre-token patterns."""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import regex

#: The pre-token patterns the tokenizer files stand for.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def read_spec(path: str | None, name: str) -> str:
    """The tokenizer file's text, read by the driver and sent to the workers in a broadcast."""
    with open(path or public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Spec:
    """A parsed tokenizer file."""

    def __init__(self, text: str) -> None:
        parsed = json.loads(text)
        model = parsed["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.merges: list[tuple[str, str]] = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def pieces(self, text: str) -> list[str]:
        """Text between special strings and, at odd places, the special strings themselves."""
        if self._cut is None or not any(s in text for s in self.specials):
            return [text]
        return self._cut.split(text)


@lru_cache(maxsize=4)
def spec_of(text: str) -> Spec:
    return Spec(text)
