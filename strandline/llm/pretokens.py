"""Byte-level BPE vocabularies read from a tokenizers file, and their pre-tokens."""

from __future__ import annotations

import json
import re
from functools import cache

import regex

#: Fixed value: the pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for texts of printable ASCII, tab, line ends and Latin-1 letters only, whose classes can be listed: twice as fast.
LETTERS, SPACES = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t\n\r"
LISTED = re.compile(f"[ -~\\t\\n\\r{LETTERS}]*").fullmatch
LISTED_FIND = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
FIND = regex.compile(PATTERN).findall


def find(text: str) -> list[str]:
    return LISTED_FIND(text) if LISTED(text) else FIND(text)


@cache
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: its own where Latin-1 prints it, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Vocabulary:
    """Ranks and ids over bytes, and added tokens, of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        to_byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.find = find
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def pretokens(self, text: str) -> list[str]:
        """In order; an added token that stands in the text is a piece of its own."""
        if not self.split or not any(s in text for s in self.added):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.split(text)):
            out += [part] if k % 2 else self.find(part)
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
