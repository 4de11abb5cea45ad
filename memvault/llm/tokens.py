"""Tokenizing in workers: texts are cut into parts that encode on their own, and parts are looked up in caches.

``byte_level`` tokenizers (GPT-2 pattern) may be cut before a single space
between two other characters: no pre-token spans that place, and the whole-text
encoding is the encodings of the parts in turn. Tokenizers that drop blanks may
be cut at any space or line feed.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Parts that a worker keeps, and their characters in all; a full cache starts anew.
KEPT_PARTS, KEPT_CHARS = 400_000, 8_000_000
#: Characters of text that are cut up at a time.
SEGMENT = 1 << 20
#: The pre-token pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BESIDE_BLANK = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """text in pieces of about size characters that begin where a part may; a later piece begins with its space."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def parts(segment: str) -> list[str]:
    """The parts of a segment; all but the first stand after a space that is left out here."""
    if _BESIDE_BLANK.search(segment, 1) or segment[-1:].isspace():
        head, rest = segment[:1], segment[1:]
        found = _CUT.split(rest) if head.isspace() else _CUT.split(segment)
        if head.isspace():
            found[0] = head + found[0]
        return found
    if segment[:1] == " ":
        first, *rest = segment[1:].split(" ")
        return [" " + first, *rest]
    return segment.split(" ")


@cache
def ordinary(path: str):
    """The same byte-level vocabulary for tiktoken, which is faster, and which ids begin with a space.

    None if ids aren't in the order of the merges, for then ranks can't stand for them.
    """
    import tiktoken

    given = json.loads(load(path).to_str())["model"]
    signs = _byte_signs()
    ranks = {bytes(signs[c] for c in word): i for word, i in given["vocab"].items() if all(c in signs for c in word)}
    merged = [given["vocab"]["".join(pair)] for pair in given["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    ranks = {word: i for word, i in ranks.items() if i < 256 + len(merged)}
    spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
    spaced[[i for word, i in ranks.items() if word[:1] == b" "]] = True
    return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spaced


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class PartIds:
    """The ids of parts as bytes of little-endian unsigned 32-bit numbers, through a bounded cache."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        found = load(self.path).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def spaced(self, parts: list[str]) -> list[bytes]:
        """The ids of parts after their spaces. Parts without inner spaces are encoded in one go and told apart by the spaces."""
        text = " " + " ".join(parts)
        quick = ordinary(self.path)
        if quick is None or "<|" in text or text.count(" ") != len(parts):
            return self.encode([" " + x for x in parts])
        ids = np.array(quick[0].encode_ordinary(text), dtype="<u4")
        bounds = (4 * np.flatnonzero(quick[1][ids])).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(bounds, [*bounds[1:], len(data)], strict=True)]

    def text_ids(self, text: str) -> bytes:
        out = []
        for segment in segments(text):
            first, *rest = parts(segment)
            out += self.encode([first])
            found = list(map(self.known.get, rest))
            if None in found:
                missing = [x for x, ids in zip(rest, found, strict=True) if ids is None]
                new = self.spaced(missing)
                if len(self.known) > KEPT_PARTS or self.chars > KEPT_CHARS:
                    self.known, self.chars = {}, 0
                self.known.update(zip(missing, new, strict=True))
                self.chars += sum(map(len, missing))
                more = iter(new)
                found = [next(more) if ids is None else ids for ids in found]
            out += found
        return b"".join(out)


@cache
def part_ids(path: str) -> PartIds:
    """This worker's cache for a tokenizer."""
    return PartIds(path)
