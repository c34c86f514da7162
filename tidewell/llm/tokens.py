"""Token ids by the tokenizers library, with a bounded cache of ids by chunk of text.

Texts are cut into chunks that the tokenizer can't join: its pre-tokenizer never lets a token cross from white space
into what follows, but for the one space before a word. The ids of a chunk are therefore the same alone and in its text,
and frequent chunks are encoded once. A tokenizer of another make is given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Entries of the cache, which is emptied when it is full.
CACHE = 600_000
#: Unicode's White_Space.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_WORDS = re.compile(rf"[^{_WHITE}]+")


def chunk_pattern(spec: dict) -> re.Pattern | None:
    """How texts may be cut for the tokenizer of this description; None: not at all."""
    model, before, normalizer = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout"):
        return None
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normalizer:
        return _SPACED
    steps = before.get("pretokenizers") or []
    if [x.get("type") for x in steps] == ["Split", "ByteLevel"] and (normalizer or {}).get("type") == "Sequence":
        split = steps[0]
        drops = split.get("behavior") == "Removed" and split.get("invert") and not steps[1].get("use_regex")
        plain = [x.get("type") for x in normalizer["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        if drops and plain and not steps[1].get("add_prefix_space") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
            return _WORDS
    return None


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Ids by chunk; what is not there is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[chunk] = self.encode(chunk)
        return ids


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.pattern = chunk_pattern(json.load(f))
        self.words = self.pattern is _WORDS
        self.letters = byte_letters()
        self.marks = {c: self._plain(c) for c in ".,;:!?"}
        self.cache = _Cache(self._chunk)

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk; a word of Latin-1 letters is one pre-token, and goes to the model as such."""
        mark = self.marks.get(chunk[-1])
        if mark is not None:
            head = chunk[:-1]
            if head.isalpha() or head[:1] == " " and head[1:].isalpha():
                return self.cache[head] + mark
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            if chunk.isascii():
                raw = chunk.lower() if self.words else chunk.replace(" ", self.letters[0x20])
            else:
                try:
                    chunk.encode("latin-1")
                except UnicodeEncodeError:
                    return self._plain(chunk)
                raw = (chunk.lower() if self.words else chunk).encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        return self._plain(chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern is None:
            return self._plain(text)
        if self.words and not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            chunks = text.split()
        else:
            chunks = self.pattern.findall(text)
        return b"".join(map(self.cache.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)
