"""Token ids of whole texts, from vocabulary files of public tokenizers."""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import MEMO_WORD, memory

#: Words whose ids a worker remembers; it keeps the first, which hold the frequent ones.
MEMO = 400_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file is, by the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


_BYTES = _byte_characters()
_MARKS = (".", ",")
#: The pieces that word_bpe_49k.json merges within, and the same among lower-case characters below U+0100.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+").findall


def _plain(low: str) -> bool:
    """Whether all characters are below U+0100, where case and composition have no exceptions."""
    return low.isascii() or max(low) < "\u0100"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """A process's tokenizer for a vocabulary file."""
    return Tokenizer.from_file(path)


class IdBytes(dict):
    """Little-endian 32-bit ids of what stands between blanks or line ends, remembered up to a bound.

    Holds for tokenizers that drop white space before they merge, as word_bpe_49k.json does: there no token spans
    a blank, so a text's ids are those of its parts one after another.
    """

    def __init__(self, path: str):
        super().__init__()
        self.of = tokenizer(path)
        self.model = self.of.model
        steps = json.loads(self.of.pre_tokenizer.__getstate__()).get("pretokenizers", [{}]) if self.of.pre_tokenizer else [{}]
        added = {x.content[:1].lower() for x in self.of.get_added_tokens_decoder().values()}
        #: What added tokens begin with, which are found before any cut. Where that is one character and the pattern is
        #: known, parts of printable characters below U+0100 without it are cut here.
        self.added = min(added, default="\n")
        self.cuts = steps[0].get("pattern") == {"Regex": _PATTERN} and len(added) <= 1 and not self.added.isalnum()

    def __missing__(self, part: str) -> bytes:
        low, end = part.lower(), part[-1:]
        if self.cuts and _plain(part) and self.added not in part and part.isprintable():
            if low.isalpha():
                out = self.piece(low) if low != part else self.word(low)
            else:
                out = b"".join(map(self.piece, _PIECES(low)))
        elif end in _MARKS and part[:-1].isalpha():
            out = self[low[:-1]] + self[end] if _plain(low[:-1]) else self.encoded(part)
        elif part.isalpha() and _plain(low):
            out = self[low] if low != part else self.word(low)
        else:
            out = self.encoded(part)
        if len(self) < MEMO and len(part) <= MEMO_WORD:
            self[part] = out
        return out

    def piece(self, low: str) -> bytes:
        """Ids of one piece of lower-case characters below U+0100."""
        out = self.get(low)
        if out is None:
            out = self.word(low)
            if len(self) < MEMO and len(low) <= MEMO_WORD:
                self[low] = out
        return out

    def word(self, low: str) -> bytes:
        """Ids of one piece, as a lower-case word of letters, below U+0100: its bytes go to the merges as they are."""
        text = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES)
        ids = [x.id for x in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encoded(self, part: str) -> bytes:
        return np.array(self.of.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        """Ids of a whole text, as bytes."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def ids_of(path: str) -> IdBytes:
    """A process's remembered ids; a worker that is used again for tokens goes on with them."""
    return memory("tokens", path, make=lambda: IdBytes(path))


@lru_cache(maxsize=2)
def ranked(path: str):
    """A process's byte-level tokenizer for a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
