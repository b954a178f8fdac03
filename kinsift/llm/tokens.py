"""Byte-level BPE ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Characters from here on may be classed by another Unicode version: such texts go through the library itself.
FIRST_UNSURE = "ɐ"
#: The pattern of the vocabulary for texts in which no two blanks meet; there its look-ahead never decides.
SINGLE_BLANKS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def default_paths() -> tuple[str, str, str]:
    """(library file, ranks of the same vocabulary, pattern) of the public vocabulary used by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class ByteBpe:
    """Encodes texts; special tokens' strings in a text are ordinary text."""

    def __init__(self, library_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.library_path, self._library = library_path, None
        self._make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pattern, self._plain = pattern, None
        self._single = self._make("single", SINGLE_BLANKS)
        self._blanks, self._unsure = re.compile(r"\s\s"), re.compile(f"[{FIRST_UNSURE}-\U0010ffff]")
        self.byte_lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for word, rank in ranks.items():
            self.byte_lengths[rank] = len(word)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self._unsure.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.library_path)
                self._library.encode_special_tokens = True
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        encoding = self._single
        if self._blanks.search(text):
            if self._plain is None:
                self._plain = self._make("plain", self._pattern)
            encoding = self._plain
        return np.array(encoding.encode_ordinary(text), dtype=np.uint32)


_loaded: dict[tuple[str, str, str], ByteBpe] = {}


def byte_bpe(paths: tuple[str, str, str] | None = None) -> ByteBpe:
    """The encoder of this process for these files."""
    paths = paths or default_paths()
    if paths not in _loaded:
        _loaded[paths] = ByteBpe(*paths)
    return _loaded[paths]
