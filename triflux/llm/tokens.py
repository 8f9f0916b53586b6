"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The tokenizer lower-cases a text, splits it into words, digits and runs of marks,
and merges only within these. For texts in Latin-1 the split is made here, so that a
task can keep the ids of what it has met, up to a number of bytes; only what is new
is merged by the tokenizers library. Chunks with other characters, or with the
strings of special tokens, go through the library as they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: About how many bytes of ids a task keeps, and characters it looks at at once.
KEPT_BYTES, CHARACTERS = 40 << 20, 1 << 20
#: What an entry takes besides its bytes.
_ENTRY = 170

# The tokenizer's split, for lower-case Latin-1.
_SPACE, _LETTER, _DIGIT = r"\t-\r \x85\xa0", "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+"
)
_GAP = re.compile("[\t-\r ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def slices(text: str) -> Iterator[str]:
    """A text cut at white space into parts of about ``CHARACTERS``."""
    at = 0
    while len(text) - at > CHARACTERS and (gap := _GAP.search(text, at + CHARACTERS)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class TextEncoder:
    """Encodes texts as the tokenizers library does, without special tokens of its own.

    Known ids are in two generations of half the bytes each. A full one becomes the
    older and the older one goes, but for what has been met again: that moves up.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._special = re.compile("|".join(re.escape(x.content) for x in added) or "(?!)")
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._byte_level = {x: written(chr(x))[0][0] for x in range(256)}
        self._most = kept_bytes // 2
        self.clear()

    def clear(self) -> None:
        """Forgets all ids."""
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0

    def _library(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        old, new, merge, held = self._old, self._new, self._merge, 0
        for piece in pieces:
            ids = old.get(piece)
            if ids is None:
                found = merge(piece.translate(self._byte_level))
                ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
            new[piece] = ids
            held += len(piece) + len(ids)
        self._held += held + _ENTRY * len(pieces)

    def _latin(self, text: str) -> bytes:
        pieces = _SPLIT.findall(text.lower())
        missing = set(pieces).difference(self._new)
        if missing:
            self._learn(missing)
        ids = b"".join(map(self._new.__getitem__, pieces))
        if self._held > self._most:
            self._old, self._new, self._held = self._new, {}, 0
        return ids

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not self._special.search(text)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; a null text counts as empty and has none."""
        out = []
        for part in slices(text or ""):
            if self._plain(part):
                out.append(self._latin(part))
                continue
            run: list[str] = []
            for chunk in _GAP.split(part):
                if self._plain(chunk):
                    run.append(chunk)
                else:
                    out += [self._latin(" ".join(run)), self._library(chunk)]
                    run = []
            out.append(self._latin(" ".join(run)))
        return b"".join(out)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process; the ids that it keeps are a task's own."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode_all(
    texts: Iterable[str | None], path: str, end_id: int = END_ID
) -> Iterator[bytes]:
    """The ids of each text with the end id behind them."""
    encode, end = encoder(path).encode, struct.pack("<I", end_id)
    for text in texts:
        yield encode(text) + end


def release(path: str) -> None:
    """What a task does at its end: workers live on, and should not keep what it took."""
    if path in _encoders:
        _encoders[path].clear()
    pa.default_memory_pool().release_unused()
