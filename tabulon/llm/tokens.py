"""Token ids of whole texts from a public tokenizer file, with encodings of repeated words remembered.

Both pre-tokenizers supported here cut a text at ASCII white space in a way that does not depend on what lies
beyond the cut, so the ids of a text are the ids of its space-delimited chunks in turn. Chunks repeat a lot;
remembering them saves most of the merging. Texts with other white space or with text that looks like a special
token are encoded whole, and so is everything when a tokenizer turns out to be of another kind.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import cache

import numpy as np
from tokenizers import Tokenizer

_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|")
_LATIN = "À-ÖØ-öø-įıĲ-ɏ"
#: Chunks of these characters alone take the short way; all of them from À on are letters that NFC keeps.
_PLAIN = re.compile(f"[\x00-\x7f{_LATIN}]+")
#: For each kind: what a chunk is, and the pre-tokens of a plain chunk.
_KINDS = {
    "byte": (
        re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"),
        re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9{_LATIN}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"),
    ),
    "word": (
        re.compile(r"[^ \t-\r]+"),
        re.compile(rf"'(?:[stmd]|re|ve|ll)|[A-Za-z{_LATIN}]+|[0-9]|[^ \t-\rA-Za-z0-9{_LATIN}]+"),
    ),
}
#: The printable stand-ins that byte-level models use for bytes that are not printable themselves.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTES = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_PROBE = "It's  a 'probe'\n\n of 3,14 kinds;  don't\tstop-here…  naïve Straße\n"


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers, with no special tokens added."""

    def __init__(self, path: str, remember: int = 800_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.chunks: dict[str, bytes] = {}
        self.kind = None
        whole = self._whole(_PROBE)
        for kind in _KINDS:
            self.kind = kind
            if self.ids(_PROBE) == whole:
                break
            self.chunks, self.kind = {}, None
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = f"Ġ{piece[1:]}" if piece[0] == " " else piece
        if not (piece.isascii() and piece.lstrip(" ").isalnum() and len(piece) - len(piece.lstrip(" ")) < 2):
            spelt = piece.encode().decode("latin-1").translate(_BYTES)
        out = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)])
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        pieces = _KINDS[self.kind][1].findall(chunk.lower() if self.kind == "word" else chunk)
        if len(pieces) == 1:
            return self.chunks.get(pieces[0]) or self._piece(pieces[0])
        known, out = self.chunks, []
        for piece in pieces:  # a piece by itself is a chunk of the same ids, so one memory serves both
            found = known.get(piece)
            if found is None:
                found = self._piece(piece)
                if len(known) < self.remember:
                    known[piece] = found
            out.append(found)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind is None or _ODD.search(text):
            return self._whole(text)
        known = self.chunks
        chunks = _KINDS[self.kind][0].findall(text)
        made = [known.get(c) for c in chunks]
        if None in made:
            for i, x in enumerate(made):
                if x is None:
                    c = chunks[i]
                    made[i] = x = known.get(c) or self._chunk(c)
                    if len(known) < self.remember:
                        known[c] = x
        return b"".join(made)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a process and file; Spark reuses its Python workers, so words stay known from task to task."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
