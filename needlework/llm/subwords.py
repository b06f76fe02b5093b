"""Subword ids from a public vocabulary file whose path is a parameter; nothing is copied into the repository."""

from __future__ import annotations

import base64
import functools
import os

DEFAULT_VOCABULARY = os.environ.get("NEEDLEWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
KEPT = 200_000


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """Byte-level BPE with the word pattern of its vocabulary."""
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """Encodes by space-separated pieces and remembers the pieces seen: a text without runs of spaces is encoded piece by piece with the same ids."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.path = path
        self.encode_whole = encoder(path).encode_ordinary
        self.size = encoder(path).n_vocab + 1
        self.ids_of: dict[str, list[int]] = {}
        self.count_of: dict[str, int] = {}

    def pieces(self, text: str) -> list[str] | None:
        """The text cut before single spaces, or None where runs of spaces make the cut unsafe."""
        if "  " in text:
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def ids(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        if pieces is None:
            return self.encode_whole(text)
        known, out = self.ids_of, []
        if len(known) > KEPT:
            known.clear()
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = self.encode_whole(p)
                if len(p) < 64:
                    known[p] = got
            out += got
        return out

    def count(self, piece: str) -> int:
        got = self.count_of.get(piece)
        if got is None:
            got = len(self.encode_whole(piece))
            if len(piece) < 64:
                if len(self.count_of) > KEPT:
                    self.count_of.clear()
                self.count_of[piece] = got
        return got


class PackedSubwords(Subwords):
    """Ids as little-endian 16-bit numbers."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        super().__init__(path)
        if self.size > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")

    def pack(self, text: str) -> bytes:
        import array

        # whole: as many words are rare, remembering pieces costs more than it saves
        return array.array("H", self.encode_whole(text)).tobytes()


@functools.lru_cache(maxsize=2)
def packer(path: str) -> PackedSubwords:
    """One packer a worker process, kept from task to task."""
    return PackedSubwords(path)
