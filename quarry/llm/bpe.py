"""Byte-level BPE ids from a public tokenizer file.

Where all white space runs of a text are one character long, the look-ahead of the pre-token pattern
never matters, and a pattern without it, which runs without backtracking, gives the same pre-tokens.
Texts with longer runs take the whole pattern, and those with a special token's string go through
``tokenizers``.  The file is read on the executor and is the same on all of them.
"""

from __future__ import annotations

import json
import sys
from array import array
from functools import cache

#: White space other than space and line feed, U+001C..U+001F (such for Python alone) among it.
RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern without its look-ahead.
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        names = {c: b for b, c in enumerate(byte_names())}
        ranks = {bytes(names[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.plain = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("byte-bpe-single", pat_str=SINGLE, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACE)
        return (self.plain if runs else self.single).encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        ids = array("I", self.ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + extra))
        extra += b not in shown
    return out


@cache
def loaded(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(path)
