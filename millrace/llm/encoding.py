"""Token ids of whole texts from the tokenizers library, with repeated pieces encoded once.

The byte-level vocabulary splits texts by a fixed pattern, and no token crosses
from a character to white space after it, or from a line break to what follows.
So a text is cut there, each different piece goes to the library once, and the
ids of pieces are joined. Texts with the library's special strings go to it whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RARE = re.compile(f"[{SPACE.replace(' ', '').replace(chr(10), '')}\0]")
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Within these characters, letters and digits are as the library's pattern has them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+")


def vocabulary(name: str) -> str:
    """The place of a vocabulary file; a path to one is taken as it is."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Known(dict):
    """Ids of pieces; a piece that is asked for and missing is encoded. The least recent half goes when it is full."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        self.encode, self.half, self.before = encode, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        ids = self[piece] = self.before.get(piece) or self.encode(piece)
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; remembers at most ``most`` pieces."""

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.bytes = "".join(chr(x if x in shown else 256 + hidden.index(x)) for x in range(256))
        self.space = self.bytes[32]
        self.known = Known(self.piece, most)

    def forget(self) -> None:
        self.known.clear()
        self.known.before = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        if part.isascii():
            mapped = part.replace(" ", self.space)
        else:
            mapped = "".join(map(self.bytes.__getitem__, part.encode()))
        return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if piece[-1] in ".," and len(piece) > 2 and _WORD.fullmatch(piece, 0, len(piece) - 1):
            return self.known[piece[:-1]] + self.known[piece[-1]]
        if _WORD.fullmatch(piece):
            return self.part(piece)
        if _PLAIN.fullmatch(piece):
            return b"".join(map(self.part, _PARTS.findall(piece)))
        return self.whole(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text without added special tokens."""
        out, known = [], self.known.__getitem__
        for text in texts:
            if any(x in text for x in self.special):
                out.append(self.whole(text))
                continue
            uneven = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n" or _RARE.search(text)
            pieces = _PIECES.findall(text) if uneven else text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
            out.append(b"".join(map(known, pieces)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
