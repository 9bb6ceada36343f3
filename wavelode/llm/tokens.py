"""Token ids of whole texts by the public tokenizers' files, as little-endian 32-bit data.

White space never joins two words into one token in the vocabularies used here, so a text
is cut at spaces and every distinct piece is encoded by the library once per worker.
"""

from __future__ import annotations

import re
from array import array
from unicodedata import normalize

#: Pieces whose ids a worker remembers, and the longest piece that it does.
CACHE, LONGEST = 800_000, 64
_encoders: dict[tuple[str, bool], "Encoder"] = {}


class _Pieces(dict):
    """Ids of pieces; a new piece is put together from known parts where it can be cut."""

    def __init__(self, encode, inner):
        self.encode, self.inner = encode, self if inner is None else inner

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self.encode.word(piece) if piece.isalpha() and max(piece) < _LATIN_END else self.parts(piece)
        if len(piece) <= LONGEST:
            self[piece] = value
        return value

    def parts(self, piece: str) -> bytes:
        if "\n" in piece:
            first, *lines = _LINE.split(piece)
            if lines:
                return self[first] + b"".join(self.encode.line + self.inner[line] for line in lines)
        word = piece[:-1]
        if piece[-1:] in _MARKS and _letters(word):
            return self[word] + self.inner[piece[-1]]
        return self.encode(piece)


class _Call:
    """The library on a piece, with the text that stands before it; ``line`` has a line feed's ids."""

    def __init__(self, library, before: str, keeps_case: bool):
        self.library, self.model, self.before, self.keeps_case = library, library.model, before, keeps_case
        self.line = array("I", library.encode("\n", add_special_tokens=False).ids).tobytes()

    def __call__(self, piece: str) -> bytes:
        return array("I", self.library.encode(self.before + piece, add_special_tokens=False).ids).tobytes()

    def word(self, piece: str) -> bytes:
        """Letters alone are one word for the vocabulary's model, which needs its bytes as letters."""
        word = self.before + piece if self.keeps_case else piece.lower()
        if not piece.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        elif self.before:
            word = _SPACE + piece
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()


class Encoder:
    """Encodes texts to bytes of ids. ``spaced`` vocabularies keep a space with the word after it."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        library = self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in library.get_added_tokens_decoder().values()]
        self.bare = _Pieces(_Call(library, "", spaced), None)
        self.pieces = _Pieces(_Call(library, " ", True), self.bare) if spaced else self.bare
        self.spaced = spaced

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            # A text that spells an added token goes to the library whole.
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = _cuts(text) if self.spaced else text.split(" ")
        return self.bare[words[0]] + b"".join(map(self.pieces.__getitem__, words[1:]))


#: Byte-level vocabularies write bytes that are no visible Latin-1 character as letters from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_LATIN_END, _SPACE = "\u0100", _BYTE_LETTERS[32]
#: Marks that the vocabularies' rules always part from the letters before them.
_MARKS = frozenset(".,;:!?")
_BLANKS = re.compile(r" \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A line feed between two visible characters.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")


def _letters(word: str) -> bool:
    """Whether a word is letters, also as the vocabularies normalise it: some letters become a letter and a sign, which joins a mark."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


def _cuts(text: str) -> list[str]:
    """Pieces between the single spaces that stand between two visible characters."""
    if text[0] == " " or text[-1] == " " or _BLANKS.search(text):
        return _CUT.split(text)
    return text.split(" ")


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = (path, spaced)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
