"""Cut a text into the pieces that the word tokenizer encodes one by one.

The tokenizer file normalises (NFC, white space, lower case per character), cuts
with one pattern and encodes every piece on its own, so the ids of a text are
those of its pieces in order. That makes pieces the unit of caching: a corpus
has few distinct ones. Most texts hold only characters for which all of this is
plain; they take a fast pattern. The others take the general path.
"""

from __future__ import annotations

import re
import unicodedata

import regex

# The special tokens and the splitting pattern of the tokenizer file.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
# Latin text: no character of it is changed by NFC, and all lower to one character.
_UNPLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa0-įı-ɏ]")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t\n\x0b\x0c\r \xa0"
_PLAIN = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_SPACE}{_DIGITS}{_LETTERS}]+")
_ANY = regex.compile(PATTERN)


def normal(text: str) -> str:
    """The tokenizer's normal form of a text without special tokens."""
    text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
    # Sigma is lowered per character, without regard to the end of a word.
    return text.replace("Σ", "σ").lower()


def plain_pieces(text: str) -> list[str]:
    """The pieces of a text that holds no special token."""
    if _UNPLAIN.search(text):
        return _ANY.findall(normal(text))
    return _PLAIN.findall(text.lower())


def pieces(text: str) -> list[str]:
    """All pieces of a text; special tokens are pieces of their own."""
    if "<|" not in text:
        return plain_pieces(text)
    found: list[str] = []
    for part in _SPECIAL.split(text):
        if part in SPECIAL:
            found.append(part)
        elif part:
            found.extend(plain_pieces(part))
    return found


def chunks(text: str) -> list[str]:
    """Parts of a text whose encodings, in order, make up that of the text.

    White space ends a piece, so a plain text can be cut there first, which is
    cheaper; ``pieces`` of each chunk follow. A text that is not plain, or that
    may hold a special token, stays whole.
    """
    if "<|" in text or _UNPLAIN.search(text):
        return [text]
    return text.lower().split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]
