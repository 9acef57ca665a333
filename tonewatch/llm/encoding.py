"""Token ids of whole texts, by the ``tokenizers`` library, with repeated words encoded once.

The tokenizers used here never let a token reach from a visible character over
the white space after it, so a text may be cut there and the parts encoded on
their own.  The strings of special tokens part a text as well; they become their
one id, as in a plain call of the library.  A worker remembers the ids of parts
it has met lately more than once, ``REMEMBERED_BYTES`` in all of its tables
together, so its memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Sequence
from operator import attrgetter

import numpy as np

from .common import hold

REMEMBERED_BYTES = 160 << 20
#: What an entry of a table takes besides its key and value.
_ENTRY_BYTES = 72
#: Marks of parts met once: a power of two, a byte each.
_SEEN = 1 << 20
#: Longer parts are encoded each time they occur.
LONGEST_REMEMBERED = 48
BYTES_PER_ID = 4

#: Unicode's white space.
SPACE = r"\t-\r \x85\xa0  -     　"
_PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORDS = re.compile(f"[^{SPACE}]+")
_RARE_SPACE = re.compile(r"[\t\x0b-\r\x85\xa0  -     　]")
#: Characters that Python and the tokenizer split and lower-case alike, and that no normal form changes.
_LATIN = re.compile(r"[\t-\r -\x84\x86-\x9f\xa1-įıĴ-ňŊ-ž]*")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII marks after a word.  The apostrophe is left out: it may belong to the letters next to it.
_MARKS = "".join(filter(re.compile(r"[!-&(-/:-@\[-`{-~]").match, map(chr, range(128))))
_ID = attrgetter("id")


def _has_rare_space(text: str) -> bool:
    """White space but blanks and line feeds; none of it is printable, which is the faster test."""
    return not text.replace("\n", " ").isprintable() and _RARE_SPACE.search(text) is not None


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Room:
    """What the tables of one encoder may take: half of it for what is new, half for what was before."""

    def __init__(self) -> None:
        self.tables: list[_Recent] = []
        self.taken = 0
        self.marks, self.marked = bytearray(_SEEN), 0

    def seen_before(self, key: str) -> bool:
        """Whether the key was asked for lately, or one that shares its mark; most parts of a text never come again."""
        at = hash(key) & _SEEN - 1
        if self.marks[at]:
            return True
        if self.marked >= _SEEN // 2:
            self.marks, self.marked = bytearray(_SEEN), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def turn(self) -> None:
        """What was new becomes what was before, which is forgotten."""
        for table in self.tables:
            table.older = dict(table)
            table.clear()
        self.taken = 0


class _Recent(dict):
    """Keys to ids, those asked for lately; ``find`` is asked for the others."""

    def __init__(self, find, room: Room) -> None:
        self.find, self.room, self.older = find, room, {}
        room.tables.append(self)

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
            if not self.room.seen_before(key):
                return value
        if len(key) <= LONGEST_REMEMBERED:
            room, size = self.room, sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY_BYTES
            if room.taken + size > REMEMBERED_BYTES // 2:
                room.turn()
            room.taken += size
            self[key] = value
        return value

    def known(self, key: str) -> bytes | None:
        """The ids if they are remembered; nothing is asked for or kept."""
        return self.get(key) or self.older.get(key)


class Encoder:
    """Encodes texts as bytes of unsigned little-endian 32-bit ids, without adding special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has as many tasks as it has cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {x: i.to_bytes(BYTES_PER_ID, "little") for x, i in added.items()}
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        self.parting = re.compile(f"({'|'.join(longest_first)})") if added else None
        self.by_blank = self.tokenizer.normalizer is None  # a blank belongs to the word after it
        alphabet = _byte_alphabet()
        self.before = chr(alphabet[ord(" ")]) if self.by_blank else ""
        letters = filter(_LETTERS.match, map(chr, range(256)))
        self.spelled = {x: x.encode().decode("latin-1").translate(alphabet) for x in letters}
        self.merge = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(BYTES_PER_ID, "little") for i in range(self.vocabulary)]
        self.room = Room()
        self.words = _Recent(self._word, self.room)
        self.literal = _Recent(self._part, self.room)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, letters: str, before: str = "") -> bytes:
        """Ids of a word of letters, which the tokenizer itself would not split further."""
        if not letters.isascii():
            letters = "".join(map(self.spelled.__getitem__, letters))
        return b"".join(map(self.packed.__getitem__, map(_ID, self.merge(before + letters))))

    def _marked(self, word: str, table: _Recent, before: str) -> bytes | None:
        """Ids of letters that marks may follow; None for other words."""
        letters = word.rstrip(_MARKS)
        if not (letters.isalpha() and (letters.isascii() or _LETTERS.fullmatch(letters))):
            return None
        if len(letters) == len(word):
            return self._merged(letters, before)
        # The word as a whole is remembered; its letters alone would take room that others need.
        return (table.known(letters) or self._merged(letters, before)) + self.literal[word[len(letters) :]]

    def _word(self, word: str) -> bytes:
        """Ids of a word after a blank; a word that begins with a line feed has no blank before it."""
        if word[0] == "\n":
            return self.literal["\n"] + self.literal[word[1:]]
        found = self._marked(word, self.words, self.before)
        return self._whole(" " + word if self.by_blank else word) if found is None else found

    def _part(self, part: str) -> bytes:
        """Ids of a part as it stands, be it after a line feed, in front of a text, or white space."""
        found = self._marked(part, self.literal, "") if self.by_blank else None
        return self._whole(part) if found is None else found

    def _ids(self, text: str) -> Iterable[bytes]:
        if not self.by_blank:
            if _LATIN.fullmatch(text) and not any(x in (low := text.lower()) for x in self.special):
                return map(self.words.__getitem__, low.split())
            return map(self.literal.__getitem__, _WORDS.findall(text))
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if runs or text[0] in " \n" or text[-1] in " \n" or _has_rare_space(text):
            return map(self.literal.__getitem__, _PARTS.findall(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return [self.literal[first], *map(self.words.__getitem__, rest)]

    def _parted(self, text: str) -> bytes:
        if self.parting is None or not any(x in text for x in self.special):
            return b"".join(self._ids(text))
        parts = self.parting.split(text)
        return b"".join(self.special[x] if i % 2 else b"".join(self._ids(x)) for i, x in enumerate(parts) if x)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        return [self._parted(x) if x else b"" for x in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    hold("encoder", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_kind(path: str) -> str:
    """The least unsigned type that holds every id of the tokenizer: 16 bits or 32."""
    return "<u2" if encoder(path).vocabulary <= 1 << 16 else "<u4"
