"""Token ids of whole texts by the tokenizers library, with each distinct piece between blanks encoded once.

A text is cut at every space that follows a character that isn't white space (where the tokenizer drops blanks, at
all white space). With the pre-tokenizers in use, no token spans such a place: a token that holds a non-blank
character has a blank at its start at most. So the ids of the pieces, joined, are the ids of the text (tests compare
them with the library on whole texts). The pieces repeat, and a bounded table keeps their ids as little-endian
unsigned 32-bit numbers.

A piece that is new goes through the whole library, or, where it is Latin-1 letters, ASCII punctuation and single line
breaks alone, is cut as the pre-tokenizer does it and handed to the library's BPE model part by part, which costs a
third. Both give the same ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from itertools import islice

from keelson.llm.common import hold, quiet_collector

#: Pieces, and parts of pieces, that a worker keeps. When the table is full, the older three quarters stay: frequent pieces come early.
TABLE = 1_100_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which can begin a contraction
ODD_BLANKS = re.compile("[\x1c-\x1f\x85]")  # white space to Python, perhaps not to the library
PLAIN = re.compile(f" ?[{LETTERS}{MARKS}]+(?:\n[{LETTERS}{MARKS}]+)*")
PARTS = re.compile(f" ?[{LETTERS}]+| ?[{MARKS}]+|\n")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, then 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BLANK_PAIRS = tuple(c + " " for c in " \t\n\x0b\x0c\r")
RARE_PAIR = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


def plainly_spaced(text: str) -> bool:
    """Whether no space follows other white space."""
    return not any(p in text for p in BLANK_PAIRS) and not RARE_PAIR.search(text)


def cut_at_spaces(text: str) -> list[str]:
    """The text, cut before each space that follows a character that isn't white space."""
    parts = text.split(" ")
    if parts[0] and plainly_spaced(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out: list[str] = []
    joined = parts[0]
    for p in parts[1:]:
        if joined and not joined[-1].isspace():
            out.append(joined)
            joined = " " + p
        else:
            joined += " " + p
    out.append(joined)
    return out


class PieceEncoder:
    """encode(texts) gives the ids of each text as bytes (little-endian unsigned 32 bit)."""

    def __init__(self, path: str, table: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        #: Whether white space gives tokens: it does unless it is normalised and then left out of the split.
        self.keeps_blanks = json.loads(self.tokenizer.to_str())["normalizer"] is None
        self.limit, self.letters = table, byte_letters()
        #: Ids of pieces, and parts, that begin with a blank, by what follows it; and of others.
        self.spaced: dict[str, bytes] = {}
        self.table: dict[str, bytes] = {}

    def known(self, piece: str) -> bytes | None:
        return self.spaced.get(piece[1:]) if piece[:1] == " " else self.table.get(piece)

    def keep(self, piece: str, ids: bytes) -> bytes:
        if piece[:1] == " ":
            self.spaced[piece[1:]] = ids
        else:
            self.table[piece] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """The pieces of a text. Those but the first begin with the space that they were cut at, if blanks count."""
        if not self.keeps_blanks:
            return text.split(" ") if ODD_BLANKS.search(text) else text.split()
        return cut_at_spaces(text)

    def plain_parts(self, piece: str) -> list[str] | None:
        """What the pre-tokenizer makes of a piece, if that is certain here."""
        if not self.keeps_blanks:
            piece = piece.lower() if piece.isascii() or PLAIN.fullmatch(piece) else piece
        word = piece[1:] if piece[:1] == " " else piece
        if word.isascii() and word.isalpha():
            return [piece]
        if not PLAIN.fullmatch(piece):
            return None
        return [p for p in PARTS.findall(piece) if self.keeps_blanks or p != "\n"]

    def part_ids(self, part: str) -> bytes:
        ids = self.known(part)
        if ids is None:
            if part.isascii():
                letters = part.replace(" ", self.letters[32]).replace("\n", self.letters[10])
            else:
                letters = "".join(map(self.letters.__getitem__, part.encode()))
            ids = self.keep(part, b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)]))
        return ids

    def learn(self, missing: set[str]) -> None:
        rest = []
        for piece in missing:
            if (parts := self.plain_parts(piece)) is None:
                rest.append(piece)
            elif parts == [piece]:
                self.part_ids(parts[0])
            else:
                self.keep(piece, b"".join(map(self.part_ids, parts)))
        if rest:
            import numpy as np

            for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.keep(p, np.array(e.ids, "<u4").tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        for name in ("table", "spaced"):
            if len(kept := getattr(self, name)) > self.limit:
                setattr(self, name, dict(islice(kept.items(), 3 * self.limit // 4)))
        get, spaced = self.table.get, self.spaced.get
        found, open_ = [], []
        missing: set[str] = set()
        for text in texts:
            if self.keeps_blanks and text and text[0] != " " and plainly_spaced(text):
                # every piece but the first begins with the one blank before it
                parts = text.split(" ")
                ids = list(map(spaced, parts))
                ids[0] = get(parts[0])
                if None in ids:
                    at = [k for k, i in enumerate(ids) if i is None]
                    pieces = [" " + parts[k] if k else parts[0] for k in at]
            else:
                parts = self.split(text)
                ids = list(map(self.known if self.keeps_blanks else get, parts))
                if None in ids:
                    at = [k for k, i in enumerate(ids) if i is None]
                    pieces = [parts[k] for k in at]
            if None in ids:
                missing.update(pieces)
                open_.append((ids, at, pieces))
            found.append(ids)
        if missing:
            self.learn(missing)
            for ids, at, pieces in open_:
                for k, i in zip(at, map(self.known, pieces), strict=True):
                    ids[k] = i
        return [b"".join(ids) for ids in found]


@cache
def made(path: str, table: int) -> PieceEncoder:
    quiet_collector()
    return PieceEncoder(path, table)


def encoder(path: str, table: int = TABLE) -> PieceEncoder:
    """One for each tokenizer in a Python worker; it outlives the tasks until those of another operator begin."""
    hold(path, made.cache_clear)
    return made(path, table)
