"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. BPE by ranks has a prefix property: the tokens of a string are the tokens of one of its prefixes and a last
token t, where t is the longest token that ends there and forms, with the token before it, a pair that BPE leaves as
it is (Berglund and van der Merwe 2023). A state of the transducer is what the bytes read so far leave undecided: the
last token emitted, and the bytes after it. Reading a byte extends the tail, finds the last token at its end, and
emits each token that lies before a boundary shared by all prefixes that a later token could still follow (this
is looked for once the tail has `hold` bytes). A later token can begin only where the tail's rest is the beginning of
some token, so the lookahead is bounded by `hold` and the longest token. States and transitions are made when they are first needed, and kept in a table of bounded size.

Decoding joins the tokens' bytes and runs them through an incremental UTF-8 state machine, which holds back an
unfinished sequence between blocks.

Texts are cut by the pre-tokenizer's pattern, each match on its own. Distinct pieces between blanks are transduced
once and kept (see token_ids on where texts may be cut).

Defined cases: a null or empty text has no tokens, and its digests are those of the empty string; repeated rows and
null ids are kept as they are; an empty table gives an empty result; extra columns are ignored by `encode_documents`.
A string cell whose bytes aren't UTF-8 is read with U+FFFD in their place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keelson.llm.common import as_text, hold, pieces_of, quiet_collector, table, text_rows
from keelson.llm.token_ids import cut_at_spaces, plainly_spaced

NEVER = 1 << 62
SOUND, OPEN = 1, 2
#: Signs from which a piece isn't kept for other texts.
LONG = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 of the token, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeTransducer:
    """The transducer of one vocabulary. step() reads a byte, end() says what is still to be emitted."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000, hold: int = 4):
        self.ranks, self.max_states, self.hold = ranks, max_states, hold
        prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: tokens that merging their own bytes gives; another can only be a whole match
        sound = {t for t in ranks if len(t) == 1 or self.merged(t) == [t]}
        #: of each string of bytes that is such a token, or that some token begins with: SOUND, OPEN or both
        self.kinds = {t: (t in sound) * SOUND + (t in prefixes) * OPEN for t in sound | prefixes}
        self.code = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.once: set[int] = set()
        self.reset()

    def reset(self) -> None:
        #: (last token emitted, tail) by number, its number, and its transitions; 0 is the start
        self.once.clear()
        self.states: list[tuple[bytes, bytes]] = [(b"", b"")]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        #: of each state, for each place in its tail, the last token there
        self.chains: list[list[bytes]] = [[b""]]
        self.tails: list[bytes] = [b""]
        #: of each state, the places in its tail where a later token can begin
        self.starts: list[list[int]] = [[0]]

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition, for pairs of tokens: join the neighbours of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        ranks = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NEVER)
        return parts

    def stable(self, left: bytes, token: bytes) -> bool:
        """Whether BPE leaves this pair of tokens as it is."""
        key = (left, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + token) == [left, token]
        return known

    def extend(self, state: int, byte: int) -> tuple[int, bytes]:
        """The transition by byte, made anew."""
        before, chain, tail = self.states[state][0], self.chains[state], self.tails[state] + bytes((byte,))
        n = len(tail)
        starts, token, kinds = [], None, self.kinds
        for start in self.starts[state]:  # the longest first
            part = tail[start:]
            kind = kinds.get(part, 0)
            if token is None and kind & SOUND and ((left := chain[start] if start else before) == b"" or self.stable(left, part)):
                token = part
            if kind & OPEN:
                starts.append(start)
        starts.append(n)
        chain = [*chain, token]
        final, out = 0, []
        if n >= self.hold:
            # the ways back from each place that a later token may follow meet in a boundary that is final
            places = set(starts)
            while len(places) > 1:
                last = max(places)
                places.discard(last)
                places.add(last - len(chain[last]))
            (final,) = places
            at = final
            while at:
                out.append(self.code[chain[at]])
                at -= len(chain[at])
        left = chain[final] if final else before
        new_tail, new_chain = (tail[final:], [left, *chain[final + 1 :]]) if final else (tail, chain)
        key = (left, new_tail)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.moves)
            self.states.append(key)
            self.moves.append({})
            self.chains.append(new_chain)
            self.tails.append(new_tail)
            self.starts.append([s - final for s in starts] if final else starts)
        move = self.moves[state][byte] = (number, b"".join(reversed(out)))
        return move

    def end(self, chain: list[bytes]) -> bytes:
        """The ids still due, from the last tokens of each place of the tail."""
        out, at = [], len(chain) - 1
        while at:
            token = chain[at]
            out.append(self.code[token])
            at -= len(token)
        return b"".join(reversed(out))

    def walk(self, state: int, rest: bytes) -> bytes:
        """The ids due from a state on, for the last bytes of a piece, without making states."""
        before, chain, tail, starts = self.states[state][0], [*self.chains[state]], self.tails[state], self.starts[state]
        kinds, pairs = self.kinds.get, self.pairs
        begin, tail = len(tail), tail + rest
        for n in range(begin + 1, len(tail) + 1):
            ahead = []
            token = None
            for start in starts:
                part = tail[start:n]
                kind = kinds(part)
                if kind:
                    if token is None and kind & SOUND:
                        left = chain[start] if start else before
                        if not left or (fits := pairs.get((left, part))) or (fits is None and self.stable(left, part)):
                            token = part
                    if kind & OPEN:
                        ahead.append(start)
            chain.append(token)
            ahead.append(n)
            starts = ahead
        return self.end(chain)

    def transduce(self, piece: bytes) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit numbers.

        A match that is itself a token is that token, by definition. A transition gets a state of its own when it is
        met for the second time; the rest of a short piece beyond a transition that is new is walked through.
        """
        if (whole := self.code.get(piece)) is not None:
            return whole
        if len(self.moves) > self.max_states:
            self.reset()
        state, out, moves = 0, [], self.moves
        for i, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                if len(piece) <= 64:
                    key = state << 8 | byte
                    if key not in self.once:
                        if len(self.once) > 4 * self.max_states:
                            self.once.clear()
                        self.once.add(key)
                        out.append(self.walk(state, piece[i:]))
                        return b"".join(out)
                elif len(moves) > 2 * self.max_states:  # within one very long piece: keep this state alone
                    key, chain, tail, starts = self.states[state], self.chains[state], self.tails[state], self.starts[state]
                    self.reset()
                    moves, state = self.moves, 0
                    if key != self.states[0]:
                        self.numbers[key] = state = len(moves)
                        self.states.append(key)
                        moves.append({})
                        self.chains.append(chain)
                        self.tails.append(tail)
                        self.starts.append(starts)
                move = self.extend(state, byte)
            state, emitted = move
            if emitted:
                out.append(emitted)
        out.append(self.end(self.chains[state]))
        return b"".join(out)


class Utf8Stream:
    """An incremental UTF-8 state machine: feed() returns the whole characters so far and holds back a begun one.

    The state is the number of continuation bytes still due and those held; only the last three bytes of a block can
    belong to a begun character, so the machine walks over those alone. Bytes that are no UTF-8 pass unchanged.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def due(lead: int) -> int:
        """The length of the sequence that a byte begins; 1 for any other byte."""
        return 4 if 0xF0 <= lead <= 0xF4 else 3 if lead >= 0xE0 and lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 1

    def feed(self, block: bytes) -> bytes:
        data = self.held + block
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte < 0xC0:
                continue
            if self.due(byte) > back:
                self.held = data[-back:]
                return data[:-back]
            break
        self.held = b""
        return data

    def finish(self) -> bytes:
        out, self.held = self.held, b""
        return out


class ByteBpe:
    """Encodes and decodes whole texts; keeps the ids of distinct pieces in a table of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: int = 700_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.transducer = MergeTransducer(ranks)
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        #: each id in decimal with a comma, as rows of equal width that end in zero bytes
        self.decimal = np.array([f"{i},".encode() for i in range(max(self.tokens) + 1)])
        self.limit = table
        #: Ids of pieces that begin with a blank, by what follows it; of others; and of matches of the pattern.
        self.spaced: dict[str, bytes] = {}
        self.table: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: Of pieces too long to be kept, for the text at hand.
        self.long: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """The ids of new pieces. The pattern runs over all of them at once: no match spans their seams."""
        matches = self.find("".join(pieces))
        if sum(map(len, matches)) != sum(map(len, pieces)):  # the pattern leaves signs out
            for p in pieces:
                self.keep(p, b"".join(map(self.part_ids, self.find(p))))
            return
        at = 0
        for p in pieces:
            part = matches[at]
            at += 1
            ids, rest = self.part_ids(part), len(p) - len(part)
            while rest:
                part = matches[at]
                at += 1
                ids, rest = ids + self.part_ids(part), rest - len(part)
            self.keep(p, ids)

    def part_ids(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.transducer.transduce(part.encode("utf-8", "replace"))
            if len(part) < 64:
                self.parts[part] = ids
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) >= LONG:
            self.long[piece] = ids
        elif piece[:1] == " ":
            self.spaced[piece[1:]] = ids
        else:
            self.table[piece] = ids

    def known(self, piece: str) -> bytes | None:
        if len(piece) >= LONG:
            return self.long.get(piece)
        return self.spaced.get(piece[1:]) if piece[:1] == " " else self.table.get(piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        for name in ("table", "spaced", "parts"):
            if len(kept := getattr(self, name)) > self.limit:
                setattr(self, name, dict(islice(kept.items(), self.limit // 2)))
        if text and text[0] != " " and plainly_spaced(text):
            # every piece but the first begins with the one blank before it
            pieces = text.split(" ")
            found = list(map(self.spaced.get, pieces))
            found[0] = self.table.get(pieces[0])
            if None in found:
                at = [k for k, ids in enumerate(found) if ids is None]
                self.learn(list(dict.fromkeys(" " + pieces[k] if k else pieces[k] for k in at)))
                for k in at:
                    found[k] = self.known(" " + pieces[k] if k else pieces[k])
        else:
            pieces = cut_at_spaces(text)
            for p in dict.fromkeys(pieces):
                if p and self.known(p) is None:
                    self.learn([p])
            found = [self.known(p) for p in pieces if p]
        self.long.clear()
        return b"".join(found)

    def decode(self, ids: Iterable[int], block: int = 1 << 16) -> Iterator[bytes]:
        """The text's bytes in blocks that end at whole characters."""
        stream, get = Utf8Stream(), self.tokens.__getitem__
        ids = ids if isinstance(ids, list) else list(ids)
        for i in range(0, len(ids), block):
            yield stream.feed(b"".join(map(get, ids[i : i + block])))
        yield stream.finish()


@cache
def made(path: str, pattern: str) -> ByteBpe:
    quiet_collector()
    return ByteBpe(load_ranks(path), pattern)


def coder(path: str, pattern: str) -> ByteBpe:
    """One for each vocabulary in a Python worker; it outlives the tasks until those of another operator begin."""
    hold(path, made.cache_clear)
    return made(path, pattern)


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in pieces_of(batches, "text", 4 << 20, path):
            counts, ids_sha, text_sha = [], [], []
            for text in as_text(batch.column("text")):
                ids = np.frombuffer(bpe.encode(text), "<u4")
                counts.append(len(ids))
                listed = bpe.decimal[ids].tobytes().translate(None, b"\0")
                ids_sha.append(hashlib.sha256(listed[:-1]).hexdigest())
                decoded = hashlib.sha256()
                for block in bpe.decode(ids.tolist()):
                    decoded.update(block)
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in pieces_of(batches, "text", 4 << 20, path):
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in as_text(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return text_rows(docs, id_col, text_col).mapInArrow(encoded(path, pattern), "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return the count and both digests."""
    return text_rows(docs, id_col, text_col).mapInArrow(digests(path, pattern), CODED)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
