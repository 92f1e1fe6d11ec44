"""Removal of byte strings that occur more than once, by a distributed difference-cover suffix sort.

Every byte that lies in a string of `span` bytes which also starts anywhere else goes, in all its occurrences. To sort
the suffixes of a large corpus byte by byte would move each byte dozens of times, so the algorithm runs on phrases:

1. Parse. Texts are cut where the hash of WIDTH bytes is smallest in some window of places (winnowing). Whether
   a place is cut depends on LEFT bytes before it and RIGHT bytes from it alone, so equal strings are cut alike but for
   these margins, and no phrase is longer than a window. A phrase's letter is a 63-bit hash of its bytes with both
   margins. Whole copies of a text, known by their SHA-256, are removed whole; one of each group goes on. Letters that
   occur once can't lie in a repeat; they go, and what is left are segments of repeated letters (this is where most of
   a corpus leaves). Equal segments go on once.
2. The segments' suffixes are sorted by a difference-cover algorithm (see `suffixes`), which gives for each phrase the
   number M of phrases from it on that occur in the same order elsewhere.
3. A place p starts a repeat for certain if the match of a phrase that begins at p + LEFT at the latest reaches
   p + span. It can't if the phrases well inside of p .. p + span don't match elsewhere. What is left, a few dozen
   places at the ends of each match, is open: each is decided by the count of its span bytes (of the first 128 bits of
   their SHA-256) among open places and those certain ones whose first letter inside is one of an open place's (one of
   each set of texts that agree there).

Several spans can be judged in one go; the shortest sets the window. Numbers travel in packets (see `packets`): a
letter that occurs again within a task's texts is known to repeat, so a task sends each letter once to be counted, and
no letter, however frequent, fills a partition. Texts are read twice, and of the second time only those with open or
certain places are shuffled (their hashes are broadcast while they are WANTED at most; beyond that all texts are).

Defined cases: a null or empty text has no bytes; texts shorter than `span` lose nothing; rows of one id and text are
copies of each other, each returned; a null doc_id is kept; an empty table gives an empty result; extra columns, of any
name, are kept by `cut_texts` and ignored by `repeats`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import as_bytes, free_shuffles, materialise, pieces_of, release, small_batches, table, text_rows
from keelson.llm.packets import PACKET, batches_of, dealt, got, home_of, mapped, numbers, put, rows_of, spread_by
from keelson.llm.suffixes import matches

SPAN = 400
#: Passages: what repeats in PASSAGE bytes and holds over PASSAGE_WORDS whole words. Of 51 words of English prose in a
#: row, 1 in 200 stretches is shorter than 200 bytes.
PASSAGE, PASSAGE_WORDS = 200, 50
WIDTH = 16
#: The widest window, so that a phrase's bytes fit seven bits.
WIDEST = 96
#: Bytes of texts that are parsed side by side, and of a long text at a time.
BLOCK, STRETCH = 1 << 16, 1 << 18
#: Bytes of texts for which a partition is set up, up to the session's number of shuffle partitions.
PARTITION = 24 << 20
#: Letters or places that a task gathers before it deals them out.
GATHERED = 1 << 20
#: Texts whose hashes are broadcast, eight bytes each.
WANTED = 8_000_000


def window_of(span: int) -> int:
    """The window for a span: the widest with which every span holds a whole phrase with its margins."""
    window = min(WIDEST, (span - WIDTH + 3) // 4)
    if window < WIDTH:
        raise ValueError("spans under 77 bytes are too short")
    return window


def margins(window: int) -> tuple[int, int]:
    """(LEFT, RIGHT): the bytes before a place and from it on that decide whether it is cut."""
    return window - 1, window + WIDTH - 1


# -- hashes

U, U4 = np.uint64, np.uint32
ODD = U(0x9E3779B97F4A7C15)  # 2^64 / golden ratio, odd
INVERSE = U(pow(int(ODD), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
SHORT = (BYTE >> U(32)).astype(np.uint32)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD to the power of place and of minus place, for n places; kept for longer texts to come."""
    if len(POWERS.get("up", ())) < n:
        size = max(1 << 17, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            for name, factor in (("up", ODD), ("down", INVERSE)):
                cells = np.full(size, factor)
                cells[0] = 1
                POWERS[name] = np.cumprod(cells)
    return POWERS["up"][:n], POWERS["down"][:n]


class Hashes:
    """64-bit hashes of any byte ranges of a text, from prefix sums of byte * ODD^-place."""

    def __init__(self, text: np.ndarray):
        self.up, down = powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(np.take(BYTE, text) * down[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def stretches(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ranges, in order, that lie within a few STRETCHes."""
    if not len(starts):
        return
    bounds = np.searchsorted(starts, np.arange(int(starts[0]), int(starts[-1]) + 1, 2 * STRETCH))
    for i, j in zip(bounds, [*bounds[1:], len(starts)], strict=True):
        if i < j:
            yield int(i), int(j)


# -- 1. parse


def windowed(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each `width` values in a row."""
    best = np.minimum if least else np.maximum
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def grams(block: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each WIDTH bytes in a row, never 0."""
    h, width, factor = np.take(SHORT, block), 1, 0x9E3779B1
    while width < WIDTH:  # a polynomial, by doubling
        ahead = h[width:]
        h = h[: len(ahead)] * U4(factor)
        h += ahead
        width, factor = 2 * width, factor * factor & 0xFFFFFFFF
    h ^= h >> U4(15)
    h *= U4(0x2C1B3C6D)
    h ^= h >> U4(12)
    h *= U4(0x297A2D39)
    return h | U4(1)


def cut_within(block: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """The places that are cut, of texts that lie side by side: those that are the least of any window of their text."""
    if len(block) < WIDTH + window - 1:
        return np.empty(0, np.int64)
    h = grams(block)
    low = windowed(h, window, True)
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # windows that reach into the next text don't count
        low[max(start, stop - WIDTH - window + 2) : stop] = 0
    pad = np.zeros(window - 1, np.uint32)
    return np.nonzero(windowed(np.concatenate((pad, low, pad)), window, False) == h)[0]


def cuts(block: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """Where phrases begin, of texts side by side, and where the last text ends."""
    if len(edges) > 2 or len(block) <= 2 * STRETCH:
        chosen = cut_within(block, edges, window)
    else:  # one long text
        (left, right), n, found = margins(window), len(block), []
        for at in range(0, n, STRETCH):
            begin, end = max(0, at - left), min(n, at + STRETCH + right)
            here = cut_within(block[begin:end], np.array([0, end - begin]), window) + begin
            found.append(here[(here >= at) & (here < at + STRETCH)])
        chosen = np.concatenate(found)
    return np.union1d(chosen, edges)


def letters_of(block: np.ndarray, edges: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each phrase, its letter, where each text's phrases begin): a letter is a hash of a phrase with its
    margins, 63 bits, never 0 (which stands for an end)."""
    at, (before, after) = cuts(block, edges, window), margins(window)
    bounds = np.searchsorted(at, edges)
    begin, end, owner = at[:-1], at[1:], np.repeat(np.arange(len(edges) - 1), np.diff(bounds))
    left, right = np.maximum(begin - before, edges[owner]), np.minimum(end + after, edges[owner + 1])
    parts = []
    for i, j in stretches(begin, end):
        first, last = int(left[i]), int(right[i:j].max())
        parts.append(Hashes(block[first:last]).of(left[i:j] - first, right[i:j] - first))
    with np.errstate(over="ignore"):
        place = mixed((begin - left).astype(np.uint64) * U(1 << 20) + (end - begin).astype(np.uint64))
        letters = mixed(np.concatenate(parts) + place) >> U(1)
    return (end - begin).astype(np.uint8), np.maximum(letters, U(1)).astype(np.int64), bounds


PARSED = "rid long, doc long, n_bytes long, n_words long, sha binary, sizes binary, letters binary"


def parsed(least: int, window: int) -> Callable:
    """Rows with a number of their own, their text's SHA-256, and the phrases of texts of `least` bytes and more.

    A text met before in the same task has no phrases: of copies only one goes on, and the first of a task's could.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARSED.split(", ")]
        rid, seen = TaskContext.get().partitionId() << 33, set()
        for batch in pieces_of(batches, "text"):
            texts = as_bytes(batch.column("text"))
            sha = [hashlib.sha256(t).digest() for t in texts]
            n = len(texts)
            words, sizes, letters = [None] * n, [None] * n, [None] * n
            held: list[int] = []
            size = 0

            def solve() -> None:
                nonlocal size
                block = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)  # noqa: B023
                edges = np.cumsum([0, *(len(texts[i]) for i in held)])  # noqa: B023
                phrase, letter, bounds = letters_of(block, edges, window)
                dark = ~np.take(BLANK, block)
                begun = dark.copy()
                begun[1:] &= ~dark[:-1]
                begun[edges[:-1]] = dark[edges[:-1]]
                counts = np.add.reduceat(begun, edges[:-1], dtype=np.int64).tolist()
                p, q = phrase.tobytes(), letter.tobytes()
                for k, i in enumerate(held):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    words[i], sizes[i], letters[i] = counts[k], p[a:b], q[8 * a : 8 * b]  # noqa: B023
                held.clear()
                size = 0

            for i, t in enumerate(texts):
                if len(t) < least or sha[i] in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(sha[i])
                if held and len(t) > BLOCK:
                    solve()
                held.append(i)
                size += len(t)
                if size >= BLOCK:
                    solve()
            if held:
                solve()
            cells = [np.arange(rid, rid + n), batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(words, pa.int64()), *(pa.array(x, pa.binary()) for x in (sha, sizes, letters))]
            rid += n
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], names=names)

    return run


LETTER, SURE, REPEATED, LATER, SEGMENT, TEXT, PLACES, LEADER, ASKED, WANTED_PLACES, HASHED, DECIDED = range(12)


def runs_among(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.nonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))[0] if len(sorted_) else np.empty(0, np.int64)


def owners_cell(ids: np.ndarray, *more: np.ndarray) -> bytes:
    """Owners of entries, equal ones next to each other, as one cell: each owner, how many entries it has, and more of it."""
    starts = runs_among(ids)
    return put(ids[starts], np.diff(np.append(starts, len(ids))), *(x[starts] for x in more))


def owners_of(cell) -> list[np.ndarray]:
    """The owner of each entry, and more of it."""
    ids, n, *more = got(cell)
    return [np.repeat(x, n) for x in (ids, *more)]


def deal_letters(n: int) -> Callable:
    """Texts (rid, sha, sizes, letters) to packets of letters, by the letters' range: each letter once, those met again apart."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        spread = TaskContext.get().partitionId() % n

        def out() -> Iterator[tuple]:
            counts = np.array([len(r[2]) for r in held])
            owner = np.repeat(np.array([r[0] for r in held], np.int64), counts)
            known = np.repeat(np.frombuffer(b"".join(bytes(r[1])[:8] for r in held), np.int64), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            letter = np.concatenate([numbers(r[3]) for r in held])
            loc = place << 8 | np.concatenate([numbers(r[2], np.uint8) for r in held]).astype(np.int64) << 1
            held.clear()
            order = np.argsort(letter)
            starts = runs_among(letter[order])
            size = np.diff(np.append(starts, len(order)))
            again = np.ones(len(order), bool)
            again[order[starts]] = False
            loc[order[starts[size > 1]]] |= 1
            part = np.where(again, n, spread_by(letter, n)).astype(np.uint16 if n < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(n + 2)).tolist()
            for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if i < j:
                    at = order[i:j]
                    yield (k if k < n else spread), 0, (LETTER if k < n else SURE), 0, j - i, letter[at].tobytes(), owners_cell(owner[at], known[at]), loc[at].tobytes()

        size = 0
        for row in rows:
            held.append(row)
            size += len(row[2])
            if size >= GATHERED:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def deal_by_owner(owner: np.ndarray, n: int, kind: int, part: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Entries (owner and one or two columns) to packets for their owners' homes."""
    home = home_of(owner, n)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(n + 1)).tolist()
    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if i < j:
            at = order[i:j]
            cells = [c[at].tobytes() for c in columns]
            yield k, 0, kind, part, j - i, owner[at].tobytes(), cells[0], cells[1] if len(cells) > 1 else None


def repeated_letters(n: int) -> Callable:
    """The entries (owner, loc, letter) of letters that occur more than once, for their owners' homes.

    Copies of a text (the same begin of its hash, the same place) count as one, which the least of them stands for.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        found, cells = [], []
        for row in rows:
            own, known = owners_of(row[6])
            if row[2] == SURE:
                found.append((own, numbers(row[7]) >> 1, numbers(row[5])))
            else:
                cells.append((numbers(row[5]), own, known, numbers(row[7])))
        if cells:
            letter, owner, known, loc = (np.concatenate(c) for c in zip(*cells, strict=True))
            order = np.argsort(letter)
            starts = runs_among(letter[order])
            size = np.diff(np.append(starts, len(order)))
            sure = np.add.reduceat(loc[order] & 1, starts) > 0
            at = order[np.repeat((size > 1) | sure, size)]
            letter, owner, known, loc = letter[at], owner[at], known[at], loc[at]
            order = np.lexsort((owner, loc >> 1, known, letter))
            letter, owner, known, loc = letter[order], owner[order], known[order], loc[order]
            new = np.concatenate(([True], (letter[1:] != letter[:-1]) | (known[1:] != known[:-1]) | (loc[1:] >> 1 != loc[:-1] >> 1)))[: len(order)]
            sure = np.logical_or.reduceat(loc & 1 > 0, np.nonzero(new)[0]) if len(order) else new
            letter, owner, loc = letter[new], owner[new], loc[new] >> 1
            starts = runs_among(letter)
            size = np.diff(np.append(starts, len(letter)))
            keep = np.repeat((size > 1) | (np.logical_or.reduceat(sure, starts) if len(starts) else size > 1), size)
            found.append((owner[keep], loc[keep], letter[keep]))
        if found:
            owner, loc, letter = (np.concatenate(c) for c in zip(*found, strict=True))
            yield from deal_by_owner(owner, n, REPEATED, 0, loc, letter)

    return run


SEGMENTS = "seg binary, rid long, place int, least long, letters binary, sizes binary"


def segment_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of repeated letters at places in a row of a text, but for later copies; seg is a 128-bit hash of the letters."""
    found, later = [], []
    for row in rows:
        if row[2] == LATER:
            later.append(row[1])
        else:
            found.append((numbers(row[5]), numbers(row[6]), numbers(row[7])))
    if not found:
        return
    owner, loc, letter = (np.concatenate(c) for c in zip(*found, strict=True))
    stays = ~np.isin(owner, np.array(later, np.int64))
    owner, loc, letter = owner[stays], loc[stays], letter[stays]
    if not len(owner):
        return
    order = np.lexsort((loc, owner))
    owner, place, size, letter = owner[order], loc[order] >> 7, (loc[order] & 127).astype(np.uint8), letter[order]
    edges = np.nonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))[0] + 1
    starts, stops = [0, *edges.tolist()], [*edges.tolist(), len(owner)]
    least = np.minimum.reduceat(letter, starts).tolist()
    letters, sizes = letter.tobytes(), size.tobytes()
    for k, (i, j) in enumerate(zip(starts, stops, strict=True)):
        own = letters[8 * i : 8 * j]
        yield hashlib.blake2b(own, digest_size=16).digest(), int(owner[i]), int(place[i]), least[k], own, sizes[i:j]


# -- 3. places


def to_places(spans: list[int], window: int, n: int) -> Callable:
    """Texts and their segments to the places that start repeats for certain, those that are open, and by letter the
    leaders (certain places of one of each set of texts that agree) and what open places ask for."""
    left, right = margins(window)

    def solve(texts: list[tuple], segments: list[list[tuple]]) -> Iterator[tuple]:
        counts = np.array([len(t[6]) for t in texts])
        first = np.cumsum(counts + 1) - counts - 1  # of each text, in arrays with an entry for each cut and the end
        sizes = np.zeros(int((counts + 1).sum()), np.int64)
        for t, at in zip(texts, first.tolist(), strict=True):
            sizes[at + 1 : at + 1 + len(t[6])] = numbers(t[6], np.uint8)
        at = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), counts + 1)
        at -= at[first][owner]
        n_bytes, last = np.array([t[4] for t in texts])[owner], (first + counts)[owner]
        m, prev, letter = (np.zeros(len(at), np.int64) for _ in range(3))
        for own, base in zip(segments, first.tolist(), strict=True):
            for row in own:
                here = slice(base + row[3], base + row[3] + len(row[5]) // 8)
                rest = len(row[5]) // 8 - np.arange(len(row[5]) // 8)
                letter[here] = numbers(row[5])
                m[here] = rest if row[4] & 2 else numbers(row[6])
                prev[here] = numbers(row[7]) if row[4] & 1 else rest  # others share all with the leader
        i = np.nonzero(m)[0]
        ends = np.zeros(len(at), np.int64)  # how far the match from a cut on reaches
        ends[i] = np.minimum(at[i + m[i]] + right, n_bytes[i])
        copied = np.array([t[3] for t in texts], bool)
        certain, open_ = [], []
        for tag, span in enumerate(spans):
            low, high = np.maximum(at[i] - left, 0), np.minimum(at[i + 1] - left - 1, ends[i] - span)
            ok = high >= low
            certain.append((owner[i[ok]], low[ok], high[ok]))
            # leaders: not those that the suffix before shares
            shared = np.where(prev[i] > 0, np.minimum(at[i + prev[i]] + right, n_bytes[i]) - span + 1, 0)
            low = np.maximum(low, shared)
            point, rest = at[i] - left, np.maximum(low, at[i] - left + 1)
            alone = (point >= low) & (point <= high)
            more = rest <= high
            pieces = [np.concatenate(x) for x in zip((i[alone], letter[i[alone]], point[alone], point[alone]), (i[more], letter[i[more] + 1], rest[more], high[more]), strict=True)]
            yield from deal_leaders(tag, np.array([t[1] for t in texts])[owner[pieces[0]]], *pieces[1:])
            # open: the phrases well inside match
            f = i[at[i] > 0]
            beyond = f + m[f] + 1
            high = np.minimum(at[f] - left, n_bytes[f] - span)
            high = np.where(beyond <= last[f], np.minimum(high, at[np.minimum(beyond, last[f])] - span + right - 1), high)
            low = np.maximum(at[f - 1] - left + 1, 0)
            low = np.where(m[f - 1] > 0, np.maximum(low, ends[f - 1] - span + 1), low)
            high = high - ((high == at[f] - left) & (ends[f] - span >= high))
            ok = high >= low
            f, low, high = f[ok], low[ok], high[ok]
            open_.append((owner[f], low, high))
            asked = np.unique(letter[f[~copied[owner[f]]]])
            part = spread_by(asked, n)
            bounds = np.searchsorted(part, np.arange(n + 1)).tolist()
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b:
                    yield k, 0, ASKED, tag, b - a, asked[a:b].tobytes(), None, None
        bounds = [np.searchsorted(x[0], np.arange(len(texts) + 1)).tolist() for x in (*certain, *open_)]
        for k, t in enumerate(texts):
            if any(b[k] < b[k + 1] for b in bounds):
                cells = [x[c][b[k] : b[k + 1]] for x, b in zip((*certain, *open_), bounds, strict=True) for c in (1, 2)]
                yield t[0], t[1], PLACES, t[3], t[4], bytes(t[5]), put(*cells), None

    def deal_leaders(tag: int, rid: np.ndarray, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        part = spread_by(letter, n)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(n + 1)).tolist()
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                at = order[a:b]
                yield k, 0, LEADER, tag, b - a, letter[at].tobytes(), rid[at].tobytes(), put(low[at], high[at])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        texts: dict[int, tuple] = {}
        segments: dict[int, list[tuple]] = {}
        for row in rows:
            if row[2] == TEXT:
                texts[row[1]] = row
            else:
                segments.setdefault(row[1], []).append(row)
        held: list[int] = []
        size = 0
        for key in sorted(segments):
            held.append(key)
            size += len(texts[key][6])
            if size >= GATHERED // 4:
                yield from solve([texts[k] for k in held], [segments[k] for k in held])
                held, size = [], 0
        if held:
            yield from solve([texts[k] for k in held], [segments[k] for k in held])

    return run


def wanted_leaders(n: int) -> Callable:
    """Of the leaders those whose letter an open place asks for, for their texts' homes."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        asked: dict[int, list] = {}
        leaders: dict[int, list] = {}
        for row in rows:
            if row[2] == ASKED:
                asked.setdefault(row[3], []).append(numbers(row[5]))
            else:
                leaders.setdefault(row[3], []).append((numbers(row[5]), numbers(row[6]), *got(row[7])))
        for tag in asked.keys() & leaders.keys():
            letter, rid, low, high = (np.concatenate(c) for c in zip(*leaders[tag], strict=True))
            keep = np.isin(letter, np.unique(np.concatenate(asked[tag])))
            yield from deal_by_owner(rid[keep], n, WANTED_PLACES, tag, low[keep], high[keep])

    return run


CANDIDATES = "sha binary, rid long, copied int, certain binary, hashed binary"


def by_owner(rows: list[tuple[np.ndarray, ...]]) -> dict[int, list[np.ndarray]]:
    """Entries (owner, columns) as each owner's columns."""
    if not rows:
        return {}
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    starts = runs_among(columns[0])
    stops = np.append(starts[1:], len(order)).tolist()
    return {k: [c[a:b] for c in columns[1:]] for k, a, b in zip(columns[0][starts].tolist(), starts.tolist(), stops, strict=True)}


def candidates_of(tags: int) -> Callable:
    """Texts with certain places, and those whose hashes count: open ones and the leaders that are wanted."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        texts, wanted = [], [[] for _ in range(tags)]
        for row in rows:
            if row[2] == PLACES:
                texts.append(row)
            else:
                wanted[row[3]].append((numbers(row[5]), numbers(row[6]), numbers(row[7])))
        found = [by_owner(w) for w in wanted]
        for row in texts:
            cells = got(row[6])
            certain, open_ = cells[: 2 * tags], cells[2 * tags :]
            if row[3]:  # a text with copies goes whole
                certain = [c[:0] for c in certain]
            hashed = []
            for tag in range(tags):
                own = found[tag].get(row[1], [np.empty(0, np.int64)] * 2)
                hashed += [np.concatenate((o, w)) for o, w in zip(open_[2 * tag : 2 * tag + 2], own, strict=True)]
            if any(map(len, certain)) or any(map(len, hashed)):
                yield bytes(row[5]), row[1], row[3], put(*certain), put(*hashed)

    return run


def texts_read(wanted) -> Callable:
    """(sha, text) of the texts whose hash is wanted (all, if it is None), each once for a task that meets it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces_of(batches, "text"):
            texts = as_bytes(batch.column("text"))
            sha = [hashlib.sha256(t).digest() for t in texts]
            if wanted is not None:
                asked = wanted.value
                own = np.frombuffer(b"".join(sha), np.int64)[::4]
                hit = asked[np.minimum(np.searchsorted(asked, own), len(asked) - 1)] == own if len(asked) else np.zeros(len(own), bool)
                sha, texts = zip(*[(s, t) for s, t, h in zip(sha, texts, hit.tolist(), strict=True) if h], strict=True) if hit.any() else ((), ())
            rows = []
            for s, t in zip(sha, texts, strict=True):
                if s not in seen:
                    rows.append((s, t))
                    if len(seen) < 200_000:
                        seen.add(s)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["sha", "text"])

    return run


def place_hashes(text: bytes, low: np.ndarray, high: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, the first 128 bits of the SHA-256 of the span from each of them, as two numbers) for runs of places."""
    n = high - low + 1
    places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    sha = hashlib.sha256
    digests = b"".join([sha(text[p : p + span]).digest() for p in places.tolist()])
    return places, np.frombuffer(digests, np.int64).reshape(-1, 4)[:, :2]


def deal_hashes(spans: list[int], n: int) -> Callable:
    """Candidates with their texts to packets of hashes, by the hash, and of the texts that stay."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[list] = [[] for _ in spans]
        size = 0

        def out() -> Iterator[tuple]:
            for tag, cells in enumerate(held):
                if cells:
                    owner, place, one, two = (np.concatenate(c) for c in zip(*cells, strict=True))
                    cells.clear()
                    part = ((one.view(np.uint64) >> U(32)).astype(np.int64) * n) >> 32
                    order = np.argsort(part.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
                    bounds = np.searchsorted(part[order], np.arange(n + 1)).tolist()
                    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        if i < j:
                            at = order[i:j]
                            yield k, 0, HASHED, tag, j - i, np.concatenate((one[at], two[at])).tobytes(), owners_cell(owner[at]), place[at].tobytes()

        for sha, text, rid, copied, certain, hashed in rows:
            data, runs = bytes(text), got(hashed)
            for tag, span in enumerate(spans):
                place, both = place_hashes(data, runs[2 * tag], runs[2 * tag + 1], span)
                if len(place):
                    held[tag].append((np.full(len(place), rid), place, both[:, 0].copy(), both[:, 1].copy()))
                    size += len(place)
            if not copied:
                yield rid % n, rid, TEXT, 0, len(data), data, bytes(certain), bytes(sha)
            if size >= GATHERED:
                yield from out()
                size = 0
        yield from out()

    return run


def decided(n: int) -> Callable:
    """The places whose hashes occur at another place, too, for their texts' homes."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        by_tag: dict[int, list] = {}
        for row in rows:
            both = numbers(row[5])
            by_tag.setdefault(row[3], []).append((both[: row[4]], both[row[4] :], *owners_of(row[6]), numbers(row[7])))
        for tag, cells in by_tag.items():
            one, two, owner, place = (np.concatenate(c) for c in zip(*cells, strict=True))
            order = np.argsort(one)
            starts = runs_among(one[order])
            size = np.diff(np.append(starts, len(order)))
            at = order[np.repeat(size > 1, size)]
            one, two, owner, place = one[at], two[at], owner[at], place[at]
            order = np.lexsort((place, owner, two, one))
            one, two, owner, place = one[order], two[order], owner[order], place[order]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]
            fresh = np.concatenate(([True], new[1:] | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))[: len(one)]  # a text read twice counts once
            one, two, owner, place, new = one[fresh], two[fresh], owner[fresh], place[fresh], new[fresh]
            starts = np.nonzero(new)[0]
            size = np.diff(np.append(starts, len(new)))
            keep = np.repeat(size > 1, size)
            yield from deal_by_owner(owner[keep], n, DECIDED, tag, place[keep])

    return run


def removed_runs(low: np.ndarray, high: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by spans that start at low .. high."""
    order = np.argsort(low, kind="stable")
    begin, end = low[order], np.maximum.accumulate(high[order] + span)
    new = np.concatenate(([True], begin[1:] > end[:-1]))[: len(begin)]
    starts = np.nonzero(new)[0]
    stops = np.append(starts[1:], len(begin)) - 1
    return list(zip(begin[starts].tolist(), end[stops].tolist(), strict=True)) if len(begin) else []


def whole_words(text: bytes, begin: int, end: int) -> int:
    """The words that lie within a run."""
    words = len(text[begin:end].split())
    dark = lambda i: 0 <= i < len(text) and not BLANK[text[i]]
    cut = (dark(begin - 1) and dark(begin)) + (dark(end - 1) and dark(end))
    return max(0, words - int(cut))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def settled(spans: list[int], judge: Callable) -> Callable:
    """Texts with their certain and decided places to judge(rid, sha, text, removed runs of each span)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        texts, found = [], [[] for _ in spans]
        for row in rows:
            if row[2] == TEXT:
                texts.append(row)
            else:
                found[row[3]].append((numbers(row[5]), numbers(row[6])))
        places = [by_owner(f) for f in found]
        for row in texts:
            cells, runs = got(row[6]), []
            for tag, span in enumerate(spans):
                own = places[tag].get(row[1], [np.empty(0, np.int64)])[0]
                runs.append(removed_runs(np.concatenate((cells[2 * tag], own)), np.concatenate((cells[2 * tag + 1], own)), span))
            if any(runs):
                yield judge(row[1], bytes(row[7]), bytes(row[5]), runs)

    return run


def hashes_of(rows: DataFrame, at_most: int) -> np.ndarray | None:
    """The first eight bytes of all sha, sorted; none if there are more than at_most."""
    if rows.count() > at_most:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(x[:8] for x in batch.column("sha").to_pylist())])], names=["x"])

    found = rows.select("sha").mapInArrow(run, "x binary").collect()  # eight bytes for each of at_most texts
    return np.sort(np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.int64))


def marked(rows: DataFrame, spans: list[int], judge: Callable, schema: str, types: list[pa.DataType]) -> tuple[DataFrame, DataFrame]:
    """(all rows, marks): rows are (rid, doc, n_bytes, n_words, sha, copies), marks what judge says of each distinct text
    that loses bytes; texts with copies (copies > 1) go whole and have none."""
    spark = rows.sparkSession
    window = window_of(min(spans))
    parsed_ = materialise(rows.mapInArrow(parsed(min(spans), window), PARSED), "parsed")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-(parsed_.agg(F.sum("n_bytes")).first()[0] or 0) // PARTITION)))
    groups = parsed_.where(F.col("n_bytes") >= min(spans)).groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("first"), F.max("n_words").alias("words")).where("copies > 1")
    groups = materialise(groups, "copies")  # a side of its own: the other can then be split where one text has most rows
    light = parsed_.select("rid", "doc", "n_bytes", "n_words", "sha").join(groups, "sha", "left")
    light = materialise(light.select("rid", "doc", "n_bytes", F.coalesce("words", "n_words").alias("n_words"), "sha", F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("first").isNotNull() & (F.col("rid") != F.col("first"))).alias("later")), "texts")
    release(groups)
    home = F.expr(f"CAST(pmod(rid, {n}) AS INT)").alias("home")
    nothing = [F.lit(None).cast("binary").alias(c) for c in "abc"]
    later = light.where("later").select(home, F.col("rid").alias("id"), F.lit(LATER).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), *nothing)
    letters = mapped_from(parsed_.where("letters IS NOT NULL").select("rid", "sha", "sizes", "letters"), deal_letters(n))
    entries = mapped(dealt(letters, n), repeated_letters(n)).union(later)
    segments = materialise(tabled(dealt(entries, n), segment_rows, SEGMENTS, [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]), "segments")
    free_shuffles(spark)
    # one row for each segment, written, so that Spark can split the other side of a join where one segment has most rows
    kinds = materialise(segments.groupBy("seg").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("lead")), "kinds")
    leads = F.struct("rid", "place") == F.col("lead")
    firsts = segments.join(kinds, "seg").where(leads).select("seg", "letters", "sizes", "least")
    found = matches(firsts, max(spans) - margins(window)[1], n)  # a phrase that begins at p or later needs no more
    known = materialise(kinds.join(found, "seg"), "kinds")
    release(kinds, found)
    cell = lambda c: F.col(c).cast("binary")
    number = F.when(F.col("n") > 1, 2).otherwise(0) + F.when(leads, 1).otherwise(0)
    of_segments = segments.join(known, "seg").select(home, F.col("rid").alias("id"), F.lit(SEGMENT).alias("kind"), F.col("place").alias("part"), number.cast("long").alias("n"), cell("letters").alias("a"), cell("m").alias("b"), cell("prev").alias("c"))
    of_texts = parsed_.where("letters IS NOT NULL").select("rid", "sizes").join(light.where("NOT later"), "rid").select(home, F.col("rid").alias("id"), F.lit(TEXT).alias("kind"), F.when(F.col("copies") > 1, 1).otherwise(0).alias("part"), F.col("n_bytes").alias("n"), cell("sha").alias("a"), cell("sizes").alias("b"), F.lit(None).cast("binary").alias("c"))
    places = materialise(mapped(dealt(of_segments.union(of_texts), n), to_places(spans, window, n)), "places")
    release(parsed_, segments, known)
    wanted = mapped(dealt(places.where(F.col("kind").isin(LEADER, ASKED)), n), wanted_leaders(n))
    candidates = materialise(tabled(dealt(places.where(F.col("kind") == PLACES).union(wanted), n), candidates_of(len(spans)), CANDIDATES, [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]), "candidates")
    release(places)
    hashes = hashes_of(candidates, WANTED)
    texts = rows.mapInArrow(texts_read(None if hashes is None else spark.sparkContext.broadcast(hashes)), "sha binary, text binary")
    with small_batches(spark):
        both = texts.join(candidates, "sha").select("sha", "text", "rid", "copied", "certain", "hashed")
        hashed = materialise(mapped_from(both, deal_hashes(spans, n)), "hashed")
    release(candidates)
    with small_batches(spark):
        chosen = mapped(dealt(hashed.where(F.col("kind") == HASHED), n), decided(n))
        marks = materialise(tabled(dealt(hashed.where(F.col("kind") == TEXT).union(chosen), n), settled(spans, judge), schema, types), "marks")
    release(hashed)
    return light, marks


def mapped_from(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Rows of any columns to packets."""
    names = df.columns
    return df.mapInArrow(lambda batches: batches_of(fn(rows_of(batches, names))), PACKET)


def tabled(packets: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Packets to rows of another schema."""
    names = [f.split()[0] for f in schema.split(", ")]
    return packets.mapInArrow(lambda batches: batches_of(fn(rows_of(batches)), names, types), schema)


# -- results

MARKS = "rid long, n_removed long, n_spans long, kept_sha256 string, has_passage boolean"
MARK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def counted(words: int) -> Callable:
    """What is removed by the first span, and whether a run of the last one is a passage."""

    def judge(rid: int, sha: bytes, text: bytes, runs: list[list[tuple[int, int]]]) -> tuple:
        kept = kept_bytes(text, runs[0])
        return rid, len(text) - len(kept), len(runs[0]), hashlib.sha256(kept).hexdigest(), any(whole_words(text, a, b) > words for a, b in runs[-1])

    return judge


def repeats(docs: DataFrame, span: int = SPAN, passage: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With passage = (bytes, words) also has_passage: whether the text holds a run of over so many whole words that is
    covered by strings of so many bytes which occur elsewhere, too.
    """
    spans, words = [span, *([passage[0]] if passage else [])], passage[1] if passage else 0
    light, marks = marked(text_rows(docs, id_col, text_col), spans, counted(words), MARKS, MARK_TYPES)
    all_ = light.withColumnRenamed("doc", "doc_id").join(marks, "rid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    gone = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    runs = F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0)))
    sha = F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    has = F.when(F.col("copies") > 1, F.coalesce("n_words", F.lit(0)) > words).otherwise(F.coalesce("has_passage", F.lit(False)))
    return all_.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), runs.cast("long").alias("n_spans"), sha.alias("kept_sha256"), *([has.alias("has_passage")] if passage else []))


def cutter(names: list[str], text_col: str, runs_col: str) -> Callable:
    """Rows with the runs that go (pairs of int64; null: none) to rows without that column, their texts cut; characters stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cell in zip(as_bytes(batch.column(text_col)), batch.column(runs_col).to_pylist(), strict=True):
                runs = []
                for a, b in np.frombuffer(cell or b"", np.int64).reshape(-1, 2).tolist():
                    b = min(b, len(text))
                    while a < b and text[a] & 0xC0 == 0x80:  # a character begun before stays
                        a += 1
                    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:  # and one that goes on behind
                        b -= 1
                    runs.append((a, b))
                texts.append(kept_bytes(text, runs).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names=names)

    return run


def listed(words: int) -> Callable:
    """The runs of over so many whole words."""

    def judge(rid: int, sha: bytes, text: bytes, runs: list[list[tuple[int, int]]]) -> tuple:
        return sha, np.array([r for r in runs[0] if whole_words(text, *r) > words], np.int64).tobytes()

    return judge


def cut_texts(docs: DataFrame, span: int = SPAN, words: int = -1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all repeats of over `words` whole words cut out of the texts. A null text becomes empty; other columns stay as they are."""
    light, marks = marked(text_rows(docs, id_col, text_col), [span], listed(words), "sha binary, runs binary", [pa.binary(), pa.binary()])
    whole = F.lit(np.array([0, 1 << 62], np.int64).tobytes())  # of texts with copies: all
    copied = light.where((F.col("copies") > 1) & (F.col("n_bytes") >= span) & (F.coalesce("n_words", F.lit(0)) > words)).select("sha").distinct().withColumn("runs", whole)
    sha, runs = (f"{name}-{uuid.uuid4().hex}" for name in ("sha", "runs"))  # no column of docs has these names
    own = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    both = docs.withColumn(sha, own).join(marks.union(copied).toDF(sha, runs), sha, "left")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return both.select(*kept, F.col(f"`{runs}`")).mapInArrow(cutter(docs.columns, text_col, runs), docs.schema)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), passage=(PASSAGE, PASSAGE_WORDS))
