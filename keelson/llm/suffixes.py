"""The suffix order of many strings of 64-bit letters, by a distributed difference-cover algorithm.

Karkkainen and Sanders (2003), Kulla and Sanders (2006): the triples of letters at places 1 and 2 modulo 3 are sorted
and named by rank; while names repeat and a triple spans fewer bytes than matter, the string of names is sorted by the
same algorithm; places 0 modulo 3 are merged by two sorts, with places 1 by (letter, rank of the next suffix) and with
places 2 by (letter, next letter, rank of the one after). Adjacent suffixes' common prefixes then say how much of each
suffix occurs elsewhere.

How it is distributed. The strings lie in chunks, each at home in one partition; all that concerns neighbouring places
is done there. A sort is a round trip: a chunk sends each of its distinct keys once, with the number of places that
have it, to the range that the key falls in (bounds come from a sample); the range adds up the
counts below each key and sends them back. So what a task sorts are distinct keys, and however often a key occurs, a
range gets it once from each chunk. The driver sees the sample and a few sums for each range. Every round trip is
written to the shared folder. A string of SMALL letters at most is sorted in one task, by the same steps.

Where names repeat that span too little, but most don't, only those that do and the names right after them go on to
the string of names (each comparison is settled there at the latest), and a third sort, by (name, rank there), tells
samples of one name apart.

Places that agree in all bytes that matter, or to the ends of their strings, may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import materialise, release
from keelson.llm.packets import PACKET, at_home, batches_of, dealt, got, grouped, mapped, numbers, put, rows_of

STRING, DIRECTORY, MERGE, RANKS, TOTAL, EDGE, SUFFIX, TIES = range(8)
ANSWER, UNTIED = 10, 20  # and the number of the sort
#: Beyond a string's end nothing is left to compare.
ENDLESS = 1 << 40
#: Places of a string that one task sorts.
SMALL = 1 << 18
#: Places for which a range or home is set up.
SORTED = 200_000
#: Places of a chunk, unless one string is longer.
CHUNK = 1 << 21
#: Keys that a chunk gives for the bounds of ranges.
SAMPLED = 32


# -- what happens at home


def padded(v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With three zeros at least, to a multiple of three places."""
    k = 3 + -len(v) % 3
    return np.concatenate((v, np.zeros(k, np.int64))), np.concatenate((s, np.full(k, ENDLESS, np.int64)))


def ahead_of(x: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """The value k places on."""
    return np.concatenate((x[k:], np.full(k, fill, np.int64)))


def samples(n: int) -> np.ndarray:
    return np.concatenate((np.arange(1, n, 3), np.arange(2, n, 3)))


def triples(v: np.ndarray, s: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(distinct triples at the samples, [how many, bytes], which of them each sample has)."""
    at = samples(len(v))
    columns = [v[at], ahead_of(v, 1)[at], ahead_of(v, 2)[at]]
    span = np.minimum(s + ahead_of(s, 1, ENDLESS) + ahead_of(s, 2, ENDLESS), ENDLESS)[at]
    order, starts, group = grouped(columns)
    first = order[starts]
    return [c[first] for c in columns], [np.bincount(group), span[first]], group


def names_string(names: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string of names: those of places 1 modulo 3, a zero, those of places 2."""
    span = np.minimum(s + ahead_of(s, 1, ENDLESS) + ahead_of(s, 2, ENDLESS), ENDLESS)[samples(len(v))]
    half = len(names) // 2
    cut = lambda x, zero: np.concatenate((x[:half], [zero], x[half:]))
    return padded(cut(names, 0), cut(span, ENDLESS))


def sample_ranks(ranks: np.ndarray, zeros: int, n: int) -> np.ndarray:
    """From the ranks in the string of names, 1 and the number of smaller samples; `zeros` places of that string are no samples."""
    third = n // 3
    return np.concatenate((ranks[:third], ranks[third + 1 : 2 * third + 1])) - zeros + 1


def in_place(of_samples: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[samples(n)] = of_samples
    return out


def merge_keys(v: np.ndarray, r: np.ndarray) -> list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]]:
    """For both sorts of the merge: (distinct keys, [places 0, samples that have them], places, which key each has)."""
    n, out = len(v), []
    for kind in (1, 2):
        at = np.concatenate((np.arange(0, n, 3), np.arange(kind, n, 3)))
        columns = [v[at], *([ahead_of(v, 1)[at]] if kind == 2 else []), ahead_of(r, kind)[at]]
        order, starts, group = grouped(columns)
        third, size = n // 3, len(starts)
        out.append(([c[order[starts]] for c in columns], [np.bincount(group[:third], minlength=size), np.bincount(group[third:], minlength=size)], at, group))
    return out


def merged(v: np.ndarray, r: np.ndarray, keys: list[tuple], less: list[list[np.ndarray]]) -> np.ndarray:
    """The number of smaller suffixes, from the counts below the keys of both sorts."""
    out = r - 1
    for (_, _, at, group), (zeros, others) in zip(keys, less, strict=True):
        out[at] += zeros[group]
        third = len(v) // 3
        out[at[:third]] += others[group[:third]]
    third = np.arange(0, len(v), 3)
    # places 0 were counted below themselves twice, and have no rank as a sample
    out[third] += 1 - less[1][0][keys[1][3][: len(third)]]
    return out


def below(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def local_ranks(v: np.ndarray, s: np.ndarray, limit: int) -> np.ndarray:
    """The same for a string within one task."""
    _, (count, span), group = triples(v, s)
    names = (below(count) + 1)[group]
    if ((count > 1) & (span < limit)).any():
        v2, s2 = names_string(names, v, s)
        names = sample_ranks(local_ranks(v2, s2, limit), len(v2) - len(names), len(v))
    r = in_place(names, len(v))
    keys = merge_keys(v, r)
    return merged(v, r, keys, [[below(c) for c in counts] for _, counts, _, _ in keys])


# -- round trips


def deal_keys(keys_of: Callable, splitters: list[list[np.ndarray]], n: int) -> Callable:
    """Chunks to packets of their distinct keys, one for each sort and range."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            for tag, (keys, counts) in enumerate(keys_of(row)):
                at = [0, *lower_bounds(keys, splitters[tag]).tolist(), len(keys[0])]
                for part, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if i < j:
                        yield part, row[1], tag, row[0], j - i, np.concatenate([k[i:j] for k in keys]).tobytes(), np.concatenate([c[i:j] for c in counts]).astype(np.int64).tobytes(), None

    return run


def lower_bounds(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted keys are below each splitter."""
    low, high = np.searchsorted(keys[0], splitters[0], "left"), np.searchsorted(keys[0], splitters[0], "right")
    for j in np.nonzero(low < high)[0].tolist():
        a, b = int(low[j]), int(high[j])
        for key, s in zip(keys[1:], splitters[1:], strict=True):
            a, b = a + int(np.searchsorted(key[a:b], s[j], "left")), a + int(np.searchsorted(key[a:b], s[j], "right"))
        low[j] = a
    return low


def count_range(limit: int | None, answer: int) -> Callable:
    """A range's keys to the counts below each of them. With a limit the second count is a span, and the second answer
    is whether a key is open: it occurs more than once and spans less. The driver is told how many places are open."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        by_tag: dict[int, list[tuple]] = {}
        for row in rows:
            by_tag.setdefault(row[2], []).append(row)
        for tag, found in by_tag.items():
            sizes = [r[4] for r in found]
            side_by_side = lambda cell: np.concatenate([numbers(r[cell]).reshape(-1, r[4]) for r in found], axis=1)  # noqa: E731, B023
            keys, counts = side_by_side(5), side_by_side(6)
            order, starts, group = grouped(list(keys))
            sums = [np.add.reduceat(c[order], starts) for c in counts[: 1 if limit else 2]]
            less, total = [below(x)[group] for x in sums], [0, *(x.sum() for x in sums)]
            if limit:
                open_ = (sums[0] > 1) & (counts[1][order[starts]] < limit)
                less.append(open_[group].astype(np.int64))
                total = [sums[0][open_].sum(), *total[1:], 0]
            at = 0
            for row, size in zip(found, sizes, strict=True):
                yield row[3], row[1], answer + tag, row[0], size, np.concatenate([x[at : at + size] for x in less]).tobytes(), None, None
                at += size
            yield 0, -1, TOTAL, found[0][0], tag, np.array(total, np.int64).tobytes(), None, None

    return run


class Counted:
    """The counts below each chunk's keys, as packets for the chunks, and what the driver adds to those of each range."""

    def __init__(self, owners: DataFrame, kind: int, keys_of: Callable, sorts: int, n: int, limit: int | None = None, answer: int = ANSWER):
        splitters = split(owners.where(F.col("kind") == kind), sorts, n)
        self.packets = materialise(mapped(dealt(mapped(owners.where(F.col("kind") == kind), deal_keys(keys_of, splitters, n)), n), count_range(limit, answer)), "counts")
        totals: dict[tuple[int, int], np.ndarray] = {}
        for r in self.packets.where(F.col("kind") == TOTAL).select("part", "n", "a").collect():  # one for each range and sort
            totals[r["n"], r["part"]] = numbers(bytes(r["a"]))
        self.open = sum(int(t[0]) for t in totals.values())
        self.base: dict[tuple[int, int], np.ndarray] = {}
        at: dict[int, np.ndarray] = {}
        for (tag, part), t in sorted(totals.items()):
            self.base[tag, part] = at.get(tag, np.zeros(len(t) - 1, np.int64))
            at[tag] = self.base[tag, part] + t[1:]


def less_of(rows: list[tuple], tag: int, base: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
    """The counts below a chunk's keys, in the keys' order."""
    parts = [numbers(r[5]).reshape(-1, r[4]) + base[tag, r[3]][:, None] for r in rows]
    return list(np.concatenate(parts, axis=1))


def split(owners: DataFrame, sorts: int, n: int) -> list[list[np.ndarray]]:
    """For each sort n - 1 keys that part the keys evenly, from the samples that the owners carry."""
    found: list[list] = [[] for _ in range(sorts)]
    weights: list[list] = [[] for _ in range(sorts)]
    for r in owners.select("c").collect():  # SAMPLED keys of each chunk, or twice as many
        widths, steps, *arrays = got(bytes(r["c"]))
        for tag in range(sorts):
            columns = arrays[int(widths[:tag].sum()) :][: int(widths[tag])]
            found[tag].append(columns)
            weights[tag].append(np.full(len(columns[0]), steps[tag]))
    out = []
    for cells, weight in zip(found, weights, strict=True):
        columns, weight = [np.concatenate(c) for c in zip(*cells, strict=True)], np.concatenate(weight)
        order = np.lexsort(columns[::-1])
        upto = np.cumsum(weight[order])
        at = order[np.minimum(np.searchsorted(upto, np.arange(1, n) * (int(upto[-1]) / n)), len(order) - 1)]
        out.append([c[at] for c in columns])
    return out


def sampled(sorts: list[list[np.ndarray]]) -> bytes:
    """Evenly spaced keys of each sort, and how many keys each stands for."""
    steps = [max(1, len(keys[0]) // SAMPLED) for keys in sorts]
    return put(np.array([len(keys) for keys in sorts]), np.array(steps), *(k[step // 2 :: step] for keys, step in zip(sorts, steps, strict=True) for k in keys))


# -- one level


def string_packet(home: int, key: int, v: np.ndarray, s: np.ndarray) -> tuple:
    return home, key, STRING, 0, len(v), v.tobytes(), s.tobytes(), sampled([triples(v, s)[0]])


def string_keys(row: tuple) -> list:
    return [triples(numbers(row[5]), numbers(row[6]))[:2]]


def merge_packet(home: int, key: int, v: np.ndarray, r: np.ndarray) -> tuple:
    return home, key, MERGE, 0, len(v), v.tobytes(), r.tobytes(), sampled([k[0] for k in merge_keys(v, r)])


def keys_to_merge(row: tuple) -> list:
    return [k[:2] for k in merge_keys(numbers(row[5]), numbers(row[6]))]


def names_of(kinds: dict[int, list[tuple]], base: dict, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of a chunk's samples, and which of them are open."""
    less, open_ = less_of(kinds[ANSWER], 0, base)
    return (less + 1)[group], (open_ > 0)[group]


def open_part(names: np.ndarray, open_: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the string of names the open ones and those right after them, with a zero after each run; and where in that
    the open samples are, in order."""
    v2, s2 = names_string(names, v, s)
    half = len(names) // 2
    mask = np.zeros(len(v2), bool)
    mask[:half], mask[half + 1 : 2 * half + 1] = open_[:half], open_[half:]
    kept = mask.copy()
    kept[1:] |= mask[:-1]
    at = np.nonzero(kept)[0]
    place = np.arange(len(at)) + np.cumsum(np.concatenate(([0], np.diff(at) > 1)))
    size = int(place[-1]) + 1 if len(at) else 0
    v3, s3 = np.zeros(size, np.int64), np.full(size, ENDLESS, np.int64)
    v3[place], s3[place] = v2[at], s2[at]
    return v3, s3, place[mask[at]]


def to_open(base: dict, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk with the counts of its triples to the part of its string of names that is open."""
    if STRING not in kinds:
        return
    (row,) = kinds[STRING]
    v, s = numbers(row[5]), numbers(row[6])
    v3, s3, _ = open_part(*names_of(kinds, base, triples(v, s)[2]), v, s)
    if len(v3):
        yield string_packet(row[0], key, *padded(v3, s3))


def tie_keys(names: np.ndarray, ranks: np.ndarray) -> list[tuple]:
    """Keys of two sorts: by name and rank, and by name alone; what is between their counts is a place within a name."""
    out = []
    for columns in ([names, ranks], [names]):
        order, starts, group = grouped(columns)
        out.append(([c[order[starts]] for c in columns], [np.bincount(group), np.zeros(len(starts), np.int64)], group))
    return out


def to_ties(base: dict, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk's open samples: their names and their ranks in the open part."""
    if STRING not in kinds or RANKS not in kinds:
        return
    (row,), (ranks,) = kinds[STRING], kinds[RANKS]
    v, s = numbers(row[5]), numbers(row[6])
    names, open_ = names_of(kinds, base, triples(v, s)[2])
    own, rank = names[open_], numbers(ranks[5])[open_part(names, open_, v, s)[2]]
    yield row[0], key, TIES, 0, len(own), own.tobytes(), rank.tobytes(), sampled([k[0] for k in tie_keys(own, rank)])


def keys_of_ties(row: tuple) -> list:
    return [k[:2] for k in tie_keys(numbers(row[5]), numbers(row[6]))]


def from_ties(base: dict, untied: dict, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk with the counts of its triples and of its open samples, on to the merge."""
    if STRING not in kinds:
        return
    (row,) = kinds[STRING]
    v, s = numbers(row[5]), numbers(row[6])
    names, open_ = names_of(kinds, base, triples(v, s)[2])
    if TIES in kinds:
        (ties,) = kinds[TIES]
        both, alone = tie_keys(numbers(ties[5]), numbers(ties[6]))
        names = names.copy()
        names[open_] += less_of(kinds[UNTIED], 0, untied)[0][both[2]] - less_of(kinds[UNTIED + 1], 1, untied)[0][alone[2]]
    yield merge_packet(row[0], key, v, in_place(names, len(v)))


def to_names(base: dict, key: int, kinds: dict[int, list[tuple]], merging: bool = False) -> Iterator[tuple]:
    """A chunk with the counts of its triples to its string of names, or on to the merge."""
    if STRING not in kinds:
        return
    (row,) = kinds[STRING]
    v, s = numbers(row[5]), numbers(row[6])
    names = names_of(kinds, base, triples(v, s)[2])[0]
    if merging:
        yield merge_packet(row[0], key, v, in_place(names, len(v)))
    else:
        yield string_packet(row[0], key, *names_string(names, v, s))


def to_merge(zeros: int, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk with the ranks of its string of names, on to the merge."""
    (row,), (ranks,) = kinds[STRING], kinds[RANKS]
    v = numbers(row[5])
    yield merge_packet(row[0], key, v, in_place(sample_ranks(numbers(ranks[5]), zeros, len(v)), len(v)))


def to_ranks(base: dict, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    if MERGE not in kinds:
        return
    (row,) = kinds[MERGE]
    v, r = numbers(row[5]), numbers(row[6])
    out = merged(v, r, merge_keys(v, r), [less_of(kinds[ANSWER + tag], tag, base) for tag in (0, 1)])
    yield row[0], key, RANKS, 0, len(out), out.tobytes(), None, None


def in_one_task(limit: int) -> Callable:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        found = sorted(rows, key=lambda r: r[1])
        if found:
            v, s = (np.concatenate([numbers(r[c]) for r in found]) for c in (5, 6))
            ranks, at = local_ranks(v, s, limit), 0
            for r in found:
                yield r[0], r[1], RANKS, 0, r[4], ranks[at : at + r[4]].tobytes(), None, None
                at += r[4]

    return run


def suffix_ranks(strings: DataFrame, total: int, limit: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Packets of ranks, exact in the first `limit` bytes of each suffix, for strings of `total` places in all, sorted in
    `most` ranges at most.

    Also the written tables that they are read from, to be released when they have been written themselves.
    """
    only, n = strings.where(F.col("kind") == STRING), ranges_of(total, most)
    if total <= SMALL:
        return mapped(only.repartitionById(1, F.lit(0)), in_one_task(limit)), []
    names = Counted(strings, STRING, string_keys, 1, n, limit)
    if not names.open:
        merge = materialise(at_home([only, names.packets], n, partial(to_names, names.base, merging=True)), "merge")
    elif 3 * names.open < total:  # fewer than half of the samples
        lower = materialise(at_home([only, names.packets], n, partial(to_open, names.base)), "names")
        ranks, spent = suffix_ranks(lower, lower.agg(F.sum("n")).first()[0], limit, most)
        ties = materialise(at_home([only, names.packets, ranks], n, partial(to_ties, names.base)), "ties")
        release(lower, *spent)
        untied = Counted(ties, TIES, keys_of_ties, 2, n, answer=UNTIED)
        merge = materialise(at_home([only, names.packets, ties, untied.packets], n, partial(from_ties, names.base, untied.base)), "merge")
        release(ties, untied.packets)
    else:
        lower = materialise(at_home([only, names.packets], n, partial(to_names, names.base)), "names")
        size = lower.agg(F.sum("n")).first()[0]
        ranks, spent = suffix_ranks(lower, size, limit, most)
        merge = materialise(at_home([only, ranks], n, partial(to_merge, size - 2 * total // 3)), "merge")
        release(lower, *spent)
    release(names.packets)
    counts = Counted(merge, MERGE, keys_to_merge, 2, n)
    return at_home([merge, counts.packets], n, partial(to_ranks, counts.base)), [merge, counts.packets]


def ranges_of(total: int, most: int) -> int:
    """Ranges, and homes that are kept apart, for so many places."""
    return min(most, max(1, -(-total // SORTED)))


# -- strings and matches


def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Strings (seg, letters, sizes) to chunks: letters with a zero after each string, and a directory of the strings."""
    home = TaskContext.get().partitionId()
    held: list[tuple] = []
    made = size = 0

    def out() -> Iterator[tuple]:
        nonlocal made, size
        v, s, lengths = [], [], []
        for _, letters, sizes in held:
            v += [numbers(letters), np.zeros(1, np.int64)]
            s += [numbers(sizes, np.uint8).astype(np.int64), np.full(1, ENDLESS, np.int64)]
            lengths.append(len(v[-2]))
        key = home << 20 | made
        yield string_packet(home, key, *padded(np.concatenate(v), np.concatenate(s)))
        yield home, key, DIRECTORY, 0, 0, b"".join(bytes(seg) for seg, _, _ in held), np.array(lengths, np.int64).tobytes(), None
        made, size = made + 1, 0
        held.clear()

    for row in rows:
        held.append(row)
        size += len(row[1]) // 8
        if size >= CHUNK:
            yield from out()
    if held:
        yield from out()


def suffix_spans(v: np.ndarray, s: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
    """For letters at the given places, how many follow within `limit` bytes and their string, themselves included."""
    ends = np.concatenate(([0], np.cumsum(np.where(v == 0, 0, s))))
    zeros = np.nonzero(v == 0)[0]
    return np.minimum(zeros[np.searchsorted(zeros, at)], np.searchsorted(ends, ends[at] + limit)) - at


def taken(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of all starts, in one array."""
    total = int(lengths.sum())
    skipped = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(total) + skipped]


def distinct_suffixes(v: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(places of letters, distinct ranks, a place of each, which of them each place has, how many places each has)."""
    at = np.nonzero(v)[0]
    u, first, inverse, count = np.unique(rank[at], return_index=True, return_inverse=True, return_counts=True)
    return at, u, at[first], inverse, count


def deal_suffixes(total: int, n: int, limit: int, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk's distinct suffixes, as the letters of `limit` bytes, to the ranges of their ranks."""
    (row,), (ranks,) = kinds[STRING], kinds[RANKS]
    v, s = numbers(row[5]), numbers(row[6])
    _, u, first, _, count = distinct_suffixes(v, numbers(ranks[5]))
    spans = suffix_spans(v, s, first, limit)
    bounds = np.searchsorted((u * n) // total, np.arange(n + 1))
    for part, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if i < j:
            yield part, key, SUFFIX, row[0], j - i, put(u[i:j], count[i:j], spans[i:j]), taken(v, first[i:j], spans[i:j]).tobytes(), None


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many letters two suffixes share from the first."""
    n = min(len(a), len(b))
    differ = np.nonzero(a[:n] != b[:n])[0]
    return int(differ[0]) if len(differ) else n


def compare_neighbours(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Suffixes of a range to m, the letters that each shares with either neighbour, and prev, those with the one before."""
    found = sorted(rows, key=lambda r: r[1])
    if not found:
        return
    cells = [got(r[5]) for r in found]
    rank, count, span = (np.concatenate(c) for c in zip(*cells, strict=True))
    flat = np.concatenate([numbers(r[6]) for r in found])
    offset = np.cumsum(span) - span
    order = np.argsort(rank, kind="stable")  # of equal ones, the first chunk's leads
    ranked = rank[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.nonzero(new)[0]
    lead, many = order[starts], np.add.reduceat(count[order], starts) > 1
    shared = np.zeros(len(lead) + 1, np.int64)  # with the one before
    alive, k = np.arange(1, len(lead)), 0
    while len(alive):
        a, b = lead[alive - 1], lead[alive]
        inside = (span[a] > k) & (span[b] > k)
        alive, a, b = alive[inside], a[inside], b[inside]
        same = flat[offset[a] + k] == flat[offset[b] + k]
        alive = alive[same]
        shared[alive] += 1
        k += 1
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    m = np.where(many, span[lead], np.maximum(shared[:-1], shared[1:]))
    flags = (group == 0) * 2 + (group == len(lead) - 1) * 4
    flags[lead] += 1
    at = 0
    for row in found:
        here = slice(at, at + row[4])
        yield row[3], row[1], ANSWER, row[0], row[4], put(m[group[here]], shared[:-1][group[here]], flags[here]), None, None
        at += row[4]
    first, last = lead[0], lead[-1]
    yield 0, -1, EDGE, found[0][0], 0, flat[offset[first] : offset[first] + span[first]].tobytes(), flat[offset[last] : offset[last] + span[last]].tobytes(), None


MATCHES = "seg binary, m binary, prev binary"


def to_matches(edges: dict[int, tuple[int, int]], limit: int, key: int, kinds: dict[int, list[tuple]]) -> Iterator[tuple]:
    """A chunk's strings, with m and prev of each letter."""
    if STRING not in kinds:
        return
    (row,), (ranks,), (names,) = kinds[STRING], kinds[RANKS], kinds[DIRECTORY]
    v, s = numbers(row[5]), numbers(row[6])
    at, _, first, inverse, _ = distinct_suffixes(v, numbers(ranks[5]))
    m, prev, lead = [], [], []
    for r in kinds[ANSWER]:
        a, b, flags = got(r[5])
        before, after = edges[r[3]]
        a = np.maximum(a, np.where(flags & 2, before, 0))
        a = np.maximum(a, np.where(flags & 4, after, 0))
        m.append(a)
        prev.append(np.where(flags & 2, before, b))
        lead.append(flags & 1)
    m, prev, lead = (np.concatenate(x) for x in (m, prev, lead))
    all_m, all_prev = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    all_m[at] = m[inverse]
    leads = (lead[inverse] == 1) & (first[inverse] == at)
    all_prev[at] = np.where(leads, prev[inverse], suffix_spans(v, s, at, limit))
    begin, segs = 0, bytes(names[5])
    for i, n in enumerate(numbers(names[6]).tolist()):
        yield segs[16 * i : 16 * i + 16], all_m[begin : begin + n].tobytes(), all_prev[begin : begin + n].tobytes()
        begin += n + 1


def matches(strings: DataFrame, limit: int, n: int) -> DataFrame:
    """(seg, m, prev) of distinct strings (seg, letters, sizes, least): for each letter how many from it on occur in the
    same order elsewhere, and how many of them in the suffix before it in suffix order (all, if it has an equal one).

    Strings that begin alike (the same least letter) share a chunk as far as it holds them, so that they send less.
    """
    near = strings.repartitionByRange(n, "least", "seg").select("seg", "letters", "sizes")
    own = materialise(near.mapInArrow(lambda batches: batches_of(chunks(rows_of(batches, ["seg", "letters", "sizes"]))), PACKET), "strings")
    total = own.agg(F.sum("n")).first()[0] or 0
    if not total:
        return strings.sparkSession.createDataFrame([], MATCHES)
    unwritten, spent = suffix_ranks(own, total, limit, n)
    ranks = materialise(unwritten, "suffix-ranks")
    release(*spent)
    n = ranges_of(total, n)
    only = own.where(F.col("kind") == STRING)
    sent = dealt(at_home([only, ranks], n, partial(deal_suffixes, total, n, limit)), n)
    answers = materialise(mapped(sent, compare_neighbours), "neighbours")
    ends = {r["part"]: (numbers(bytes(r["a"])), numbers(bytes(r["b"]))) for r in answers.where(F.col("kind") == EDGE).select("part", "a", "b").collect()}  # two suffixes of each range
    parts = sorted(ends)
    shared = [common(ends[p][1], ends[q][0]) for p, q in zip(parts, parts[1:], strict=False)]
    edges = {p: (a, b) for p, a, b in zip(parts, [0, *shared], [*shared, 0], strict=True)}
    out = at_home([own, ranks, answers.where(F.col("kind") == ANSWER)], n, partial(to_matches, edges, limit), MATCHES, [pa.binary()] * 3)
    out = materialise(out, "matches")
    release(own, ranks, answers)
    return out
