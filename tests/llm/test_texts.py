"""The operators on documents against brute force: on odd rows, on empty tables, and on random texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import byte_bpe, exact_dedup, packing, registry, repeats, simhash, suffixes, token_files, token_ids

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {n: token_ids.PieceEncoder(public_tokenizers.path(n)) for n in NAMES}
LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
for t in LIBRARY.values():
    t.encode_special_tokens = True
TEXT = st.lists(st.one_of(st.sampled_from(["the ", "ing", " ", "  ", "\n", "'s", "é", "日本", "12", "$$", "\t", "<|endoftext|>", ".\n", ","]), st.text(st.characters(min_codepoint=1, max_codepoint=0x2FF), max_size=6)), max_size=12).map("".join)


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def owners_by_definition(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text)].append((-len(text), doc is None, doc or 0, doc))
    want = []
    for doc, text in docs:
        body = re.sub(r"[\x20\x09-\x0d]", "", text)
        keep = min(groups[body])[3]
        want.append((doc, keep, len(groups[body]), doc == keep, hashlib.sha256(body.encode()).hexdigest()))
    return want


def test_exact_dedup(odd, none):
    assert sorted(rows(exact_dedup.owners(odd)), key=str) == sorted(owners_by_definition(documents(odd)), key=str)
    assert rows(exact_dedup.owners(none)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=60), st.integers(3, 40))
def test_trie_with_spills(keys, nodes):
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, 1 << 30, nodes)
    for k in keys:
        trie.insert(k, 1)
    found = list(trie.items())
    assert len(found) == len(set(keys)) and dict(found) == {k: keys.count(k) for k in keys}


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_transducer_agrees_with_tiktoken(text):
    ids = np.frombuffer(CODER.encode(text), "<u4").tolist()
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert b"".join(CODER.decode(ids, 3)) == text.encode()


def test_transducer_on_one_long_piece():
    random.seed(3)
    text = "".join(random.choice("abeinth") for _ in range(5000))
    coder = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    coder.transducer.max_states = 500
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


def test_utf8_stream_holds_back_begun_characters():
    data = "aé日🙂z".encode()
    for size in (1, 2, 3):
        stream, out = byte_bpe.Utf8Stream(), []
        for i in range(0, len(data), size):
            out.append(stream.feed(data[i : i + size]))
        assert all(part.decode() is not None for part in out) and b"".join([*out, stream.finish()]) == data


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=TEXT)
def test_pieces_agree_with_the_library(name, text):
    assert np.frombuffer(ENCODERS[name].encode([text])[0], "<u4").tolist() == LIBRARY[name].encode(text, add_special_tokens=False).ids


def coded_by_the_library(docs):
    for doc, text in docs:
        ids = TIKTOKEN.encode_ordinary(text)
        yield doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_rows(odd, none):
    found = rows(byte_bpe.digest_documents(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    assert sorted(found, key=str) == sorted(coded_by_the_library(documents(odd)), key=str)
    assert rows(byte_bpe.digest_documents(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)) == []


def check_packing(found, docs):
    """Each id of each document lies in one piece, sequences have no gaps, and little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in found:
        pieces[doc, total].append((start, length, crc))
        sequences[sequence].append((offset, length))
    tokens = 0
    for doc, text in docs:
        ids = np.array([*LIBRARY["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids, 2], "<u4")
        tokens += len(ids)
        own = [p for p in pieces[doc, len(ids)] if zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2]]
        assert {i for s, n, _ in own for i in range(s, s + n)} == set(range(len(ids)))
    assert sum(p[1] for ps in pieces.values() for p in ps) == tokens
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * tokens


def test_packing_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(rows(packing.pack(odd, path)), documents(odd))
    assert rows(packing.pack(none, path)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60))
def test_packer_places_each_token_once_with_little_padding(lengths):
    p = packing.HarmonicPacker()
    placed = [x for i, n in enumerate(lengths) for x in p.add(i, n)] + list(p.finish())
    assert sorted((d, i) for d, start, n, _, _ in placed for i in range(start, start + n)) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    used = defaultdict(int)
    for _, _, n, sequence, offset in placed:
        used[sequence] += n
        assert offset < 4096
    padding = sum(0 if u & (u - 1) == 0 else 4096 - u for u in used.values())
    assert padding <= packing.SLACK * 4096 * len(used)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 31, 1001).astype("<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind) == ids).all()


def token_rows(docs):
    at = 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        ids = np.array([*LIBRARY["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids, 0], "<u4")
        yield doc, at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)


@pytest.mark.parametrize(("kind", "block", "file_ids"), [("byte", 64, 200), ("bit", 1 << 16, 1 << 24)])
def test_token_files(odd, none, kind, block, file_ids):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = rows(token_files.read_tokens(token_files.write_tokens(odd, path, kind=kind, block=block, file_ids=file_ids)))
    assert sorted(found, key=lambda r: r[1]) == list(token_rows(documents(odd)))
    assert rows(token_files.read_tokens(token_files.write_tokens(none, path))) == []


def simhash_by_definition(text: str) -> int:
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """The smallest fingerprint linked with each, by comparing all pairs."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in prints}


def near_by_definition(docs):
    docs = [(d, simhash_by_definition(t)) for d, t in docs]
    groups = groups_of([p for _, p in docs])
    first = {}
    for d, p in docs:
        if d is not None:
            first[groups[p]] = min(first.get(groups[p], d), d)
    return [(d, p, first.get(groups[p])) for d, p in docs]


def test_simhash_rows(odd, none):
    want = [(d, p - (1 << 64) if p >> 63 else p, c) for d, p, c in near_by_definition(documents(odd))]
    assert sorted(rows(simhash.near_duplicates(odd)), key=str) == sorted(want, key=str)
    assert rows(simhash.near_duplicates(none)) == []


@pytest.mark.parametrize("hot", [None, 40])
def test_links_join_what_all_pairs_join(spark, monkeypatch, hot):
    """Clusters around a few fingerprints; with a low bound their buckets are cut finer."""
    from keelson.llm.graph import components

    monkeypatch.setattr(simhash, "PAIRWISE", 20)
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(30)}
    for base in list(prints)[:2]:
        for _ in range(120):
            x = base
            for _ in range(random.randrange(4)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    if hot:
        monkeypatch.setattr(simhash, "HOT", hot)
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    labels = {r["vertex"]: r["label"] for r in components(simhash.links(df)).collect()}
    want, found = defaultdict(set), defaultdict(set)
    for p, g in groups_of(prints).items():
        want[g].add(p)
        found[labels.get(signed[p], signed[p])].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def repeated_by_definition(texts, span):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("span", [400, 100])
def test_repeats(spark, span):
    random.seed(span)
    prose = lambda n: "".join(random.choice(["ab", "the ", "é", "on", " ", "z", "qu", "ring "]) for _ in range(n))
    passage, long_one = prose(300), prose(900)
    edited = long_one[:500] + "#" + long_one[501:900] + prose(50)
    texts = [prose(400) + passage + prose(200), passage + prose(100), long_one, edited, long_one[200:] + "!", "x" * 1500, prose(90) + "x" * 700, None, "", prose(20), passage + passage, prose(50) + long_one[100:640], long_one]
    docs = spark.createDataFrame([(i if i != 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS doc", "text AS letter")
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (t, gone) in enumerate(zip(raw, repeated_by_definition(raw, span), strict=True)):
        runs = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((i if i != 9 else None, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(rows(repeats.repeats(docs, span)), key=str) == sorted(want, key=str)
    cut = {r["doc_id"]: r["text"] for r in repeats.cut_texts(docs, span).collect()}
    assert cut[2] == "" and cut[0].startswith(texts[0][:100]) and all(t is not None for t in cut.values())


def test_repeats_of_nothing(odd, none):
    assert rows(repeats.repeats(none)) == []
    found = {r[0]: r[2] for r in rows(repeats.repeats(odd)) if r[0] is not None}
    assert found[10] == found[11] == 3000 and found[1] == 0


def test_repeats_with_copies_in_any_order(spark):
    """Near copies of texts whose copies lie in one task, the smallest id not first."""
    random.seed(8)
    prose = lambda n: "".join(random.choice(["ab", "the ", "on", " ", "z", "qu", "ring "]) for _ in range(n))
    texts = [(4, prose(300))]
    for near, ids in ((9, (7, 2)), (19, (17, None)), (29, (22, 22))):
        text = prose(400)
        texts += [*((i, text) for i in ids), (near, prose(80) + text[300:900] + prose(80))]
    want = [(i, int(gone.sum())) for (i, _), gone in zip(texts, repeated_by_definition([t.encode() for _, t in texts], 400), strict=True)]
    assert all(600 <= dict(want)[near] < 700 for near in (9, 19, 29)) and dict(want)[4] == 0
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert sorted(((r[0], r[2]) for r in rows(repeats.repeats(docs))), key=str) == sorted(want, key=str)


def test_passages(spark):
    """What repeats in fewer bytes than the span, but holds over 50 words; whole copies; long texts in stretches."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short, passage, copy, long_one = prose(40), prose(55), prose(60), prose(60_000)
    texts = [prose(30) + " " + passage + " " + prose(30), prose(80) + " " + passage, short + " " + prose(90), prose(9) + " " + short, copy, copy, prose(200), long_one, prose(50) + long_one[150_000:320_000], "yx" * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: r for r in rows(repeats.repeats(docs, 400, (200, 50)))}
    assert {i for i, r in found.items() if r[5]} == {0, 1, 4, 5, 7, 8}
    raw = [t.encode() for t in texts]
    for span in (400, 200):
        want = [int(gone.sum()) for gone in removed_by_hashes(raw, span)]
        assert [r[2] for _, r in sorted((found if span == 400 else {r[0]: r for r in rows(repeats.repeats(docs, 200))}).items())] == want
    cut = {r["doc_id"]: r["text"] for r in repeats.cut_texts(docs, 200, 50).collect()}
    assert passage[5:-5] not in cut[0] and short in cut[2] and cut[4] == cut[5] == "" and cut[6] == texts[6] and len(cut[7]) < len(texts[7]) - 169_000


def removed_by_hashes(raw, span):
    """As repeated_by_definition, for longer texts: windows by Python's own hash of bytes."""
    hashes = [np.array([hash(t[i : i + span]) for i in range(max(0, len(t) - span + 1))], np.int64) for t in raw]
    known, count = np.unique(np.concatenate(hashes), return_counts=True)
    again = known[count > 1]
    for t, h in zip(raw, hashes, strict=True):
        gone = np.zeros(len(t) + 1, np.int64)
        at = np.nonzero(np.isin(h, again))[0]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + span, -1)
        yield np.cumsum(gone)[:-1] > 0


@pytest.mark.parametrize("small", [None, 500])
def test_matches_are_the_longest(spark, monkeypatch, small):
    """Each letter's match is the longest that any other suffix has; the order is sorted in one task, or in rounds."""
    if small:
        monkeypatch.setattr(suffixes, "SMALL", small)
        monkeypatch.setattr(suffixes, "SORTED", 300)
    random.seed(7)
    base = [random.randrange(1, 1 << 40) for _ in range(120)]
    strings = [[7] * 50, [7] * 49 + [9], *([random.choice((3, 5)) for _ in range(random.randrange(1, 30))] for _ in range(20))]
    strings += [base[i : i + random.randrange(1, 90)] for i in (random.randrange(100) for _ in range(25))]
    strings = [s for s in {tuple(s): s for s in strings}.values() if s]
    sizes, limit = {}, 60
    out = []
    for s in strings:
        size = [sizes.setdefault(x, 1 + x % 9) for x in s]
        letters = np.array(s, np.int64).tobytes()
        out.append((hashlib.blake2b(letters, digest_size=16).digest(), bytearray(letters), bytearray(size), min(s)))
    df = spark.createDataFrame(out, "seg binary, letters binary, sizes binary, least long")
    found = {bytes(r["seg"]): (np.frombuffer(r["m"], np.int64).tolist(), np.frombuffer(r["prev"], np.int64).tolist()) for r in suffixes.matches(df, limit, 3).collect()}

    def ahead(s, i):  # the letters of `limit` bytes
        total, j = 0, i
        while j < len(s) and total < limit:
            total += sizes[s[j]]
            j += 1
        return s[i:j]

    all_ = [(k, i, ahead(s, i)) for k, s in enumerate(strings) for i in range(len(s))]
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    leads = 0
    for k, i, own in all_:
        m, prev = (x[i] for x in found[out[k][0]])
        assert m == max(shared(own, other) for q, j, other in all_ if (q, j) != (k, i)) and prev <= m
        leads += prev < len(own)
    assert leads >= len({tuple(own) for _, _, own in all_}) - 1


# -- the registered queries, on whole tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark.read.parquet(f"{SF}/documents.parquet"))


def answered(spark, name):
    return rows(registry.queries()[name](spark, SF))


def test_op2_repeats(spark, table):
    raw = [t.encode() for _, t in table]
    want = []
    for (doc, _), t, gone, short in zip(table, raw, removed_by_hashes(raw, 400), removed_by_hashes(raw, repeats.PASSAGE), strict=True):
        edges = lambda flags: np.nonzero(np.diff(np.concatenate(([0], flags.astype(int), [0]))))[0].reshape(-1, 2).tolist()
        has = any(repeats.whole_words(t, a, b) > 50 for a, b in edges(short))
        want.append((doc, len(t), int(gone.sum()), len(edges(gone)), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), has))
    assert sorted(answered(spark, "op2_repeats")) == sorted(want)
    assert any(r[5] for r in want) and any(r[2] for r in want)


def test_op6_packing(spark, table):
    check_packing(answered(spark, "op6_packing"), table)


def test_op7_byte_bpe(spark, table):
    assert sorted(answered(spark, "op7_byte_bpe")) == sorted(coded_by_the_library(table))


def test_op8_simhash(spark, table):
    assert sorted(answered(spark, "op8_simhash")) == sorted((d, f"{p:016x}", c) for d, p, c in near_by_definition(table))


def test_op10_token_files(spark, table):
    assert sorted(answered(spark, "op10_token_files")) == sorted(token_rows(table))
