"""Toxicity scores of deobfuscated text.

Writers hide words by look-alike signs (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition (idiiioot). A hidden word
is what most likely went through that noisy channel: each sign of the observed string gives a lattice of the letters
it may stand for (itself, a look-alike, nothing, a gap between words), runs of a letter may stand for one or two,
separators between single letters may stand for nothing or a gap. Trigrams can't tell a sign that ends a word from
punctuation, so a noisy string is read in three ways (READINGS), and the words of each count. The Viterbi algorithm
finds the path with the best product of channel and language model. The language model is a character trigram model,
counted over all documents given.

Only strings that show signs of noise are decoded; other words are what they seem. A noisy string of over 64 signs is
decoded in parts that overlap by half. The score is a logistic regression on the words of
the restored text and on what they begin with. Which of those count is learnt from labelled documents: at most `sample`
of them, the first by a hash of the id, each distinct text once, so that copies don't pose as evidence.

Bounds: the trigram table has 28^3 cells, the vocabulary `words` entries, the regression `sample` rows; nothing else
comes to the driver. The sample's ids are broadcast, `sample` of them at most.

Defined cases: null and empty texts have no words and get the score of the intercept; repeated rows are each returned
and scored alike; labels that are null don't count, and of several for one id the highest does; without usable labels
of both kinds all scores are 0; an empty table gives an empty result; extra columns are ignored by `scores`. Ids that
are null are held in (their remainder isn't 2).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import as_text, materialise, pieces_of, release, table, text_rows

SAMPLE = 20_000
WORDS = 2_000
#: Documents that a word must occur in to be learnt.
LEAST_DOCS = 5
#: Standard errors that a word's log odds must lie from zero to be learnt: with few labels chance makes many words look strong.
LEAST_Z = 2.0
#: Lengths of beginnings of words that count as features of their own: languages inflect and compound.
STEMS = (5, 7)
THRESHOLD = 0.3

# The letters that signs stand for in leetspeak.
LOOK_ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
# Log-probabilities of the channel.
LEET, DROP, REPEATED, SPACED = -1.0, -3.0, -0.5, -0.2
# A gap between words: a separator; a sign that is punctuation, a digit, any other sign.
GAP = {c: -0.2 for c in " .-_*"} | {c: -0.5 for c in "!¡|+("} | {c: -4.0 for c in "0123456789"}
RARE_GAP = -8.0

SIGNS = re.escape("".join(LOOK_ALIKE))
#: Single letters or signs with separators between them; words with a sign anywhere; words with a letter three times.
NOISY = re.compile(
    rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:[ .\-_*]{{1,2}}(?:[^\W\d_]|[{SIGNS}])){{2,}}(?![^\W_])"
    rf"|(?<![^\W\d_])(?<![{SIGNS}])(?=[{SIGNS}]*+[^\W\d_])[^\W\d_]*+[{SIGNS}](?:[^\W\d_]|[{SIGNS}])*+"
    rf"|\w*([^\W\d_])\1{{2,}}\w*",
    re.IGNORECASE,
)
#: A piece between blanks that is one letter or sign, but for punctuation around it.
SINGLE = re.compile(rf"[\"'(\[]*([^\W_]|[{SIGNS}])[\"'.,;:!?)\]]*")
WORD = re.compile(r"[^\W\d_]+")
#: A word that no disguise can hide in: letters, with plain punctuation around them and no letter three times in a row.
SIMPLE = re.compile(r"[\"']*+(?!\w*?(\w)\1\1)([^\W\d_]+)[.,;:?)\"']*+")
LETTERS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
OTHER = 27
SIDE = 28


@lru_cache(1 << 12)
def plain(c: str) -> str:
    """A letter without its accents."""
    return unicodedata.normalize("NFKD", c)[:1].lower() or c


# -- the language model


LATIN = bytes(LETTERS.get(plain(chr(b)), 0 if not chr(b).isalpha() else OTHER) for b in range(256))


def codes(text: str) -> np.ndarray:
    """Letters as 1..26, any other letter as 27, all else as 0 (a gap)."""
    raw = np.frombuffer(text.encode("latin-1", "replace").translate(LATIN), np.uint8)
    return np.concatenate(([0], raw, [0])).astype(np.int32)


def trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's texts; runs of gaps count as one."""
    counts = np.zeros(SIDE**3, np.int64)
    for batch in pieces_of(batches, "text"):
        for text in as_text(batch.column("text")):
            c = codes(text)
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
            if len(c) > 2:
                counts += np.bincount(c[:-2] * SIDE * SIDE + c[1:-1] * SIDE + c[2:], minlength=SIDE**3)
    used = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["gram", "n"])


def language_model(rows: DataFrame) -> np.ndarray:
    """log P(third | first two) as a cube, interpolated with bigrams; from all of rows."""
    counted = rows.mapInArrow(trigram_rows, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 28^3 at most
    n = np.zeros(SIDE**3)
    for r in counted:
        n[r["gram"]] = r["n"]
    n = n.reshape(SIDE, SIDE, SIDE)
    two = n.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + SIDE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5))


# -- the channel


#: What signs may stand for: letters or nothing; letters only; letters, nothing or a gap between words.
READINGS = ("hidden", "letters", "gaps")


def lattice(observed: str, reading: str = "hidden") -> list[list[tuple[str, float]]]:
    """For each stretch of a noisy string, what it may stand for, with log-probabilities."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(observed):
        c = observed[i]
        j = i + 1
        while j < len(observed) and observed[j].lower() == c.lower():
            j += 1
        run = j - i
        if c in " .-_*":
            out.append([("", SPACED)] + ([(" ", GAP[c])] if reading == "gaps" else []))
        elif c in LOOK_ALIKE:
            if reading == "letters":
                out.append([(letter * min(run, 2), LEET) for letter in LOOK_ALIKE[c]])
                i = j
                continue
            silent = [("", DROP * min(run, 3))]
            silent += [(" ", GAP.get(c, RARE_GAP))] if reading == "gaps" else []
            out.append([(letter, LEET) for letter in LOOK_ALIKE[c]] + silent + ([(letter * 2, LEET + REPEATED) for letter in LOOK_ALIKE[c]] if run > 1 else []))
        elif not c.isalpha():
            out.append([("", DROP)])
        elif run > 2:
            out.append([(plain(c), REPEATED), (plain(c) * 2, 2 * REPEATED)])
        else:
            out.append([(plain(c) * run, 0.0)] + ([(plain(c), 3 * REPEATED)] if run == 2 and reading != "letters" else []))
        i = j
    return out


def viterbi(observed: str, model: np.ndarray, reading: str = "hidden") -> str:
    """The likeliest words behind a noisy string, with blanks between them."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in lattice(observed, reading):
        ahead: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in paths.items():
            for letters, cost in choices:
                x, y, s = a, b, score + cost
                for c in letters:
                    z = 0 if c == " " else LETTERS.get(c, OTHER)
                    if z == y == 0:  # gaps in a row count as one
                        continue
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in ahead or s > ahead[x, y][0]:
                    ahead[x, y] = (s, said + letters)
        paths = ahead
    return max((score + (model[a, b, 0] if b else 0.0), said) for (a, b), (score, said) in paths.items())[1]


def stretches(noisy: str, longest: int = 64) -> list[str]:
    """A noisy string in parts that are decoded on their own. They overlap by half, so that a word at a seam is whole in one."""
    return [noisy[i : i + longest] for i in range(0, max(1, len(noisy) - longest // 2), longest // 2)]


class Restorer:
    """The words of restored texts, and what longer ones begin with, under one language model.

    Words between blanks are looked up in a table of bounded size, decoded only when they are new and noisy; single
    letters in a row are decoded together. wanted: the features that count; all if it is None.
    """

    def __init__(self, model: np.ndarray, wanted: dict[str, float] | None = None, table: int = 150_000):
        self.model, self.wanted, self.limit = model, wanted, table
        self.known: dict[str, tuple[str, ...]] = {}

    def restore(self, text: str) -> str:
        """The text with its noisy strings decoded: the likeliest words of each reading."""

        def said(m: re.Match) -> str:
            return " ".join(dict.fromkeys(viterbi(x, self.model, r) for x in stretches(m[0]) for r in READINGS))

        return NOISY.sub(said, text)

    def of(self, word: str) -> tuple[str, ...]:
        found = {m[2]} if (m := SIMPLE.fullmatch(word)) else set(WORD.findall(self.restore(word)))
        found |= {w[:n] + "^" for w in found if len(w) > min(STEMS) for n in STEMS if len(w) > n}
        out = tuple(sorted(found if self.wanted is None else found & self.wanted.keys()))
        if len(word) < 64:
            if len(self.known) >= self.limit:
                self.known = dict(islice(self.known.items(), self.limit // 2))
            self.known[word] = out
        return out

    def features(self, text: str) -> set[str]:
        words = text.lower().split()
        out: set[str] = set()
        get = self.known.get
        for w in set(words):
            found = get(w)
            if found is None:
                found = self.of(w)
                get = self.known.get
            if found:
                out.update(found)
        alone = {i: m[1] for i, w in enumerate(words) if len(w) < 8 and (len(w) == 1 or not w.isalpha()) and (m := SINGLE.fullmatch(w))}
        single = list(alone)
        begun = 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - begun >= 3:
                    letters = [alone[i] for i in single[begun:k]]
                    # the first or the last may be a word of its own
                    for part in (letters, letters[1:], letters[:-1]):
                        if len(part) >= 3:
                            out.update(self.of(" ".join(part)))
                begun = k
        return out


# -- the classifier


def remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def sample_rows(model: np.ndarray) -> Callable:
    """(sha, toxic, words) of labelled rows; words distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in pieces_of(batches, "text", 2 << 20):
            texts = as_text(batch.column("text"))
            words = [sorted(restorer.features(t)) for t in texts]
            sha = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["sha", "toxic", "words"])

    return run


def fitted(x: list[list[int]], y: np.ndarray, size: int, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by accelerated gradient descent with a ridge."""
    rows = np.repeat(np.arange(len(x)), [len(f) for f in x])
    columns = np.concatenate([np.array(f, np.int64) for f in x]) if len(rows) else np.empty(0, np.int64)
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    v, c = w.copy(), b
    # a bound of the curvature: a quarter of the largest column sum of x'x
    width = np.array([len(f) for f in x], float)
    step = 1 / (0.25 * np.bincount(columns, width[rows], size).max(initial=0.0) + ridge)
    for t in range(1, rounds + 1):
        z = c + np.bincount(rows, v[columns], len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w2 = v - step * (np.bincount(columns, g[rows], size) + ridge * v)
        b2 = c - g.sum() / len(y)
        v, c = w2 + (t - 1) / (t + 2) * (w2 - w), b2 + (t - 1) / (t + 2) * (b2 - b)
        w, b = w2, b2
    return w, b


def train(rows: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE, words: int = WORDS) -> tuple[dict[str, float], float | None]:
    """Weights of words and the intercept, from labelled rows whose fold isn't held out."""
    given = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder("doc_id") != 2)
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded top-k
    docs = rows.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # `sample` rows at most
    known = materialise(docs.mapInArrow(sample_rows(model), "sha binary, toxic int, words array<string>").groupBy("sha").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")), "toxic-sample")
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total["n"] or not total["t"] or total["t"] == total["n"]:
        return {}, None
    n, t = total["n"], total["t"]
    counts = known.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("d")).where(F.col("d") >= LEAST_DOCS)
    a, d = F.col("a"), F.col("d")
    odds = F.log((a + 0.5) / (F.lit(t) - a + 0.5)) - F.log((d - a + 0.5) / (F.lit(n - t) - (d - a) + 0.5))
    # log odds in units of their error: strong and well supported words first
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (d - a + 0.5))
    best = counts.select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(words).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(best)}
    if not vocabulary:  # no word tells: the share of toxic ones is all there is to say
        return {}, float(np.log((t + 0.5) / (n - t + 0.5)))
    wanted = F.broadcast(known.sparkSession.createDataFrame(list(vocabulary.items()), "word string, i int"))  # `words` rows at most
    used = known.select("sha", "toxic", F.explode_outer("words").alias("word")).join(wanted, "word", "left").groupBy("sha", "toxic").agg(F.collect_list("i").alias("x"))
    data = used.orderBy("sha").select("x", "toxic").collect()  # `sample` rows at most, of words' numbers
    release(known)
    w, b = fitted([r["x"] for r in data], np.array([r["toxic"] for r in data], float), len(vocabulary))
    return {word: float(w[i]) for word, i in vocabulary.items()}, b


def score_rows(model: np.ndarray, weights: dict[str, float], intercept: float | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, weights)
        for batch in pieces_of(batches, "text", 4 << 20):
            out = []
            for text in as_text(batch.column("text")):
                if intercept is None:
                    out.append(0.0)
                    continue
                z = intercept + sum(sorted(weights[w] for w in restorer.features(text)))
                out.append(float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, words: int = WORDS) -> DataFrame:
    """doc_id and score of every row; labels has doc_id and toxic."""
    rows = text_rows(docs, id_col, text_col)
    model = language_model(rows)
    weights, intercept = train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), model, sample, words)
    return rows.mapInArrow(score_rows(model, weights, intercept), "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (with its columns) that score below the threshold."""
    rows = text_rows(docs)
    model = language_model(rows)
    weights, intercept = train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), model)
    score = score_rows(model, weights, intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 4 << 20):
            keep = np.concatenate([b.column("score").to_numpy() for b in score(iter([batch]))]) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
