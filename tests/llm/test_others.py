"""Tool calls, archives, top-k search, toxicity and the pipeline on small tables."""

import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import registry, tool_calls, topk, toxicity, warc_zip
from tests.oracle import SF, same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), SQL[name])


# -- tool calls

SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("now", None, None, None)]


def linked(spark, calls, results, rounds=64, schemas=None):
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    s = spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean")
    if schemas:
        s = spark.createDataFrame(schemas, "tool string, name string, type string, required boolean, enum array<string>, max_length int, items string")
    return tool_calls.link(c, r, s, rounds).orderBy("conv_id", "place").collect()


def test_calls_are_ordered_by_reference_and_validated(spark):
    calls = [
        (1, 0, "c", "add", '{"a": 1, "b": {"$ref": "b"}}'), (1, 1, "b", "add", '{"b": 2.5, "a": 3, "note": "x\\n\\"y\\""}'), (1, 2, "a", "now", None),
        (1, 3, "a", "now", "{}"), (1, 4, "u", "fly", "{}"), (1, 5, "w", "add", '{"a": "1", "b": 2}'), (1, 6, None, "now", "not json"),
    ]
    results = [(1, 7, "c", "four"), (1, 8, "b", None), (1, 9, "a", "noon"), (1, 10, "a", "late"), (1, 11, "zz", "?"), (2, 0, "c", "other"), (1, 12, "u", "up")]
    found = linked(spark, calls, results)
    at = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in found}
    assert at[1, "call", "c", 0]["level"] == 2 and at[1, "result", "c", 7]["level"] == 3
    assert at[1, "result", "b", 8]["place"] < at[1, "call", "c", 0]["place"]
    assert at[1, "call", "b", 1]["valid"] and not at[1, "call", "c", 0]["valid"] and not at[1, "call", "w", 5]["valid"] and at[1, "call", "a", 2]["valid"]
    assert [at[1, "call", "a", t]["status"] for t in (2, 3)] == ["linked", "duplicate"]
    assert [at[1, "result", "a", t]["status"] for t in (9, 10)] == ["linked", "duplicate"]
    assert at[1, "result", "zz", 11]["status"] == at[2, "result", "c", 0]["status"] == "orphan"
    assert at[1, "call", "u", 4]["status"] == "unknown" and at[1, "call", None, 6]["status"] == "unanswered"
    assert at[1, "call", "b", 1]["json"] == '{"arguments":{"a":3,"b":2.5,"note":"x\\n\\"y\\""},"id":"b","name":"add","role":"assistant","type":"function_call"}'
    assert all(json.loads(r["json"]) for r in found) and not any(r["cyclic"] for r in found)
    assert [r["place"] for r in found if r["conv_id"] == 1] == list(range(len(calls) + len(results) - 1))


def test_cycles_are_flagged(spark):
    calls = [(1, 0, "p", "now", '{"x":{"$ref":"q"}}'), (1, 1, "q", "now", '{"x":{"$ref":"p"}}'), (1, 2, "r", "now", "{}")]
    found = {(r["kind"], r["call_id"]): r["cyclic"] for r in linked(spark, calls, [(1, 3, i, "") for i in "pqr"], rounds=5)}
    assert found["call", "p"] and found["call", "q"] and not found["call", "r"]


def test_long_chains_are_ordered_and_not_cyclic(spark):
    """Chains longer than any number of rounds, dealt backwards; a cycle with a call behind it and one before."""
    n = 500
    chain = [(1, n - i, f"c{i}", "now", f'{{"x":{{"$ref":"c{i - 1}"}}}}' if i else "{}") for i in range(n)]
    forks = [(2, n - i, f"f{i}", "now", '{"x":[' + ",".join(f'{{"$ref":"f{j}"}}' for j in range(max(0, i - 3), i, 2)) + "]}") for i in range(12)]
    ring = [(3, 0, "p", "now", '{"x":{"$ref":"q"},"y":{"$ref":"s"}}'), (3, 1, "q", "now", '{"x":{"$ref":"p"}}'), (3, 2, "b", "now", '{"x":{"$ref":"p"}}'), (3, 3, "s", "now", "{}")]
    calls = chain + forks + ring
    found = linked(spark, calls, [(c, 1000, i, "") for c, _, i, *_ in calls], rounds=3)
    at = {(r["conv_id"], r["kind"], r["call_id"]): r for r in found}
    assert [at[1, "call", f"c{i}"]["level"] for i in range(n)] == [2 * i for i in range(n)]
    want = []
    for i in range(12):
        want.append(max((want[j] + 2 for j in range(max(0, i - 3), i, 2)), default=0))
    assert [at[2, "call", f"f{i}"]["level"] for i in range(12)] == want
    assert {r["call_id"] for r in found if r["cyclic"]} == {"p", "q", "b"}
    assert at[3, "result", "s"]["place"] < at[3, "call", "p"]["place"]


def test_arguments_are_canonical_at_every_depth(spark):
    calls = [(1, 0, "a", "free", '{"a":{"y":1,"x":[2.50,1e2,{"d":null,"c":"\\u00e9"}]}}'), (1, 1, "b", "free", ' { "a" : {"x":[2.5, 1.0e2,{"c":"é","d":null}],"y":1}} '), (1, 2, "c", "free", '{"a":1,"a":2}'), (1, 3, "d", "free", '{"a":{"x":1,"x":1}}'), (1, 4, "e", "free", "[1]")]
    found = {r["call_id"]: r for r in linked(spark, calls, [], schemas=[("free", "a", "any", False, None, None, None)])}
    body = lambda i: found[i]["json"].replace(f'"id":"{i}"', "")
    assert body("a") == body("b") and '{"a":{"x":[2.5,100.0,{"c":"é","d":null}],"y":1}}' in body("a")
    assert [found[i]["valid"] for i in "abcde"] == [True, True, False, False, False] and json.loads(found["c"]["json"])["arguments"] == '{"a":1,"a":2}'


@pytest.mark.parametrize(
    ("arguments", "valid"),
    [
        ('{"mode":"fast","tags":["x","y"],"at":{"day":3}}', True), ('{"mode":"slow"}', False), ('{"mode":"fast","tags":[1]}', False), ('{"mode":"fast","tags":"x"}', False), ('{"mode":"fast","at":{}}', False),
        ('{"mode":"fast","at":{"day":"3"}}', False), ('{"mode":"fast","note":"12345"}', True), ('{"mode":"fast","note":"123456"}', False), ('{"tags":[]}', False), ('{"mode":"fast","more":1}', False), ('{"mode":"fast","at":{"day":3.0}}', True), ('{"mode":"fast","at":{"day":3.5}}', False),
    ],
)
def test_arguments_are_held_against_schemas(spark, arguments, valid):
    schema = [("t", "mode", "string", True, ['"fast"', '"safe"'], None, None), ("t", "tags", "array", False, None, None, "string"), ("t", "at", "object", False, None, None, None), ("t", "at.day", "integer", True, None, None, None), ("t", "note", "string", False, None, 5, None)]
    assert linked(spark, [(1, 0, "a", "t", arguments)], [], schemas=schema)[0]["valid"] is valid


def test_op4_orders_chains_flags_rings_and_finds_faults(spark):
    """On a table large enough to hold all of it; the SQL says the same."""
    sf = "/root/testdata/sf0.01"
    df = registry.queries()["op4_tool_calls"](spark, sf)
    same(df, SQL["op4_tool_calls"], sf)
    rows = df.collect()
    assert max(r["level"] for r in rows if not r["cyclic"]) >= 4 and any(r["cyclic"] for r in rows)
    assert {r["valid"] for r in rows if r["kind"] == "call"} == {True, False}


def test_no_messages(spark):
    assert linked(spark, [], []) == []


# -- archives


class Bytes:
    def __init__(self, data):
        self.data, self.reads = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads += n
        return self.data[at : at + n]


@pytest.mark.parametrize("limit", [None, 10])
def test_packages_are_read_by_range(monkeypatch, limit):
    if limit:  # every size counts as too large for the plain directory
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    w = warc_zip.PackageWriter(out)
    payloads = [b"", b"x" * 50_000, "é\r\n\r\n".encode() * 40]
    for i, p in enumerate(payloads):
        w.add(i, f"http://e/{i}", p, hashlib.sha256(p).hexdigest(), None)
    w.add(9, None, payloads[1], "d", 1)
    w.close()
    found = list(warc_zip.Package(Bytes(out.getvalue())).records())
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == [*payloads, b""]
    assert found[3][0]["warc-type"] == "revisit" and found[3][0]["warc-refers-to"] == "<urn:page:1>"
    assert zipfile.ZipFile(io.BytesIO(out.getvalue())).testzip() is None


def test_damaged_packages_are_refused():
    with pytest.raises(ValueError):
        warc_zip.Package(Bytes(b"no zip at all" * 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.RECORDS, b"a" * 1000)
    with pytest.raises(ValueError, match="stored"):
        warc_zip.Package(Bytes(out.getvalue())).place(warc_zip.RECORDS)


def test_odd_pages(spark):
    same_, long_one = "s" * 99, "l" * 100
    pages = [(1, same_), (2, same_), (3, long_one), (4, long_one), (4, long_one), (3, long_one), (5, None), (None, long_one), (6, "é" * 50), (7, "é" * 50)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("digest", F.lit("clash"))
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.read_packages(warc_zip.write_packages(df, package_bytes=150)).collect()), key=str)
    want = [(1, 99, "response", None), (2, 99, "response", None), (3, 100, "response", None), (3, 100, "response", None), (4, 100, "revisit", 3), (4, 100, "revisit", 3), (5, 0, "response", None), (6, 100, "response", None), (7, 100, "revisit", 6), (None, 100, "revisit", 3)]
    assert found == sorted(want, key=str)
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0))).collect() == []


# -- top-k


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(150)] + [(i, [0.5, 0.25, 0.0, 1.0]) for i in range(150, 260)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    rows += [(40, [0.5, 0.25, 0.0, 1.0]), (40, [0.5, 0.25, 0.0, 1.0]), (400, [3000.0, -2000.0, 1.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    usable = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(usable):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for other, (i, w) in enumerate(usable) if other != at and len(w) == len(v))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert found == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# -- toxicity


def test_toxicity_learns_and_sees_through_disguise(spark):
    import random

    random.seed(4)
    clean = ["river", "stone", "garden", "window", "paper", "winter", "bread", "music", "letter", "forest", "idle", "rotten", "modern"]
    docs, labels = [], []
    for i in range(600):
        words = [random.choice(clean) for _ in range(30)]
        if i % 5 == 0:
            words[random.randrange(30)] = random.choice(["moron", "idiot"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    hidden = ["river m0r0n stone", "you i d i o t there", "mooooron bread", "an 1d1ot", "i.d.i.o.t!", "MORON"]
    docs += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, "river stone 2024 window"), (2001, None), (2002, ""), (2003, "bread $$$ music###"), (None, "garden")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (3, None), (5, 1)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(d, lab).collect()}
    assert all(found[1000 + i] >= 0.3 for i in range(len(hidden)))
    assert all(found[i] < 0.3 for i in (2000, 2001, 2002, 2003, None))
    wrong = [i for i, t in labels if (found[i] >= 0.3) != bool(t)]
    assert len(wrong) <= 3
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, lab).collect()}
    assert 1000 not in kept and {2000, 2001, None} <= kept
    assert toxicity.scores(d.limit(0), lab).collect() == []
    assert {r["score"] for r in toxicity.scores(d, lab.where("toxic = 0")).collect()} == {0.0}


def test_disguises_that_end_in_signs(spark):
    """Words of a corpus behind signs at their ends, and spaced letters beside punctuation and one-letter words."""
    text = "river stone garden window paper you are an idiot, moron and asshole. hello, see a boss kiss us! an ass, morons and idiots too. a shit show. " * 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.language_model(docs))
    for written, word in [("idio7", "idiot"), ("asshol3", "asshole"), ("a$$", "ass"), ("5h17", "shit"), ("m0r0n5", "morons"), ("m0r0n", "moron"), ("1d10t!", "idiot"), ("i d i o t, you", "idiot"), ("a i d i o t", "idiot"), ("a m o r o n .", "moron"), ("i.d.i.o.t!", "idiot")]:
        assert word in r.features(written), (written, r.features(written))
    assert "hello" in r.features("hello!") and "see" in r.features("(see this)") and not r.features("2024 $100 3.14")


@pytest.mark.parametrize("reading", toxicity.READINGS)
def test_viterbi_finds_the_best_path(reading):
    """Against all paths through small lattices."""
    import itertools

    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIDE), (toxicity.SIDE, toxicity.SIDE)))

    def score(letters):
        x = y = 0
        total = 0.0
        for part, cost in letters:
            total += cost
            for c in part:
                z = 0 if c == " " else toxicity.LETTERS.get(c, toxicity.OTHER)
                if z == y == 0:
                    continue
                total += model[x, y, z]
                x, y = y, z
        return total + (model[x, y, 0] if y else 0.0)

    for noisy in ("1d10t", "a$$", "i d i.o t", "mooor0n!", "b44d", "(5h17)", "x--y|z", "ññ0"):
        best = max(itertools.product(*toxicity.lattice(noisy, reading)), key=score)
        said = toxicity.viterbi(noisy, model, reading)
        same_said = [p for p in itertools.product(*toxicity.lattice(noisy, reading)) if "".join(x for x, _ in p) == said]
        assert max(map(score, same_said)) == pytest.approx(score(best)), noisy


def test_regression_is_at_its_optimum():
    """The gradient is zero there, and no step away from it is better."""
    rng = np.random.default_rng(6)
    x = [sorted(set(rng.integers(0, 30, rng.integers(0, 9)).tolist())) for _ in range(400)]
    y = np.array([float(sum(f < 6 for f in row) + rng.random() > 1.5) for row in x])
    dense = np.zeros((400, 30))
    for row, features in zip(dense, x, strict=True):
        row[features] = 1

    def loss(w, b):
        z = dense @ w + b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ w

    w, b = toxicity.fitted(x, y, 30, 1.0)
    p = 1 / (1 + np.exp(-(dense @ w + b)))
    assert np.abs(dense.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05
    assert all(loss(w + d, b) >= loss(w, b) - 1e-3 for d in rng.normal(0, 0.05, (50, 30)))
    alone, base = toxicity.fitted([[]] * 10, np.array([1.0] * 3 + [0.0] * 7), 1)
    assert not alone.any() and base == pytest.approx(np.log(3 / 7), abs=0.05)


def test_very_long_texts_and_ties_are_scored(spark):
    name = lambda i: chr(97 + i // 26) + "x" + chr(97 + i % 26)
    docs = [(i, f"{'bad' if i % 2 else 'good'} word {name(i)}") for i in range(80)] + [(100, "good " * 200_000 + "bad"), (101, "b a d " * 50_000), (102, "good"), (102, "good"), (None, "bad")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    found = [(r["doc_id"], r["score"]) for r in toxicity.scores(d, lab).collect()]
    assert len(found) == len(docs) and len({s for i, s in found if i == 102}) == 1 and all(0 <= s <= 1 for _, s in found)
    assert len({s for i, s in found if i is not None and i < 80 and i % 2}) == 1 and dict(found)[1] > 0.3 > dict(found)[0]
    assert toxicity.stretches("a" * 150) == ["a" * 64, "a" * 64, "a" * 64, "a" * 54] and toxicity.stretches("a" * 64) == ["a" * 64]


def test_held_out_accuracy(spark):
    """On rows whose labels weren't learnt: few at this size, so the bounds are wide."""
    sf = "/root/testdata/sf0.01"
    found = toxicity.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").toPandas()
    bad, good = found[found.toxic == 1], found[found.toxic == 0]
    rank = found.score.rank()
    auc = (rank[found.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert len(bad) >= 10 and auc > 0.9 and bad.predicted.mean() >= 0.5 and good.predicted.mean() <= 0.03, (auc, bad.predicted.mean(), good.predicted.mean())


# -- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left <= ids and (len(left) > 0.5 * len(ids))
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    assert p.run(spark, SF).count() > 0


def test_pipeline_keeps_one_row_of_each_text(spark):
    """Rows repeated whole, ids with several texts, copies and near copies in any order, null ids: one row of a text stays."""
    import random

    import corpus_pipeline as p

    random.seed(6)
    prose = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e, f = (prose(80) for _ in range(6))
    rows = [(9, a), (5, b), (5, b), (7, a), (7, a), (7, c), (3, c), (6, d + " "), (6, d), (6, d + " "), (None, e), (None, e), (None, f), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").coalesce(1)
    want = [(7, a), (5, b), (3, c), (6, d + " "), (None, e), (None, f)]
    for stages in (p.STAGES[1:2], p.STAGES[2:3], p.STAGES[1:4]):
        after = docs
        for _, stage in stages:
            after = stage(spark, after, SF)
        assert after.columns == docs.columns
        found = [(r["doc_id"], r["text"] or "") for r in after.collect()]
        blank = (lambda t: t) if stages[0][0] == "exact dedup" else str.strip  # near copies: either text of id 6
        assert sorted(((i, blank(t)) for i, t in found), key=str) == sorted([*((i, blank(t)) for i, t in want), (8, "")], key=str), [s[0] for s in stages]


def test_the_whole_run_against_brute_force(spark, tmp_path):
    """Copies, near copies, passages, odd rows and columns with clashing names through all stages; nothing is labelled."""
    import random

    import corpus_pipeline as p
    from tests.llm import test_texts as t

    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long_one = prose(60), prose(700)
    texts = [(3, long_one), (1, long_one), (1, long_one), (2, long_one + " "), (9, long_one + " end"), (4, prose(90) + "\n" + passage + " " + prose(40)), (5, passage + " " + prose(120)), (6, prose(300)), (None, prose(80)), (7, None), (8, ""), (10, prose(3000))]
    random.shuffle(texts)
    names = ["__starts", "__v", "__doc", "kept", "ident", "component_id", "row"]
    docs = spark.createDataFrame([(i, x, 0 if x is None else len(x), *range(len(names))) for i, x in texts], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (6, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    rows = [(i, x or "") for i, x in texts]
    chosen = {}
    for (i, x), (_, keep, *_) in zip(rows, t.owners_by_definition(rows), strict=True):  # the longest text of those with the kept id
        body = "".join(x.split())
        if i == keep and (body not in chosen or (-len(x), hashlib.sha256(x.encode()).digest()) < (-len(chosen[body][1]), hashlib.sha256(chosen[body][1].encode()).digest())):
            chosen[body] = (i, x)
    rows = list(chosen.values())
    near = t.near_by_definition(rows)
    groups = t.groups_of([f for _, f, _ in near])
    first = {}
    for (i, x), (_, f, component) in zip(rows, near, strict=True):
        if i == component:
            key = (f - (1 << 64) if f >> 63 else f, hashlib.sha256(x.encode()).digest())
            if groups[f] not in first or key < first[groups[f]][0]:
                first[groups[f]] = (key, i, x)
    rows = [(i, x) for _, i, x in first.values()]
    raw = [x.encode() for _, x in rows]
    out = []
    for (i, _), x, gone in zip(rows, raw, t.removed_by_hashes(raw, p.repeats.PASSAGE), strict=True):
        edges = np.nonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))[0].reshape(-1, 2).tolist()
        out.append((i, p.repeats.kept_bytes(x, [(a, b) for a, b in edges if p.repeats.whole_words(x, a, b) > p.repeats.PASSAGE_WORDS]).decode()))
    assert sum(len(x) for _, x in out) < sum(map(len, raw)) - 600 and len(out) == 7
    before = p.STAGES[0][1](spark, docs, str(tmp_path))
    assert before.columns == docs.columns and before.count() == docs.count()
    t.check_packing([tuple(r) for r in p.run(spark, str(tmp_path)).collect()], out)
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(empty + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(empty + "/labels.parquet")
    assert p.run(spark, empty).collect() == []
