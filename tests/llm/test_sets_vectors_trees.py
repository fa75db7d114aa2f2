"""Hard negatives, sketch classes and Merkle manifests against brute force and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coffer.llm import merkle, negatives, sketches
from coffer.llm.common import materialize
from coffer.llm.marks import Marks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECS = "vec_id long, label int, embedding array<float>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, every, low, keep=5):
    """Rows as the contract has them, each pair of id and score once."""
    valid = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        valid.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    anchors = {}
    for i, label, q in valid:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q), key=lambda a: (a[0], np.array(a[1]).tobytes()))
    out = set()
    for a, (label, q) in anchors.items():
        score = lambda v: sum(x * y for x, y in zip(q, v))
        same = sorted({(-score(v), i) for i, lab, v in valid if i != a and lab == label and len(v) == len(q)})[:keep]
        other = sorted({(-score(v), i) for i, lab, v in valid if i != a and lab != label and len(v) == len(q)})
        for p, pid in same:
            hits = [(s, i) for s, i in other if low * -p <= 100 * -s <= 100 * -p][:keep]
            out |= {(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def test_hard_negatives_match_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(700):
        label = int(r.integers(0, 4)) if i % 3 else 1  # one label holds a third
        v = (r.normal(size=12) + (label == 1)).tolist()
        rows.append((i, label, v))
    # equal rows and scores, short and zero vectors, oddities
    rows += [(701 + j, 2, rows[5][2]) for j in range(9)] + [(20, *rows[20][1:])] * 3 + [(33, 3, rows[34][2]), (40, 0, rows[41][2])]
    rows += [(900 + j, j % 2, [0.0] * 12) for j in range(12)] + [(1000 + j, j % 2, [1.0, 0.5 * j]) for j in range(11)]
    rows += [(None, 1, [1.0] * 12), (1100, None, [1.0] * 12), (1120, 1, None), (1140, 1, []), (1160, 1, [1.0] * 11 + [None]), (1180, 1, [1.0] * 11 + [float("nan")]),
             (1200, 1, [1.0] * 11 + [float("inf")]), (1220, 1, [1e30] * 12)]
    df = spark.createDataFrame(rows, VECS).repartition(5).withColumns({c: F.lit("mine") for c in ("id", "score", "q", "rank", "n")})
    got = {tuple(x) for x in negatives.mine(df, every=20).collect()}
    assert got == brute_negatives([x for x in rows if x[0] != 1220], 20, 80) and got


def test_vertical_scan_drops_candidates_early():
    r = np.random.default_rng(8)
    q = r.integers(-300, 300, size=(2000, 64))
    q[:, 3] *= 40
    block = negatives.Block(64, 2000, 8, np.arange(2000).tobytes(), np.zeros(2000, dtype=np.int64).tobytes(), np.ascontiguousarray(q.T).tobytes())
    vector = q[77]
    order = np.argsort(-np.abs(vector), kind="stable")
    scan = negatives.Scan(block, vector, order, 0, 2000)
    best = np.sort(q @ vector)[-5]
    left = []
    for lower, upper in scan.steps():
        assert (lower <= q[scan.rows()] @ vector).all() and (upper >= q[scan.rows()] @ vector).all()
        scan.keep(upper >= best)
        left.append(len(scan.score))
    assert left[0] < 2000 and left[-1] == 5
    assert negatives.scan_positives(block, (77, 0, vector, order), [], 5) == sorted((-int(q[i] @ vector), int(i)) for i in range(2000) if i != 77)[:5]


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECS)
    assert negatives.mine(none).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], VECS)).count() == 0  # no anchors
    assert negatives.mine(spark.createDataFrame([(100, 1, [1.0]), (2, 2, [1.0])], VECS)).count() == 0  # no positive


# ---------------------------------------------------------------- sketch classes

def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(sets, num, den):
    name = {d: d for d in sets}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if (both := len(sets[a] & sets[b])) and den * both >= num * (len(sets[a]) + len(sets[b]) - both)]
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(name[a], name[b])
            moved |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return name


@pytest.mark.parametrize("seed, k, num, den", [(1, 3, 85, 100), (4, 5, 4, 5)])
def test_sketch_classes_match_brute_force(spark, seed, k, num, den):
    r = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(40))  # a passage that most texts hold
    base = [[f"w{r.randrange(500)}" for _ in range(n)] for n in (5, 12, 17, 30, 62, 66, 150, 800)]
    rows = []
    for i in range(320):
        w = list(base[i % len(base)])
        for _ in range(r.randrange(0, 2 + len(w) // 14)):
            w[r.randrange(len(w))] = f"z{r.randrange(40)}"
        if r.random() < 0.2:
            w = w[: int(len(w) * r.uniform(0.8, 1))]
        rows.append((i, " ".join(w) + (" " + common if i % 16 < 8 else "")))
    rows += [(400, None), (401, ""), (402, "one"), (403, "One"), (404, "  \t ")] + [(500 + i, rows[7][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("fp", "n", "token", "label", "host")})
    got = {x.doc_id: x for x in sketches.near_duplicates(docs, k, num, den).collect()}
    sets = {d: shingles(t, k) for d, t in rows}
    assert {d: x.n_shingles for d, x in got.items()} == {d: len(s) for d, s in sets.items()}
    want = brute_classes(sets, num, den)
    assert {d: x.component_id for d, x in got.items()} == want
    assert all(x.kept == (d == want[d]) for d, x in got.items())


def test_least_overlap_is_rarely_undercut():
    r = np.random.default_rng(1)
    for k in (sketches.PROBE, sketches.SKETCH):
        m = sketches.least_overlap(k, 85, 100)
        assert 0 < m < 0.85 * k and (r.binomial(k, 0.85, 1_000_000) >= m).all()


def test_sketch_classes_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y " * 30000, "en", None, None), (None, None, None, None, None),
            (4, "same words here again", "en", "b", 1), (5, "same words here again", "en", "c", 1), (5, "same words here again", "en", "c", 1)]
    got = collections.Counter((x.doc_id, x.component_id, x.kept) for x in sketches.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == {(1, 1, True): 1, (2, 2, True): 2, (None, None, True): 2, (4, 4, True): 1, (5, 4, False): 2}
    assert sketches.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_classes_of_rows_that_share_an_id(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(900)}" for _ in range(n)] for n in (9, 30, 70, 200)]
    rows = []
    for i in range(160):
        w = list(base[i % len(base)])
        for _ in range(r.randrange(0, 1 + len(w) // 14)):
            w[r.randrange(len(w))] = f"z{r.randrange(60)}"
        rows.append((None if i % 5 == 0 else i // 3 if i % 2 else 1000 + i, " ".join(w)))
    rows += rows[:40] + [(7, None), (7, "")]
    got = collections.Counter(tuple(x) for x in sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
                              .select("doc_id", "n_shingles", "component_id", "kept").collect())
    sets = {j: shingles(t, 3) for j, (_, t) in enumerate(rows)}
    members = collections.defaultdict(list)
    for j, c in brute_classes(sets, 85, 100).items():
        members[c].append(j)
    want = collections.Counter()
    for of in members.values():
        least = min((rows[j][0] for j in of if rows[j][0] is not None), default=None)
        want.update((rows[j][0], len(sets[j]), least, rows[j][0] == least) for j in of)
    assert got == want


def test_sketch_tables_hold_no_whole_sets_and_few_live_ones(spark, monkeypatch):
    r = random.Random(5)
    passages = [" ".join(f"p{i}.{j}" for j in range(14)) for i in range(12)]
    # a quarter of a text's shingles are in other texts too, no two texts are near each other, but for twenty
    rows = [(i, " ".join([f"u{i}.{j}" for j in range(110)] + r.sample(passages, 3))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{i % 10}.{j}" for j in range(400)) + f" end{i}") for i in range(20)]
    tables = {}

    def kept(df, name, **options):
        tables.setdefault(name, []).append(materialize(df, name, **options))
        return tables[name][-1]

    monkeypatch.setattr(sketches, "materialize", kept)
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert len({x.component_id for x in got}) == 310
    assert {f.dataType.typeName() for of in tables.values() for t in of for f in t.schema} <= {"long", "integer", "double", "boolean", "array"}
    for t in (t for of in tables.values() for t in of):
        for f in t.schema:
            if f.dataType.typeName() == "array":
                assert (t.agg(F.max(F.size(f.name))).first()[0] or 0) <= sketches.SKETCH
    assert 20 <= tables["sketch-live"][0].count() < 80


def test_marks_lose_no_id(spark):
    ids = materialize(spark.range(0, 90_000, 3).select(F.col("id").alias("of")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS of")), "ids")
    told = Marks(ids).tell(spark.range(100_000).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id")), F.col("id"), "hit")
    hit = {r.id for r in told.filter("hit").collect()}
    assert hit >= {None, *range(0, 90_000, 3)} and len(hit) < 45_000


# ---------------------------------------------------------------- Merkle manifests

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes, fanout):
    """(root, path of each node)"""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for j, p in enumerate(at):
            run = level[p // fanout * fanout: (p // fanout + 1) * fanout]
            paths[j].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1:])))
        level = [sha(*level[i: i + fanout]) for i in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


def brute_manifest(rows, fanout=16):
    by = collections.defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, low = {}, {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[s], low[s] = tree([leaf_of(r) for r in by[s]], fanout)
    root, high = tree([subs[s] for s in order], fanout)
    out = []
    for s, above in zip(order, high):
        for row, path in zip(by[s], low[s]):
            path, leaf = path + above, leaf_of(row)
            acc = leaf_of(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0)
            for left, right in path:
                acc = sha(left, acc, right)
            out.append((row[0], leaf, subs[s], root, sha(*[x for p in path for x in p]), acc, acc == root))
    return out


@pytest.mark.parametrize("fanout, sources", [(16, 20), (3, 40), (2, 1)])
def test_merkle_manifest_matches_brute_force(spark, fanout, sources):
    r = random.Random(fanout)
    # one source holds a third of the rows, several hold one
    pick = lambda: "hot" if r.random() < 0.33 else r.choice([None, "", "é", "Z", "z", *[f"s{i}" for i in range(sources)]])
    rows = [(r.randrange(2000), r.choice(["Abc É", "abc", "", None, "X" * 5000, "ß\n1:2"]), r.choice(["en", None]), pick() if sources > 1 else "a", r.choice([0, -5, None])) for _ in range(700)]
    rows += [(None, "T", None, "a", 1), (None, "T", None, "a", 1), (7, "Q", "en", "only", 1)] + [rows[0]] * 20
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({c: F.lit("mine") for c in ("tree", "leaf", "pos", "n", "digest", "c0", "who", "path", "one", "root")})
    got = [tuple(x) for x in merkle.verify(merkle.manifest(docs, fanout)).collect()]
    assert collections.Counter(got) == collections.Counter(brute_manifest(rows, fanout))
    assert {x[-1] for x in got} == {True, False}


def test_merkle_manifest_of_few_rows(spark):
    one = [(10, "Text", "en", "a", 4)]
    (got,) = merkle.verify(merkle.manifest(spark.createDataFrame(one, DOCS))).collect()
    assert tuple(got) == brute_manifest(one)[0] and got.root == got.leaf and got.proof_sha256 == sha("")
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame(one, DOCS), 1)
