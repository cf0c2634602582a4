"""Periodic runs, SimHash links and vector codes against brute force, and their queries on whole small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("barline.llm")
from barline.llm import periodic_runs as pr  # noqa: E402
from barline.llm import queries as qs  # noqa: E402
from barline.llm import simhash_dedup as sh  # noqa: E402
from barline.llm import vector_codes as vc  # noqa: E402
from barline.llm.common import Scratch  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # lags ascend: the smallest period stays
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text, tails):
    w = WORD.findall(text or "")
    if tails and w and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def repetitive(r, n):
    """Words with stretches that repeat, some inside others."""
    w = []
    while len(w) < n:
        part = [r.choice("abcdefgh") for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
        w += (part * r.randint(1, 7))[: r.randint(1, 90)]
        if r.random() < 0.3:
            w += w[-r.randint(1, 40) :] * r.randint(1, 5)
    return w[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_texts(seed):
    r = random.Random(seed)
    texts = [repetitive(r, r.randint(0, 400)) for _ in range(60)] + [["x"] * 500, ["x", "y"] * 300, [], ["x"] * 5, ["x"] * 6, list("ab" * 4 + "c")]
    ids = [np.array([ord(c) for c in t], np.int64) for t in texts]
    want = [brute_runs(t) for t in texts]
    assert pr.runs_of_many(ids) == want
    assert [pr.runs_of(x) for x in ids] == want
    for x, w in zip(ids, want):
        parts = [run for low, high in pr.lag_ranges(len(x), 5) if low <= high for run in pr.runs_of(x, low, high)]
        assert sorted(parts, key=lambda t: (t[0], t[2])) == w


def test_lags_are_each_in_one_range():
    for n in (0, 5, 6, 7, 50, 1000, 99_999):
        for parts in (1, 3, 12):
            got = [q for low, high in pr.lag_ranges(n, parts) for q in range(low, high + 1)]
            assert got == list(range(1, pr.longest_lag(n) + 1))


def test_long_repetitive_text_is_fast():
    ids = np.tile(np.arange(3, dtype=np.int64), 200_000)
    assert pr.runs_of(ids) == [(0, 600_000, 3)]
    assert pr.runs_of(ids, 1000, 5000) == []


def run_rows():
    r = random.Random(3)
    rows = [(i, " ".join(repetitive(r, r.randint(1, 200)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (None, "a b " * 9), (103, "ä ö " * 8), (103, "ä ö " * 8), (104, "x\x0by\x0cx\ry\nx\ty x y"), (105, "one two")]
    rows += [(200 + i, " ".join(repetitive(r, 3000))) for i in range(4)] + [(200, " ".join(repetitive(r, 3000)))] * 2
    return rows


@pytest.mark.parametrize("long", [pr.LONG, 2000])
def test_run_digests_by_brute_force(spark, long):
    rows = run_rows()
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, key string, runs int")
    got = sorted(map(str, pr.periodic_runs(docs, tails=True, long=long).collect()))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(str(spark_row(i, brute_document(i, t, True), names)) for i, t in rows)
    assert got == want


def spark_row(doc_id, values, names):
    from pyspark.sql import Row

    return Row(doc_id=doc_id, **dict(zip(names, values)))


def test_run_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = qs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:2] == ["doc_id", "n_runs"] and got.count() == 0
    got = qs.op12_simhash_pigeonhole(spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


# --- SimHash


def brute_fingerprint(text, size=3):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORD.findall(text or "")]
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps, reach):
    """The least index reachable by links of all pairs."""
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ np.uint64(f)) <= reach):
            root[find(f)] = find(distinct[int(j)])
    return [find(f) for f in fps]


def test_fingerprints_of_texts(monkeypatch):
    r = random.Random(5)
    texts = [None, "", "  \n", "One", "ONE two", "one two three", "ÄÖ x Y ", *[" ".join(r.choice(["ab", "Cd", "é", "x y", "zz"]) for _ in range(r.randint(1, 900))) for _ in range(40)]]
    want = [brute_fingerprint(t) for t in texts]
    assert sh.fingerprints(pa.array(texts)).tolist() == want
    monkeypatch.setattr("barline.llm.words.STRETCH", 50)
    monkeypatch.setattr(sh, "AT_ONCE", 100)
    assert sh.fingerprints(pa.array(texts)).tolist() == want


def near_fingerprints(r, n, clusters):
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(clusters):
        base = r.getrandbits(64)
        for _ in range(40):
            out.append(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    low = r.getrandbits(40) << 24
    return out + [low | r.getrandbits(9) for _ in range(300)] + [0, 1, 3, (1 << 64) - 1, (1 << 64) - 4]


@pytest.mark.parametrize("partitions, hot", [(4, sh.HOT), (3, sh.HOT), (2, sh.HOT), (1, sh.HOT), (5, sh.HOT), (4, 3), (2, 3), (None, 20)])
def test_links_by_brute_force(spark, partitions, hot):
    from barline.llm.components import components

    fps = sorted(set(near_fingerprints(random.Random(11), 700, 12)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark)
    edges = sh.links(nodes, scratch, 2, hot, partitions).collect()
    assert all((e.u ^ e.v).bit_count() <= 2 or ((e.u ^ e.v) & ((1 << 64) - 1)).bit_count() <= 2 for e in edges)
    named = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = {}
    for f, c in zip(fps, brute_components(fps, 2)):
        groups.setdefault(c, set()).add(signed(f))
    got = {}
    for f in map(signed, fps):
        got.setdefault(named.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_thresholds_are_enough():
    """Thresholds always add up to the reach, and leave out the partition of the most candidates."""

    class Told:
        groups, reach = [list(range(16 * i, 16 * i + 16)) for i in range(4)], 2

        def within(self, fps, i):
            return np.tile([[1e6, 2e6, 3e6]] if i == 2 else [[5.0, 80.0, 900.0]], (len(fps), 1))

    got = sh.thresholds(np.zeros(3, np.uint64), Told())
    assert (got == [[0, 0, -1, 0]] * 3).all()


@pytest.mark.parametrize("reach", [1, 0, 3])
def test_odd_reaches_are_refused(spark, reach):
    with pytest.raises(ValueError):
        sh.links(spark.createDataFrame([(1,)], "fp long"), Scratch(spark), reach)


def test_near_duplicates_of_odd_rows(spark):
    texts = [(5, "a b c d e"), (3, "A b\nc d e "), (None, "a b c d e"), (9, None), (8, ""), (7, " "), (1, "q"), (1, "q"), (2, "z y x w " * 50), (None, "lonely words here")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, fp int, component string")
    got = {(r.doc_id, r.fingerprint): (r.component_id, r.kept) for r in sh.near_duplicates(docs).collect()}
    same = f"{brute_fingerprint('a b c d e'):016x}"
    assert got[5, same] == (3, False) and got[3, same] == (3, True) and got[None, same] == (3, False)
    assert got[9, "0" * 16] == got[8, "0" * 16] == (7, False) and got[7, "0" * 16] == (7, True)
    assert got[None, f"{brute_fingerprint('lonely words here'):016x}"] == (None, False)
    assert sh.near_duplicates(docs).count() == len(texts)


def test_simhash_query_by_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fps = [brute_fingerprint(t) for _, t in docs]
    least = {}
    for (i, _), c in zip(docs, brute_components(fps, 2)):
        least[c] = min(i, least.get(c, i))
    want = sorted((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(docs, fps, brute_components(fps, 2)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in qs.op12_simhash_pigeonhole(spark, small).collect()) == want


# --- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    coded = [(i, lab, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, lab in kept]
    digest = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    total = {}
    for _, lab, c in coded:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in c)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), total[lab], digest) for i, lab, c in coded)


def vector_rows(n, dims, spread=1.0):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, spread, dims)).tolist(), int(i % 4)) for i in range(n, 0, -1)]
    rows += [(1, rows[5][1], None), (1, rows[5][1], None), (None, rows[3][1], None), (0, None, 1), (-1, [None, *rows[0][1][1:]], 1), (-2, [float("nan"), *rows[0][1][1:]], 2), (-3, [float("inf"), *rows[0][1][1:]], 2)]
    return rows + [(n + 5, rows[0][1], None), (n + 6, [0.5] * dims, 9), (n + 7, [0.5] * dims, 9)]


@pytest.mark.parametrize("n, dims, spread", [(330, 8, 0.3), (20, 4, 0.01), (300, 12, 40.0)])
def test_codes_by_brute_force(spark, monkeypatch, n, dims, spread):
    rows = vector_rows(n, dims, spread)
    vectors = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    tell = lambda: sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.compress(vectors).collect())
    want = brute_codes(rows)
    assert tell() == want
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0)
    assert tell() == want


def test_bounds_hold_and_ties_take_the_lower_entry():
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(-50, 50, (60, 6)), rng.integers(-50, 50, (4, 6)).repeat(3, axis=0)])
    parts = np.concatenate([rng.integers(-70, 70, (900, 6)), entries[60:]])
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    file = vc.VaFile(entries)
    lower, upper = file._bounds(parts)
    assert (lower.T <= exact).all() and (exact <= upper.T).all()
    code, error = file.nearest(parts)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def test_no_vectors_and_too_large_ones(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vc.compress(spark.createDataFrame([], kind)).collect() == []
    assert vc.compress(spark.createDataFrame([(1, [], 0), (2, None, 0), (3, [1.0, 2.0, 3.0], 0)], kind)).collect() == []
    with pytest.raises(Exception, match="63 bits"):
        vc.compress(spark.createDataFrame([(1, [1e38, 0.0, 0.0, 0.0], 0)], kind)).collect()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_vector_codes"])
def test_queries_agree_with_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(qs.oracle_sql()[name]).df()
    got = qs.queries()[name](spark, small).toPandas()[list(want.columns)]
    rows = lambda f: sorted(str([None if x != x else x for x in r]) for r in f.astype(object).where(f.notna(), None).itertuples(index=False))
    assert [r.replace(".0", "") for r in rows(got)] == [r.replace(".0", "") for r in rows(want)]
