"""Near-dedup, line dedup and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("barline.llm")
from pyspark.sql import functions as F  # noqa: E402

from barline.llm import decontamination as dc  # noqa: E402
from barline.llm import line_dedup as ld  # noqa: E402
from barline.llm import minhash_dedup as md  # noqa: E402
from barline.llm.components import components  # noqa: E402

VOCABULARY = ["".join(p) for p in __import__("itertools").product("bdfgk", "aeio", "lmnr")]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts():
    r = random.Random(7)
    texts = [None, "", " \n", "one", "one two three", "ONE two three", "one", prose(3000, r)]
    for _ in range(12):
        base = prose(r.randint(20, 120), r).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            texts.append(" ".join(w))
    shared = prose(60, r)  # a passage that many documents share, most of them too little else
    texts += [f"{shared} {prose(r.randint(8, 50), r)}" for _ in range(60)]
    return texts


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1030)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())) == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(md, "BLOCK", block)
    texts = near_texts()
    root, sizes = brute_components(texts, 4, 80)
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, node int").repartition(5)
    out = {r.doc_id: r for r in md.near_duplicates(df, 4, 80).collect()}
    assert [out[i].component_id for i in range(len(texts))] == root
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    assert all(out[i].kept == (i == root[i]) for i in out)


def test_keep_first(spark):
    text = prose(50, random.Random(3))
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, None, "c"), (None, text, "d"), (2, text + " more", "e"), (7, "", "f"), (8, "", "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first string")
    out = md.keep_first(df, 5, 80)
    assert out.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == sorted([(2, text[:3]), (9, ""), (7, ""), (8, "")])
    assert md.near_duplicates(df.where("false")).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_and_keys():
    r = random.Random(2)
    a, b = [], []
    for _ in range(1500):
        x = "".join(r.choice("abé") for _ in range(r.randint(0, 14)))
        y = list(x)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = [r.choice("abc")] * r.randint(0, 1)
        a.append(x)
        b.append("".join(y))
    exact = np.array([distance(x, y) for x, y in zip(a, b)])
    for k in range(4):
        assert (ld.within(a, b, np.full(len(a), k)) == (exact <= k)).all()
    for x, y in zip(a, b):
        if x != y and min(len(x), len(y)) >= 6 and distance(x, y) <= 2:
            s, t = sorted((x, y), key=len)
            assert set(ld.keys_of(s, 2)[0]) & set(ld.keys_of(t, 2)[1])


@pytest.mark.parametrize("words", [1, 2, 3])
def test_bands_of_several_words(words):
    r = random.Random(words)
    a, b = [], []
    for _ in range(150):
        x = "".join(r.choice("abcdé") for _ in range(r.choice([0, 1, 20, 31, 32, 33, 63, 64, 65, 100, 160])))
        y = list(x)
        for _ in range(r.choice([0, 1, 5, 20, 31, 33, 64, 70])):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 1)] = [r.choice("abcf")] * r.randint(0, 1)
        a.append(x)
        b.append("".join(y))
    exact = np.array([distance(x, y) for x, y in zip(a, b)])
    for off in (-1, 0, 1, 7):
        most = np.clip(exact + off, 0, 32 * words - 1)
        assert (ld.within(a, b, most, words) == (exact <= most)).all()
    assert ld.linked(a, b, 2).tolist() == [d <= ld.allowed(min(len(x), len(y)), 2) for x, y, d in zip(a, b, exact.tolist())]


@pytest.mark.parametrize("block", [1024, 2])
def test_line_dedup_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ld, "BLOCK", block)
    r = random.Random(9)
    base = [prose(12, r) for _ in range(15)]
    lines = []
    for _ in range(150):
        line = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(line))
            line[i : i + r.randint(0, 1)] = [r.choice("xyzé")] * r.randint(0, 1)
        lines.append("".join(line))
    texts = ["\n".join(r.choice([*lines, "short", ""]) for _ in range(r.randint(0, 6))) for _ in range(80)] + [None, "", "\n\n"]
    got = {row.doc_id: row for row in ld.dedup_lines(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, line string").repartition(4)).collect()}
    known, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted({x for t in texts for x in (t or "").split("\n") if len(x) >= ld.MIN_CHARS})
    root = {x: x for x in distinct}
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                a, b = find(x), find(y)
                root[a] = b
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            c = find(x) if x in root else None
            if c is None or c not in known:
                kept.append(x)
            if c is not None:
                known.setdefault(c, i)
        assert (got[i].text or "") == "\n".join(kept), i


def brute_dedup(texts, least, linked):
    """Texts without later lines of a class; ``least``: characters of a line that takes part."""
    distinct = sorted({x for t in texts for x in (t or "").split("\n") if len(x) >= least})
    root, known, out = {x: x for x in distinct}, {}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if linked(x, y):
                root[find(x)] = find(y)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        out.append("\n".join(x for x in lines if x not in root or known.setdefault(find(x), (i, x)) == (i, x) and lines.count(x) == 1))
    return out


def edited(line, r, most):
    """``line`` with about ``most`` characters changed, by words or by single characters."""
    out = list(line)
    while most > 0:
        n = r.choice([1, 1, min(4, most)])
        i = r.randrange(len(out) - n)
        out[i : i + n] = r.choice([[], [r.choice("xyzé ") for _ in range(n)]])
        most -= n
    return "".join(out)


def test_long_lines_brute_force(spark):
    r = random.Random(4)
    lines = []
    for words in (16, 20, 24, 25, 26, 30, 60, 75, 110, 220):  # of 4 characters: both sides of LONG, and lines that share 51 words and more
        base = prose(words, r)
        lines += [base, *(edited(base, r, round(len(base) * share)) for share in (0.02, 0.03, 0.045, 0.05, 0.07))]
    passage = prose(55, r)
    lines += [f"{passage} {prose(12, r)}", f"{passage} {prose(12, r)}", f"{passage[:-3]}{passage[-1]}"]
    dashes = ["-" * 150, "-" * 152, "-" * 70 + "=" + "-" * 80]  # no anchors
    lines += dashes
    r.shuffle(lines)
    assert len(set(lines)) == len(lines)
    most = lambda x, y: max(2, min(len(x), len(y)) // 20)
    linked = lambda x, y: abs(len(x) - len(y)) <= most(x, y) and distance(x, y) <= most(x, y)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    got = {row.doc_id: row.text for row in ld.dedup_lines(df).collect()}
    assert [got[i] for i in range(len(lines))] == brute_dedup(lines, 40, linked)
    assert 10 < sum(not got[i] for i in got) < len(lines) - 10


def test_short_lines(spark):
    line = prose(20, random.Random(8))
    texts = [f"All rights reserved.\n{line}\n\n", f"other\nAll rights reserved.\n \n{line}", "All rights reserved!\n\n ", "All rights reserved.", None, "other\nother"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {row.doc_id: row for row in ld.dedup_lines(df, short_lines=True).collect()}
    assert [got[i].text for i in range(6)] == [texts[0], "other\n ", texts[2], "", None, ""]
    assert [got[i]["__n_dropped"] for i in range(6)] == [0, 2, 0, 1, 0, 2] and not any(got[i]["__n_linked"] for i in got)
    assert list(got[1]["__first_docs"]) == [0] and list(got[5]["__first_docs"]) == [1]


def test_op7_drops_short_lines(spark, tmp_path):
    from barline.llm.queries import op7_line_edit_dedup

    spark.createDataFrame([(i, "one line\nAll rights reserved." if i else "All rights reserved.") for i in range(3)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {row.doc_id: row.n_dropped for row in op7_line_edit_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 2}


def test_edits_within():
    r = random.Random(6)
    for _ in range(400):
        x = "".join(r.choice("abé") for _ in range(r.randint(0, 90)))
        y = edited(x, r, r.randint(0, 9)) if len(x) > 8 else x + "b"
        d = distance(x, y)
        assert [ld.edits_within(x, y, k) for k in range(14)] == [d <= k for k in range(14)]


def test_line_dedup_edges(spark):
    line = prose(20, random.Random(1))
    rows = [(1, line), (1, line), (2, line), (None, line), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [(r.doc_id, r.text, r["__n_dropped"]) for r in ld.dedup_lines(df).collect()]
    assert len(out) == 5 and sum(n for *_, n in out) == 3 and (3, None, 0) in out
    assert ld.dedup_lines(df.where("false")).count() == 0


def brute_contaminated(text, items, window, most):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    out = []
    for i, item in enumerate(items):
        w = [x for x in re.split(r"[\W_]+", item.lower()) if x]
        span = min(window, len(w))
        hit = False
        for shift in range(-len(w), len(words)):
            same = [0 <= shift + k < len(words) and words[shift + k] == x for k, x in enumerate(w)]
            hit = hit or any(sum(same[k : k + span]) >= span - most for k in range(len(w) - span + 1))
        if hit and len(w) >= 13:
            out.append(i)
    return out


def test_decontamination_brute_force(spark):
    r = random.Random(11)
    items = [prose(r.randint(13, 40), r) for _ in range(12)]
    texts = [None, "", "short"]
    for k in range(60):
        words = prose(r.randint(5, 80), r).split()
        if k % 2:
            passage = r.choice(items).split()
            low = r.randint(0, max(0, len(passage) - 13))
            passage = passage[low : low + r.randint(9, 40)]
            for _ in range(r.randint(0, 3)):
                passage[r.randrange(len(passage))] = r.choice(VOCABULARY)
            at = r.randrange(len(words))
            words[at:at] = passage
        texts.append(" ".join(words).capitalize().replace(" b", ", b"))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate([*texts, texts[-1]])], "doc_id bigint, text string, hash string, k1 int")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "tiny item")], "item_id bigint, text string")
    out = {row.doc_id: row for row in dc.decontaminate(df, bench).collect()}
    for i, t in enumerate(texts):
        assert list(out[i]["item_ids"]) == brute_contaminated(t, items, 13, 2), (i, t)
    assert len(out) == len(texts) + 1 and all(row.kept != row.contaminated for row in out.values())
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(row.kept for row in out.values())
    assert dc.decontaminate(df.where("false"), bench).count() == 0
    assert dc.decontaminate(df, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_short_items(spark):
    r = random.Random(12)
    items = [prose(n, r) for n in (*range(1, 15), 8, 8, 9, 10, 11, 12)]
    texts = []
    for item in items:
        words = item.split()
        for changes in ([], [0], [len(words) - 1], [0, len(words) // 2], *[r.sample(range(len(words)), min(k, len(words))) for k in (1, 2, 2, 2, 3)]):
            w = list(words)
            for i in changes:
                w[i] = "zzz"
            texts.append(f"{prose(r.randint(0, 9), r)} {' '.join(w)} {prose(r.randint(0, 9), r)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {row.doc_id: list(row["item_ids"]) for row in dc.decontaminate(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}

    def hits(text, item):
        w, words = item.split(), text.split()
        span = min(13, len(w))
        for shift in range(-len(w), len(words)):
            same = [0 <= shift + k < len(words) and words[shift + k] == x for k, x in enumerate(w)]
            if any(sum(same[k : k + span]) >= span - (2 if span >= 8 else 0) for k in range(len(w) - span + 1)):
                return True
        return False

    for i, t in enumerate(texts):
        assert out[i] == [k for k, item in enumerate(items) if hits(t, item)], (i, t)


def test_shuffled_join_agrees(spark, monkeypatch):
    r = random.Random(5)
    items = [prose(20, r) for _ in range(5)]
    df = spark.createDataFrame([(i, f"{prose(10, r)} {items[i % 5] if i % 2 else ''} {prose(5, r)}") for i in range(30)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = lambda: sorted((x.doc_id, tuple(x["item_ids"])) for x in dc.decontaminate(df, bench).collect())
    small = rows()
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    assert rows() == small and sum(bool(x[1]) for x in small) == 15


def test_pipeline_stages(spark, small):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, kept, small).cache()
        assert after.columns == docs.columns, name
        assert after.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= kept.count()
        kept = after
    packed = cp.STAGES[-1][1](spark, kept, small)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
