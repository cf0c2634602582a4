"""run() of the pipeline against plain Python stages, on planted documents."""

import random

import pytest

pytest.importorskip("barline.llm")
cp = pytest.importorskip("corpus_pipeline")
from barline.llm.queries import tokenizer  # noqa: E402

VOCABULARY = ["".join(p) for p in __import__("itertools").product("bdfgk", "aeio", "lmnr", "aeiou")]
TOXIC = ["vile", "scum", "hateful", "idiot", "trash"]


def prose(n, r, words=VOCABULARY):
    return " ".join(r.choice(words) for _ in range(n))


def planted(r):
    """Documents (id, text), toxic ids and benchmark items."""
    docs = {i: "\n".join(prose(14, r) for _ in range(4)) for i in range(60)}
    toxic = set(range(40, 60))
    for i in toxic:
        docs[i] = "\n".join(prose(14, r, VOCABULARY[:40] + TOXIC * 12) for _ in range(4))
    docs[5] += "\n" + docs[2].split("\n")[1]  # a repeated line
    docs[6] += "\nAll rights reserved."
    docs[7] += "\nAll rights reserved."
    docs[8] = docs[3].split("\n")[0]  # loses all of its lines
    words = docs[9].split()  # a near copy, in other lines
    docs[10] = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    items = [prose(20, r), prose(9, r)]
    docs[11] += "\n" + f"{prose(3, r)} {items[0]} {prose(3, r)}"
    docs[12] += "\n" + f"{prose(3, r)} {items[1]} {prose(3, r)}"
    return docs, toxic, items


def test_run_on_planted_documents(spark, tmp_path):
    docs, toxic, items = planted(random.Random(13))
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t in docs.items() if i not in toxic}
    seen, lines = set(), {}
    for i, t in kept.items():
        out = [x for x in t.split("\n") if x not in seen and not seen.add(x)]
        if out:
            lines[i] = "\n".join(out)
    assert 8 not in lines and lines[5] != docs[5] and lines[7] != docs[7]
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in lines.items()}
    first = {i: t for i, t in lines.items() if not any(j < i and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]) for j in lines)}
    assert set(lines) - set(first) == {10}
    clean = {i: t for i, t in first.items() if not any(x in t for x in items)}
    assert set(first) - set(clean) == {11, 12}

    import tokenizers

    bpe = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {i: len(bpe.encode(t).ids) for i, t in clean.items()}
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(clean)
    got = {i: sum(r.length for r in rows if r.doc_id == i) for i in clean}
    assert all(got[i] - want[i] in (0, 1) for i in clean) and len({got[i] - want[i] for i in clean}) == 1  # the end mark, if any
    places = {}
    for r in rows:
        places.setdefault(r[next(c for c in r.asDict() if c in ("sequence", "sequence_id", "bin", "bin_id"))], []).append((r.offset, r.length))
    for mine in places.values():
        mine.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0 and sum(mine[-1]) <= 2048
