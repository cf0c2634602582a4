"""Quality, rules, chat, URL and toxicity operators: edge cases and small oracles."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("barline.llm")
from barline.llm import chat_format, quality_compression, quality_rules, queries, text_statistics, toxicity_chain, url_rules  # noqa: E402

HARD = [None, "", "   \n\n", "a", "The and of. " * 3000, "##$$ %% | " * 50, "x\ny\nx\n\nx", "É è\u00a0b\tc\x0bd\x0ce\r\nf"]
DOCS = "doc_id bigint, text string, lang string, score double, kept string"


def docs(spark, texts):
    """Rows with a null id, a repeated row and columns whose names operators use themselves."""
    rows = [(i, t, None, 9.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id at all", None, None, None)], DOCS)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(windows)
    marked = {j for i, w in enumerate(windows) if c[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(marked))


def test_statistics_brute_force(spark):
    random.seed(1)
    texts = HARD + ["".join(random.choice("ab \n#|é") for _ in range(random.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert text_statistics.statistics(t)[:5] == brute_statistics(t), repr(t)
    out = text_statistics.with_statistics(docs(spark, HARD)).collect()
    assert len(out) == len(HARD) + 2
    assert text_statistics.with_statistics(docs(spark, HARD).where("false")).count() == 0


def test_rules_learn_a_planted_list(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.learn_rules(x, bad, ["a", "b", "c"])
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality_rules.covers(r.conditions, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 0.1, 0.9), (None, None, None)], "a double, b double, c double")
    kept = [r[0] for r in df.select(quality_rules.keep_column(rules)).collect()]
    assert kept[:600] == [not h for h in hit] and kept[600:] == [False, True]
    assert quality_rules.learn_rules(x, np.zeros(600, bool), ["a", "b", "c"]) == []
    assert quality_rules.learn_rules(np.zeros((0, 3)), np.zeros(0, bool), ["a", "b", "c"]) == []


def test_compression_scores(spark):
    good = ["the cat and the dog walked to a house of stone, and it was late " * 2 + str(i) for i in range(60)]
    bad = [("BUY!! NOW!! CHEAP!! %d " % i) * 6 for i in range(60)]
    model = quality_compression.fit(good + bad, [1] * 60 + [0] * 60)
    out = {r.doc_id: r.score for r in quality_compression.score(docs(spark, [good[0], bad[0], None, "", "BUY!! " * 9000]), model, "text", ["doc_id"]).collect()}
    assert out[0] > 0.7 > 0.3 > out[1] and out[2] == out[3] and all(0 <= v <= 1 for v in out.values()) and None in out
    assert quality_compression.score(docs(spark, HARD), quality_compression.fit([], []), "text", ["doc_id"]).where("score <> 0.5").count() == 0


def test_quality_held_out(spark, small):
    rows = queries.op1_compression_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)


def test_chat_round_trip(spark):
    hard = ["", "plain", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|im_start|>", "<", "<|im_end|", "\\", "\n", "<|im_", "é" * 5]
    for role in ["user", "assistant", "", "a\nb", "a\\nb", "<|im_start|>", "<|im_end|>\n"]:
        for text in hard:
            rendered, low, high = chat_format.render_turn(role, text)
            assert [t[:2] for t in chat_format.parse(rendered)] == [(role, text)] and chat_format.unescape(rendered[low:high]) == text
    random.seed(4)
    for _ in range(500):
        text = "".join(random.choice(["<", "\\", "|", "im_", "start", "end", ">", "\n", "a"]) for _ in range(12))
        assert chat_format.parse(chat_format.render_turn("assistant", text)[0])[0][1] == text
    turns = [(c, i, "assistant" if i % 2 else "user", t) for c in range(3) for i, t in enumerate(hard)] + [(9, 0, None, None), (9, 0, None, None), (None, None, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert set(out) == {0, 1, 2, 9, None}
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns[: len(hard)]).encode()).hexdigest()
    loss = "".join(t for i, t in enumerate(hard) if i % 2)
    assert out[0].turns_sha256 == want and out[0].loss_chars == len(loss) and out[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert out[9].n_turns == 2 and out[9].loss_sha256 == hashlib.sha256(b"").hexdigest()
    whole = {r.conv_id: r.text for r in chat_format.assemble(chat_format.format_turns(df)).collect()}
    assert [t[1] for t in chat_format.parse(whole[1])] == hard and len(whole[1]) == out[1].formatted_chars
    assert chat_format.read_back(chat_format.format_turns(df.where("false"))).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://x.net/a", "https://A.Example.NET/en/1?q=1", "http://example.com/de/", "http://b.org/fr/x#y", "ftp://org/fr/", "http://evil.shop/win/12?ref=1", "http://good.shop/news/12", "http://q.net", "http://a.b?x://c/d"]
    mined_from = [(f"http://evil{i}.shop/win/{i}?ref=1", 1) for i in range(30)] + [(f"http://good{i}.shop/news/{i}", 0) for i in range(90)]
    rules = url_rules.mine_rules(spark.createDataFrame(mined_from, "url string, label int"))
    assert {t for r in rules.collect() for t in r.tokens} <= {"p:win", "q:ref"}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[3]])], "page_id bigint, url string, verdict string")
    out = {r.page_id: (r.host, r["path"], r["rule"], r.verdict) for r in url_rules.judge(pages, rules, queries.URL_RULES).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == out[12] == ("x.net", "/a", "net/", "block")
    assert out[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert out[5][2:] == ("example.com/de/", "block") and out[6] == ("b.org", "/fr/x", "org/fr/", "allow") and out[7][2] == "org/fr/"
    assert out[8][2:] == (None, "block") and out[9][2:] == (None, "allow") and out[11][:2] == ("a.b", "")
    none = url_rules.mine_rules(spark.createDataFrame([], "url string, label int"))
    assert none.count() == 0 and url_rules.judge(pages.where("false"), none, queries.URL_RULES).count() == 0


def test_toxicity_chain(spark):
    random.seed(2)
    clean = lambda: " ".join(random.choice("the of and to in that is was for it".split()) for _ in range(40))
    texts, toxic = [], []
    for i in range(300):
        t = clean()
        if i % 4 == 0:
            t += " " + " ".join(random.sample(["idiot,", "MORON", "scum!"] if i % 8 else ["crudelfa", "crudelbo", "crudelki"], 2))
        texts.append(t)
        toxic.append(int(i % 4 == 0))
    categories = toxicity_chain.mine_categories(texts, toxic)
    assert list(categories)[-1] == "toxic" and len(categories) >= 3
    chain = toxicity_chain.fit_chain(texts[:200], {k: v[:200] for k, v in categories.items()})
    held = [chain.probabilities(t)[-1] for t in texts[200:]]
    assert sum((p >= 0.3) == (y == 1) for p, y in zip(held, toxic[200:])) >= 98
    assert len(chain.links[-1]) == len(categories) - 1
    df = docs(spark, [*HARD, "you idiot, you moron"])
    out = toxicity_chain.score(df, chain, "text", ["doc_id"]).collect()
    assert len(out) == len(HARD) + 3 and all(0 <= r.p_toxic <= 1 for r in out)
    kept = toxicity_chain.keep_clean(df, chain, 0.3)
    assert kept.columns == df.columns and kept.count() == len(HARD) + 1
    empty = toxicity_chain.fit_chain([], {"toxic": []})
    assert empty.probabilities("anything")[-1] < 1e-6 and toxicity_chain.keep_clean(df.where("false"), empty, 0.3).count() == 0
