"""New words go to the tokenizers library many at a time, with the ids that it gives each text as a whole."""

import pytest

pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402

from barline.llm.fast_tokens import CachedEncoder  # noqa: E402

WORDS = ["été", "ouéaieux", "Èonai", "İstanbul", "ŉa", "été", "naïve,", "don't", "a_b", "x1", "日本語", "ﬁn", "ẞa", "Straße.", "plain", "Word", "ǆ", "ʼn"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_asked_for_together(name):
    code = CachedEncoder(public_tokenizers.path(name))
    asked, plain = [], code.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    code.tokenizer = Counting()
    letters = "abcdefghijklmnopqrstuvwxyzàâçéèêîôûüß"
    many = [letters[i % 37] + letters[i // 37 % 37] + "é" + letters[i * 7 % 37] for i in range(1369)]
    texts = [" ".join(["start", *WORDS, *many]), "Start " + " ".join(reversed(WORDS)), "\n".join(WORDS)]
    (ids, offsets), = code.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memory_of_new_words_is_bounded(name, monkeypatch):
    monkeypatch.setattr("barline.llm.fast_tokens.ASKED", 50, raising=False)
    monkeypatch.setattr("barline.llm.fast_tokens.AT_ONCE", 4000)
    code = CachedEncoder(public_tokenizers.path(name), cache=1500)
    calls, plain = [], code.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **more):
            calls.append(sum(len(t.split()) for t in texts))
            return plain.encode_batch_fast(texts, **more)

    code.tokenizer = Counting()
    texts = [" ".join(["always", "x1", *(f"{k}a{i}" for i in range(300))]) for k in range(12)]
    got = [ids[a:b].tolist() for ids, offsets in code.encode(pa.array(texts)) for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(calls) <= 50  # not all new words of a part at once
    assert len(code.slot) <= 1500
    blank = "" if code.kind == "word" else " "
    assert blank + "x1" in code.slot  # met in every part, so it was kept
