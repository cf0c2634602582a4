"""Token ids by the tokenizers library, with a memory of chunks that were encoded before.

Both supported kinds of tokenizer cut a text at single blanks before anything
else can join across them, so the ids of a text are those of its chunks in
order. A worker keeps the ids of chunks it has met (bounded) and asks the library
only for new ones. Texts that hold a control string or unusual white space, and
tokenizers of other kinds, are given to the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs

#: Chunks that one worker remembers at most, bytes of text that are encoded at once, and new chunks that the library is given at once.
CACHE, AT_ONCE, ASKED = 300_000, 2_000_000, 20_000
#: Characters beyond ASCII's six that some library counts as white space, and the mark that parts chunks here.
_ODD = "\x00\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts in which a line end or blank stands beside another one, at an end, or other white space stands anywhere.
_IRREGULAR = f"^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c{_ODD}]"


def _one_word(c: str) -> bool:
    """Whether each library counts ``c`` as one word of letters, in any normal form and case: of the first blocks of Unicode, so any version knows them."""
    return c.isalpha() and (c.isascii() or (max(c) < "\u0250" and c.lower().isalpha() and unicodedata.is_normalized("NFC", c)))


class CachedEncoder:
    """encode(texts): all ids of an array of texts and where each text's ids begin."""

    def __init__(self, source: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if "://" in source:
            fs, path = pyarrow.fs.FileSystem.from_uri(source)
            with fs.open_input_stream(path) as f:
                raw = f.read().decode()
        else:
            with open(source, encoding="utf-8") as f:
                raw = f.read()
        self.tokenizer = Tokenizer.from_str(raw)
        spec = json.loads(raw)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = self._kind(spec)
        tokens = [t for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.word_end = np.array([t.endswith("</w>") for t in tokens])
        self.word_begin = np.array([t.startswith("\u0120") for t in tokens])  # the byte-level form of a blank
        self.limit = cache
        self._forget()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout"):
            return "whole"
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            return "blank"  # a word keeps the blank before it
        steps = pre.get("pretokenizers") or []
        if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("use_regex", True) and model.get("end_of_word_suffix") == "</w>":
            return "word"  # white space and the case of letters go
        return "whole"

    def _forget(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.begin, self.size, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat = np.zeros(4096, "<u4")

    def _keep(self, words: list[str]) -> None:
        """Forgets all but these: chunks that were met again are met once more, most others never."""
        ids, lengths = self._gather(np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words)))
        self._forget()
        self._put(words, ids, lengths)

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Gives each word a slot with its ids, which lie one after the other in ``ids``."""
        first, n = len(self.slot), len(words)
        while first + n > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.size, self.size * 0])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = lengths
        self.begin[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.slot.update(zip(words, range(first, first + n), strict=True))

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in ``slots`` one after the other, and their numbers."""
        lengths = self.size[slots]
        ends = np.cumsum(lengths)
        where = np.repeat(self.begin[slots] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[where], lengths

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        lengths = np.array([len(f) for f in found], np.int64)
        return np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of some texts at a time, in order: text k has ids[offsets[k]:offsets[k + 1]]; null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
            yield self._some(texts.slice(low, high - low))
            low = high

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            ids, lengths = self._whole(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        odd = pc.match_substring_regex(texts, f"[{_ODD}]" if self.kind == "word" else _IRREGULAR)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s, ignore_case=True))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.kind == "word":
            parts = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        else:
            parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        units = parts.flatten().dictionary_encode()
        slots = self._slots(units.dictionary.to_pylist())[units.indices.to_numpy()]
        ids, lengths = self._gather(slots)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if not odd.any():
            return ids, offsets
        more, numbers = self._whole(texts.filter(pa.array(odd)).to_pylist())
        sizes = np.diff(offsets)
        sizes[odd] = numbers
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(total[-1], "<u4")
        from_odd = np.repeat(odd, sizes)
        out[from_odd], out[~from_odd] = more, ids
        return out, total

    def _slots(self, words: list[str]) -> np.ndarray:
        missing = [w for w in words if w not in self.slot]
        if len(self.slot) + 2 * len(missing) > self.limit:
            self._keep([w for w in words if w and w in self.slot])
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _learn(self, missing: list[str]) -> None:
        """New words; those of letters and a tail of marks are put together from their two parts.

        Words that are told apart in the ids (by their end, or by the blank that they begin with) are asked for as one text.
        """
        slot = self.slot
        two: list[str] = []
        bodies: list[str] = []
        ask: dict[str, None] = {}
        for c in missing:
            body = c.rstrip(".,;:!?%&$*#|")
            if body and len(body) < len(c) and body.lstrip(" ").lower().isalpha():
                two.append(c)
                bodies.append(body)
                if body not in slot:
                    ask[body] = None
                if c[len(body) :] not in slot:
                    ask[c[len(body) :]] = None
            else:
                ask[c] = None
        plain = [c for c in ask if (_one_word(c) if self.kind == "word" else c[0] == " " and len(c) > 1)]
        for low in range(0, len(plain), ASKED):
            some = plain[low : low + ASKED]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.kind == "word" else "").join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1 if self.kind == "word" else np.append(np.flatnonzero(self.word_begin[ids])[1:], len(ids))
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._put(some, ids, np.diff(ends, prepend=0))
        rest = [c for c in ask if c not in slot]
        for low in range(0, len(rest), ASKED):
            some = rest[low : low + ASKED]
            self._put(some, *self._whole(some))
        if two:
            pairs = np.fromiter(chain.from_iterable((slot[b], slot[c[len(b) :]]) for c, b in zip(two, bodies, strict=True)), np.int64, 2 * len(two))
            ids, lengths = self._gather(pairs)
            self._put(two, ids, lengths.reshape(-1, 2).sum(axis=1))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(source: str) -> CachedEncoder:
    """The worker's encoder for a tokenizer file, kept over its tasks."""
    if source not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[source] = CachedEncoder(source)
    return _ENCODERS[source]


def forget() -> None:
    """Drops the worker's encoders."""
    _ENCODERS.clear()
