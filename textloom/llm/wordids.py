"""Token ids of whole texts by a tokenizer file, with words memoised where the file's rules allow it.

Where a tokenizer drops white space and never looks across it (``WORD_RULES``, read from the file), the ids
of a text are the ids of its pieces between spaces and line ends, in order, and a piece needs encoding once
per worker. New pieces that are letters only are encoded together, many to a call: each ends in one token
with the word's end mark, so the ids of a call fall apart into words there. Other pieces, and the whole
texts of any other tokenizer, are encoded one by one. All ids come from the tokenizers library alone.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

#: Entries a worker remembers before it forgets all; the ids are the same, only found again.
MEMO_ENTRIES = 1_000_000
#: A longer piece is encoded each time.
MEMO_CHARS = 64
#: Words encoded in one call.
WORDS_A_CALL = 1000

#: The normaliser and pre-tokenizer under which no token spans white space, and runs of
#: letters, single digits and runs of other signs are encoded apart.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordMemo(dict):
    """piece -> its ids as little-endian ``uint16``/``uint32`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.waiting: list[str] = []
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())
        end = rules["model"].get("end_of_word_suffix")
        self.by_words = all(rules[k] == v for k, v in WORD_RULES.items()) and rules["post_processor"] is None and bool(end) and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        if self.by_words:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True
            self.plain = frozenset(c for c in map(chr, range(0x600)) if c.isalpha() and self._one_run(c))
            self.tails = {sign: self._encode(sign) for sign in ".,"}

    def _one_run(self, letter: str) -> bool:
        """Whether the letter is one run with the letters beside it, lower-cased alike anywhere (a dotted capital I or a capital sigma isn't)."""
        inside, last = f"a{letter}a", f"a{letter}"
        normal = self.tokenizer.normalizer.normalize_str
        alike = normal(inside) == inside.lower() and normal(last) == last.lower()
        return alike and normal(inside).isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(normal(inside))) == 1

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _encode(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters."""
        out, calls = [], [words[k : k + WORDS_A_CALL] for k in range(0, len(words), WORDS_A_CALL)]
        for some, encoding in zip(calls, self.tokenizer.encode_batch_fast([" ".join(some) for some in calls], add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype=self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer's words don't end where its rules say")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode these pieces and remember those that aren't long. A plain letter and a sign after it are never in one run."""
        plain, tails, letters_only = self.plain, self.tails, self.plain.issuperset
        stems, signs, words, others = [], [], set(), set()
        for piece in pieces:
            sign = piece[-1:]
            if sign in tails and piece[-2:-1] in plain:
                stem = piece[:-1]
                signs.append(tails[sign])
            else:
                stem = piece
                signs.append(b"")
            if letters_only(stem):
                stem = stem.lower()
                if stem and stem not in self:
                    words.add(stem)
            elif stem not in self:
                others.add(stem)
            stems.append(stem)
        words, others, out = list(words), list(others), {}
        own = dict(zip(words, self._encode_words(words)))
        self.update((w, ids) for w, ids in own.items() if len(w) <= MEMO_CHARS)
        own.update(zip(others, (self._bytes(x.ids) for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False))))
        for piece, stem, sign in zip(pieces, stems, signs):
            out[piece] = (own[stem] if stem in own else self[stem] if stem else b"") + sign
        self.update((p, ids) for p, ids in out.items() if len(p) <= MEMO_CHARS)
        return out

    def __missing__(self, piece: str) -> None:
        self.waiting.append(piece)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_words:
            return [self._encode(t) for t in texts]
        if len(self) > MEMO_ENTRIES:
            self.clear()
        self.waiting, waiting, found = [], [], []
        for text in texts:
            found.append(list(map(self.__getitem__, text.replace("\n", " ").split(" "))))
            waiting.append(self.waiting)
            self.waiting = []
        fresh = self._learn(list(set(chain.from_iterable(waiting))))
        for ids, some in zip(found, waiting):
            at = -1
            for piece in some:
                at = ids.index(None, at + 1)
                ids[at] = fresh[piece]
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=4)
def memo(path: str) -> WordMemo:
    return WordMemo(path)
