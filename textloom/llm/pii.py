"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 8).

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping per kind, each
match kept or dropped by its own rule. The random field adds what the patterns miss, such as addresses
written with "at" and "dot", national phone numbers, or card numbers with other separators: it scores
whole candidate segments (digits, groups, separators, checksum, words around) around places with digits
or address signs, and dynamic programming over segments of at most ``MAX_TOKENS`` tokens chooses
boundaries and kinds jointly. Segments that touch a base span are not added.

The field learns by likelihood on at most ``TRAIN_DOCS`` documents that hold base spans, shared out evenly
among the kinds; of each at most ``TRAIN_SPANS`` spans of its kind, drawn over the whole text. The spans are
also rewritten into the forms the patterns miss, with addresses and groupings made up at random, and set against numbers of the same shapes that
something else announces (part, order and reference numbers, ISBNs); it needs no labels. The sample is fixed by a hash of the
text. A kind without a base span anywhere can't be learnt, which is reported as a warning.

Offsets are code points, ends exclusive. Null texts are empty, very long ones are taken whole. Of segmentations
with equal scores the one with fewer entities, then the kind and segment found first, is taken. Repeated rows each get their row; an empty
table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
TRAIN_DOCS = 300
#: Spans of a kind that one document of the sample gives, drawn by a hash of their place.
TRAIN_SPANS = 8
#: Characters around a trigger that the field looks at.
AROUND = 48
Span = tuple[str, int, int]
#: A kind, the text around one of its spans, and the base spans in it, that span first.
Context = tuple[str, str, list[Span]]

#: The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """All that start earliest before an @: a local part can hold no @, so each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By kind as in ``KINDS``, then by start."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"[0-9]{3,}|@|[0-9][ ().-]{1,2}[0-9]{2,}|[(\[{]\s?at\s?[)\]}]|\b(?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT)\b")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_NUMERIC_SIGNS = frozenset("+-.() /")
_ADDRESS_SIGNS = frozenset("@.-_+%()[]{}")


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, merged where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


#: A host's parts: labels, with hyphens, between dots.
_HOST = re.compile(r"w(?:-w)*(?:\.w(?:-w)*)+")


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def candidates(text: str, toks: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[tuple[str, tuple[str, ...]]]]]]:
    """By end token (exclusive): the segments that may be an entity, with the features of each kind."""
    words = [text[a:b] for a, b in toks]
    numeric = [w[0].isdigit() or w in _NUMERIC_SIGNS for w in words]
    address = [w.isalnum() or w in _ADDRESS_SIGNS for w in words]
    ats = [i for i, w in enumerate(words) if w == "@" or w.lower() == "at"]
    out: dict[int, list] = defaultdict(list)
    for i, w in enumerate(words):
        if w[0].isdigit() or w in "+(":
            digits = 0
            for j in range(i, min(i + MAX_TOKENS, len(words))):
                if not numeric[j] or (j > i and toks[j][0] - toks[j - 1][1] > 1):
                    break
                if words[j][0].isdigit():
                    digits += len(words[j])
                    if 7 <= digits <= 22 or (digits >= 4 and j - i == 6):
                        out[j + 1].append((i, _number_features(text, toks, i, j + 1)))
    for at in ats:
        for i in range(max(0, at - 6), at):
            if words[i].isalnum() and all(address[i:at]) and all(toks[k + 1][0] == toks[k][1] for k in range(i, at - 2)):
                host = ""
                for j in range(at + 1, min(at + 18, len(words))):
                    if not address[j]:
                        break
                    w = words[j]
                    if w.isalnum() and w.lower() != "dot":  # letters and digits that touch are one label
                        host += "" if host[-1:] == "w" and toks[j][0] == toks[j - 1][1] else "w"
                    else:
                        host += "" if w in "()[]{}" else "." if w == "." or w.lower() == "dot" else "-"
                    if w.isalnum() and _HOST.fullmatch(host):
                        out[j + 1].append((i, [("email", _address_features(text, toks, words, i, at, j + 1))]))
    return out


def _goes_on(sign: str, further: str) -> bool:
    """Whether a word goes on: with the sign beside, or behind a dot or hyphen."""
    return sign.isalnum() or sign in ".-" and further.isalnum()


def _left_word(text: str, at: int) -> str:
    m = re.search(r"([^\W\d_]+)[\s:=#.]*$", text[max(0, at - 24) : at])
    return m[1].lower() if m else ""


#: How many rewritten forms of a span the field learns from.
REWRITES = {"email": 4, "ip": 1, "card": 1, "phone": 4}
#: Words that announce a kind.
_CUES = {"phone", "tel", "call", "mobile", "fax", "card", "visa", "credit", "account", "ip", "host", "server", "address", "email", "mail", "contact", "telefon", "téléphone", "teléfono", "token", "key", "id", "order", "version"} | {
    "ref", "reference", "part", "no", "nr", "number", "invoice", "isbn", "tracking", "serial", "sku", "article", "item", "case", "ticket", "batch", "lot", "parcel",
}


#: What those words say of a number.
_TOLD = {w: "call" for w in ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")} | {
    w: "count" for w in ("token", "key", "id", "order", "version", "ref", "reference", "part", "no", "nr", "number", "invoice", "isbn", "tracking", "serial", "sku", "article", "item", "case", "ticket", "batch", "lot", "parcel")
}


def _number_features(text, toks, i, j) -> list[tuple[str, tuple[str, ...]]]:
    a, b = toks[i][0], toks[j - 1][1]
    span = text[a:b]
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    digits = _digits(span)
    left, right = text[a - 1 : a], text[b : b + 1]
    cue = _left_word(text, a)
    shape = "-".join(map(str, groups)) if len(groups) < 6 else "many"
    signs = "".join(sorted(set(re.sub("[0-9]", "", span))))
    beyond = bool(re.search(r"[0-9][ ./-]$", text[max(0, a - 2) : a]) or re.match(r"[ ./-][0-9]", text[b : b + 2]))  # the sequence goes on
    octets = len(groups) == 4 and signs == "." and all(int(g) <= 255 for g in span.split(".") if g)
    common = ("bias", f"n={_bucket(len(digits))}", f"groups={len(groups)}", f"shape={shape}", f"signs={signs}", f"plus={span[0] == '+'}", f"open={span.count('(') == span.count(')')}", f"cut={_goes_on(left, text[a - 2 : a - 1] if a > 1 else '') or _goes_on(right, text[b + 1 : b + 2])}", f"cue={cue if cue in _CUES else ''}", f"told={_TOLD.get(cue, '')}", f"beyond={beyond}", f"trunk={digits[:1] == '0'}", f"year={len(digits) == 8 and digits[:2] in ('19', '20')}")
    return [("ip", (*common, f"octets={octets}")), ("card", (*common, f"luhn={luhn(digits)}", f"size={13 <= len(digits) <= 19}")), ("phone", (*common, f"size={9 <= len(digits) <= 15}"))]


def _address_features(text, toks, words, i, at, j) -> tuple[str, ...]:
    host = [w for w in words[at + 1 : j] if w not in "()[]{}"]
    is_dot = [w == "." or w.lower() == "dot" for w in host]
    spelled = words[at] != "@"
    ends = words[j - 1]
    right = text[toks[j - 1][1] : toks[j - 1][1] + 1]
    shut = all(words[i:j].count(x) == words[i:j].count(y) for x, y in ("()", "[]", "{}"))
    return (
        "bias", f"after_dot={min(next((k for k, d in enumerate(reversed(is_dot)) if d), 9), 9)}", f"local={min(at - i, 5)}", f"spelled={spelled}", f"dots={min(sum(is_dot), 3)}", f"bracketed={spelled and at > 0 and words[at - 1] in '([{'}", f"tld={2 <= len(ends) <= 6 and ends.isalpha()}", f"dot_word={any(w.lower() == 'dot' for w in host)}",
        f"alternate={all(d == bool(k % 2) for k, d in enumerate(is_dot))}", f"shut={shut}", f"cut={right == '@' or _goes_on(right, text[toks[j - 1][1] + 1 : toks[j - 1][1] + 2])}", f"goes_on={bool(re.match(r'(?: dot |[ ]?[(\[{]dot[)\]}]|[.])[A-Za-z]', text[toks[j - 1][1] : toks[j - 1][1] + 8], re.IGNORECASE))}",
        f"from_start={i == 0 or toks[i][0] > toks[i - 1][1]}", f"cue={cue if (cue := _left_word(text, toks[i][0])) in _CUES else ''}",
    )


class Field:
    """Weights by (kind, feature). A token outside entities scores 0, so entity scores are odds against it."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = {} if weights is None else weights

    def score(self, kind: str, feats: tuple[str, ...]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in feats)

    def best(self, n: int, segments: dict) -> list[tuple[str, int, int]]:
        """The likeliest segmentation of n tokens: (kind, first, end) of its entities."""
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kinds in segments.get(j, ()):
                for kind, feats in kinds:
                    s = best[i] + self.score(kind, feats)
                    if s > best[j]:
                        best[j], back[j] = s, (kind, i)
        out, j = [], n
        while j > 0:
            if back[j]:
                out.append((back[j][0], back[j][1], j))
                j = back[j][1]
            else:
                j -= 1
        return out[::-1]

    def expected(self, n: int, segments: dict) -> list[tuple[float, str, tuple[str, ...], int, int]]:
        """Each entity segment's probability, by the forward and backward sums over all segmentations."""
        items = [(i, j, kind, feats, self.score(kind, feats)) for j, x in segments.items() for i, kinds in x for kind, feats in kinds]
        by_end, by_start = defaultdict(list), defaultdict(list)
        for i, j, _, _, s in items:
            by_end[j].append((i, s))
            by_start[i].append((j, s))
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, s in by_end[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + s for j, s in by_start[i])])
        return [(float(np.exp(ahead[i] + s + behind[j] - ahead[n])), kind, feats, i, j) for i, j, kind, feats, s in items]


def _word(rng: np.random.Generator, low: int = 3, high: int = 9) -> str:
    return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(low, high))))


def _pick(rng: np.random.Generator, some):
    return some[int(rng.integers(len(some)))]


def _address(rng: np.random.Generator) -> tuple[str, str]:
    """Local part and host of an address like those that people have."""
    local = _pick(rng, (_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}_{_word(rng)}", f"{_word(rng)}{int(rng.integers(1, 99))}", f"{_word(rng, 1, 2)}.{_word(rng)}", f"{_word(rng)}-{_word(rng)}"))
    labels = [_word(rng, 2, 10) for _ in range(int(rng.integers(1, 3)))]
    return local, ".".join([*labels, _pick(rng, ("com", "org", "net", "edu", "de", "fr", "io", "info", "co.uk", "com.br"))])


#: How an address is spelt: what stands for the @, and for dots of its host.
_AT_FORMS = (" at ", " AT ", " (at) ", " [at] ", "(at)", "[at]", " {at} ")
_DOT_FORMS = (" dot ", " DOT ", " (dot) ", " [dot] ", "(dot)", "[dot]")


def rewritten(kind: str, value: str, rng: np.random.Generator) -> str | None:
    """A base value, or one made up in its place, in a form that the patterns miss."""
    digits = _digits(value)
    if kind == "email":
        local, host = value.rsplit("@", 1) if rng.integers(2) else _address(rng)
        at = _pick(rng, _AT_FORMS)
        # without brackets a plain dot is too little to tell an address
        dot = _pick(rng, _DOT_FORMS[:2] if at.strip(" ").isalpha() else (*_DOT_FORMS, ".", "."))
        return local + at + host.replace(".", dot)
    if kind == "phone" and len(digits) >= 10:
        d = digits[-10:]
        n = d.lstrip("0") or d
        forms = (
            f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"0{n[:2]}/{n[2:9]}", f"0{n[:3]}/{n[3:9]}", f"0{n[:3]} {n[3:10]}", f"0{n[:4]}-{n[4:9]}",
            f"(0{n[:2]}) {n[2:6]} {n[6:9]}", f"00{n[:2]} {n[2:4]} {n[4:]}", f"00{n[:2]}-{n[2:5]}-{n[5:]}", f"0{n[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}", f"0{n[:3]} {d[3:5]} {d[5:7]} {d[7:9]}",
        )
        return _pick(rng, forms)
    if kind == "card" and len(digits) == 16:
        return ".".join(digits[k : k + 4] for k in range(0, 16, 4))
    return None


#: What announces a number that is no phone, and what stands before one (a word that says nothing too).
_COUNTED = ("Part no. ", "Ref ", "Ref. ", "Order ", "order no. ", "Invoice ", "ISBN ", "Tracking ", "Serial ", "SKU ", "Case ", "Ticket #", "Lot ", "article nr. ", "Item ")
_CALLED = ("", "or ", "and ", "then ", "with ", "Tel. ", "Tel: ", "phone ", "Phone: ", "call ", "mobile ", "Fax ")


def _counted(rng: np.random.Generator) -> str:
    """A number of a phone's length and shape that something else is known by."""
    d = "".join(map(str, rng.integers(0, 10, 13)))
    shape = _pick(rng, (f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"{d[:3]}.{d[3:6]}.{d[6:10]}", f"{d[:3]} {d[3:6]} {d[6:10]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[:10]}", f"{d[:4]} {d[4:8]} {d[8:12]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}-{d[10:12]}", f"{d[:2]}/{d[2:9]}", f"0{d[:3]} {d[3:10]}"))
    return _pick(rng, _COUNTED) + shape


def contexts(text: str, base: list[Span], kind: str, most: int = TRAIN_SPANS) -> list[Context]:
    """Spans of the kind from anywhere in the text, with what lies around them. No base span is cut at an edge."""
    out = []
    for _, a, b in heapq.nsmallest(most, (s for s in base if s[0] == kind), key=lambda s: (zlib.crc32(f"{s[1]}:{s[2]}".encode()), s)):
        near = [s for s in base if a - AROUND < s[2] <= a or b <= s[1] < b + AROUND]
        lo = max([0, a - AROUND, *(s[2] for s in near if s[1] < a - AROUND)])
        hi = min([len(text), b + AROUND, *(s[1] for s in near if s[2] > b + AROUND)])
        inside = [(kind, a, b), *(s for s in near if lo <= s[1] and s[2] <= hi)]
        out.append((kind, text[lo:hi], [(k, x - lo, y - lo) for k, x, y in inside]))
    return out


def _examples(context: Context, rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Short texts with their true spans: as found, rewritten, and with the entity spoilt."""
    kind, text, [(_, a, b), *others] = context
    left, value, right = text[:a], text[a:b], text[b:]

    def put(middle: str, entity: bool = False) -> tuple[str, list[Span]]:
        grown = len(middle) - len(value)
        spans = [(k, x, y) if y <= a else (k, x + grown, y + grown) for k, x, y in others]
        return left + middle + right, spans + [(kind, a, b + grown)] * entity

    out = [put(value, True)]
    for _ in range(REWRITES[kind]):
        if other := rewritten(kind, value, rng):
            cue = _pick(rng, _CALLED) if kind == "phone" else ""
            text, spans = put(cue + other, True)
            out.append((text, [*spans[:-1], (kind, a + len(cue), a + len(cue) + len(other))]))
    if kind == "phone":
        out += [put(_counted(rng)) for _ in range(3)]
    if kind == "card":  # a number that fails its checksum is no card
        spoilt = value[:-1] + str((int(value[-1]) + 1 + int(rng.integers(8))) % 10)
        if not luhn(_digits(spoilt)):
            out.append(put(spoilt))
    if kind == "ip":
        out.append(put("999." + value.partition(".")[2]))
        out.append(put(f"version {int(rng.integers(9))}.{int(rng.integers(20))}.{int(rng.integers(99))} of 20{int(rng.integers(10, 30))}-01-{int(rng.integers(10, 28))}"))
    out.append(put("".join(map(str, rng.integers(0, 10, int(rng.integers(5, 12)))))))
    return out


def learn(texts: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """The field of the base spans of the texts."""
    return learn_contexts([c for text in texts for base in [base_spans(text)] for kind in KINDS for c in contexts(text, base, kind)], epochs, rate, decay)


def learn_contexts(found: list[Context], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Likelihood ascent over the examples of the spans."""
    rng = np.random.default_rng(5)
    data = []
    for context in found:
        for sample, spans in _examples(context, rng):
            toks = tokens_of(sample, 0, len(sample))
            segments = candidates(sample, toks)
            truth = {(k, a, b) for k, a, b in spans}
            data.append((len(toks), segments, {(kind, i, j) for j, x in segments.items() for i, kinds in x for kind, _ in kinds if (kind, toks[i][0], toks[j - 1][1]) in truth}))
    field = Field(defaultdict(float))
    for epoch in range(epochs):
        for at in rng.permutation(len(data)):
            n, segments, truth = data[at]
            step = rate / (1 + 0.3 * epoch)
            for p, kind, feats, i, j in field.expected(n, segments):
                gap = ((kind, i, j) in truth) - p
                if abs(gap) > 1e-3:
                    for f in feats:
                        field.weights[(kind, f)] += step * (gap - decay * field.weights[(kind, f)])
    if not data:  # nothing to learn from: nothing is added
        field.weights = {}
    return Field({k: round(v, 6) for k, v in field.weights.items()})


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    if not field.weights:
        return []
    out = []
    for lo, hi in windows(text):
        toks = tokens_of(text, lo, hi)
        segments = candidates(text, toks)
        out += [(kind, toks[i][0], toks[j - 1][1]) for kind, i, j in (field.best(len(toks), segments) if segments else [])]
    if not out:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
    free = lambda a, b: not (k := int(np.searchsorted(starts, b))) or reach[k - 1] <= a
    return [x for x in out if free(x[1], x[2])]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _shares(sizes: list[int], most: int) -> list[int]:
    """An even part of ``most`` for each; what small ones leave goes to the others."""
    out, left = [0] * len(sizes), most
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - n))
        left -= out[i]
    return out


def sampled(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> dict[str, list[list[Context]]]:
    """By kind, the contexts of each document of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's documents of least hash, by kind: (-hash, contexts)
        least: dict[str, list[tuple[int, str]]] = {kind: [] for kind in KINDS}
        held: dict[str, set[int]] = {kind: set() for kind in KINDS}
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                base = base_spans(text)
                for kind in {k for k, _, _ in base}:
                    heap = least[kind]
                    if h in held[kind] or (len(heap) == max_docs and -h <= heap[0][0]):
                        continue
                    item = (-h, json.dumps(contexts(text, base, kind)))
                    held[kind].add(h)
                    if len(heap) < max_docs:
                        heapq.heappush(heap, item)
                    else:
                        held[kind].discard(-heapq.heapreplace(heap, item)[0])
        rows = [(kind, -h, found) for kind in KINDS for h, found in least[kind]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["kind", "h", "found"])

    text = F.col("text").cast("string")
    # by a hash of the text, so that the sample doesn't depend on ids or on the order of rows
    some = docs.filter(text.rlike("@|[0-9]")).select(F.xxhash64(text).alias("h"), text.alias("text"))
    # copies in several tasks are one document
    rows = materialize(some.mapInArrow(run, "kind string, h long, found string"), "pii-sample").groupBy("kind", "h").agg(F.min("found").alias("found"))
    by_kind = [[r["found"] for r in rows.filter(F.col("kind") == kind).orderBy("h").limit(max_docs).collect()] for kind in KINDS]
    return {kind: [[(k, t, [tuple(s) for s in spans]) for k, t, spans in json.loads(x)] for x in found[:n]] for kind, found, n in zip(KINDS, by_kind, _shares([len(x) for x in by_kind], max_docs))}


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Field:
    sample = sampled(docs, max_docs)
    if absent := [kind for kind, found in sample.items() if not found]:
        warnings.warn(f"no document holds a base span of kind {', '.join(absent)}: the field adds no such span", stacklevel=2)
    return learn_contexts([c for found in sample.values() for x in found for c in x])


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, base_sha256, spans, n_added, has_pii (whether any span was found)."""
    model = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = np.zeros((batch.num_rows, len(KINDS)), dtype=np.int64), [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[i, KINDS.index(kind)] += 1
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                more = added_spans(text, base, model)
                spans.append(spans_text(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array([bool(x) for x in spans])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "has_pii"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, has_pii boolean")
