"""Quality rules with suffix-array repetition (operator 11).

Every text gets the plain counts (characters, symbols, repeated lines) by DataFrame functions, and a suffix
array over its words: suffixes are grouped by their first two words, then four, eight and so on, only groups
of several going on, until all suffixes stand apart. Neighbours' longest common prefixes follow from the
groups of each step. Intervals of common prefixes whose words before differ are the maximal repeated
substrings; the union of their spans is what repetition covers. A text that passes the plain rules is kept if its repeats of
``min_repeat`` words or more cover at most ``max_covered`` of its words and none is longer than
``max_repeat`` words.

Texts of a batch share one array: words of different texts never count as equal, so nothing repeats across texts.
A task holds about ``WORDS_AT_ONCE`` words at a time, or one text if that is longer; arrays take some 12 bytes for a
word and 4 for each doubling that its longest repeat needs.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and wordless texts have no words and fail; very long texts are taken
whole. Overlapping repeats (``a a a``) count each word once. Repeated rows each get their row, an empty table
gives none. Other columns are ignored, or kept whatever their names by ``keep_varied``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

WORDS_AT_ONCE = 1 << 20
BYTES_AT_ONCE = 1 << 22

_BLANK = "[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    #: repeats of so many words or more count as repeated passages
    min_repeat: int = 8
    #: in percent of a text's words
    max_covered_percent: int = 30
    max_repeat: int = 200


RULES = Rules()


def suffix_groups(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the words ``codes``, and for each place the common prefix with the place before.

    ``ends`` has, for each word, where its text ends; suffixes end there. Equal words of two texts differ. The order of
    words is that of their codes, text by text.
    """
    n = len(codes)
    start = np.arange(n, dtype=np.int64)
    width = int(codes.max(initial=0)) + 2
    following = np.where(start + 1 < ends, codes[np.minimum(start + 1, n - 1)] + 1, 0)
    # texts have distinct ends, so (text, word, next word) sorts by the first two words inside each text
    text = np.cumsum(np.concatenate(([0], (ends[1:] != ends[:-1]).astype(np.int64)))) if n else start
    if n and width * width * int(text[-1] + 1) < 1 << 62:
        key = (text * width + codes) * width + following
        order = np.argsort(key, kind="stable")
        changes = key[order[1:]] != key[order[:-1]]
    else:
        order = np.lexsort((following, codes, text))
        changes = (following[order[1:]] != following[order[:-1]]) | (codes[order[1:]] != codes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    fresh = np.concatenate(([True], changes)) if n else np.zeros(0, dtype=bool)
    group = np.maximum.accumulate(np.where(fresh, start, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    ranks = [codes, rank]  # by the power of two whose words they tell apart
    step = 2
    while True:
        again = np.flatnonzero(~fresh)
        if not len(again):
            break
        # places of groups with several suffixes; a suffix that ends here comes first, and there is one at most
        places = np.union1d(again, group[again])
        at = order[places]
        on = at + step
        second = np.where(on < ends[at], rank[np.minimum(on, n - 1)] + 1, 0)
        sort = np.lexsort((second, group[places]))
        at, second, own = at[sort], second[sort], group[places][sort]
        order[places] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        fresh[places] = new
        own = np.maximum.accumulate(np.where(new, places, 0))
        group[places] = own
        rank = rank.copy()
        rank[at] = own
        ranks.append(rank)
        step *= 2
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        # neighbours of one text: the longest steps first, each that agrees moves both on
        pair = np.flatnonzero(text[order[1:]] == text[order[:-1]]) + 1
        left, right, shared = order[pair - 1], order[pair], np.zeros(len(pair), dtype=np.int64)
        for power in range(len(ranks) - 1, -1, -1):
            a, b = left + shared, right + shared
            whole = (a + (1 << power) <= ends[left]) & (b + (1 << power) <= ends[right])
            a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
            shared += np.where(whole & (ranks[power][a] == ranks[power][b]), 1 << power, 0)
        common[pair] = shared
    return order, common


def maximal_repeats(order: np.ndarray, common: np.ndarray, codes: np.ndarray, begins: np.ndarray, at_least: int) -> list[tuple[int, int, int]]:
    """(words, first place, last place) in the suffix array of every maximal repeated substring of ``at_least`` words.

    Intervals of common prefixes, left to right with a stack; one counts if the words before its suffixes differ (the
    start of a text, given by ``begins``, differs from all).
    """
    long = np.flatnonzero(common >= at_least)
    if not len(long):
        return []
    before = np.where(order > begins[order], codes[np.maximum(order - 1, 0)], -1)
    differs = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    out = []
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1):
        stack: list[tuple[int, int]] = []  # (common prefix, first place)
        for place, value in zip([*run.tolist(), int(run[-1]) + 1], [*common[run].tolist(), 0]):
            first = place - 1
            while stack and stack[-1][0] > value:
                words, first = stack.pop()
                if differs[place - 1] > differs[first]:
                    out.append((words, first, place - 1))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, first))
    return out


def covered(spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which words lie in a span [place, place + length)."""
    n = len(lengths)
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, spans, 1)
    np.add.at(marks, spans + lengths[spans], -1)
    return np.cumsum(marks[:-1]) > 0


def repetition(texts: pa.Array, window: int, min_repeat: int) -> tuple[np.ndarray, ...]:
    """Per text: words, words in repeated windows, words in maximal repeats, longest repeat, number of maximal repeats."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words = pc.list_flatten(lists)
    real = pc.not_equal(words, "")  # a wordless text splits into one empty word
    parent = pc.list_parent_indices(lists).filter(real).to_numpy()
    codes = pc.dictionary_encode(words.filter(real)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(parent, minlength=len(texts)).astype(np.int64)
    stops = np.cumsum(n_words)
    ends, begins = stops[parent], (stops - n_words)[parent]
    order, common = suffix_groups(codes, ends)
    longest = np.zeros(len(codes), dtype=np.int64)  # the longest repeat that starts at each word
    if len(codes):
        longest[order] = np.maximum(common, np.append(common[1:], 0))
    per_text = lambda mask: np.bincount(parent[mask], minlength=len(texts)).astype(np.int64)
    in_windows = per_text(covered(np.flatnonzero(longest >= window), np.full(len(codes), window, dtype=np.int64)))
    in_repeats = per_text(covered(np.flatnonzero(longest >= min_repeat), longest))
    peak = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(peak, parent, longest)
    repeats = np.zeros(len(texts), dtype=np.int64)
    for _, first, _ in maximal_repeats(order, common, codes, begins, min_repeat):
        repeats[parent[order[first]]] += 1
    return n_words, in_windows, in_repeats, peak, repeats


_COLUMNS = ("n_words", "n_repeat_words", "n_covered_words", "longest_repeat", "n_repeats")


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches with about BYTES_AT_ONCE bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > BYTES_AT_ONCE:
            yield start, i - start
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes) - start


def counts(docs: DataFrame, rules: Rules = RULES, *carried: Column) -> DataFrame:
    """doc_id, word_chars, n_symbols, n_dup_lines and the suffix array's counts of every row of ``docs``, and ``carried`` columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]")))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carried)
    kept = [c for c in held.columns if c != "text"]
    rows = held.select(
        *kept, F.length(F.regexp_replace("text", _BLANK + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), "text",
    )
    kept = [c for c in rows.columns if c != "text"]
    window, min_repeat = rules.window, rules.min_repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in _pieces(batch.column("text")):
                part = batch.slice(start, n)
                found = repetition(part.column("text"), window, min_repeat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, found)], names=[*kept, *_COLUMNS])

    schema = StructType([*rows.select(*kept).schema.fields, *(StructField(c, LongType()) for c in _COLUMNS)])
    return rows.mapInArrow(run, schema)


def _judged(rows: DataFrame, rules: Rules) -> DataFrame:
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_window_percent * F.col("n_words"))
    varied = (100 * F.col("n_covered_words") <= rules.max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= rules.max_repeat)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & varied)


def quality_rules(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed`` and ``kept``."""
    return _judged(counts(docs, rules), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat", "n_repeats")


def keep_varied(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with all their columns; nothing shuffles."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return _judged(counts(docs, rules, row), rules).filter("kept").select("row.*")
