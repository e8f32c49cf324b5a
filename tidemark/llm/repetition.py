"""Repetition rules from suffix arrays (operator 5)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map

#: Characters that end words, and those counted as symbols: fixed values.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the words from it on that also stand elsewhere in its own text.

    words: the ids of several texts, one after another, where equal ids in different texts already differ; ends: for each place the end
    of its text. The suffix array comes from prefix doubling that sorts only the suffixes not yet told apart; the levels give the longest
    common prefix of neighbours, and the larger of a suffix's two is the depth of its deepest interval.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    first = np.r_[True, sorted_words[1:] != sorted_words[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    open_ = order[~(first & np.r_[first[1:], True])]  # in order of rank
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < ends[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        base = rank[open_]
        new_group = np.r_[True, base[1:] != base[:-1]]
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        first = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[open_] = base + np.maximum.accumulate(np.where(first, at, 0)) - start
        levels.append(rank)
        step *= 2
        open_ = open_[~(first & np.r_[first[1:], True])]
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1].copy(), array[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        ok = (a < n) & (b < n)
        ok[ok] = r[a[ok]] == r[b[ok]]
        lcp[ok] += 1 << level
        a[ok] += 1 << level
        b[ok] += 1 << level
    out[array[:-1]] = lcp
    out[array[1:]] = np.maximum(out[array[1:]], lcp)
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a span [i, i + lengths[i]) of at least `least`."""
    n = len(lengths)
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + lengths[at], -1)
    return np.cumsum(marks[:-1]) > 0


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def measure(texts: list[str], least_repeat: int, max_fraction: float, max_longest: int) -> list[tuple]:
    """The columns of COLUMNS for each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    stops = np.cumsum(sizes)
    depth = longest_repeats(doc * (len(number) + 1) + ids, stops[doc])
    # a three-word window found twice; the most that can reach over a text's end is cut by its end in `depth`
    windows = covered(np.where(depth >= 3, 3, 0), 3)
    spans = covered(depth, least_repeat)
    of = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    repeat_words, span_words = of(windows), of(spans)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, depth)
    out = []
    for i, t in enumerate(texts):
        n, r, c, m = int(sizes[i]), int(repeat_words[i]), int(span_words[i]), int(longest[i])
        failed = n < 50 or 100 * r > 50 * n
        kept = not failed and c <= max_fraction * n and m <= max_longest
        out.append((n, len(t) - sum(t.count(x) for x in BLANKS), sum(t.count(x) for x in SYMBOLS), duplicate_lines(t), r, failed, kept, c, m))
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_repeat: int = 8, max_fraction: float = 0.4, max_longest: int = 100, group_words: int = 200_000) -> DataFrame:
    """Per row of docs its counts, base_failed, and kept: false if base_failed, or if repeats of least_repeat or more words cover over
    max_fraction of the words, or if the longest repeat within the text has over max_longest words.

    Words are the symbols of the suffix array, and a repeat stands twice or more in one text. Null and empty texts have no words and fail the base;
    repeated rows give repeated results; an empty table gives none; other columns are ignored. Row by row, without a shuffle; texts are taken in
    groups of about group_words words, so memory is bounded by a group or the longest text.
    """
    schema = f"{id_col} long, {COLUMNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in schema.split(", ")]
        for b in batches:
            ids, texts, held = [], [], 0
            for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                t = text.as_py() or ""
                ids.append(i)
                texts.append(t)
                held += len(t) // 6
                if held >= group_words or k == b.num_rows - 1:
                    cols = [ids, *zip(*measure(texts, least_repeat, max_fraction, max_longest))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=names)
                    ids, texts, held = [], [], 0

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")), run, schema)
