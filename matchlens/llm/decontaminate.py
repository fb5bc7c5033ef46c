"""Benchmark decontamination by the q-gram lemma, in characters.

A window of a benchmark item of length m that occurs in a text with at most k edits shares at least
m + 1 - q (k + 1) of its q-grams with it, all within a band of neighbouring diagonals. Shared q-grams
are counted in bands that overlap by k diagonals; windows that reach the bound in a band are verified
by banded alignment. Every position of an item starts a window and nothing below the bound can hold a
match, so no window within its edits is missed, wherever in the item a passage begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchlens.llm.common import fresh

Q = 8
#: Characters of a window of an item; shorter items are one window.
WINDOW = 96
#: Edits allowed per character of a window.
ERROR = 0.1
#: Items with fewer characters are too short to be told from chance.
LEAST_ITEM = 32
#: Diagonals of a band, besides the overlap.
BAND = 32
#: Characters of benchmark text in a block; a task holds the index of one block at a time.
BLOCK_CHARS = 2_000_000
#: Characters of an item that are indexed as one; places within it fit 20 bits.
PIECE_CHARS = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def flat(text: str) -> str:
    """Lower case, with every run of blanks as one space and none at the ends."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from every position; Q is a power of two."""
    out, width, factor = codes.astype(np.uint64), 1, _FACTOR
    while width < Q:
        if len(out) <= width:
            return np.zeros(0, np.uint64)
        out = out[:-width] * factor + out[width:]
        width, factor = 2 * width, np.uint64(int(factor) ** 2 % (1 << 64))
    return out


@dataclass
class Index:
    """The q-grams of a block of items, and the windows to be found."""

    ids: list
    codes: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray
    least: int
    reach: int

    def shape(self, item: int) -> tuple[int, int, int]:
        """(length, edits, least shared q-grams) of every window of an item."""
        length = min(WINDOW, len(self.codes[item]))
        edits = int(ERROR * length)
        return length, edits, length + 1 - Q * (edits + 1)

    def windows(self, item: int) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, least shared q-grams) of the windows of an item, one from every position."""
        length, edits, least = self.shape(item)
        return [(a, a + length, edits, least) for a in range(len(self.codes[item]) - length + 1)]


def build_index(items: list[tuple]) -> Index | None:
    """The index of (id, text) items; None when no item is long enough."""
    kept = [(i, _codes(flat(t))) for i, t in items if t is not None]
    kept = [(i, c) for i, c in kept if len(c) >= LEAST_ITEM]
    if not kept:
        return None
    hashes = [_hashes(c) for _, c in kept]
    every = np.concatenate(hashes)
    item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(every, kind="stable")
    grams, first, count = np.unique(every[order], return_index=True, return_counts=True)
    table = np.zeros(1 << 22, bool)
    table[(grams * _FACTOR) >> np.uint64(42)] = True
    index = Index([i for i, _ in kept], [c for _, c in kept], grams, first, count, item[order], at[order], table, 0, 0)
    shapes = [index.shape(n) for n in range(len(kept))]
    index.least = max(1, min(least for _, _, least in shapes))
    index.reach = max(length + edits for length, edits, _ in shapes)
    return index


def distance(pattern: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of the whole `pattern` in `text`, if at most `edits` apart.

    `text` is the stretch that a band covers, so all its columns are within the band.
    """
    # of edits + 1 pieces of the pattern, one at least is left whole by the edits
    if (size := len(pattern) // (edits + 1)) and len(text) > 4 * len(pattern):
        held, wanted = (v.tobytes().decode("utf-32-le", "surrogatepass") for v in (text, pattern))
        if not any(wanted[n * size : (n + 1) * size] in held for n in range(edits + 1)):
            return None
    row = np.zeros(len(text) + 1, np.int32)
    columns = np.arange(len(text) + 1, dtype=np.int32)
    for n, code in enumerate(pattern, 1):
        step = np.empty_like(row)
        step[0] = n
        np.minimum(row[:-1] + (text != code), row[1:] + 1, out=step[1:])
        row = np.minimum.accumulate(step - columns) + columns
        if row.min() > edits:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= edits else None


def first_within(patterns: np.ndarray, texts: np.ndarray, edits: int) -> int | None:
    """The first row of `patterns` that is at most `edits` from some place of the same row of `texts`: `distance` for many."""
    rows = np.zeros((len(texts), texts.shape[1] + 1), np.int16)
    columns = np.arange(rows.shape[1], dtype=np.int16)
    alive = np.arange(len(texts))
    for n in range(patterns.shape[1]):
        step = np.empty_like(rows)
        step[:, 0] = n + 1
        np.minimum(rows[:, :-1] + (texts != patterns[:, n : n + 1]), rows[:, 1:] + 1, out=step[:, 1:])
        rows = np.minimum.accumulate(step - columns, axis=1) + columns
        keep = rows.min(axis=1) <= edits
        if not keep.all():
            rows, texts, patterns, alive = rows[keep], texts[keep], patterns[keep], alive[keep]
            if not len(alive):
                return None
    return int(alive[0])


def _verified(index: Index, n: int, ats: np.ndarray, codes: np.ndarray, low: int, most: int) -> tuple | None:
    """The match of item `n` in the band from diagonal `low`, whose hits are at the sorted item positions `ats`.

    All windows that reach the bound are tried, those with the most hits first.
    """
    item = index.codes[n]
    length, edits, least = index.shape(n)
    least = max(1, least)
    if len(ats) < least:
        return None
    # the starts from which `least` neighbouring hits lie in one window
    low_start, high_start = ats[least - 1 :] - (length - Q), ats[: len(ats) - least + 1]
    able = low_start <= high_start
    if not able.any():
        return None
    starts = np.arange(max(0, low_start[able].min()), min(len(item) - length, high_start[able].max()) + 1)
    hits = np.searchsorted(ats, starts + length - Q, "right") - np.searchsorted(ats, starts)
    order = np.argsort(-hits, kind="stable")
    starts = starts[order][hits[order] >= least]
    width, done, size = BAND + 3 * most + length, 0, 1
    while done < len(starts):
        tried = starts[done : done + size]
        places = (low + tried - most)[:, None] + np.arange(width)
        inside = (places >= 0) & (places < len(codes))
        stretches = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))  # no character
        first = first_within(item[tried[:, None] + np.arange(length)], stretches, edits)
        if first is not None:
            start = int(tried[first])
            left = max(0, low + start - most)
            far, end = distance(item[start : start + length], codes[left : max(0, low + start - most + width)], edits)
            return index.ids[n], far, max(0, left + end - length - far), left + end
        done, size = done + size, min(64, 8 * size)
    return None


def find(index: Index, texts: list[str | None]) -> list[list[tuple]]:
    """For each text, (item id, edits, start, end) of a window of each item found in it, the densest of its first band.

    Positions are those of the flat text; the start is where the window's band begins at the latest.
    """
    out: list[list[tuple]] = [[] for _ in texts]
    flats = [_codes(flat(t)) if t else np.zeros(0, np.uint32) for t in texts]
    for n, codes in enumerate(flats):
        for start in range(0, max(1, len(codes)), 1 << 20):  # very long texts in overlapping pieces
            piece = codes[start : start + (1 << 20) + 2 * index.reach]
            known = {f[0] for f in out[n]}
            out[n] += [(i, e, a + start, b + start) for i, e, a, b in _find_in(index, piece) if i not in known]
    return out


def _find_in(index: Index, codes: np.ndarray) -> list[tuple]:
    hashes = _hashes(codes)
    place = np.flatnonzero(index.table[(hashes * _FACTOR) >> np.uint64(42)])
    if len(place) < index.least:
        return []
    # a match has at least `least` hits within `reach` characters
    dense = place[index.least - 1 :] - place[: len(place) - index.least + 1] <= index.reach
    if not dense.any():
        return []
    mark = np.zeros(len(place) + 1, np.int32)
    starts = np.flatnonzero(dense)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + index.least, -1)
    place = place[np.cumsum(mark[:-1]) > 0]
    gram = np.minimum(np.searchsorted(index.grams, hashes[place]), len(index.grams) - 1)
    true = index.grams[gram] == hashes[place]
    place, gram = place[true], gram[true]
    if len(place) < index.least:
        return []
    counts = index.count[gram]
    text_at = np.repeat(place, counts)
    entry = np.repeat(index.first[gram] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    item, at = index.item[entry], index.at[entry]
    diagonal = text_at - at + (1 << 20)
    # bands of BAND diagonals that overlap by the most edits a window has: a hit lies in one or two
    most = int(ERROR * WINDOW)
    band = diagonal // BAND
    again = diagonal % BAND < most
    item, at, band = (np.concatenate([v, w[again]]) for v, w in ((item, item), (at, at), (band, band - 1)))
    key = (item.astype(np.int64) << 44) | (band.astype(np.int64) << 20) | at
    key = np.unique(key)
    group = key >> 20
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    # bands in which `least` neighbouring hits lie in one window
    ahead, behind = slice(index.least - 1, None), slice(max(0, len(key) - index.least + 1))
    close = np.flatnonzero((group[ahead] == group[behind]) & (key[ahead] - key[behind] <= WINDOW - Q))
    found: dict[int, tuple] = {}
    for g in np.unique(np.searchsorted(edges, close, "right") - 1):
        a, b = edges[g], edges[g + 1]
        n, low = int(key[a] >> 44), (int(key[a] >> 20) & 0xFFFFFF) * BAND - (1 << 20)
        if n in found:
            continue
        hit = _verified(index, n, key[a:b] & 0xFFFFF, codes, low, most)
        if hit:
            found[n] = hit
    return list(found.values())


def _blocks(benchmark: DataFrame, id_col: str, text: str) -> list[list[tuple]]:
    """The stated items, flat, in blocks of about BLOCK_CHARS characters; long ones in overlapping pieces of one id."""
    blocks, held = [[]], 0
    for row in benchmark.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().orderBy("id", "text").toLocalIterator():
        whole = flat(row.text)
        for start in range(0, max(1, len(whole) - 2 * WINDOW), PIECE_CHARS):
            piece = whole[start : start + PIECE_CHARS + 2 * WINDOW]
            if blocks[-1] and held + len(piece) > BLOCK_CHARS:
                blocks.append([])
                held = 0
            blocks[-1].append((row.id, piece))
            held += len(piece)
    return blocks


def _first_of_each(matches: list[tuple]) -> list[tuple]:
    """Sorted by item, null last, with the match of fewest edits, then the first, of every item."""
    best: dict = {}
    for m in matches:
        if m[0] not in best or m[1:] < best[m[0]][1:]:
            best[m[0]] = m
    return sorted(best.values(), key=lambda m: (m[0] is None, m[0] if m[0] is not None else 0))


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with an array `out` of the benchmark items found in each whole text; no row moves.

    An entry is (item, edits, start, end), one for every item id, of any type and null too: a verified window of the item, its edits, and its place
    in the flat text. Items below LEAST_ITEM characters and null items are not looked for. Null and
    empty texts match nothing. The items are the stated query set: they go to the tasks in blocks of
    bounded size, one pass over a batch of texts for each block.
    """
    spark = docs.sparkSession
    blocks = [b for b in _blocks(benchmark, item_id, item_text) if b]
    shared = [spark.sparkContext.broadcast(b) for b in blocks]
    at, names = docs.columns.index(text), [*docs.columns, out]
    item_type = benchmark.schema[item_id].dataType
    kind = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = build_index(shared[0].value) if len(shared) == 1 else None
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = batch.column(at).to_pylist()
                found: list[list[tuple]] = [[] for _ in texts]
                for block in shared:
                    index = held or build_index(block.value)
                    if index is not None:
                        for mine, more in zip(found, find(index, texts), strict=True):
                            mine += more
                rows = [[dict(zip(("item", "edits", "start", "end"), f, strict=True)) for f in _first_of_each(mine)] for mine in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names)

    added = f"`{out}` array<struct<item:{item_type.simpleString()},edits:int,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), added]))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the rows that hold a passage of a benchmark item; other rows and all columns stay."""
    found = fresh(docs, "matches")
    return with_matches(docs, benchmark, text, found, item_id, item_text).where(F.size(found) == 0).drop(found)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, contaminated, n_items, items, least_edits) for every row of `docs`.

    Null and repeated ids each give their row. Other columns and their names play no part. An empty
    table gives an empty one; an empty benchmark finds nothing.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    found = with_matches(base, benchmark, "text", "matches", item_id, item_text)
    items = F.transform("matches", lambda m: m["item"])
    return found.select(
        F.col("id").alias(id_col), (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        items.alias("items"), F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"),
    )
