"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every training text is cut into overlapping passages, long enough that any span of an item's length
lies whole in one. A passage is the query: an item is retrieved where the BM25 weight of the terms
they share is a given share of the item's own weight. Items stand in blocks, and each term keeps
the largest weight it has in a block; terms too common to decide (their weights together stay under
a slack) are left out of the bound. The shallow moves are made for a batch of passages at once: a
passage's block maxima are summed for the blocks that its terms are in, and blocks under the
threshold are skipped whole. In the blocks that are left its posting lists are walked a document at
a time: the maxima of the lists in order of their next items choose the pivot, lists before it skip
to it, and an item is scored where the lists meet at the pivot.

What is retrieved is verified: the passage must hold enough of the three-word runs of the item's
question (all but its last sentence) and of the words of its answer (the last sentence), or most of
the three-word runs of the whole item. An item of one sentence, or with a question or answer of
fewer than SHORT words, is verified by the runs of the whole item. An item of one or two words is
found where a sentence or a line of a text is just these words.

A null or wordless text matches nothing; a null or wordless item is ignored; a text of any length is
searched whole; repeated rows and ties give the same items; without items nothing is retrieved.
Columns beside `text` pass through, one named as the result is replaced.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unspool.llm import kernels as K
from unspool.llm.common import materialize

#: BM25's saturation and length weights.
K1, BETA = 1.2, 0.75
#: Items, and bytes of their texts, that one index holds at most; more are searched in several passes, one index in each.
INDEX_ITEMS, INDEX_BYTES = 20_000, 16 << 20
#: A question or answer of fewer words is not verified by itself: one edit could hide it.
SHORT = 5
#: The share of the whole item's runs that is enough without its answer.
MOST = 0.6
_BLOCK = 2
#: Passages times blocks that are summed at once.
_DENSE = 1 << 21
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word (a run of letters and digits, lowered) in order."""
    return K.letter_terms(K.lower_latin(data), offs, _NOT_WORD, (0,), (np.uint64(0),))


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    #: How many of the words, from the first, are the question; the rest is the answer.
    asked: int
    #: Sorted distinct words and the share of the item's own weight that each has.
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, known: np.ndarray) -> float:
        """The share of the item's weight that sorted distinct words have."""
        return float(self.weight[np.isin(self.terms, known)].sum())

    def verified(self, words: list[int], overlap: float) -> bool:
        own = self.words.tolist()
        runs, here = _runs(own), _runs(words)
        if len(runs & here) >= MOST * len(runs):
            return True
        question, answer = _runs(own[: self.asked]), set(own[self.asked :])
        return len(question & here) >= overlap * len(question) and len(answer & set(words)) >= overlap * len(answer)


@dataclass
class Index:
    """terms: sorted; for each its items and weights, and its blocks of items with the largest weight in each."""

    items: list[Item]
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_bound: np.ndarray
    blocks: int
    slack: float
    stride: int
    threshold: float
    overlap: float
    #: Items of one or two words, by their words.
    short: dict[tuple[int, ...], list[int]]

    @cached_property
    def lists(self) -> list[tuple[list[int], list[float], list[int], list[float]]]:
        """For each term its items, their weights, its blocks and their bounds."""
        cut = lambda x, start: [x[a:b].tolist() for a, b in itertools.pairwise(start.tolist())]
        return list(zip(cut(self.item, self.start), cut(self.weight, self.start), cut(self.block, self.block_start), cut(self.block_bound, self.block_start), strict=True))


def _runs(words: list[int], width: int = 3) -> set[tuple[int, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def build(rows: list[tuple[int, str]], threshold: float = 0.4, overlap: float = 0.4) -> Index:
    """rows: (item_id, text). threshold: share of an item's own BM25 weight; overlap: share of question and of answer."""

    def hashes(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return hashed_words(data, np.array([0, len(data)]))[1]

    texts = [(i, t, hashes(t)) for i, t in sorted((r for r in rows if r[1]), key=lambda r: (r[0], r[1]))]
    short: dict[tuple[int, ...], list[int]] = {}
    for item_id, _, words in texts:
        if 0 < len(words) < 3:
            short.setdefault(tuple(words.tolist()), []).append(item_id)
    texts = [x for x in texts if len(x[2]) >= 3]
    seen = Counter(w for _, _, words in texts for w in set(words.tolist()))
    mean = sum(len(w) for _, _, w in texts) / max(1, len(texts))
    items = []
    for item_id, text, words in texts:
        own, tf = np.unique(words, return_counts=True)
        docs = np.array([seen[w] for w in own.tolist()])
        raw = np.log1p((len(texts) - docs + 0.5) / (docs + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - BETA + BETA * len(words) / mean))
        answer = len(hashes([p for p in _SENTENCE.split(text) if len(hashes(p))][-1]))
        asked = len(words) - answer
        if asked < SHORT or answer < SHORT:
            asked = len(words)
        items.append(Item(item_id, words, asked, own, raw / raw.sum()))
    terms = np.array(sorted(seen), np.uint64)
    at = [np.searchsorted(terms, i.terms) for i in items]
    term = np.concatenate(at) if items else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(items)), [len(x) for x in at])
    weight = np.concatenate([i.weight for i in items]) if items else np.zeros(0)
    largest = np.zeros(len(terms))
    np.maximum.at(largest, term, weight)
    # The terms of most items first, as long as all of them together stay under a quarter of the threshold.
    order = np.lexsort((np.arange(len(terms)), -np.bincount(term, minlength=len(terms))))
    free = np.zeros(len(terms), bool)
    free[order[np.cumsum(largest[order]) <= threshold / 4]] = True
    number = np.cumsum(~free) - 1
    keep = ~free[term]
    term, item, weight = number[term[keep]], item[keep], weight[keep]
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    cell, back = np.unique(term * max(1, -(-len(items) // _BLOCK)) + item // _BLOCK, return_inverse=True)
    bound = np.zeros(len(cell))
    np.maximum.at(bound, back, weight)
    blocks = max(1, -(-len(items) // _BLOCK))
    all_terms = np.arange(int((~free).sum()) + 1)
    longest = max((len(w) for _, _, w in texts), default=1)
    return Index(items, terms[~free], np.searchsorted(term, all_terms), item, weight, np.searchsorted(cell // blocks, all_terms), cell % blocks, bound, blocks, threshold / 4 if free.any() else 0.0, max(16, longest), threshold, overlap, short)


def search(found: list[Index], col: pa.Array) -> list[dict[int, float]]:
    """For each text the items retrieved and verified, with the score of the best passage."""
    data, offs = K.buffer_of(col)
    out: list[dict[int, float]] = [{} for _ in range(len(offs) - 1)]
    found = [x for x in found if x.items or x.short]
    if found:
        for a, b in K.steps(offs, 2 * K.STEP_BYTES):
            part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            row, h = hashed_words(part, own)
            for index in found:
                if len(h) and index.items:
                    _search(index, row, h, out[a:b])
                if len(h) and index.short:
                    _search_short(index.short, part, own, h, out[a:b])
    return out


def _search_short(short: dict[tuple[int, ...], list[int]], data: np.ndarray, offs: np.ndarray, h: np.ndarray, out: list[dict[int, float]]) -> None:
    """Items of one or two words: the whole of a sentence or line."""
    begin, end, row = K.words(K.lower_latin(data), offs, _NOT_WORD)
    after = np.append(data[1:], 0x20)
    after[offs[1:][(offs[1:] > 0)] - 1] = 0x20
    stop = (data == 0x0A) | (np.isin(data, np.frombuffer(b".!?", np.uint8)) & np.isin(after, np.array([0x20, *range(0x09, 0x0E)], np.uint8)))
    stops = np.concatenate(([0], np.cumsum(stop)))
    # Whether something ends between a word and the next one.
    ends = np.append((row[1:] != row[:-1]) | (stops[begin[1:]] > stops[end[:-1]]), True)
    starts = np.append(True, ends[:-1])
    for size in sorted({len(words) for words in short}):
        at = np.flatnonzero(starts[: len(h) - size + 1] & ends[size - 1 :])
        if size == 2:
            at = at[~ends[at]]
        at = at[np.isin(h[at], np.array([words[0] for words in short if len(words) == size], np.uint64))]
        for i in at.tolist():
            for item_id in short.get(tuple(h[i : i + size].tolist()), []):
                out[row[i]][item_id] = 1.0


def _search(index: Index, row: np.ndarray, h: np.ndarray, out: list[dict[int, float]]) -> None:
    """Passages are two neighbouring cells of `stride` words, so any span of an item's length is in one."""
    count = np.bincount(row, minlength=len(out))
    first = np.concatenate(([0], np.cumsum(count)))
    cells = np.maximum(1, -(-count // index.stride))
    cell_first = np.concatenate(([0], np.cumsum(cells)))
    cell = cell_first[row] + (np.arange(len(h)) - first[row]) // index.stride
    at = np.minimum(np.searchsorted(index.terms, h), max(0, len(index.terms) - 1))
    hit = np.flatnonzero(index.terms[at] == h) if len(index.terms) else np.zeros(0, np.int64)
    if not len(hit):
        return
    # A word counts once in a cell, and once in a passage: said again it would only loosen the bound.
    key = np.unique(cell[hit] * len(index.terms) + at[hit])
    cell_of, term = np.divmod(key, len(index.terms))
    before = key - len(index.terms)
    fresh = key[np.minimum(np.searchsorted(key, before), len(key) - 1)] != before
    row_of_cell = np.repeat(np.arange(len(out)), cells)
    follows = np.append(row_of_cell[1:] == row_of_cell[:-1], False)
    least = index.threshold - index.slack
    for c, blocks in _blocks_reached(index, cell_of, term, fresh, follows, least):
        a, b = np.searchsorted(cell_of, (c, c + 1 + int(follows[c])))
        wanted = _walk(index, np.unique(term[a:b]).tolist(), blocks, least)
        if not wanted:
            continue
        r = int(row_of_cell[c])
        begin = int(first[r]) + (c - int(cell_first[r])) * index.stride
        words = h[begin : min(begin + 2 * index.stride, int(first[r + 1]))]
        known, said = np.unique(words), words.tolist()
        for item in (index.items[k] for k in wanted):
            score = item.score(known)
            if score >= index.threshold and item.verified(said, index.overlap):
                out[r][item.item_id] = max(out[r].get(item.item_id, 0.0), min(1.0, score))


def _blocks_reached(index: Index, cell: np.ndarray, term: np.ndarray, fresh: np.ndarray, follows: np.ndarray, least: float):
    """(first cell, blocks) of the passages with blocks whose maxima for the passage's terms add up to `least`.

    fresh: whether a cell's term is not one of the cell before. Entries count for their own cell's
    passage, and fresh ones for the passage that begins a cell earlier.
    """
    size = index.block_start[term + 1] - index.block_start[term]
    # Cells are taken in runs of about as many sums as _DENSE.
    touched = np.bincount(cell, size, len(follows))
    runs = np.flatnonzero(np.diff(np.cumsum(np.minimum(touched, index.blocks) + 1) // max(1, _DENSE // 4), prepend=-1))
    for c0, c1 in zip(runs.tolist(), [*runs[1:].tolist(), len(follows)], strict=True):
        a, b = np.searchsorted(cell, (c0, c1 + 1))
        own = size[a:b]
        post = np.arange(int(own.sum())) + np.repeat(index.block_start[term[a:b]] - np.cumsum(own) + own, own)
        key, bound = np.repeat(cell[a:b] - c0, own) * index.blocks + index.block[post], index.block_bound[post]
        width = (c1 - c0) * index.blocks
        before = key - index.blocks
        ahead = np.flatnonzero(np.repeat(fresh[a:b] & np.append(False, follows)[cell[a:b]], own) & (before >= 0))
        here = np.flatnonzero(key < width)
        both, bounds = np.concatenate([key[here], before[ahead]]), np.concatenate([bound[here], bound[ahead]])
        if width <= max(_DENSE, 8 * len(both)):
            reached = np.flatnonzero(np.bincount(both, bounds, width) >= least)
        else:
            # Few of very many blocks are touched: only those are summed.
            some, back = np.unique(both, return_inverse=True)
            reached = some[np.bincount(back, bounds, len(some)) >= least]
        c, block = np.divmod(reached, index.blocks)
        cut = np.flatnonzero(np.diff(c, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=False):
            yield int(c[i]) + c0, block[i:j].tolist()


def _walk(index: Index, terms: list[int], blocks: list[int], least: float) -> list[int]:
    """The items of some blocks that reach `least` with a passage's terms, a document at a time by pivots."""
    lists = [index.lists[t] for t in terms]
    out = []
    for block in blocks:
        heads = []
        for items, weights, own_blocks, bounds in lists:
            k = bisect_left(own_blocks, block)
            if k < len(own_blocks) and own_blocks[k] == block:
                p = bisect_left(items, block * _BLOCK)
                heads.append([items[p], bounds[k], p, bisect_left(items, (block + 1) * _BLOCK, p), items, weights])
        while heads:
            heads.sort(key=lambda x: x[0])
            total, pivot = 0.0, None
            for x in heads:
                total += x[1]
                if total >= least:
                    pivot = x[0]
                    break
            if pivot is None:
                break
            if heads[0][0] == pivot:
                if sum(x[5][x[2]] for x in heads if x[0] == pivot) >= least:
                    out.append(pivot)
                pivot += 1
            # Every list before the pivot skips to it; one that ends within the block goes.
            for x in heads:
                if x[0] < pivot:
                    x[2] = bisect_left(x[4], pivot, x[2], x[3])
                    x[0] = x[4][x[2]] if x[2] < x[3] else -1
            heads = [x for x in heads if x[0] >= 0]
    return out


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The test items in parts that an index holds."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-size // INDEX_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [own.where(part == k) for k in range(parts)]


def _index(part: DataFrame, threshold: float, overlap: float) -> Index:
    return build([tuple(r) for r in part.collect()], threshold, overlap)


def find(found: list[Index], text: Column | str) -> Column:
    """array of struct(item_id, score): the items whose text a document holds, by item_id. The indexes go to every executor."""

    @F.arrow_udf("array<struct<item_id:bigint,score:double>>")
    def benchmark_leaks(texts: pa.Array) -> pa.Array:
        hits = [sorted(x.items()) for x in search(found, texts)]
        sizes = np.concatenate(([0], np.cumsum([len(x) for x in hits]))).astype(np.int32)
        flat = [y for x in hits for y in x]
        items = pa.StructArray.from_arrays([pa.array([y[0] for y in flat], pa.int64()), pa.array([y[1] for y in flat], pa.float64())], ["item_id", "score"])
        return pa.ListArray.from_arrays(pa.array(sizes), items)

    return benchmark_leaks(text)


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "hits", threshold: float = 0.4, overlap: float = 0.4) -> DataFrame:
    """docs with `column`: the test items that each row's text holds, as find() gives them.

    One index at a time is on the driver and sent to the executors. Where the benchmark needs more,
    each has its own pass over the texts, whose few hits are written and meet the rows by their text.
    """
    parts = _parts(benchmark)
    if len(parts) == 1:
        return docs.withColumn(column, find([_index(parts[0], threshold, overlap)], F.col("text")))
    key = [F.xxhash64("text").alias("__text"), F.length("text").alias("__size")]
    found = None
    for part in parts:
        hits = docs.select(*key, F.explode(find([_index(part, threshold, overlap)], F.col("text"))).alias("hit")).distinct()
        hits = materialize(hits, "leaks")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("__text", "__size", "hit.item_id").agg(F.max("hit.score").alias("score"))
    by_text = best.groupBy("__text", "__size").agg(F.array_sort(F.collect_list(F.struct("item_id", "score"))).alias("__hits"))
    met = docs.drop(column).withColumns({"__text": key[0], "__size": key[1]}).join(by_text, ["__text", "__size"], "left")
    kept = [c for c in docs.columns if c != column]
    return met.select(*kept, F.coalesce("__hits", F.array().cast("array<struct<item_id:bigint,score:double>>")).alias(column))
