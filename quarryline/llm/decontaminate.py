"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items are cut into word trigrams, and all are seeds, however many documents hold them.
Where a document holds a seed of an item and enough of its words, it is aligned with it
around the place of the seed, on words; the local alignment's score over the item's best
possible score is the similarity, so substituted, dropped and added words cost a little
each and don't hide a copy.

The items are the stated query set: they are sent to the tasks in blocks of at most
``BLOCK_WORDS`` words, and each block meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import small_batches

SEED_WORDS = 3
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: words of items sent to each task at once: 8 bytes each
BLOCK_WORDS = 2_000_000

#: words are runs of letters, digits and characters beyond ASCII, so that marks
#: and case don't hide a copy
_WORD = tb.LETTER.copy()
_WORD[48:58] = True
U = np.uint64


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, each row's first word)."""
    for lo, _, data, offsets in tb.pieces(column):
        low = tb.LOWER[data]
        starts, ends, first = tb.runs(_WORD[low], offsets)
        yield lo, tb.span_hash(tb.prefix_sums(low), starts, ends), first


class Items:
    """A block of benchmark items: words, and seeds sorted by hash."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        hashes, bounds = [], [0]
        for _, h, first in _words(pa.array(texts, pa.large_string())):
            hashes.append(h)
            bounds += (bounds[-1] + first[1:]).tolist()
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.bounds = np.array(bounds)
        grams, item, at = [], [], []
        for i in range(len(ids)):
            w = self.words[bounds[i] : bounds[i + 1]]
            n = min(SEED_WORDS, len(w))
            g = tb.shingles(w, n) if n else np.zeros(0, U)
            grams.append(g)
            item.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
        self.grams, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, item, at))
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.at = self.grams[order], self.item[order], self.at[order]
        self.distinct, self.starts = np.unique(self.grams, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.grams))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, index into distinct) of every seed that starts at a word.  Items
        shorter than a seed are met by runs of their own length."""
        places, which = [], []
        for n in range(1, SEED_WORDS + 1):
            g = tb.shingles(hashes, n)
            if n < SEED_WORDS and not self.short(n):
                continue
            if len(g) and len(self.distinct):
                j = np.searchsorted(self.distinct, g)
                j[j == len(self.distinct)] = 0
                hit = np.flatnonzero(self.distinct[j] == g)
                places.append(hit)
                which.append(j[hit])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(which)

    def short(self, n: int) -> bool:
        return bool((np.diff(self.bounds) == n).any())


def similarity(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman score over the item's best, and the word of the text at which
    the alignment ends."""
    if not len(item) or not len(text):
        return 0.0, 0
    slope = np.arange(len(text) + 1) * GAP
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        new = np.zeros(len(text) + 1)
        np.maximum(step, 0, out=new[1:])
        # gaps along the text: the best start to the left, less what each word costs
        new = np.maximum.accumulate(new - slope) + slope
        j = int(new.argmax())
        if new[j] > best:
            best, end = float(new[j]), j
        row = new
    return best / (MATCH * len(item)), end


def matches(items: Items, hashes: np.ndarray, places: np.ndarray, which: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, end word) for one text and its seeds."""
    regions: dict[int, list[int]] = {}
    for p, j in zip(places.tolist(), which.tolist(), strict=True):
        for g in range(items.starts[j], items.ends[j]):
            regions.setdefault(int(items.item[g]), []).append(p - int(items.at[g]))
    out = []
    for i, starts in sorted(regions.items()):
        item = items.words[items.bounds[i] : items.bounds[i + 1]]
        n, starts = len(item), sorted(set(starts))
        best = (0.0, 0, 0)
        while starts:
            # seeds whose copies of the item would begin within its length
            near = [s for s in starts if s <= starts[0] + n]
            starts = starts[len(near) :]
            lo, hi = max(0, near[0] - n // 2), min(len(hashes), near[-1] + n + n // 2)
            text = hashes[lo:hi]
            if MATCH * int(np.isin(item, text).sum()) < threshold * MATCH * n:
                continue
            score, end = similarity(item, text)
            if score > best[0]:
                best = (score, max(0, lo + end - n), lo + end)
        if best[0] >= threshold:
            out.append((i, *best))
    return out


def _per_text(items: Items, column: pa.Array, threshold: float) -> Iterator[tuple[int, list]]:
    for lo, hashes, first in _words(column):
        places, which = items.found(hashes)
        doc = np.searchsorted(first, places, "right") - 1
        order = np.lexsort((places, doc))
        places, which, doc = places[order], which[order], doc[order]
        inside = places < first[doc + 1] if len(doc) else np.zeros(0, bool)
        places, which, doc = places[inside], which[inside], doc[inside]
        for d in np.unique(doc):
            a, b = np.searchsorted(doc, [d, d + 1])
            got = matches(items, hashes[first[d] : first[d + 1]], places[a:b] - first[d], which[a:b], threshold)
            if got:
                yield lo + int(d), got


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of items with their seeds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    for b in range(blocks):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word): documents with a local
    alignment of at least ``threshold`` with an item; words count from 0.

    Null and wordless texts match nothing; neither do null or wordless items.  Items
    repeated in id and text count once, repeated documents each.  Items of fewer words
    than a seed need all of them in a row.  Only doc_id and text are read."""

    def leaks(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], items.ids[m], float(s), a, b) for i, got in _per_text(items, batch.column(1), threshold) for m, s, a, b in got]
                if rows:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "item_id": pa.array([r[1] for r in rows], pa.int64()), "similarity": pa.array([r[2] for r in rows]), "first_word": pa.array([r[3] for r in rows], pa.int64()), "end_word": pa.array([r[4] for r in rows], pa.int64())})

        return run

    out = None
    for shared in _blocks(docs, benchmark):
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(leaks(shared), "doc_id long, item_id long, similarity double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``find_leaks`` names, decided where they are
    read: no text is shuffled."""
    at = docs.columns.index("text")

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in _per_text(shared.value, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs
    for shared in _blocks(docs, benchmark):
        out = out.mapInArrow(clean(shared), docs.schema)
    return out
