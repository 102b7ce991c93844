"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased words (runs of letters and digits), so
spacing and punctuation don't matter.

1. Seeds.  An item's runs of ``min_match`` words are its seeds, as a table of
   hashes with their places.  Documents give the rolling hashes that a filter of
   ``2 ** filter_bits`` bits, made of all seeds, lets through: it holds no item, has
   one size, and lets more through where a benchmark is very large, which costs
   time and changes nothing.  What is let through is joined with the seeds.
2. A document goes on with an item only if the item's words under shared seeds
   could reach the threshold.
3. Those pairs are tiled: the longest match of unmarked words is found by growing
   Karp-Rabin hashed seeds, marked on both sides, and so on until no match of
   ``min_match`` words is left.  A pair whose tiles cover a share ``threshold`` of the
   item's words is a leak, in whatever order the passages stand.  Items with fewer
   words than ``min_match`` are one tile, matched whole.

Cases: items and documents that are null or without words match nothing.
Repeated items or rows each give rows of their own; several texts under one id
are compared each.  Rows with null ids take no part.  Ties among matches go to
the earlier start in the item, then in the document.  Other columns are
ignored, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, documents_only, forget, mix, odd_multipliers, settle, slices

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode() for w in _WORD.findall(text.lower())] if text else []


def seed_hashes(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k, factor in enumerate(odd_multipliers(width, 3)):
        h += words[k : k + n] * factor
    return mix(h)


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in doc, length), longest first.

    Among matches of equal length the one that starts first in the item, then
    in the document, is marked first.  Holds the places of shared seeds, not their pairs.
    """
    width = min(min_match, len(item))
    if not width or len(doc) < width:
        return []
    item_hashes, doc_hashes = seed_hashes(item, width).tolist(), seed_hashes(doc, width)
    at = np.flatnonzero(np.isin(doc_hashes, np.array(item_hashes, np.uint64)))
    places: dict[int, list[int]] = {}
    for j, h in zip(at.tolist(), doc_hashes[at].tolist()):
        places.setdefault(h, []).append(j)
    a, b = item.tolist(), doc.tolist()
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    out = []
    while True:
        best: list[tuple[int, int]] = []
        longest = width
        for i, h in enumerate(item_hashes):
            if any(used_a[i : i + width]):
                continue
            for j in places.get(h, ()):
                if any(used_b[j : j + width]):
                    continue
                if i and j and a[i - 1] == b[j - 1] and not used_a[i - 1] and not used_b[j - 1]:
                    continue  # part of the match that starts before it
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > longest:
                    longest, best = n, []
                if n == longest:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if not any(used_a[i : i + longest]) and not any(used_b[j : j + longest]):
                used_a[i : i + longest] = used_b[j : j + longest] = b"\1" * longest
                out.append((i, j, longest))


SEED = pa.schema([("item_id", pa.int64()), ("of_text", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("place", pa.int32()), ("seed", pa.int64())])
SEED_SQL = "item_id long, of_text long, n int, width int, place int, seed long"


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, names, texts = (batch.column(c).to_pylist() for c in ("item_id", "of_text", "text"))
            for i, j in slices(texts):
                rows: list[list] = [[] for _ in SEED]
                for item, name, text in zip(ids[i:j], names[i:j], texts[i:j]):
                    words = hashes.of(words_of(text))
                    width = min(min_match, len(words))
                    if width:
                        h = seed_hashes(words, width).view(np.int64)
                        for column, value in zip(rows, ([item] * len(h), [name] * len(h), [len(words)] * len(h), [width] * len(h), range(len(h)), h.tolist())):
                            column.extend(value)
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, SEED)], schema=SEED)

    return items.select("item_id", "of_text", "text").distinct().mapInArrow(run, SEED_SQL)


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the seeds' first ``bits`` bits, as bytes: of one size, whatever the benchmark's."""
    bit = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << bits - 6, np.int64)
    out[held["word"].to_numpy()] = held["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


def _shared(documents: DataFrame, known: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """(doc_id, seed): the rolling hashes of each document that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                split = [words_of(t) for t in texts[i:j]]
                n = np.fromiter(map(len, split), np.int64, len(split))
                words, ends = hashes.of([w for s in split for w in s]), np.cumsum(n)
                docs = np.repeat(np.arange(len(n)), n)
                for width in widths:
                    h = seed_hashes(words, width)
                    top = h >> np.uint64(64 - bits)
                    at = np.flatnonzero(known[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
                    at = at[at + width <= ends[docs[at]]]
                    if len(at):
                        pairs = np.unique(np.stack([docs[at], h[at].view(np.int64)]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][pairs[0]]), pa.array(pairs[1])], ["doc_id", "seed"])

    return documents.mapInArrow(run, "doc_id long, seed long")


LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())])
LEAK_SQL = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"


def _tiled(pairs: DataFrame, min_match: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = []
            last, words = None, None
            for doc, item, text, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "passage"))):
                if text != last:
                    last, words = text, hashes.of(words_of(text))
                want = hashes.of(words_of(passage))
                marked = tiles(want, words, min_match)
                covered = sum(n for *_, n in marked)
                if covered >= threshold * len(want):
                    rows.append((doc, item, len(want), covered, len(marked), covered / len(want)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LEAK)], schema=LEAK)

    return pairs.mapInArrow(run, LEAK_SQL)


def leaks(documents: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.6, filter_bits: int = 24) -> DataFrame:
    """One row for each document and test item of which it holds a share ``threshold`` of the words at least."""
    docs = documents_only(documents).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.withColumn("of_text", F.xxhash64("text"))
    seeds = settle(_seeds(items, min_match))
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())  # min_match rows at most
    hits = settle(_shared(docs, _filter(seeds, filter_bits), filter_bits, widths).distinct())
    covered = hits.join(seeds, "seed").groupBy("doc_id", "item_id", "of_text", "n", "width").agg(F.collect_set("place").alias("places"))
    under = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    pairs = settle(covered.where(F.size(under) >= threshold * F.col("n")).select("doc_id", "item_id", "of_text"))
    passages = items.withColumnRenamed("text", "passage")
    found = settle(_tiled(docs.join(pairs, "doc_id").join(passages, ["item_id", "of_text"]).select("doc_id", "item_id", "text", "passage"), min_match, threshold))
    forget(seeds, hits, pairs)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that leak no test item; rows with a null doc_id stay."""
    found = leaks(documents, benchmark, **options).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti")
