"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

1. Sketch.  A document's words (split at ASCII white space, A-Z lower-cased)
   give its set of distinct 5-word shingles as 64-bit hashes.  One permutation
   deals the set to ``bins`` bins by its top bits; each bin keeps its least
   hash.  An empty bin copies a full one found by 2-universal probing (optimal
   densification).  ``bands`` bands of ``bins / bands`` values are the buckets.
2. Classes.  Documents with the same set are one class, named by its smallest
   doc_id; only classes go on, so any number of copies costs no pairs.
3. Stars.  In each bucket every class is paired with one centre: as many
   candidates as members, never their square.  The centre is the member that
   shares most buckets with most others: the source of a group of near-copies
   is nearer to each of them than they are to each other.  Candidates are confirmed on the
   full sets and confirmed links give components.
4. Exactness.  A bucket whose members are still in several components gets
   another star, about the heaviest member outside the components of its last
   centres.  After ``star_rounds`` stars the members left over in divided buckets
   are joined on the rarest shingles of their sets (prefix filter): every pair of
   different components that can reach the threshold is tried, and what a large
   group has in common brings no two of its members together.

Losses: a pair that shares no bucket, unless both ends are left over.  A pair
whose sketches agree in less than 0.75 less six deviations of the bins (0.52 of
128) is not confirmed either: about 1 in 10 ** 9 for independent bins.  Sets of
fewer shingles than bins fill the rest with copies, so their bins aren't
independent; tests measure both against all pairs.

A pair of similarity 0.75 shares none of 32 bands of 4 with probability
(1 - 0.75 ** 4) ** 32 = 5e-6.

Cases: a document without words (null, empty or blank text) has an empty set
and is linked with nothing.  Every input row gives a row; repeated rows are
copies of one another and share a component.  A doc_id with several texts is
one document: it is linked with whatever any of them is linked with, and each
row has its own n_shingles.  A null doc_id forms no class name: such a row is
linked with nothing.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, documents_only, forget, mix, odd_multipliers, settle, slices, utf8
from tessera.llm._graph import components


def shingles(text: bytes | None, hashes: WordHash, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    factors = odd_multipliers(width, 5)
    if len(w) < width:
        h = (w * factors[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))
    else:
        n = len(w) - width + 1
        h = w[:n] * factors[0]
        for k in range(1, width):
            h = h + w[k : k + n] * factors[k]
    return np.unique(mix(h))


class OnePermutation:
    """Signatures of sorted hash sets by one-permutation hashing with optimal densification."""

    def __init__(self, bins: int = 128, bands: int = 32):
        assert bins & (bins - 1) == 0 and bins % bands == 0
        self.bins, self.bands = bins, bands
        self.starts = (np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)).astype(np.uint64)
        self.rounds = np.arange(bins, dtype=np.uint64)

    def signature(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(h, self.starts)
        full = at < np.append(at[1:], len(h))
        out = np.zeros(self.bins, np.uint64)
        out[full] = h[at[full]]
        empty = np.flatnonzero(~full)
        attempt = 0
        while len(empty):
            probe = (mix(self.rounds[empty] + np.uint64((attempt + 1) << 20)) & np.uint64(self.bins - 1)).astype(np.int64)
            hit = full[probe]
            out[empty[hit]] = out[probe[hit]]
            empty = empty[~hit]
            attempt += 1
        return out

    def buckets(self, signature: np.ndarray) -> list[int]:
        rows = signature.reshape(self.bands, -1)
        h = mix(np.arange(1, self.bands + 1, dtype=np.uint64))
        for k in range(rows.shape[1]):
            h = mix(h ^ rows[:, k])
        return h.view(np.int64).tolist()


SKETCH = "doc_id long, n_shingles long, set_hash string, sketch binary, buckets array<long>"


def sketches(documents: DataFrame, width: int = 5, bins: int = 128, bands: int = 32) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, oph = WordHash(), OnePermutation(bins, bands)
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                n, names, marks, buckets = [], [], [], []
                for text in texts[i:j]:
                    h = shingles(text, hashes, width)
                    n.append(len(h))
                    if len(h):
                        signature = oph.signature(h)
                        names.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                        marks.append((signature & np.uint64(0xFF)).astype(np.uint8).tobytes())
                        buckets.append(oph.buckets(signature))
                    else:
                        names.append(None), marks.append(None), buckets.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(marks, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "sketch", "buckets"])

    return documents_only(documents).mapInArrow(run, SKETCH)


def _likely(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs whose sketches agree in a share ``floor`` of the bins at least (six deviations under the threshold)."""
    mark = classes.select("node", "sketch")
    both = pairs.join(mark.toDF("a", "mark_a"), "a").join(mark.toDF("b", "mark_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("mark_a", "mark_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= floor))

    return both.select("a", "b", "mark_a", "mark_b").mapInArrow(run, "a long, b long")


def _grams(documents: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, grams): the full set of each text of the nodes."""
    texts = documents.where("doc_id is not null and text is not null").join(nodes.select(F.col("node").alias("doc_id")).hint("shuffle_merge"), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                grams = pa.array([shingles(t, hashes, width).view(np.int64) for t in texts[i:j]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), grams], ["node", "grams"])

    return texts.mapInArrow(sets, "node long, grams array<long>").where("size(grams) > 0")


def _confirmed(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets of their texts."""
    ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    full = settle(_grams(documents, ends, width))
    both = pairs.join(full.toDF("a", "grams_a"), "a").join(full.toDF("b", "grams_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = settle(both.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long"))
    forget(full)
    return out


def _prefix_pairs(documents: DataFrame, left: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes of different components that the rarest shingles of both leave possible.

    left has node and component.  A set's shingles are put in order of the number of sets that hold them, rarest
    first.  Two sets that reach the threshold share one among the first n - ceil(2p / (100 + p) n) + 1 of the smaller
    and the first n - ceil(p / 100 n) + 1 of the larger, and so many after the first of these that the threshold can
    still be met.  What a group of near-copies has in common comes last in that order, so its members don't meet there.
    """
    full = settle(_grams(documents, left, width).select("node", F.xxhash64("grams").alias("set"), F.size("grams").alias("n"), "grams"))
    each = full.select("node", "set", "n", F.explode("grams").alias("gram"))
    held = each.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # A shingle of one set alone is in no pair: it takes its place before all others and needs no row.
    kept = each.join(held.hint("shuffle_merge"), "gram").groupBy("node", "set", "n").agg(F.sort_array(F.collect_list(F.struct("k", "gram"))).alias("rare"))
    probe = F.expr(f"n - int(ceil({percent} * n / 100)) + 1 - (n - size(rare))")
    kept = settle(kept.withColumn("probed", probe).where("probed > 0").select("node", "set", "n", F.size("rare").alias("m"), F.slice("rare.gram", 1, F.col("probed")).alias("first")))
    rows = kept.join(left, "node").select("node", "component", "set", "n", "m", F.posexplode("first").alias("i", "gram"))
    # i shingles of several sets and n - m of this one alone come before.
    index = rows.where(f"i <= m - int(ceil({2 * percent} * n / {100 + percent}))")
    index = index.select("gram", F.col("node").alias("other"), F.col("component").alias("theirs"), F.col("set").alias("set2"), F.col("n").alias("n2"), F.expr("m - i").alias("rest2"))
    least = F.least(F.expr("m - i"), F.col("rest2"))
    fits = (100 + percent) * least >= percent * (F.col("n") + F.col("n2"))
    order = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("set2") < F.col("set")))
    possible = order & (F.col("component") != F.col("theirs")) & (100 * F.col("n2") >= percent * F.col("n")) & fits
    pairs = settle(rows.join(index.hint("shuffle_merge"), "gram").where(possible).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    forget(full, kept)
    return pairs


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 75, bins: int = 128, bands: int = 32, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = documents_only(documents)
    written: list[DataFrame] = []

    def stored(df: DataFrame) -> DataFrame:
        written.append(settle(df))
        return written[-1]

    sketched = stored(sketches(docs, width, bins, bands))
    named = sketched.where("set_hash is not null and doc_id is not null")
    first = named.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    # Copies have the same sketch and buckets: the row of the class's first document stands for all.
    classes = stored(named.select("set_hash", F.col("doc_id").alias("node"), "sketch", "buckets").join(first, ["set_hash", "node"], "left_semi").dropDuplicates(["set_hash"]))
    # A doc_id with several texts is one node that belongs to the classes of all of them.
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("set_hash")).alias("x"), F.max(F.xxhash64("set_hash")).alias("y")).where("x < y").select("doc_id")
    of_several = named.select("doc_id", "set_hash").join(several, "doc_id", "left_semi").distinct().join(classes.select("set_hash", "node"), "set_hash")
    links = [stored(of_several.where("doc_id <> node").select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")))]
    member = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stored(member.join(shared.hint("shuffle_merge"), "bucket"))
    weight = stored(member.groupBy("node").agg(F.sum("n").alias("weight")))
    member = stored(member.select("bucket", "node").join(weight.hint("shuffle_merge"), "node"))

    floor = max(0.0, percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / bins) ** 0.5)
    tried: list[DataFrame] = []

    def confirm(pairs: DataFrame) -> None:
        new = pairs.distinct()
        if tried:
            new = new.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        new = stored(new)
        tried.append(new)
        links.append(_confirmed(stored(_likely(new, classes, floor).distinct()), docs, width, percent))

    found, joined = None, 0

    def grouped() -> DataFrame:
        """Components of all links; those handed in before are stood for by their components."""
        nonlocal found, joined
        found = components(reduce(DataFrame.union, links[joined:]), known=found)
        written.append(found)
        joined = len(links)
        return found

    placed = member.withColumn("component", F.col("node"))
    divided = member.select("bucket").distinct()
    used = None
    for turn in range(star_rounds + 1):
        if turn:
            placed = stored(member.join(grouped(), "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("component")))
            divided = stored(placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"))
            if divided.isEmpty():
                break
        here = placed.join(divided, "bucket", "left_semi")
        if turn < star_rounds:
            free = here if used is None else here.join(used, ["bucket", "component"], "left_anti")
            centre = free.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.struct(-F.col("weight"), "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
            centre = stored(centre)
            taken = centre.select("bucket", F.col("own").alias("component"))
            used = taken if used is None else used.union(taken)
            star = here.join(centre, "bucket").where("node <> centre and component <> own" if turn else "node <> centre")
            confirm(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
        else:
            written.append(_prefix_pairs(docs, here.select("node", "component").distinct(), width, percent))
            confirm(written[-1])
    if joined < len(links):
        grouped()
    names = classes.select("set_hash", "node").join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    rows = sketched.select("doc_id", "n_shingles", "set_hash")
    linked = rows.where("set_hash is not null").join(names, "set_hash", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("set_hash is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = settle(linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    forget(*written, *links[1:])
    return result
