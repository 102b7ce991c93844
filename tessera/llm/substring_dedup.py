"""Substring dedup on words, with fixed-block anchors.

A repeat of ``window`` words holds, wherever it lies, a whole block of
``window / 2`` words that starts at a multiple of ``window / 2`` in the
document it repeats.  So:

1. Every document's non-overlapping blocks are the index and the rolling hash
   of every position is a probe; both are dealt to shards by hash.  A probe is
   7 bytes (40 bits of hash and a position) in arrays of a slice of documents,
   not a row.  A block hash that two documents hold is an anchor.
2. Hits are extended: in each document every window of ``window`` words that
   holds an anchored position is hashed in full and dealt to shards; the
   smallest doc_id that holds a window is its source, and in all others it is a
   repeat.  Consecutive repeated windows are maximal exact repeats.
3. The words that they cover are removed.

Windows are judged on the input, by two independent 64-bit polynomials over
64-bit word hashes: of 10 ** 13 windows two different ones are taken for equal
with a probability of about 10 ** -13.  A passage in thousands of documents costs
its own occurrences, no pairs.

Cases: null, empty and blank texts have no words, nothing is removed and the
kept text is empty.  Texts shorter than a window are kept whole.  Rows with one
doc_id count as one document where windows are compared, so equal rows remove
nothing from each other; each gets a row of its own.  Rows with a null doc_id
neither lose words nor take them from others.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, by_group, documents_only, forget, mix, rolling, settle, sha, shards_for, slices, utf8

#: A shard's part of a slice: for each document its id and number of entries, then the entries' hashes and positions.
PACKED = "shard int, ids binary, counts binary, low binary, high binary, places binary, more binary"
_PACKED = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("places", pa.binary()), ("more", pa.binary())])
#: A shard's answer to a part of the documents, and all answers to one document.
DEALT = "part int, ids binary, counts binary, first binary, second binary"
_DEALT = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "first", "second"))])
FOUND = "doc_id long, first binary, second binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])


def narrow(a: np.ndarray) -> bytes:
    """Non-negative integers with a leading byte for their width."""
    size = 2 if not len(a) or a.max() < 1 << 16 else 4
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def pack(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, ids: np.ndarray, shards: int, high_bytes: int, more: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One row a shard.  docs: index into ids of each entry, ascending; 4 + high_bytes bytes of each hash are kept, and all of a second one."""
    if not len(hashes):
        return None
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard, hashes, docs, places = shard[order], hashes[order], docs[order], places[order]
    more = more[order] if more is not None else hashes[:0]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    rows: list[list] = [[] for _ in range(7)]
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
        own, counts = np.unique(docs[i:j], return_counts=True)
        rows[0].append(int(shard[i]))
        rows[1].append(ids[own].tobytes())
        rows[2].append(narrow(counts))
        rows[3].append((hashes[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        rows[4].append((hashes[i:j] >> np.uint64(32)).astype(f"<u{high_bytes}").tobytes())
        rows[5].append(narrow(places[i:j]))
        rows[6].append(more[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _PACKED)], schema=_PACKED)


def unpack(t: pa.Table, high_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, doc_ids and places of a shard's entries."""
    joined = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
    hashes = joined("low", "<u4").astype(np.uint64) | joined("high", f"<u{high_bytes}").astype(np.uint64) << np.uint64(32)
    counts = np.concatenate([widen(x) for x in t["counts"].to_pylist()])
    places = np.concatenate([widen(x) for x in t["places"].to_pylist()])
    return hashes, np.repeat(joined("ids", "<i8"), counts), places


def deal(docs: np.ndarray, first: np.ndarray, second: np.ndarray | None, parts: int) -> pa.Table:
    """Places (or pairs of them) in documents, one row for each part of the documents."""
    if not len(docs):
        return _DEALT.empty_table()
    part = (mix(docs.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((first, docs, part))
    part, docs, first = part[order], docs[order], first[order]
    second = second[order] if second is not None else first[:0]
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows: list[list] = [[] for _ in _DEALT]
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
        ids, counts = np.unique(docs[i:j], return_counts=True)
        for column, value in zip(rows, (int(part[i]), ids.astype("<i8").tobytes(), narrow(counts), narrow(first[i:j]), narrow(second[i:j]))):
            column.append(value)
    return pa.Table.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _DEALT)], schema=_DEALT)


def gathered(dealt: DataFrame, parts: int) -> DataFrame:
    """One row a document, with all of its places."""

    def run(t: pa.Table) -> pa.Table:
        ids = np.concatenate([np.repeat(np.frombuffer(r, "<i8"), widen(c)) for r, c in zip(t["ids"].to_pylist(), t["counts"].to_pylist())])
        first, second = (np.concatenate([widen(x) for x in t[c].to_pylist()]) for c in ("first", "second"))
        order = np.lexsort((first, ids))
        ids, first, second = ids[order], first[order], second[order] if len(second) else second
        cuts = np.flatnonzero(np.diff(ids)) + 1
        ends = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]))
        return pa.Table.from_arrays([pa.array(ids[[i for i, _ in ends]]), *(pa.array([narrow(c[i:j]) for i, j in ends], pa.binary()) for c in (first, second))], schema=_FOUND)

    return by_group(dealt, parts, run, FOUND)


def places_of(b: bytes | None) -> np.ndarray:
    return np.unique(widen(b)) if b else np.empty(0, np.int64)


def _slice_words(texts: list, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, and for each word its document's index and the words from it to its document's end."""
    split = [t.split() if t else [] for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    words = hashes.of([w for s in split for w in s])
    docs = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return words, docs, ends[docs] - np.arange(len(words))


def _probes(documents: DataFrame, block: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), utf8(batch.column(1))
            for i, j in slices(texts):
                words, docs, rest = _slice_words(texts[i:j], hashes)
                at = np.flatnonzero(rest[: max(0, len(words) - block + 1)] >= block)
                first = np.searchsorted(docs, docs[at])
                out = pack(rolling(words, block, 8)[at] if len(at) else np.empty(0, np.uint64), docs[at], at - first, ids[i:j], shards, 1)
                if out is not None:
                    yield out

    return documents.mapInArrow(run, PACKED)


def _anchors(probes: DataFrame, block: int, parts: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        h, docs, places = unpack(t, 1)
        order = np.lexsort((docs, h))
        h, docs, places = h[order], docs[order], places[order]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        last = np.append(np.flatnonzero(new)[1:], len(h)) - 1
        many = docs[np.flatnonzero(new)] != docs[last]
        indexed = np.bincount(group, places % block == 0, len(many)) > 0
        keep = (many & indexed)[group]
        return deal(docs[keep], places[keep], None, parts)

    return gathered(by_group(probes, parts, run, DEALT), parts)


def _windows(anchored: DataFrame, window: int, block: int, shards: int) -> DataFrame:
    """Every window that holds an anchored position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, texts, places = batch.column(0).to_numpy().astype(np.int64), utf8(batch.column(1)), batch.column(2).to_pylist()
            for i, j in slices(texts):
                words, docs, rest = _slice_words(texts[i:j], hashes)
                if len(words) < window:
                    continue
                n = len(words) - window + 1
                first = np.searchsorted(docs, np.arange(j - i))
                hits = np.concatenate([places_of(p) + first[k] for k, p in enumerate(places[i:j])])
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(hits - (window - block), first[docs[hits]]), 1)
                np.add.at(near, hits + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[:n] > 0) & (rest[:n] >= window))
                out = pack(rolling(words, window, 50)[at], docs[at], at - first[docs[at]], ids[i:j], shards, 4, rolling(words, window, 51)[at])
                if out is not None:
                    yield out

    return anchored.mapInArrow(run, PACKED)


def _repeats(windows: DataFrame, parts: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        h, docs, places = unpack(t, 4)
        more = np.frombuffer(b"".join(t["more"].to_pylist()), np.uint64)
        order = np.lexsort((docs, more, h))
        h, more, docs, places = h[order], more[order], docs[order], places[order]
        new = np.append(True, (h[1:] != h[:-1]) | (more[1:] != more[:-1]))
        later = docs > docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        return deal(docs[later], places[later], None, parts)

    return gathered(by_group(windows, parts, run, DEALT), parts)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(documents: DataFrame, window: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = utf8(batch.column(1)), batch.column(2).to_pylist()
            rows: list[list] = [[] for _ in range(4)]
            for text, p in zip(texts, places):
                words = text.split() if text else []
                n = len(words)
                if p:
                    at = places_of(p)
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:n] == 0)]
                kept = b" ".join(words)
                rows[0].append(n), rows[1].append(n - len(words)), rows[2].append(sha(kept)), rows[3].append(kept.decode() if keep_text else None)
            out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[3], pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    return documents.mapInArrow(run, RESULT + ", kept string" * keep_text)


def remove_repeats(documents: DataFrame, window: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every document."""
    assert window % 2 == 0
    docs = documents_only(documents)
    shards, block = shards_for(docs), window // 2
    named = docs.where("doc_id is not null")
    anchors = settle(_anchors(_probes(named, block, shards), block, shards))
    windows = _windows(named.join(anchors.select("doc_id", "first"), "doc_id"), window, block, shards)
    repeats = settle(_repeats(windows, shards))
    forget(anchors)
    null_rows = docs.where("doc_id is null").withColumn("first", F.lit(None).cast("binary"))
    return _removed(named.join(repeats.select("doc_id", "first"), "doc_id", "left").union(null_rows), window, keep_text)
