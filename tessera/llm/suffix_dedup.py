"""Suffix-array dedup on bytes, by a common-prefix-aware distributed merge sort.

A byte goes if a string of ``length`` bytes over it also starts earlier
(smaller doc_id, or the same document and a smaller offset).

1. The suffix array is sparse.  Suffixes start at anchors: positions whose
   48-byte gram has the least hash in some window of ``length`` bytes, ties
   included.  What is an anchor depends on the window's bytes alone, so equal
   strings have equal anchors and every string holds one.  Anchors whose gram
   occurs once are dropped after a count of gram hashes.
2. Each task sorts its suffixes: the gram first, as one symbol ordered by its
   hash (so ranges are even without samples), then the bytes.  It merges those
   with equal surroundings (``length`` bytes from the anchor on, and as many
   before it as a string can reach) and deals the sorted run, front-coded, to
   ranges of the gram's hash.
3. A range merges its runs with a loser tree.  Each stored loser knows its
   common prefix with the last winner; bytes are compared from there on, and
   the prefix with the previous suffix comes out with each suffix.
4. Neighbours that share a gram are compared: prefixes come from the merge,
   what they share before the anchor is extended to the left.  If both make
   ``length`` bytes, the later place is a repeat over all of them.  Large groups
   are settled class by class, not pair by pair.

Strings are compared byte by byte, in the merge and to the left of anchors;
hashes only choose and bring together.  Two grams of one hash are kept apart by
the merge, and cost an anchor that would not have been needed at most.

Cases: null and empty texts have no bytes and keep the empty text.  Texts
shorter than ``length`` are kept.  Rows with one doc_id count as the same places
of one document, so equal rows remove nothing from each other.  Rows with a null
doc_id neither lose bytes nor take them from others.  Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import by_group, documents_only, forget, mix, rolling, settle, sha, shards_for, text_slices, utf8
from tessera.llm.substring_dedup import DEALT, PACKED, deal, gathered, pack, places_of, unpack, widen

GRAM = 48
#: Groups up to this size are compared pair by pair, larger ones class by class: the same answer for less work.
PAIRWISE = 24
#: Suffixes that a task sorts at once.
RUN_ENTRIES = 60_000
#: Bytes of text whose hashes are made at once (a longer text alone), and anchors that are packed together.
SLICE_BYTES, PACK_ENTRIES = 1 << 20, 200_000
#: Bytes of input whose suffixes one range holds, on average.
SHARD_BYTES = 2 << 20

_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of ``width`` values, in O(log width) passes."""
    size = 1
    while size * 2 <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def anchors_of(data: np.ndarray, rest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of concatenated texts, and their grams' hashes.  rest: bytes from each place to its text's end."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = length - GRAM + 1
    h = rolling(_BYTE_CODES[data], GRAM, 10)
    h |= np.uint64(1)  # 0 stands for no window
    least = sliding(h, width, np.minimum)
    least[rest[: len(least)] < length] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, mix(h[at])  # least hashes are small ones: mixed again, they spread over all shards


def _layout(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each text starts, and for each byte how many bytes its text has from there on."""
    n = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    starts = np.cumsum(n) - n
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    return data, starts, np.repeat(starts + n, n) - np.arange(len(data))


def _grams(documents: DataFrame, length: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            held: list[tuple] = []

            def packed() -> pa.RecordBatch | None:
                h, docs, places = map(np.concatenate, zip(*held))
                held.clear()
                return pack(h, docs, places, ids, shards, 1)

            for i, _, texts in text_slices(batch.column(1), SLICE_BYTES):
                data, starts, rest = _layout(texts)
                at, h = anchors_of(data, rest, length)
                docs = np.searchsorted(starts, at, "right") - 1
                held.append((h, docs + i, at - starts[docs]))
                if sum(len(x[0]) for x in held) > PACK_ENTRIES and (out := packed()) is not None:
                    yield out
            if held and (out := packed()) is not None:
                yield out

    return documents.mapInArrow(run, PACKED)


def _recurring(grams: DataFrame, parts: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        h, docs, places = unpack(t, 1)
        order = np.argsort(h, kind="stable")
        new = np.append(True, np.diff(h[order]) != 0)
        group = np.cumsum(new) - 1
        keep = order[np.bincount(group)[group] > 1]
        return deal(docs[keep], places[keep], None, parts)

    return gathered(by_group(grams, parts, run, DEALT), parts)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b)) - start
    x = int.from_bytes(a[start : start + n], "big") ^ int.from_bytes(b[start : start + n], "big")
    return start + n - (x.bit_length() + 7 >> 3)


RUN = "shard int, shared binary, lengths binary, tails binary, left_lengths binary, lefts binary, ids binary, places binary"
_RUN = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("shared", "lengths", "tails", "left_lengths", "lefts", "ids", "places"))])


def _front_coded(run: list[tuple]) -> list[bytes]:
    """Columns of a sorted run of (key, left, doc_id, place)."""
    shared, tails, before = bytearray(), [], b""
    for key, *_ in run:
        n = common(before, key)
        shared.append(n)
        tails.append(key[n:])
        before = key
    return [bytes(shared), bytes(map(len, tails)), b"".join(tails), bytes(len(r[1]) for r in run), b"".join(r[1] for r in run), np.array([r[2] for r in run], "<i8").tobytes(), np.array([r[3] for r in run], "<i8").tobytes()]


def _decoded(row: dict) -> list[tuple]:
    """(key, common prefix with the key before, left, doc_id, place) of a run."""
    out, key, at, left_at, tails, lefts = [], b"", 0, 0, row["tails"], row["lefts"]
    for n, m, k, doc, place in zip(row["shared"], row["lengths"], row["left_lengths"], np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["places"], "<i8").tolist()):
        key = key[:n] + tails[at : at + m]
        out.append((key, n, lefts[left_at : left_at + k], doc, place))
        at += m
        left_at += k
    return out


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Entries of all runs in order, each with its common prefix with the entry before, by a loser tree."""
    k = 1 << max(0, len(runs) - 1).bit_length()
    end = (b"\xff" * 256, 0)
    runs = [*([*r, end] for r in runs), *([end] for _ in range(k - len(runs)))]
    at = [0] * k
    losers: list = [None] * k  # (stream, its common prefix with the winner that passed)

    def play(x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser, each with its common prefix with the last entry that came out, or the loser's with the winner."""
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        a, b = runs[x[0]][at[x[0]]][0], runs[y[0]][at[y[0]]][0]
        n = common(a, b, x[1])
        return (x, (y[0], n)) if n == len(a) or (n < len(b) and a[n] < b[n]) else (y, (x[0], n))

    level: list = [(i, 0) for i in range(k)]
    base = k
    while base > 1:
        base //= 2
        level = [play(level[2 * i], level[2 * i + 1]) for i in range(base)]
        for i, (_, loser) in enumerate(level):
            losers[base + i] = loser
        level = [w for w, _ in level]
    winner = level[0]
    while True:
        stream, shared = winner
        entry = runs[stream][at[stream]]
        if len(entry) == 2:
            return
        yield entry, shared
        at[stream] += 1
        winner = stream, runs[stream][at[stream]][1]
        node = (k + stream) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _judge(group: list, length: int, out: list) -> None:
    """Repeats in a group that shares a gram: [key, prefix with the one before, left, doc_id, place] in key order."""
    ahead = 8  # bytes of the hash before the text in a key
    if len(group) <= PAIRWISE:
        for i, (key, _, left, doc, place) in enumerate(group):
            best_left = best_right = -1
            shared = 1 << 30
            for j in range(i - 1, -1, -1):  # prefixes shrink on the way down and up
                shared = min(shared, group[j + 1][1])
                best_left, best_right = _against(group[j], left, doc, place, shared - ahead, length, best_left, best_right)
            shared = 1 << 30
            for j in range(i + 1, len(group)):
                shared = min(shared, group[j][1])
                best_left, best_right = _against(group[j], left, doc, place, shared - ahead, length, best_left, best_right)
            if best_left >= 0:
                out.append((doc, place - best_left, place + best_right))
        return
    reach = length - GRAM
    prefix = np.array([g[1] for g in group]) - ahead
    rights, lefts = np.array([len(g[0]) for g in group]) - ahead, np.array([len(g[2]) for g in group])
    docs, places = np.array([g[3] for g in group]), np.array([g[4] for g in group])
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort((places, docs))] = np.arange(len(group))
    by_left = sorted(range(len(group)), key=lambda i: group[i][2])
    shared_left = np.array([0, *(common(group[i][2], group[j][2]) for i, j in zip(by_left, by_left[1:]))])
    left_class = np.empty(len(group), np.int64)
    low, high = np.full(len(group), -1), np.full(len(group), -1)
    for o in range(reach + 1):
        fits = np.flatnonzero((lefts >= o) & (rights >= length - o))
        if not len(fits):
            continue
        right_class = np.cumsum(prefix < length - o)
        left_class[by_left] = np.cumsum(shared_left < o)
        order = fits[np.lexsort((rank[fits], left_class[fits], right_class[fits]))]
        new = np.append(True, (np.diff(right_class[order]) != 0) | (np.diff(left_class[order]) != 0))
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = order[(docs[order] != docs[first]) | (places[order] != places[first])]
        low[later] = np.where(low[later] < 0, o, low[later])
        high[later] = o
    for i in np.flatnonzero(low >= 0):
        out.append((int(docs[i]), int(places[i] - high[i]), int(places[i] + length - low[i])))


def _against(other: list, left: bytes, doc: int, place: int, right: int, length: int, best_left: int, best_right: int) -> tuple[int, int]:
    if (other[3], other[4]) < (doc, place):
        n = common(left, other[2])
        if n + right >= length:
            return max(best_left, n), max(best_right, right)
    return best_left, best_right


def _verdicts(found: list[tuple], parts: int) -> pa.Table:
    a = np.array(sorted(set(found)), "<i8").reshape(-1, 3)
    return deal(a[:, 0], a[:, 1], a[:, 2], parts)


def _runs(anchored: DataFrame, length: int, shards: int) -> DataFrame:
    """Front-coded sorted runs; suffixes with equal surroundings in one task are judged there and stand as one."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        judged: list[tuple] = []

        def flush() -> pa.RecordBatch:
            entries = sorted((key, left, doc, place) for (key, left), (doc, place) in held.items())
            rows: list[list] = [[] for _ in _RUN]
            start = 0
            of = [(int.from_bytes(e[0][:8], "big") >> 32) * shards >> 32 for e in entries]
            for i in range(1, len(entries) + 1):
                if i == len(entries) or of[i] != of[start]:
                    for column, value in zip(rows, [of[start], *_front_coded(entries[start:i])]):
                        column.append(value)
                    start = i
            if judged:  # these travel along, under a shard of their own
                a = np.array(judged, "<i8")
                for column, value in zip(rows, [-1 - len(judged) % shards, b"", b"", b"", b"", a[:, 2].tobytes(), a[:, 0].tobytes(), a[:, 1].tobytes()]):
                    column.append(value)
            held.clear()
            judged.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _RUN)], schema=_RUN)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, texts in text_slices(batch.column(1), SLICE_BYTES):
                data, starts, _ = _layout(texts)
                at = [places_of(p) for p in batch.column(2).slice(i, j - i).to_pylist()]
                flat = np.concatenate([a + s for a, s in zip(at, starts)])
                codes = mix(rolling(_BYTE_CODES[data], GRAM, 10) | np.uint64(1))
                keys = iter([x.to_bytes(8, "big") for x in codes[flat].tolist()])
                for doc, text, own in zip(ids[i:j], texts, at):
                    for p in own.tolist():
                        key, left = next(keys) + text[p : p + length], text[max(0, p - reach) : p][::-1]
                        was = held.setdefault((key, left), (doc, p))
                        if was != (doc, p):
                            if (doc, p) < was:
                                held[key, left] = doc, p
                                later = was
                            else:
                                later = doc, p
                            if len(left) + len(key) - 8 >= length:
                                judged.append((later[0], later[1] - len(left), later[1] + len(key) - 8))
                    if len(held) + len(judged) > RUN_ENTRIES:
                        yield flush()
        if held or judged:
            yield flush()

    return anchored.mapInArrow(run, RUN)


def _repeats(runs: DataFrame, length: int, parts: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out: list[tuple] = []
        if rows and rows[0]["shard"] < 0:
            for r in rows:
                out += zip(*(np.frombuffer(r[c], "<i8").tolist() for c in ("ids", "places", "lefts")))
            return _verdicts(out, parts)
        group: list = []
        same: dict[bytes, int] = {}  # left context to its entry, among those with the last key
        for (key, _, left, doc, place), shared in merged([_decoded(r) for r in rows]):
            if group and shared < 8 + GRAM:
                _judge(group, length, out)
                group = []
            if not group or shared < len(key) or len(key) != len(group[-1][0]):
                same = {}
            k = same.setdefault(left, len(group))
            if k == len(group):
                group.append([key, shared, left, doc, place])
                continue
            was = group[k]
            if (was[3], was[4]) == (doc, place):
                continue
            later = max((was[3], was[4]), (doc, place))
            was[3:] = min((was[3], was[4]), (doc, place))
            if len(left) + len(key) - 8 >= length:
                out.append((later[0], later[1] - len(left), later[1] + len(key) - 8))
        if group:
            _judge(group, length, out)
        return _verdicts(out, parts)

    return gathered(by_group(runs, parts, run, DEALT), parts)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(documents: DataFrame, keep_bytes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text, starts, ends in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text or b""
                kept, removed = text, []
                if starts:
                    for s, e in zip(widen(starts).tolist(), widen(ends).tolist()):
                        if removed and s <= removed[-1][1]:
                            removed[-1][1] = max(removed[-1][1], e)
                        else:
                            removed.append([s, e])
                    edges = [0, *(x for r in removed for x in r), len(text)]
                    kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for column, value in zip(rows, (len(text), len(text) - len(kept), len(removed), sha(kept), kept)):
                    column.append(value)
            out = [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[4], pa.binary())] * keep_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    return documents.mapInArrow(run, RESULT + ", kept binary" * keep_bytes)


def remove_repeats(documents: DataFrame, length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    assert length > GRAM
    docs = documents_only(documents)
    shards = shards_for(docs, SHARD_BYTES)
    named = docs.where("doc_id is not null")
    anchors = settle(_recurring(_grams(named, length, shards), shards))
    repeats = settle(_repeats(_runs(named.join(anchors.select("doc_id", "first"), "doc_id"), length, shards), length, shards))
    forget(anchors)
    nothing = F.lit(None).cast("binary")
    null_rows = docs.where("doc_id is null").withColumns({"first": nothing, "second": nothing})
    return _removed(named.join(repeats, "doc_id", "left").union(null_rows), keep_bytes)
