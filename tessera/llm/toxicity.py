"""Toxicity by noisy-channel deobfuscation and a learned lexicon.

1. A character language model: trigram counts over the letters of all
   documents, summed per slice and then over the corpus.
2. Restoration: a word with digits or symbols that may stand for letters, one that
   repeats a letter three times or more, or single letters in a row are a lattice:
   each character may stand for letters (leetspeak), for nothing (spacing), and a
   run of one letter for fewer of it (repetition), each at a channel cost.
   Viterbi decoding under the language model gives the best readings.  A string
   with marks inside is also read as its letter pieces and its pieces between
   the marks.  A string of more than 40 runs of characters may hold many words: it
   is also read in overlapping windows in which the lattice places boundaries of
   words, over its whole length.  Single letters in a row, however many, are read
   in the same windows.
3. The lexicon: words and word beginnings of labelled training texts, each with
   the Wilson lower bound of the share of toxic texts among those that hold it.
   Near-copies count once, and a bound far from chance is asked of an entry.
   A text's score is the noisy-or of the squared bounds of its three worst words,
   restored words among them: one sure word is enough, a weak one needs company,
   and length alone adds nothing.  Readings that overlap in a string are one word.

A word has at most READINGS readings, of the PATHS best spellings that the decoder
keeps for each pair of last letters; a text's score takes its TOP_WORDS worst
words.  These are parameters of the decoder and the score, not of the input.
The lexicon is learned from ``sample_rows`` labelled rows at most (the least
hashes of doc_id) and keeps ``max_entries`` entries.
The language model and the scores cover all documents and whole texts.

Cases: null, empty and blank texts score 0.  Null labels aren't learned from;
of repeated labels of a doc_id the largest counts.  Without labelled rows every
score is 0.  Every row gives a row.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, documents_only, mix, odd_multipliers, slices, utf8
from tessera.llm.near_dup import shingles
from tessera.llm.quality import held_out

#: What a character can stand for besides itself, as commonly used in disguises.
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u", "×": "x", "ø": "o",
}
FILLERS = ".,-_~'`*^:;/\\#=​­·•"
SYMBOL_COST, FILLER_COST, DROP_COST, REPEAT_COST, WILD_COST = 0.7, 0.3, 2.5, 0.5, 2.0
READINGS, PATHS = 8, 4  # of a word, and kept for each pair of last letters
TOP_WORDS = 3  # a score takes a text's worst words together
LONGEST = 40  # runs of a disguised word; a longer string is several words
WINDOW = 1000  # runs of a long string that are divided at once
BEAM, MARGIN = 10.0, 5.0  # what a word in hand, and a whole division, may cost more than the best

_EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»“”‘’*_-~|%&#"
_ODD = re.compile(rf"(?=.*[^\W\d_]|.*[{re.escape(''.join(DISGUISES))}])(?:.*[^\w]|.*[\d_]|.*(.)\1\1)", re.DOTALL)
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_MARKS = re.escape(_EDGES.strip())
_SINGLE = rf"(?:[{_MARKS}]*+[^{_MARKS}\s][{_MARKS}]*+|[{_MARKS}])"
_SPELLED = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}(?!\S)){{2}}")  # three words of one character each
_OTHERS = re.compile(r"[^\W\d_a-z]{4,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_CHUNKS = re.compile(r"(?:[^\W_]|[@$€£¡µ×])+"), re.compile(r"(?:[^\W_]|[@$€£¡µ×!|+(])+")  # marks as joints, and as letters
_CODES = np.zeros(256, np.int64)
_CODES[np.arange(97, 123)] = np.arange(1, 27)
_CODES[np.arange(65, 91)] = np.arange(1, 27)
_CODES[128:] = 27


def collapsed(word: str) -> str:
    return _RUNS.sub(r"\1", word)


def short(token: str) -> bool:
    return len(token) <= LONGEST or len(list(islice(_RUNS.finditer(token), LONGEST + 1))) <= LONGEST


def windows(token: str, start: int, end: int) -> Iterator[tuple[list[re.Match], bool, bool]]:
    """The runs of a part of a string in windows that overlap by 2 * LONGEST, and whether one is the first or the last."""
    part: list[re.Match] = []
    first = True
    for m in _RUNS.finditer(token, start, end):
        if len(part) == WINDOW:
            yield part, first, False
            part, first = part[-2 * LONGEST :], False
        part.append(m)
    if part:
        yield part, first, True


class CharacterModel:
    """Trigram costs (negative log probabilities) over boundary, a-z and other letters."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(28, 28, 28).astype(np.float64)
        low = c.sum(axis=(0, 1)) + 0.5
        low /= low.sum()
        two = c.sum(axis=0) + 4 * low
        two /= two.sum(axis=1, keepdims=True)
        three = c + 4 * two[None, :, :]
        self.cost = (-np.log(three / three.sum(axis=2, keepdims=True))).tolist()

    @staticmethod
    def code(letter: str) -> int:
        return ord(letter) - 96 if "a" <= letter <= "z" else 27

    def restore(self, token: str) -> list[str]:
        """The best readings of a disguised word, best first."""
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for m in _RUNS.finditer(token):
            options = self.options(m[1], len(m[0]))
            new: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), paths in states.items():
                for letters, price in options:
                    x, y, added = a, b, price
                    for letter in letters:
                        z = self.code(letter)
                        added += self.cost[x][y][z]
                        x, y = y, z
                    new.setdefault((x, y), []).extend((cost + added, out + letters) for cost, out in paths)
            states = {k: sorted(paths)[:PATHS] for k, paths in new.items()}
        ends = sorted((cost + self.cost[a][b][0], out) for (a, b), paths in states.items() for cost, out in paths)
        return [out for _, out in ends[:READINGS] if out]

    def words(self, token: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, readings) of the words in a string of any length that may hold several.

        Windows overlap by more than a word, and a word that a window may cut is left to the other one.
        Letters outside a-z are one sign to the model, which can't tell words among them: four in a row stay together.
        """
        spans: dict[tuple[int, int], None] = {(0, len(token)): None} if short(token) else {}
        at = 0
        for m in [*_OTHERS.finditer(token), None]:
            for part, first, last in windows(token, at, m.start() if m else len(token)):
                low, high = part[0].start(), part[-1].end()
                spans.update(dict.fromkeys((i, j) for i, j in self.divided(part) if (first or i > low) and (last or j < high)))
            if m:
                at = m.end()
                spans[m.span()] = None
        found = ((i, j, (collapsed(x),) if _OTHERS.fullmatch(x) else tuple(dict.fromkeys(map(collapsed, self.restore(x))))) for i, j in spans for x in [token[i:j]])
        return [f for f in found if f[2]]

    def divided(self, runs: list[re.Match]) -> list[tuple[int, int]]:
        """The words of all divisions of the runs into words that cost little more than the best one."""
        cost = self.cost
        ends: dict[int, tuple[float, int]] = {runs[0].start(): (0.0, 0)}  # place: least cost of a boundary there, letter before it
        begun: dict[int, int] = {}
        arcs: dict[tuple[int, int], float] = {}
        active: dict[tuple[int, int, int], float] = {}  # (place of the word's start, last two letters): cost

        def end(place: int, hypotheses: dict[tuple[int, int, int], float], last: bool = False) -> None:
            for (start, x, y), c in hypotheses.items():
                if y or last:
                    c += cost[x][y][0] if y else 0.0
                    arcs[start, place] = min(arcs.get((start, place), math.inf), c - ends[start][0])
                    if place not in ends or c < ends[place][0]:
                        ends[place] = c, y

        def moved(hypotheses: dict[tuple[int, int, int], float], letters: str, price: float, out: dict) -> None:
            for (start, x, y), c in hypotheses.items():
                if y and k - begun[start] >= LONGEST if letters else k and k == begun[start]:
                    continue  # too long, or a word that would begin with a mark
                c += price
                for letter in letters:
                    z = self.code(letter)
                    c += cost[x][y][z]
                    x, y = y, z
                if c < out.get((start, x, y), math.inf):
                    out[start, x, y] = c

        for k, m in enumerate(runs):
            if m.start() in ends:
                begun[m.start()] = k
                c, letter = ends[m.start()]
                active[m.start(), letter, 0] = c
            new: dict[tuple[int, int, int], float] = {}
            inside = m.end() - 1
            halves: dict[tuple[int, int, int], float] = {}
            options = self.options(m[1], len(m[0]))
            for letters, price in options:
                moved(active, letters, price, new)
                if len(letters) == 2:
                    moved(active, letters[0], price, halves)
            if halves:  # one word ends with the letter, the next begins with it
                end(inside, halves)
                begun[inside] = k
                for letters, _ in options:
                    if len(letters) == 2:
                        moved({(inside, ends[inside][1], 0): ends[inside][0]}, letters[0], 0.0, new)
            least = min(new.values()) + BEAM
            active = {h: c for h, c in new.items() if c <= least}
            end(m.end(), active, k == len(runs) - 1)
        rest = {runs[-1].end(): 0.0}
        into = sorted(arcs.items(), key=lambda a: -a[0][1])
        for (start, place), c in into:
            if place in rest:
                rest[start] = min(rest.get(start, math.inf), c + rest[place])
        best = rest[runs[0].start()] + MARGIN
        return [(i, j) for (i, j), c in into if j in rest and ends[i][0] + c + rest[j] <= best]

    @staticmethod
    def options(c: str, n: int) -> list[tuple[str, float]]:
        """What a run of n equal characters may stand for, and its price."""
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, REPEAT_COST * (n > 1)))
            if n > 1:
                options.append((c * 2, REPEAT_COST * (n > 2)))
        for letter in DISGUISES.get(c, ""):
            options.append((letter, SYMBOL_COST))
            if n > 1:
                options.append((letter * 2, SYMBOL_COST))
        if c in FILLERS:
            options.append(("", FILLER_COST))
            if c == "*" and n == 1:
                options += [(x, WILD_COST) for x in "aeiou"]
        elif not c.isalpha() and (c not in DISGUISES or c in "!|(+"):
            options.append(("", DROP_COST))
        return options


def readings(text: str, model: CharacterModel, cache: dict) -> set[str]:
    """All distinct words of a text, restored."""
    low = text.lower()
    words = low.split()
    out: set[str] = set()
    for w in set(words):
        known = cache.get(w)
        if known is None:
            known = restored(w, model)
            if len(w) <= 4 * LONGEST:
                cache[w] = known
            if len(cache) > 300_000:
                cache.clear()
        out.update(known)
    for token in spelled(words) if _SPELLED.search(low) else ():
        out.update(x for _, _, found in model.words(token) for x in found)
    return out


def restored(word: str, model: CharacterModel) -> tuple[str, ...]:
    """The readings of one word in lower case, without repeated letters."""
    return tuple(dict.fromkeys(x for _, _, found in spans(word, model) for x in found))


def spans(word: str, model: CharacterModel) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, readings) of a word in lower case and of the words inside it, without repeated letters.

    Spans that overlap are different readings of the same characters.
    """
    if len(word) <= LONGEST and word.isalpha() and not _TRIPLE.search(word):  # a plain word, by far the most
        return [(0, len(word), (collapsed(word),))]
    bare = word.strip(_EDGES)
    found = [collapsed(bare)] if bare.isalpha() else []
    for x in {word.strip(_EDGES.replace("!", "").replace("|", "").replace("(", "")), bare}:
        if short(x) and _ODD.match(x):
            found += map(collapsed, model.restore(x))
    out = [(0, len(bare), tuple(dict.fromkeys(found)))] if found else []
    if bare.isalpha() and short(bare):
        return out
    out += [(m.start(), m.end(), (collapsed(m[0]),)) for m in _LETTERS.finditer(bare)]
    for chunks in _CHUNKS:
        parts = list(chunks.finditer(bare))
        for m in parts if len(parts) > 1 else ():
            if short(m[0]) and _ODD.match(m[0]):
                out.append((*m.span(), tuple(dict.fromkeys(map(collapsed, model.restore(m[0]))))))
    if not short(bare) or sum(len(m[0]) == 1 for m in parts) >= 3:
        out += model.words(bare)
    return list(dict.fromkeys(out))


def apart(hits: list[tuple[int, int, float, str]]) -> list[tuple[float, str]]:
    """The highest of the (start, end, bound, word) that do not overlap; of equal ones the shorter."""
    taken: list[tuple[int, int]] = []
    out = []
    for i, j, bound, word in sorted(hits, key=lambda h: (-h[2], h[1] - h[0], h)):
        if all(j <= a or b <= i for a, b in taken):
            taken.append((i, j))
            out.append((bound, word))
            if len({w for _, w in out}) == TOP_WORDS:
                break
    return out


def spelled(words: list[str]) -> list[str]:
    """What is spelled out as single characters in a row, of any length; marks at a character stay as a filler."""
    out, run = [], []
    for w in [*words, "  "]:
        bare = w if len(w) == 1 else w.strip(_EDGES)
        if len(bare) == 1:
            if run and w[0] != bare:
                run.append(".")
            run.append(bare)
            if w[-1] != bare:
                run.append(".")
            continue
        if len(run) >= 3:
            token = "".join(run).strip(".")
            if len(token.replace(".", "")) >= 3:
                out.append(token)
        run = []
    return out


def features(word: str) -> list[str]:
    """A word and its beginnings, which carry the stems of inflected words."""
    return ["=" + word] + [word[:n] for n in (4, 5) if len(word) > n]


def wilson(hits: float, n: float, z: float = 1.64) -> float:
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def letter_trigrams(documents: DataFrame) -> DataFrame:
    """(code, n): letter trigrams of all texts, summed per slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                c = _CODES[np.frombuffer(b"  " + b"  ".join(t or b"" for t in texts[i:j]) + b"  ", np.uint8)]
                codes = (c[:-2] * 28 + c[1:-1]) * 28 + c[2:]
                n = np.bincount(codes[(c[1:-1] > 0) | (c[2:] > 0)], minlength=28**3)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["code", "n"])

    return documents_only(documents).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(documents: DataFrame) -> CharacterModel:
    counts = np.zeros(28**3)
    for r in letter_trigrams(documents).collect():  # 28 ** 3 rows at most
        counts[r.code] = r.n
    return CharacterModel(counts)


def one_of_each(sampled: DataFrame, rows: int = 3, bands: int = 6) -> list[int]:
    """The smallest doc_id of each group of near-copies among the sampled texts (5-word shingles, banded minima).

    sampled has doc_id and text of at most as many documents as the lexicon's sample, so groups are found on the driver.
    """
    factors = odd_multipliers(rows * bands, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            keys = []
            for text in utf8(batch.column(1)):
                h = shingles(text, hashes)
                least = np.array([mix(h * f).min() for f in factors]).reshape(bands, rows) if len(h) else np.empty((0, rows), np.uint64)
                keys.append([int(x) for x in (mix(mix(least[:, 0]) + least[:, 1]) * np.uint64(3) + least[:, 2]).view(np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    least: dict[int, int] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in sampled.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>").collect():
        parent.setdefault(r.doc_id, r.doc_id)
        for key in r["keys"]:
            a, b = root(r.doc_id), root(least.setdefault(key, r.doc_id))
            parent[max(a, b)] = min(a, b)
    return sorted({root(x) for x in parent})


def lexicon(documents: DataFrame, labels: DataFrame, label: str, model: CharacterModel, sample_rows: int = 20_000, max_entries: int = 20_000) -> dict[str, float]:
    """Words and beginnings of toxic texts, with the lower bound of the toxic share of the labelled texts that hold them."""
    docs = documents_only(documents)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    sample = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    spark = docs.sparkSession
    sampled = docs.join(F.broadcast(sample), "doc_id")  # sample_rows rows of 12 bytes
    once = spark.createDataFrame([(i,) for i in one_of_each(sampled)], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["entry", "n", "hits"])
            counts.clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in readings(text or "", model, cache) for f in features(w)}:
                    c = counts.get(f)
                    if c is None:
                        c = counts[f] = [0, 0]
                    c[0] += 1
                    c[1] += y
                if len(counts) > 300_000:
                    yield out()
        if counts:
            yield out()

    train = sampled.join(F.broadcast(once), "doc_id").select("text", "label")
    sums = train.mapInArrow(run, "entry string, n long, hits long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    best = sums.where("hits >= 4 and hits * 3 >= n").orderBy(F.desc(F.col("hits") * F.col("hits") / F.col("n")), "entry").limit(max_entries)
    return {r.entry: wilson(r.hits, r.n) for r in best.collect() if wilson(r.hits, r.n, 3.3) >= 0.3}


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the restored word that decided, for every document."""
    docs = documents_only(documents)
    model = character_model(docs)
    entries = lexicon(docs, labels.where(~held_out("doc_id", 4, 2)), "toxic", model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[tuple[float, str]]] = {}
        nothing = (0.0, "")

        def worst(words) -> tuple[float, str]:
            return max(((entries.get(f, 0.0), w) for w in words for f in features(w)), default=nothing)

        def hits_of(found) -> list[tuple[float, str]]:
            return apart([(i, j, *hit) for i, j, words in found if (hit := worst(words))[0]])

        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                low = text.lower() if text else ""
                words, hits = low.split(), []
                for w in set(words):
                    found = memory.get(w)
                    if found is None:
                        found = hits_of(spans(w, model))
                        if len(w) <= 4 * LONGEST:
                            memory[w] = found
                    hits += found
                for token in spelled(words) if _SPELLED.search(low) else ():
                    hits += hits_of(model.words(token))
                hits = sorted(set(hits), reverse=True)
                if len(memory) > 400_000:
                    memory.clear()
                rows.append((1 - math.prod(1 - bound**2 for bound, _ in hits[:TOP_WORDS]), hits[0][1] if hits else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(s, 9) for s, _ in rows], pa.float64()), pa.array([w for _, w in rows], pa.string())], ["doc_id", "score", "word"])

    scores = docs.mapInArrow(run, "doc_id long, score double, word string")
    return scores.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "word")
