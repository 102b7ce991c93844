"""Search, decontamination and the two classifiers."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import ann, quality, tiling, toxicity

DATA = "/root/testdata/sf0.01"


def test_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((5, 24))
    x = (centres[rng.integers(0, 5, 400)] + 0.4 * rng.standard_normal((400, 24))).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] * 24, 1), (504, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    out = ann.search(df, df.where("vec_id % 20 = 0"), k=10, block_rows=40, query_rows=8).collect()
    found = hit = 0
    for q in range(0, 400, 20):
        score = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, *_ in got] == list(range(1, 11))
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in got)
        found += 10
        hit += len({i for _, i, _ in got} & set(order))
    assert hit / found >= 0.9
    assert len(out) == found
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def nearest_by_hand(rows, k):
    """The k best candidates of each query, with exact sums in the order of the components."""
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for own, q in sorted({(i, tuple(v)) for i, v in usable if i % 20 == 0}):
        scores = []
        for i, v in usable:
            if i != own and len(v) == len(q):
                total = 0.0
                for a, b in zip(v, q):
                    total += a * b
                scores.append((-total, i))
        out += [(own, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_search_of_doubles(spark):
    """Doubles that floats can't tell apart, very large and small ones, ties, and repeated rows and queries."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(round(c, 2)) for c in rng.standard_normal(3)]) for i in range(1, 60)]
    rows += [(0, [1.0, 1.0, 0.0]), (0, [1.0, 1.0, 0.0]), (5, [1.0 + 1e-12, 1.0, 0.0]), (6, [1.0, 1.0, 0.0]), (6, [1.0, 1.0, 0.0]), (100, [1e300, 1.0, 0.0]), (101, [1e-300, 1e-300, 0.0]), (120, [1e-9, 0.0, 1.0]), (121, [2.0]), (140, [3.0]), (160, None), (180, [0.0, 0.0, 0.0])]
    for k, options in ((5, {}), (30, {"block_rows": 10, "query_rows": 2}), (4, {"block_rows": 10, "exact": True})):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        out = ann.search(df, df.where("vec_id % 20 = 0"), k=k, **options).collect()
        want = nearest_by_hand(rows, k)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want


def test_search_recall(spark):
    """Recall of whole tables against the exact mode, and lists that bounds leave out."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = df.where("vec_id % 20 = 0")
    key = ["query_id", "vec_id"]
    exact = ann.search(df, queries, exact=True).select(key)
    found = ann.search(df, queries, block_rows=64).select(key)
    assert exact.count() == found.count() == 2000
    assert found.join(exact, key).count() >= 0.98 * 2000


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((500, 64)).astype(np.float32), rng.standard_normal((20, 64))
    estimate, error = ann.estimates(*ann.encode(x), q, 3.0)
    assert (np.abs(estimate - q @ x.T.astype(float)) <= error).mean() > 0.99


def test_tiles():
    item = np.arange(12, dtype=np.uint64)
    doc = np.array([*range(6, 12), 99, *range(0, 6), 98], np.uint64)
    assert sorted(tiling.tiles(item, doc, 4)) == [(0, 7, 6), (6, 0, 6)]
    assert tiling.tiles(item[:2], np.array([5, 0, 1], np.uint64), 4) == [(0, 1, 2)]
    assert tiling.tiles(item, doc[:0], 4) == []


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "one two three"), (None, "x")], "item_id long, text string")
    rows = [(1, "foo epsilon, zeta ETA theta bar Alpha beta gamma delta"), (2, "alpha beta gamma delta only"), (3, "alpha beta epsilon zeta gamma eta"), (4, None), (5, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (24, 6):  # a filter that lets nearly all through changes nothing
        out = tiling.leaks(df, items, filter_bits=bits)
        assert sorted((r.doc_id, r.item_id, r.n_tiles) for r in out.collect()) == [(1, 1, 2), (5, 4, 1)]
    assert sorted(r.doc_id for r in tiling.clean(df, items).collect()) == [2, 3, 4]
    assert tiling.leaks(empty, items).count() == 0 and tiling.leaks(df, items.limit(0)).count() == 0


def tiles_by_hand(item, doc, least):
    """Greedy string tiling from all pairs of places."""
    least, free_a, free_b, out = min(least, len(item)), set(range(len(item))), set(range(len(doc))), []
    while least:
        found = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n in free_a and j + n in free_b and item[i + n] == doc[j + n]:
                    n += 1
                found.append((-n, i, j))
        most = -min(found, default=(0,))[0]
        if most < least:
            break
        for _, i, j in sorted(f for f in found if f[0] == -most):
            if set(range(i, i + most)) <= free_a and set(range(j, j + most)) <= free_b:
                free_a -= set(range(i, i + most))
                free_b -= set(range(j, j + most))
                out.append((i, j, most))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=24), st.integers(1, 4))
def test_tiles_against_all_pairs_of_places(item, doc, least):
    assert tiling.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least) == tiles_by_hand(item, doc, least)


def test_leaks_by_hand(spark, docs, rows, empty):
    """Every document against every item: repeated rows and items, reordered passages, one long text, ids with several texts."""
    from tests.llm.conftest import passage

    words = passage(40, 1).split()  # the fixture's documents 10 to 21 share these
    items = [(1, " ".join(words[:20])), (2, " ".join(words[20:30] + words[5:15])), (3, " ".join(words[:6]) + " but this is another matter " + passage(20, 900)), (4, passage(3000, 6)[-300:].upper()), (4, "xyz xyz xyz xyz xyz xyz"), (5, "Short."), (5, "Short."), (6, "one, two"), (7, None), (None, "of")]
    table = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, seed double")
    want = []
    for d, text in rows:
        doc = tiling.words_of(text)
        for i, t in items:
            item = tiling.words_of(t)
            if d is not None and i is not None and item:
                if len(item) >= 4 and not {tuple(item[k : k + 4]) for k in range(len(item) - 3)} & {tuple(doc[k : k + 4]) for k in range(len(doc) - 3)}:
                    continue
                found = tiles_by_hand(item, doc, 4) if len(doc) < 400 else tiling.tiles(*(np.array([hash(w) & (1 << 62) - 1 for w in s], np.uint64) for s in (item, doc)), 4)
                covered = sum(n for *_, n in found)
                if covered >= 0.6 * len(item):
                    want.append((d, i, len(item), covered, len(found)))
    out = tiling.leaks(docs, table).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words, r.covered_words, r.n_tiles) for r in out) == sorted(want)
    assert {i for _, i, *_ in want} == {1, 2, 4, 5, 6}


def held_out_counts(scores, labels, label):
    rows = scores.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()
    return np.array([[sum(r[label] == y and r.predicted == p for r in rows) for p in (0, 1)] for y in (0, 1)])


def test_quality(spark):
    documents, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    c = held_out_counts(quality.quality_scores(documents, labels), labels, "quality")
    assert np.trace(c) / c.sum() >= 0.97


def plain_statistics(text):
    """The 19 statistics, counted one by one."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    odds = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n", ".,;:", "!?", "|<>{}[]\\/_=", "#$%&*@^~+"]
    n, m, low = len(data), len(words), [w.lower() for w in words]
    out = [math.log(1 + n), math.log(1 + m)] + [odds(sum(chr(c) in kind for c in data), n) for kind in kinds] + [odds(sum(c >= 128 for c in data), n)]
    out.append(odds(len(set(low)), m) / (1 + 0.2 * math.log(1 + m)))
    out.append(odds(sum(low[i] == low[i + 1] for i in range(m - 1)), max(0, m - 1)))
    out.append(odds(len(lines) - len(set(lines)), len(lines)))
    out.append(math.log(1 + n / max(1, m)))
    out.append(-sum(data.count(c) / n * math.log2(data.count(c) / n) for c in set(data)) if n else 0.0)
    out.append(odds(sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in words), m))
    out.append(odds(sum(w.isupper() for w in words), m))
    return out


def test_quality_against_a_plain_discriminant(spark):
    """Scores of a whole table from densities with explicit inverses and determinants."""
    import zlib

    data = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in documents.collect()}
    own = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sets = [np.array([v for v, y in own if y == k]) for k in (0, 1)]
    cov = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, cov)) / len(own)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(19)
    full = [c + (p - c) * w for c, p, w in ((c, pooled, 0.05 * len(own) / (0.05 * len(own) + len(s))) for s, c in zip(sets, cov))]

    def density(v, k):
        d = v - sets[k].mean(axis=0)
        return math.log(len(sets[k]) / len(own)) - d @ np.linalg.inv(full[k]) @ d / 2 - np.linalg.slogdet(full[k])[1] / 2

    for r in quality.quality_scores(documents, labels).collect():
        gap = max(-50.0, min(50.0, density(x[r.doc_id], 0) - density(x[r.doc_id], 1)))
        assert r.score == pytest.approx(1 / (1 + math.exp(gap)), abs=1e-5)
        assert r.predicted == (r.score >= 0.5)


def test_toxicity(spark):
    documents, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    c = held_out_counts(toxicity.toxicity_scores(documents, labels), labels, "toxic")
    assert c[0, 1] <= 0.03 * c[0].sum() and c[1, 1] >= 0.6 * c[1].sum()


def test_restoration(spark):
    df = spark.createDataFrame([(i, "the idiot and the loser are here with other words of the text") for i in range(20)], "doc_id long, text string")
    model = toxicity.character_model(df)
    for token, word in (("1d10t", "idiot"), ("l0$er", "loser"), ("i.d.i.o.t", "idiot"), ("looooser", "loser")):
        assert word in toxicity.restored(token, model)
    assert toxicity.spelled("what l o s e r you are".split()) == ["loser"]
    assert "idiot" not in toxicity.restored("2024", model)


@pytest.fixture(scope="module")
def letters(spark):
    """The character model of the small documents."""
    return toxicity.character_model(spark.read.parquet(f"{DATA}/documents.parquet"))


@settings(max_examples=80, deadline=None)
@given(token=st.text("aeilost10$!.@*", min_size=1, max_size=7))
def test_best_reading_against_all_readings(letters, token):
    """The Viterbi path costs what the cheapest of all readings in the lattice costs."""
    options = [letters.options(m[1], len(m[0])) for m in toxicity._RUNS.finditer(token)]

    def cost(reading, price):
        codes = [0, 0, *map(letters.code, reading), 0]
        return price + sum(letters.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    all_readings: dict[str, float] = {}
    for path in itertools.product(*options):
        reading, price = "".join(x for x, _ in path), sum(p for _, p in path)
        all_readings[reading] = min(all_readings.get(reading, math.inf), cost(reading, price))
    found = letters.restore(token)
    if len(all_readings) == 1 and "" in all_readings:
        assert found == []
    else:
        best = min(c for r, c in all_readings.items())
        first = found[0] if found else ""
        assert all_readings[first] == pytest.approx(best) or min(all_readings, key=all_readings.get) == ""


def test_long_strings_are_read_whole(letters):
    fill = [f"word{'abcdefgh'[i % 8]}" for i in range(80)]
    for joint in (",", "...", "_", "/", "\u200b"):
        for at in (3, 40, 79):
            for token, word in (("idiot", "idiot"), ("1d10t", "idiot")):
                assert word in toxicity.restored(joint.join([*fill[:at], token, *fill[at:]]), letters), (joint, at, token)
    assert "idiot" in toxicity.restored(",".join([*fill[:50], *"idiot", *fill[50:]]), letters)
    assert "idiot" in toxicity.restored("youarean" * 9 + "idiot" + "youarean" * 9, letters)
    assert "idiot" in toxicity.restored("x" + "-." * 60 + "idiot" + ".-" * 60 + "x", letters)
    for text in ("-." * 60, "日本語テキスト。" * 30, "ab12" * 600, "(c" * 60):
        letters.words(text)
    assert toxicity.apart([(0, 9, 0.5, "a"), (0, 4, 0.9, "b"), (4, 9, 0.4, "c"), (4, 9, 0.4, "d")]) == [(0.9, "b"), (0.4, "c")]


def test_spelled_runs_hold_words(letters):
    def found(text):
        return toxicity.readings(text, letters, {})

    for text, word in (("what a l o s e r", "loser"), ("y o u i d i o t", "idiot"), ("l o s e r.", "loser"), ("so (i d i o t) it is", "idiot"), ("y o u 1 d 1 0 t", "idiot")):
        assert word in found(text), text
    for before in (0, 2, 3, 7):
        text = "y o u a r e " * before + "a n i d i o t " + "a n d t h e y a r e " * 5
        assert "idiot" in found(text), before
    assert toxicity.spelled("l o s e r.".split()) == ["loser"] and toxicity.spelled("a b".split()) == []


def test_pieces_between_marks_are_read(letters):
    tokens = [(x, "idiot") for x in ("you,idiot", "end.Idiot", "nice/idiot", "word—idiot", "my2idiot", "you,1d10t", "wow!1d10t", "y,o,u,i,d,i,o,t")]
    for token, word in [*tokens, ("4$$", "as"), ("455", "as"), ("i.d.i.o.t", "idiot")]:
        assert word in toxicity.restored(token.lower(), letters), token


def test_scores_at_the_edges(spark):
    """A tie at the threshold counts as 1, and a text of many megabytes is scored whole."""
    long = "good words of a text. " * 150_000
    df = spark.createDataFrame([(1, long), (2, "idiot"), (3, "idiot"), (3, "other")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in quality.quality_scores(df, none).collect()] == [(0.5, 1)] * 4
    assert [(r.score, r.predicted) for r in toxicity.toxicity_scores(df, none).collect()] == [(0.0, 0)] * 4


def test_edge_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([(4, 1, 0), (70, 0, 1), (71, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        out = f(docs, labels).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert f(docs, labels.limit(0)).count() == len(rows)
        assert f(empty, labels).count() == 0


def test_folds(spark):
    import zlib

    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), quality.held_out("id", 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
