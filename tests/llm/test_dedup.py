"""Removal of repeats and near-duplicates against brute force."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import line_dedup, near_dup, substring_dedup, suffix_dedup
from tessera.llm._graph import components
from tests.llm.conftest import passage


def named(rows):
    return sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0])


def test_words(docs, rows, empty):
    first, split = {}, {}
    for i, t in named(rows):
        w = split[i] = (t or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    out = substring_dedup.remove_repeats(docs, keep_text=True).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert next(r for r in out if r.doc_id is None).n_removed == 0
    assert sum(r.n_removed for r in out) > 500
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_bytes(docs, rows, empty):
    first, want = set(), {}
    for i, t in named(rows):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in first:
                gone[k : k + 100] = b"\1" * 100
            first.add(t[k : k + 100])
        kept = bytes(x for x, g in zip(t, gone) if not g)
        want[i] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    out = suffix_dedup.remove_repeats(docs, keep_bytes=True).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=7))
def test_loser_tree_gives_the_order_and_prefixes(runs):
    coded = []
    for r in runs:
        r = sorted(r)
        coded.append([(k, suffix_dedup.common(r[i - 1], k) if i else 0, b"", 0, 0) for i, k in enumerate(r)])
    out = [(e[0], n) for e, n in suffix_dedup.merged(coded)]
    keys = sorted(k for r in runs for k in r)
    assert [k for k, _ in out] == keys
    assert all(n == suffix_dedup.common(keys[i - 1], keys[i]) for i, (_, n) in enumerate(out) if i)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def groups_by_hand(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j > i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingle_set(t) for i, t in named(rows)}
    root = groups_by_hand(named(rows))
    out = near_dup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    loose = next(r for r in out if r.doc_id is None)
    assert loose.component_id is None and loose.kept
    assert near_dup.near_duplicates(empty).count() == 0


def test_a_document_of_several_texts(spark):
    """A doc_id with two texts is one document: whatever either is near to is in its group."""
    x, y, z = passage(60, 71), passage(60, 72), passage(60, 73)
    rows = [(1, x), (1, y), (2, y), (3, x), (4, x.replace(" ", "  ", 3)), (5, z), (6, z + " more"), (7, z), (7, y), (8, passage(60, 74))]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((i, 8 if i == 8 else 1) for i, _ in rows)


def test_all_pairs_of_a_table(spark):
    """Recall of buckets and sketches on a whole table: the groups are those of all pairs."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = groups_by_hand([tuple(r) for r in table.collect()])
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()} == want


def test_left_over_pairs(spark):
    """The prefix join finds every pair over the threshold in a group of near-copies, and far from all pairs."""
    import random

    r = random.Random(3)
    base = passage(60, 75).split()
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(words))
            words[k : k + 1] = [r.choice("abc")] if r.random() < 0.5 else []
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = df.selectExpr("doc_id as node", "doc_id as component")
    got = {(x.a, x.b) for x in near_dup._prefix_pairs(df, left, 5, 75).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near and near <= got and len(got) < 200 * 199 / 3


@pytest.mark.parametrize("shape", ["path", "zigzag", "random"])
def test_components(spark, shape):
    """Long paths, in order and against it, and scattered links; links that come later join the groups of the first."""
    import random

    r = random.Random(5)
    order = [x for i in range(100) for x in (i, 199 - i)] if shape == "zigzag" else list(range(200))
    links = list(zip(order, order[1:])) if shape != "random" else [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    links += [(500, 501), (501, 500), (7, 7), (900, 900)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: find(i) for i in root}

    def frame(pairs):
        return spark.createDataFrame(pairs, "a long, b long")

    def groups(df):
        rows = df.collect()
        assert len(rows) == len({x.node for x in rows})
        return {x.node: x.component for x in rows}

    assert groups(components(frame(links))) == want
    r.shuffle(links)
    first = components(frame(links[::2]))
    assert groups(components(frame(links[1::2]), known=first)) == want
    assert groups(components(frame([(1, 1)]), known=first)) == groups(first) and groups(components(frame([]))) == {}


def test_each_link_is_looked_at_once(spark, monkeypatch):
    """Groups of further stars start from those of the first: no link goes through the components twice."""
    given = []

    def seen(edges, *args, **more):
        given.extend((x.a, x.b) for x in edges.collect())
        return components(edges, *args, **more)

    monkeypatch.setattr(near_dup, "components", seen)
    words = passage(60, 50).split()[:30]
    groups = [words + passage(60, 60 + g).split() for g in range(4)]
    rows = [(g * 10 + k, " ".join(w[:-k] if k else w)) for g, w in enumerate(groups) for k in range(4)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i // 10 * 10 for i, _ in rows}
    assert given and len(given) == len(set(given))


def test_divided_buckets_are_settled(spark):
    """A bucket of several groups needs more than one star, and the last pairs the exact way."""
    rows = []
    for g in range(4):
        words = passage(60, 50).split()[:30] + passage(60, 60 + g).split()
        for k in range(4):
            rows.append((g * 10 + k, " ".join(words[:-k] if k else words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1, 2):
        out = near_dup.near_duplicates(df, star_rounds=rounds)
        assert {r.doc_id: r.component_id for r in out.collect()} == {i: i // 10 * 10 for i, _ in rows}


def edits(a, b, most=None):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
        if most is not None and min(before) > most:
            return most + 1
    return before[-1]


def lines_by_hand(rows):
    """n_lines, n_removed, n_links and the kept text of each document, every pair of lines compared."""
    lines = [((i, n), x) for i, t in named(rows) for n, x in enumerate((t or "").split("\n")) if t and x.strip(" ")]
    first = {}
    for at, x in lines:
        first.setdefault(x, at)
    sizes = {x: len(x.encode()) for x in first}
    links = {x: [] for x in first}
    for x in first:
        for y in first:
            if x < y and abs(sizes[x] - sizes[y]) <= 2 and (most := min(2, min(sizes[x], sizes[y]) // 20)):
                if edits(x.encode(), y.encode(), most) <= most:
                    links[x].append(y), links[y].append(x)
    want = {}
    for i, t in named(rows):
        own = [(at, x) for at, x in lines if at[0] == i]
        gone = {at[1] for at, x in own if at != first[x] or any(first[y] < first[x] for y in links[x])}
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone) if gone else t
        want[i] = (len(t.split("\n")) if t else 0, len(gone), sum(len(links[x]) for _, x in own), kept)
    return want


def test_lines(docs, rows, empty):
    out = line_dedup.line_duplicates(docs, columns=("lang", "score")).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.kept) for r in out if r.doc_id is not None} == lines_by_hand(rows)
    assert next(r for r in out if r.doc_id == 61).kept.count("\n") == 2 and all(r.lang == "en" for r in out)
    assert line_dedup.line_duplicates(empty).count() == 0


def changed(r, line, times):
    out = list(line)
    for _ in range(times):
        p = r.randint(0, len(out))
        out[p : p + r.randint(0, 1)] = [r.choice("abé ")] * r.randint(0, 1)
    return "".join(out)


@pytest.mark.parametrize("hot", [2, 32])
def test_edited_lines_of_all_lengths(spark, monkeypatch, hot):
    """Short, long and stepwise lengths, ties of place, and parts that many lines share; hot keys are refined and lose nothing."""
    import random

    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    r = random.Random(hot)
    rows = []
    for i in range(60):
        base = "".join(r.choice("abcd é") for _ in range(r.choice([4, 18, 19, 20, 21, 37, 38, 39, 40, 41, 58, 60, 62, 71, 72, 95, 97, 300])))
        texts = [base] + [changed(r, base, r.randint(0, 3)) for _ in range(2)]
        texts += [f"the same beginning of all these lines, then {r.randint(10, 99)} {r.randint(10, 99)} and the same end of them all"]
        rows.append((i // 2 * 2, "\n".join(r.sample(texts, 4))) if i % 7 else (i + 1, "\n".join(texts)))
    rows = list({i: (i, t) for i, t in rows}.values())
    out = line_dedup.line_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.n_links, x.kept) for x in out} == lines_by_hand(rows)
    assert sum(x.n_links for x in out) > 100


@pytest.mark.parametrize("k", [1, 2, 3])
def test_automaton(spark, k):
    import random

    r = random.Random(k)
    pairs = []
    for _ in range(300):
        a = [r.choice(b"abc") for _ in range(r.randint(0, 25))]
        b = list(a)
        for _ in range(r.randint(0, k + 1)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = [r.choice(b"abc")] * r.randint(0, 1)
        pairs.append((bytes(a), bytes(b)))
    for row in line_dedup._with_distance(spark.createDataFrame(pairs, "a binary, b binary"), k).collect():
        d = edits(row.a, row.b)
        assert row.distance == (d if d <= k else None)


def test_lines_that_share_a_beginning_alone_are_not_left_over(spark, monkeypatch):
    import random

    monkeypatch.setattr(line_dedup, "HOT_ROWS", 8)
    r = random.Random(1)
    lines = ["the same beginning of all lines: " + "".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    lines.append(lines[0][:-1] + "x")
    texts = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(lines)], "id long, bytes binary").withColumn("shapes", line_dedup._shapes(2, 20))
    pairs, over = line_dedup._by_segments(texts, 2)
    assert (0, 40) in {(p.x, p.y) for p in pairs.collect()}
    assert over.count() == 0


def test_rows_of_a_key_have_a_partner(spark, monkeypatch):
    """Only rows that can be in a pair under their key go on: an index row before, or for an index row any row after it."""
    import random

    kept = []
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 8)
    monkeypatch.setattr(line_dedup, "forget", lambda *frames: None)
    settle = line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda df: kept.append(out := settle(df)) or out)
    r = random.Random(2)
    base = "".join(r.choice("abcd ") for _ in range(90))
    texts = list({changed(r, base, 2) for _ in range(60)}) + ["ab" * 40, "c" * 70]
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, bytes binary").withColumn("shapes", line_dedup._shapes(2, 20))
    line_dedup._by_segments(frame, 2)
    rows = [(x.key, x.tag) for df in kept if "tag" in df.columns for x in df.collect()]
    index, ids = {}, {}
    for key, tag in rows:
        ids.setdefault(key, set()).add(tag // 2)
        if tag % 2 == 0:
            index.setdefault(key, set()).add(tag // 2)
    assert rows
    for key, tag in rows:
        before = any(i < tag // 2 for i in index.get(key, ()))
        assert before or tag % 2 == 0 and any(i > tag // 2 for i in ids[key])


def test_each_side_of_a_hot_segment_has_its_own_edits(spark, monkeypatch):
    """A text of a family makes few rows on each level, whatever the family's size: 12 and 28 where nothing has moved."""
    import random

    most = []
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 2)
    settle = line_dedup.settle

    def counted(df):
        out = settle(df)
        if "k" in out.columns:
            most.append(max(x["count"] for x in out.groupBy("id").count().collect()))
        return out

    monkeypatch.setattr(line_dedup, "settle", counted)
    for family in (20, 60):
        r = random.Random(3)
        base = "".join(r.choice("abcdefghijklmnop") for _ in range(150))
        texts = [base]
        for _ in range(family):
            line = list(base)
            for at in r.sample(range(150), 2):
                line[at] = "#"
            texts.append("".join(line))
        frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(dict.fromkeys(texts))], "id long, bytes binary").withColumn("shapes", line_dedup._shapes(2, 20))
        most.clear()
        line_dedup._by_segments(frame, 2)
        assert len(most) == 2 and most[0] <= 12 and most[1] <= 28


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_no_pair_is_lost_under_hot_keys(spark, monkeypatch, edits):
    """Of a family with all kinds of edits, each pair within them meets, or both are left over."""
    import random

    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    r = random.Random(edits)
    texts = []
    for n in (61, 97, 260):
        base = "".join(r.choice("abcdefgh ") for _ in range(n))
        texts += [base, *(changed(r, base, r.randint(1, edits)) for _ in range(22))]
    texts = [t for t in dict.fromkeys(texts) if len(t) >= 20]
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, bytes binary").withColumn("shapes", line_dedup._shapes(edits, 20))
    pairs, over = line_dedup._by_segments(frame, edits)
    met, left = {tuple(sorted(p)) for p in pairs.collect()}, {x.id for x in over.collect()}
    all_pairs = [(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) <= edits]
    by_bytes = [t.encode().decode("latin-1") for t in texts]
    within = spark.createDataFrame([(i, j, by_bytes[i], by_bytes[j]) for i, j in all_pairs], "i int, j int, a string, b string").where(f"levenshtein(a, b) <= least({edits}, least(length(a), length(b)) div 20)").collect()
    assert len(within) > 30
    assert [(x.i, x.j) for x in within if (x.i, x.j) not in met and not {x.i, x.j} <= left] == []
