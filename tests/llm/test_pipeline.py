"""Each stage of the pipeline against its operator's plain meaning, on small tables."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.settle(stage(spark, docs, DATA))
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good, bad = ({r.doc_id for r in labels if r.quality == q} for q in (1, 0))
    assert len(good - kept[names[0]]) <= 0.05 * len(good) and len(bad & kept[names[0]]) <= 0.2 * len(bad)
    assert kept[names[3]] == kept[names[4]] < kept[names[0]]


def test_run_gives_tokens(spark):
    out = corpus_pipeline.run(spark, DATA)
    r = out.first()
    assert r.n_tokens == len(r.ids) and out.select("doc_id").distinct().count() == out.count()


def plain_lines(rows):
    from tests.llm.test_dedup import lines_by_hand

    by_hand = lines_by_hand([(i, text) for i, (text, _) in rows.items()])
    out = {}
    for i, (text, n_chars) in rows.items():
        n_lines, n_removed, _, kept = by_hand[i]
        if not n_removed:
            out[i] = text, n_chars
        elif n_removed < n_lines:
            out[i] = kept, len(kept)
    return out


def plain_near_duplicates(rows):
    sets, root = {}, {i: i for i in rows}
    for i, (text, _) in rows.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i: r for i, r in rows.items() if root[i] == i}


def plain_decontaminate(rows, items):
    import re

    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    def grams(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    def covered(a, b):
        """Words of a under greedily marked longest matches of 4 words and more."""
        least, a, b, total = min(4, len(a)), list(a), list(b), 0
        while True:
            best, before = (0, 0, 0), [0] * (len(b) + 1)
            for i, x in enumerate(a):
                now = [0] * (len(b) + 1)
                for j, y in enumerate(b):
                    if x is not None and x == y:
                        now[j + 1] = before[j] + 1
                        n = now[j + 1]
                        best = max(best, (n, -(i - n + 1), -(j - n + 1)))
                before = now
            n, i, j = best[0], -best[1], -best[2]
            if n < least or not n:
                return total
            a[i : i + n], b[j : j + n] = [None] * n, [None] * n
            total += n

    items = [words(x) for x in items if x and words(x)]
    out = {}
    for i, (text, n_chars) in rows.items():
        w = words(text or "")
        near = (x for x in items if grams(x, min(4, len(x))) & grams(w, min(4, len(x))))
        if not any(covered(x, w) >= 0.6 * len(x) for x in near):
            out[i] = text, n_chars
    return out


def test_stages_equal_plain_versions(spark):
    import tokenizers

    from tessera.llm.registry import tokenizer_files

    def rows(df):
        found = df.collect()
        assert len({r.doc_id for r in found}) == len(found)
        return {r.doc_id: (r.text, r.n_chars) for r in found}

    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = {1: plain_lines, 2: plain_near_duplicates, 3: lambda r: plain_decontaminate(r, items)}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        earlier, before = docs, rows(docs)
        docs = corpus_pipeline.settle(stage(spark, docs, DATA))
        after = rows(docs)
        if k:
            assert after == plain[k](before)
            # with a near-copy, a leak and repeated lines among them, so that each stage has something to remove
            text = max((t for t, _ in before.values()), key=len)
            more = [(900_001, text + " more"), (900_002, f"Before it. {max(items, key=len)} After it."), (900_003, f"Something else.\n{text}")]
            full = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in more], earlier.schema).union(earlier)
            before = rows(full)
            want = plain[k](before)
            assert rows(stage(spark, full, DATA)) == want != before
    library = tokenizers.Tokenizer.from_file(str(tokenizer_files()["json_path"]))
    want = {i: library.encode(text or "", add_special_tokens=False).ids for i, (text, _) in after.items()}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_stages_take_any_rows(spark):
    """Nulls in every column, empty texts, repeated rows, ids with two texts, further columns, and no rows at all."""
    text = "one and the same text of some words that go on for a while, as near copies and lines are looked for in it"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " too", None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0), (None, text, "en", "a", 5), (5, "Of.", "en", "a", 3), (5, "Other.", "en", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as bucket", "2 as shard", "'x' as line", "3 as score")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, DATA)
            found = out.collect()
            assert len(found) <= df.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == list(corpus_pipeline.COLUMNS)
                assert name == corpus_pipeline.STAGES[0][0] or df is not docs or {None, 5} <= {r.doc_id for r in found}
