"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line goes if it isn't the first occurrence of its text, or if another text
within so many edits (of UTF-8 bytes) occurs earlier; both are judged on the
input.  Order is by doc_id, then line number.  Two texts may differ by one edit
for each ``bytes_per_edit`` bytes of the shorter one, ``edits`` at most; texts
under ``bytes_per_edit`` bytes are compared for equality.  Blank lines are left
alone.

1. Equal lines are one text with its first occurrence (partial aggregation, so
   a line in a third of the documents is no hot key).
2. A text has ``edits + 1`` segments of one width: the first ones at places
   counted from its start, the others from its end.  The width follows the
   length in steps (the two highest bits of length / (edits + 1)), so texts of
   nearly equal length have equal widths, and those next to a step take part
   with both.  Of two texts within the edits, one segment is untouched, with at
   most as many edits before it as it has segments before it (and likewise
   after it): the index has each text's segments, and a text probes it at the
   few places to which so many edits can have moved them, 3 + 2 keys for 2 edits.
3. Texts that share a key are pairs, but for hot keys (a beginning that many lines
   share).  Under a hot key the rest of each text is two parts, before and after
   the segment, each with edits of its own by 2: none or one for each segment that
   lies there.  Those without edits are empty; the others are texts of their own,
   and the first of them meets by 2 again, among the texts of that key alone and
   with its own edits only.  What it leaves comes last, so parts are cut in turn,
   ``LEVELS`` times in all at most.  So a text with 2 edits has 5, 16 and 44 keys,
   of each width, on the three levels at most, whatever the size of its family.
   Texts that still have hot keys are families of long near-copies.  They
   meet by their rarest grams: ``edits`` edits touch at most ``edits`` * 5 of a
   text's runs of 5 bytes and move the others by ``edits`` places, so of the
   5 * ``edits`` + 1 rarest of each, two texts have one in common at nearly the
   same place (prefix filter).  What makes a key hot is frequent, and comes last
   in that order.
4. Pairs are verified by a banded bit-parallel automaton: common ends are cut
   off, and for each number of edits the 2 * edits + 1 diagonals around the main
   one are bits of a word that each byte moves on.

Cases: null and empty texts have no lines.  Rows that share doc_id and text are
one document; rows that share doc_id alone come in the order of their texts'
hash.  Rows with a null doc_id keep all lines and take none from others.  Texts
without a repeated line stay as they are.  Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import forget, settle, shuffle_parts

#: Texts under keys of more rows than this meet by their rarest grams; grams of more texts are frequent.
HOT_ROWS = 32
GRAM = 5
#: So often a text is cut at a segment under a hot key.
LEVELS = 3
#: A part is cut on while its segments have so many bytes at least.
LEAST_SEGMENT = 4
#: Grams meet where length and place, by steps of so many bytes, are the same or next to each other.
LENGTH_STEP, PLACE_STEP = 16, 64


def _allowed(length: Column, edits: int, bytes_per_edit: int) -> Column:
    return F.least(F.lit(edits), F.floor(length / bytes_per_edit).cast("int"))


def _width(q: str) -> str:
    """SQL: the two highest bits of q."""
    return f"shiftleft(shiftright({q}, greatest(length(bin({q})) - 2, 0)), greatest(length(bin({q})) - 2, 0))"


def _shapes(edits: int, bytes_per_edit: int) -> Column:
    """The (e, w), edits and segment width, with which a text can meet one that is no longer: its own and those of texts shorter by up to ``edits``.

    w is the two highest bits of length / (e + 1): 1, 2, 3, 4, 6, 8, 12, 16, ...  Packed as e * 2 ** 32 + w.
    """
    e = f"least({edits}, n div {bytes_per_edit})"
    lengths = f"transform(sequence(0, {edits}), s -> octet_length(bytes) - s)"
    with_edits = f"transform(filter({lengths}, n -> n >= {bytes_per_edit}), n -> struct({e} as e, int(n div ({e} + 1)) as q))"
    packed = f"transform({with_edits}, p -> p.e * {1 << 32} + {_width('p.q')})"
    return F.expr(f"array_distinct({packed})")


def _rest_widths() -> Column:
    """Widths as in _shapes for a part with e edits of its own; one only where the key fixes the size of the index's part."""
    lengths = f"filter(if(size is null, transform(sequence(0, e), s -> octet_length(bytes) - s), array(size)), n -> n >= {LEAST_SEGMENT} * (e + 1))"
    return F.expr(f"array_distinct(transform(transform({lengths}, n -> int(n div (e + 1))), q -> {_width('q')}))")


def _segments(edits: int) -> Column:
    """Rows of (key, moved, at, before): each of e + 1 segments of a text, where a probe has to look for it, and the edits before it."""
    n, w, e = F.octet_length("bytes"), F.col("w"), F.col("e")
    of_edits = None
    for most in range(1, edits + 1):
        keys = []
        for i in range(most + 1):
            reach = min(i, most - i)
            for shift in range(-reach, reach + 1):
                at = (w * i if i <= most - i else n - w * (most + 1 - i)) + shift
                key = F.struct(F.xxhash64(F.lit(most * 100 + i), F.substring(F.col("bytes"), at + 1, w), "path").alias("key"), F.lit(shift != 0).alias("moved"), at.alias("at"), F.lit(i).alias("before"))
                keys.append(F.when((at >= 0) & (at + w <= n), key) if shift else key)
        # An array for each e, so that no rows are made for the keys of the others.
        of_edits = (F if of_edits is None else of_edits).when(e == most, F.array(*keys))
    return F.explode(of_edits).alias("k")


def _by_segments(texts: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """(x, y), ids of texts that share a segment under a key that isn't hot; and the ids of texts left over under hot keys."""
    none = F.array().cast("array<struct<e: int, bytes: binary, size: int>>").alias("others")
    shaped = texts.select("id", "bytes", F.explode("shapes").alias("shape"), none, F.lit(0).cast("long").alias("path"), F.lit(False).alias("probe"))
    rows = shaped.select("id", "bytes", F.shiftright("shape", 32).cast("int").alias("e"), (F.col("shape") % (1 << 32)).cast("int").alias("w"), "others", "path", "probe")
    found, over, written = [], [], []
    for level in range(1, LEVELS + 1):
        keyed = rows.select("*", _segments(edits)).where("k is not null").withColumn("moved", F.col("probe") | F.col("k.moved"))
        if level > 1:  # Rests are few beside the input: their rows are made once, for counts, pairs and cuts.
            written.append(keyed := settle(keyed))
        tags = keyed.select("k.key", (F.col("id") * 2 + F.col("moved").cast("long")).alias("tag"))
        # The lesser id is the index, with its segments in their own places: a row that has no such partner under its key joins nothing.
        index = F.when(F.col("tag") % 2 == 0, F.shiftright("tag", 1))
        several = tags.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("least"), F.max(F.shiftright("tag", 1)).alias("most")).where("least < most")
        shared = tags.join(several, "key").where((F.shiftright("tag", 1) > F.col("least")) | (index < F.col("most")))
        shared = settle(shared.select("key", "tag", "n"))
        x, y = (shared.where(F.col("n") <= HOT_ROWS).select("key", F.col("tag").alias(name)) for name in "xy")
        # The lesser id is the index, with its segments in their own places; those of the other may have moved.
        order = F.when(F.shiftright("x", 1) < F.shiftright("y", 1), F.col("x") % 2) == 0
        found.append(settle(x.join(y.hint("shuffle_merge"), "key").where(order).select(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()))
        hot = settle(shared.where(F.col("n") > HOT_ROWS).select("key", F.shiftright("tag", 1).alias("id")).distinct())
        forget(shared)
        written.append(hot)
        if level == LEVELS or hot.isEmpty():
            over.append(hot.select("id"))
            break
        of_hot = keyed if level > 1 else rows.join(hot.select("id").distinct().hint("shuffle_merge"), "id", "left_semi").select("*", _segments(edits)).where("k is not null")
        of_hot = of_hot.withColumn("key", F.col("k.key")).join(hot.hint("shuffle_merge"), ["key", "id"], "left_semi")
        left = "named_struct('e', k.before, 'bytes', substring(bytes, 1, k.at), 'size', if(2 * k.before <= e, w * k.before, null))"
        right = "named_struct('e', e - k.before, 'bytes', substring(bytes, k.at + w + 1, octet_length(bytes)), 'size', if(2 * k.before > e, w * (e - k.before), null))"
        parts = F.expr(f"filter(concat(others, array({left}, {right})), p -> p.e > 0)")
        cut = of_hot.select("id", parts.alias("parts"), F.col("key").alias("path"), (F.col("probe") | F.col("k.moved")).alias("probe")).distinct()
        cut = settle(cut.select("id", F.col("parts")[0]["bytes"].alias("bytes"), F.col("parts")[0]["e"].alias("e"), F.col("parts")[0]["size"].alias("size"), F.expr("slice(parts, 2, size(parts))").alias("others"), "path", "probe"))
        written.append(cut)
        # A part too short to be cut on, or within e bytes of one, is left over.
        over.append(cut.where(F.coalesce("size", F.octet_length("bytes") - F.col("e")) < LEAST_SEGMENT * (F.col("e") + 1)).select("id"))
        rows = cut.select("id", "bytes", "e", F.explode(_rest_widths()).alias("w"), "others", "path", "probe")
    pairs = found[0] if len(found) == 1 else settle(reduce(DataFrame.union, found).distinct())
    over = settle(reduce(DataFrame.union, over).distinct())
    forget(*written, *(found if len(found) > 1 else ()))
    return pairs, over


def _by_rare_grams(texts: DataFrame, edits: int, bytes_per_edit: int) -> DataFrame:
    """(x, y): ids of texts that share one of their rarest grams at nearly one place; all pairs within their edits are among them.

    Where that gram is frequent and no rarer one is shared, the edits must touch all rare grams of both texts.  One
    edit touches such grams of both only where these lie at nearly one place; else each text needs edits of its own,
    and both together no more than are allowed.  So members of a large family of near-copies meet where they differ
    from it at one place or very little.
    """
    assert bytes_per_edit >= 2 * GRAM  # so a text has more grams than its edits can touch
    n = F.octet_length("bytes")
    places = F.explode(F.sequence(F.lit(1), n - GRAM + 1)).alias("at")
    # Dealt in turn, as each text makes many rows.
    grams = texts.repartition(shuffle_parts(texts.sparkSession)).select("id", n.alias("n"), "bytes", places).select("id", "n", "at", F.xxhash64(F.substring(F.col("bytes"), F.col("at"), F.lit(GRAM))).alias("gram"))
    # How often a gram occurs, exactly up to HOT_ROWS: a frame of bounded size, however frequent it is.
    around = Window.partitionBy("gram").orderBy("id").rowsBetween(-HOT_ROWS - 1, HOT_ROWS + 1)
    counted = grams.withColumn("k", F.least(F.count(F.lit(1)).over(around), F.lit(HOT_ROWS + 1)).cast("int"))
    each = counted.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("k", "gram", "at"))).alias("all"))
    # Occurrences of the last of the rarest belong to them together.
    each = each.withColumn("last", F.col("all")[_allowed(F.col("n"), edits, bytes_per_edit) * GRAM])
    rarest = F.filter("all", lambda g: F.struct(g.k, g.gram) <= F.struct(F.col("last.k"), F.col("last.gram")))
    starts = F.array_sort(F.transform(F.filter("all", lambda g: g.k <= HOT_ROWS), lambda g: g["at"]))

    def touch(done: Column, at: Column) -> Column:
        """Starts of the first grams that need an edit of their own, edits + 1 at most."""
        new = (F.size(done) == 0) | (at >= F.try_element_at(done, F.lit(-1)) + GRAM)
        return F.when(new & (F.size(done) <= edits), F.array_append(done, at)).otherwise(done)

    touched = F.aggregate(starts, F.array().cast("array<int>"), touch)
    # Long lists (of texts that repeat themselves) don't go along with each of their rows.
    rare = F.when(F.size("all_rarest") <= 2 * (edits * GRAM + 1), F.transform("all_rarest", lambda g: F.struct(g.gram, g["at"])))
    rows = each.withColumn("all_rarest", rarest).select("id", "n", touched.alias("own"), rare.alias("rare"), F.explode("all_rarest").alias("g"))
    # A frequent gram brings no text together that needs more edits than are allowed for what is its own.
    rows = settle(rows.where((F.col("g.k") <= HOT_ROWS) | (F.size("own") <= edits)).select("id", "n", "own", "rare", "g.k", "g.gram", "g.at"))

    def step(value: str, by: int, moved: int) -> Column:
        return F.floor((F.col(value) + moved) / by)

    x, y = (rows.select("gram", *(F.col(c).alias(f"{c}_{name}") for c in ("n", "at", "own", "k", "rare")), F.col("id").alias(name)) for name in "xy")
    x = x.withColumn("nn", step("n_x", LENGTH_STEP, 0)).withColumn("pp", step("at_x", PLACE_STEP, 0))
    for name, value, by in (("nn", "n_y", LENGTH_STEP), ("pp", "at_y", PLACE_STEP)):
        y = y.withColumn(name, F.explode(F.array_distinct(F.array(step(value, by, -edits), step(value, by, edits)))))
    near = (F.col("x") < F.col("y")) & (F.abs(F.col("n_x") - F.col("n_y")) <= edits) & (F.abs(F.col("at_x") - F.col("at_y")) <= edits)
    few = F.size("own_x") + F.size("own_y") <= edits
    together = F.exists("own_x", lambda a: F.exists("own_y", lambda b: F.abs(a - b) <= 2 * (GRAM - 1) + edits))
    # A pair of several frequent grams meets at the first of them only, where both lists are there.
    before = F.exists("rare_x", lambda g: (F.struct(g.gram, g["at"]) < F.struct("gram", "at_x")) & F.exists("rare_y", lambda h: (h.gram == g.gram) & (F.abs(h["at"] - g["at"]) <= edits)))
    possible = (F.col("k_x") <= HOT_ROWS) | ((few | together) & ~F.coalesce(before, F.lit(False)))
    pairs = settle(x.join(y.hint("shuffle_merge"), ["gram", "nn", "pp"]).where(near & possible).select("x", "y").distinct())
    forget(rows)
    return pairs


def _common_length(a: str, b: str, at_most: str, from_end: bool) -> str:
    """SQL: length of the common prefix (or suffix) of two binaries, by doubling steps downwards.

    The limit goes into the start value, so that it is evaluated once and not at each step.
    """
    part = "substring({x}, s.at + 1, step)" if not from_end else "substring({x}, octet_length({x}) - s.at - step + 1, step)"
    same = f"{part.format(x=a)} = {part.format(x=b)}"
    steps = ", ".join(str(1 << k) for k in range(30, -1, -1))
    return f"aggregate(array({steps}), named_struct('at', 0, 'most', {at_most}), (s, step) -> named_struct('at', if(s.at + step <= s.most and {same}, s.at + step, s.at), 'most', s.most), s -> s.at)"


def _with_distance(pairs: DataFrame, edits: int) -> DataFrame:
    """Adds distance: the edits between binaries ``a`` and ``b``, null if over ``edits``."""
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    out = pairs.withColumn("head", F.expr(_common_length("a", "b", "least(octet_length(a), octet_length(b))", False)))
    out = out.withColumn("tail", F.expr(_common_length("a", "b", "least(octet_length(a), octet_length(b)) - head", True)))
    for x in "ab":
        out = out.withColumn(f"mid_{x}", F.expr(f"substring({x}, head + 1, octet_length({x}) - head - tail)"))
    out = out.withColumn("m", F.octet_length("mid_a")).withColumn("n", F.octet_length("mid_b"))
    pad = "X'" + "00" * edits + "'"
    out = out.withColumn("padded", F.expr(f"concat({pad}, mid_a, {pad}, X'00')")).drop("head", "tail", "mid_a")
    # Written out: the automaton looks at these columns for each byte and must not make them anew each time.
    out = settle(out).repartition(shuffle_parts(pairs.sparkSession))
    # Bit o of the word of byte j: does it equal byte j + o - edits of mid_a?
    bits = " + ".join(f"if(substring(padded, j + {o}, 1) = substring(mid_b, j, 1), {1 << o}, 0)" for o in range(band))
    match = f"transform(sequence(1, n), j -> {bits})"
    names = [f"r{d}" for d in range(edits + 1)]
    start = ", ".join(f"'{r}', {sum(1 << (edits + e) for e in range(d + 1))}" for d, r in enumerate(names))
    moved = ["(s.r0 & w)"]
    for d in range(1, edits + 1):
        before = f"s.r{d - 1}"
        moved.append(f"(((s.r{d} & w) | {before} | shiftright({before}, 1) | shiftleft({moved[-1]}, 1)) & {full})")
    step = ", ".join(f"'{r}', {e}" for r, e in zip(names, moved))
    last = f"shiftleft(1, m - n + {edits})"
    found = "case " + " ".join(f"when (s.{r} & {last}) <> 0 then {d}" for d, r in enumerate(names)) + " end"
    automaton = f"aggregate({match}, named_struct({start}), (s, w) -> named_struct({step}), s -> {found})"
    return out.withColumn("distance", F.expr(f"case when abs(m - n) > {edits} then null when m = 0 or n = 0 then greatest(m, n) else {automaton} end"))


def _links(texts: DataFrame, edits: int, bytes_per_edit: int) -> DataFrame:
    """(x, y, distance): ids of all pairs of texts within their edits, once each.  texts: id, bytes and their shapes."""
    pairs, hot = _by_segments(texts, edits)
    if not hot.isEmpty():
        among_hot = _by_rare_grams(texts.join(hot.hint("shuffle_merge"), "id", "left_semi"), edits, bytes_per_edit)
        pairs = settle(pairs.union(among_hot).distinct())
    ends = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    words = settle(texts.join(ends.hint("shuffle_merge"), "id", "left_semi").select("id", "bytes"))
    both = pairs.join(words.toDF("x", "a"), "x").join(words.toDF("y", "b"), "y")
    both = both.where(F.abs(F.octet_length("a") - F.octet_length("b")) <= edits)
    allowed = _allowed(F.least(F.octet_length("a"), F.octet_length("b")), edits, bytes_per_edit)
    found = settle(_with_distance(both, edits).where(F.col("distance") <= allowed).select("x", "y", "distance"))
    forget(pairs, words, hot)
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    lines = docs.where("doc_id is not null and text <> ''").select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where("trim(line) <> ''")


def line_duplicates(documents: DataFrame, edits: int = 2, bytes_per_edit: int = 20, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links and the kept text of every document, with the named other columns.

    n_links counts the other texts within so many edits of the document's lines.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in columns)).withColumn("th", F.xxhash64("text"))
    place = F.struct("doc_id", "th", "at")
    names = F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")
    first = _occurrences(docs.select("doc_id", "text", "th")).groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    texts = first.select(F.monotonically_increasing_id().alias("id"), F.encode("line", "UTF-8").alias("bytes"), *names, "first", "times")
    texts = settle(texts.withColumn("shapes", _shapes(edits, bytes_per_edit)))
    links = _links(texts.select("id", "bytes", "shapes").where(F.octet_length("bytes") >= bytes_per_edit), edits, bytes_per_edit)
    places = texts.select("id", "first")
    both = links.select("x", "y").union(links.select("y", "x")).toDF("id", "other")
    linked = both.join(places.toDF("other", "theirs"), "other").groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.min("theirs").alias("theirs"))
    # Only lines that occur again or are linked decide anything.
    judged = texts.select("id", "h", "h2", "first", "times").join(linked, "id", "left").where("times > 1 or links is not null")
    judged = settle(judged.select("h", "h2", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(F.col("theirs") < F.col("first"), F.lit(False)).alias("near")))
    occurrences = _occurrences(docs.select("doc_id", "text", "th")).select(*names, "doc_id", "th", "at")
    gone = (place != F.col("first")) | F.col("near")
    fate = occurrences.join(judged, ["h", "h2"]).where(gone | (F.col("links") > 0))
    fate = settle(fate.groupBy("doc_id", "th").agg(F.collect_set(F.when(gone, F.col("at"))).alias("removed"), F.sum("links").alias("links")))
    forget(texts, links, judged)
    lines = F.when(F.col("text") != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    out = docs.join(fate, ["doc_id", "th"], "left").withColumn("lines", lines).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    places_kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(places_kept, lambda i: F.col("lines")[i]), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), *(F.col(f"_{c}").alias(c) for c in columns))
