"""Scores of names against entities, the match ladder, reaction participants and organism queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import IGNORED_IDS, organism_key, organism_query_kind
from tessera.functions.text import sequence_ratio

# What a view, and a name's or synonym's standing, is worth.
VIEW_WEIGHTS = {"exact_norm": 40, "exact_no_commas": 35, "exact_no_paren": 30, "exact_compact": 20, "symbol_exact": 22, "element_symbol": 50}
SCOPE_BONUS = {"name": 10, "EXACT": 7, "BROAD": 4, "NARROW": 4, "RELATED": 1}
GREEK_FORMS = ("alpha", "beta", "gamma", "delta")


def _lookup(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), c), F.lit(0))


def greek_form(c: Column) -> Column:
    """The first of the Greek forms that a text names."""
    return F.coalesce(*(F.when(F.lower(c).rlike(rf"\b{g}\b"), F.lit(g)) for g in GREEK_FORMS))


def complexity(label: Column) -> Column:
    """How far a label is from a plain word: parentheses, charges, numerals, digits, signs, lists, length."""
    points = lambda pattern, n: F.when(label.rlike(pattern), n).otherwise(0)
    long = F.when(F.length(label) >= 25, F.least(F.lit(15), F.floor((F.length(label) - 25) / 10) * 3)).otherwise(0)
    return points(r"[()]", 20) + points(r"\(\s*\d+\s*[+\-]\s*\)", 25) + points(r"\b[IVX]{1,4}\b", 10) + points(r"\b\d+\b", 10) + points(r"[+\-]", 10) + points("[,;]", 4) + long


def name_hit_score(query: str, query_norm: str, view: str, label: str, label_norm: str, term: str, scope: str) -> Column:
    """The score of a hit, all terms additive.

    query and label are as written, *_norm as normalised; term is the text that
    matched and scope its standing ("name" or a synonym's scope).
    """
    q, lbl = F.col(query_norm), F.coalesce(F.col(label_norm), F.lit(""))
    low, label_low, term_low = F.lower(q), F.lower(F.coalesce(F.col(label), F.lit(""))), F.lower(F.coalesce(F.col(term), F.lit("")))
    gain = lambda condition, yes, no=0: F.when(condition, yes).otherwise(no)
    form, own = greek_form(F.col(query)), F.coalesce(greek_form(label_low), greek_form(term_low))
    greek = F.when(form.isNull(), 0).when(own.isNull(), -20).when(own != form, -80).otherwise(0)
    methyl = low.rlike(r"\b5[-\s]?methyl\b") | low.contains("5-mthf") | low.contains("methyltetrahydrofolate")
    methyl_label = label_low.rlike(r"\b5[-\s]?methyl\b") | label_low.contains("methyltetrahydrofolate")
    folate = F.when(~methyl, 0).when(methyl_label, 40).when(label_low.rlike("folic acid|folate|tetrahydrofolate|tetrahydrofolic"), -25).otherwise(0)
    code_like = F.trim(F.col(label)).rlike(r"^[A-Z]{1,3}\d{1,3}$") | ((F.length(F.trim(F.col(label))) <= 3) & F.col(label).rlike(r"\d"))
    vitamin = gain(low.contains("vitamin"), gain(label_low.contains("vitamin") | term_low.contains("vitamin"), 25, -25) + gain(F.coalesce(code_like, F.lit(False)), -35))
    element = low.rlike("^[a-z]{3,20}$")
    holds, atom_or_ion = F.contains(lbl, low), lbl.rlike(" (atom|ion)$")
    as_element = (
        gain(label_low.contains(" atom"), 30)
        + gain(lbl.isin("") | ~lbl.isin(F.concat(low, F.lit(" atom")), F.concat(low, F.lit(" ion"))), 0, 40)
        + gain((lbl != "") & (lbl != low) & ~atom_or_ion & ~holds, -60)
        + gain((lbl != "") & ~holds, -25)
        - complexity(F.when(F.col(label) != "", F.col(label)).otherwise(F.col(term)))
        + gain(F.coalesce(F.trim(F.col(label)).rlike("^[A-Za-z]{3,20}$"), F.lit(False)), 15)
    )
    derived = (low == "cellulose") & F.concat_ws(" ", label_low, term_low).rlike("acetate|propionate|phthalate|inhibitor|synthesis")
    base = _lookup(F.col(view), VIEW_WEIGHTS) + _lookup(F.col(scope), SCOPE_BONUS)
    return (base + greek + folate + vitamin + gain((lbl != "") & (lbl == q), 25) + gain(element, as_element) + gain(derived, -80)).cast("int")


def best_per_entity(hits: DataFrame, query: str, entity: str, score: str, view: str, label: str) -> DataFrame:
    """One hit for each query and entity: the highest score, then the weightier view, then the shorter label."""
    order = F.struct(F.col(score).alias("s"), _lookup(F.col(view), VIEW_WEIGHTS).alias("w"), (-F.length(F.coalesce(F.col(label), F.lit("")))).alias("l"), F.col(label).alias("t"))
    rest = [c for c in hits.columns if c not in (query, entity)]
    return hits.groupBy(query, entity).agg(F.max_by(F.struct(*rest), order).alias("_h")).select(query, entity, "_h.*")


#: What a kind of match is worth (fixed values); a confirmed participant is worth CONFIRMED at least.
LADDER = {"override": 200, "name": 100, "synonym": 90, "fuzzy": 60}
CONFIRMED = 150


def _ladder(hits: DataFrame, participants: DataFrame, entities: DataFrame) -> DataFrame:
    """(row, b, place): the best entity of each row as a struct of entity, name and score, and its place among a row's entities."""
    known = hits.where(~F.col("entity").isin(*IGNORED_IDS)).join(entities.select("entity", "name"), "entity")
    confirmed = known.join(participants.select("code", "entity").distinct().withColumn("_in", F.lit(True)), ["code", "entity"], "left")
    base = _lookup(F.col("kind"), LADDER)
    lifted = F.when(F.col("_in"), F.greatest(base, F.lit(CONFIRMED))).otherwise(base)
    name, asked = F.lower("name"), F.lower("query")
    zwitterion = F.when(name.contains("zwitterion") & ~asked.contains("zwitterion"), 10).otherwise(0)
    ring = F.when(name.rlike("pyranose|furanose") & ~asked.rlike("pyranose|furanose"), 5).otherwise(0)
    scored = confirmed.withColumn("score", (lifted - zwitterion - ring).cast("int"))
    number = F.regexp_extract("entity", r"(\d+)", 1).cast("long")
    place = F.struct("score", F.coalesce("primary", F.lit(False)), -number)
    return scored.groupBy("row").agg(F.max_by(F.struct("entity", "name", "score"), place).alias("b"), F.max(place).alias("place"))


def _with_match(best: DataFrame) -> DataFrame:
    kind = F.when(F.col("score") >= CONFIRMED, "rhea_confirmed").when(F.col("score") >= LADDER["synonym"], "string_match").otherwise("fuzzy_match")
    return best.withColumn("match", F.concat(kind, F.lit("("), "score", F.lit(")")))


def ladder_scores(hits: DataFrame, participants: DataFrame, entities: DataFrame) -> DataFrame:
    """The best entity of each row: (row, entity, name, score, match).

    hits has row, code, query, entity, kind and primary; participants has code and
    entity (of the code's reactions); entities has entity and name.  Penalties come
    after the lift of participants.  Ubiquitous entities are no match.
    """
    return _with_match(_ladder(hits, participants, entities).select("row", "b.*"))


def ladder_of_questions(rows: DataFrame, candidates: DataFrame, participants: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """As ladder_scores, where a row's hits are all candidates with its value of ``on``.

    rows has row, code, query, kind and ``on``; candidates has ``on``, entity and primary.  Rows that ask the same
    question are as one: each question meets its candidates once, and its answer goes to all of its rows.  A row
    given several times has the best answer of its questions.
    """
    question = F.struct("code", "query", "kind", on)
    asked = rows.select(on, "code", "query", "kind").where(F.col(on).isNotNull()).distinct().withColumn("row", question)
    best = _ladder(asked.join(candidates.select(on, "entity", "primary"), on), participants, entities)
    answered = rows.select("row", question.alias("_q")).join(best.withColumnRenamed("row", "_b"), F.col("_q").eqNullSafe(F.col("_b")))
    return _with_match(answered.groupBy("row").agg(F.max_by("b", "place").alias("b")).select("row", "b.*"))


def participants(code_reactions: DataFrame, reactions: DataFrame, structures: DataFrame) -> DataFrame:
    """(code, entity) of all reactions of a code.

    code_reactions has code and reaction, reactions has reaction and equation
    (structures joined by "." and ">>"), structures has entity and structure.
    """
    parts = reactions.select("reaction", F.explode(F.split("equation", r"\.|\s*>>\s*")).alias("structure")).where("structure <> ''").distinct()
    return code_reactions.select("code", "reaction").join(parts, "reaction").join(structures.select("entity", "structure"), "structure").select("code", "entity").distinct()


def gated_similarity(queries: DataFrame, pool: DataFrame, cutoff: float = 0.8, least: int = 5) -> DataFrame:
    """(row, entity, ratio): the most similar text among the participants of a row's own code.

    queries has row, code and key; pool has code, entity and text.  A pair of texts is compared once.
    """
    pairs = queries.where(F.length("key") >= least).select("row", "code", "key").join(pool.select("code", "entity", "text"), "code")
    ratios = pairs.select("key", "text").distinct().withColumn("ratio", sequence_ratio("key", "text")).where(F.col("ratio") >= cutoff)
    close = pairs.join(ratios, ["key", "text"])
    best = close.groupBy("row").agg(F.max_by("text", F.struct(F.col("ratio"), F.col("text"))).alias("text"), F.max("ratio").alias("ratio"))
    return close.select("row", "text", "entity").distinct().join(best, ["row", "text"]).select("row", "entity", "ratio")


def organism_lookup(queries: DataFrame, organisms: DataFrame, query: str, id_: str, species: str, strain: str) -> DataFrame:
    """(query, id): rows that a query names.

    A strain by itself must belong to one species alone; a strain after two words
    is looked for in that species; two words are a species, or the beginning of
    its name where there is none of just that name; one word is a genus.
    Distinct names are normalised once and joined back.
    """
    names = organisms.select(species).distinct().withColumn("_sp", organism_key(species))
    strains = organisms.select(strain).distinct().withColumn("_st", organism_key(F.coalesce(strain, F.lit(""))))
    rows = organisms.select(id_, species, strain).join(names, species).join(strains.where(F.col(strain).isNotNull()), strain, "left").select(F.col(id_).alias("id"), "_sp", F.coalesce("_st", F.lit("")).alias("_st"))
    asked = queries.select(F.col(query).alias("query")).distinct().withColumn("kind", organism_query_kind("query"))
    asked = asked.withColumn("_key", organism_key(F.when(F.col("kind") == "strain", F.regexp_extract("query", r"(?i)^\s*strain\s*[:=]\s*(.+?)\s*$", 1)).otherwise(F.col("query"))))
    words = F.split("_key", " ")
    asked = asked.withColumn("_two", F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).withColumn("_tail", F.array_join(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), " "))
    first_two = F.concat_ws(" ", F.get(F.split("_sp", " "), F.lit(0)), F.get(F.split("_sp", " "), F.lit(1)))
    alone = rows.where("_st <> ''").groupBy("_st").agg(F.countDistinct("_sp").alias("_n")).where("_n = 1").select("_st")
    by_strain = asked.where("kind = 'strain'").join(rows.join(alone, "_st", "left_semi"), F.col("_key") == F.col("_st")).select("query", "id")
    of_species = asked.where("kind = 'species_strain'").join(rows, (F.col("_two") == F.col("_sp")) & (F.col("_tail") == F.col("_st"))).select("query", "id")
    wanted = asked.where("kind = 'species'").select("query", "_two")
    exact = wanted.join(rows, F.col("_two") == F.col("_sp")).select("query", "id")
    begins = wanted.join(exact.select("query").distinct(), "query", "left_anti").join(rows.withColumn("_b", first_two), F.col("_two") == F.col("_b")).select("query", "id")
    genus = asked.where("kind = 'genus'").join(rows.where("_sp like '% %'").withColumn("_g", F.substring_index("_sp", " ", 1)), F.col("_key") == F.col("_g")).select("query", "id")
    return reduce(DataFrame.union, (by_strain, of_species, exact, begins, genus)).distinct()


def suggestions(queries: DataFrame, names: DataFrame, query: str, name: str, cutoff: float = 0.85, most: int = 10) -> DataFrame:
    """(query, name, ratio): up to ``most`` similar names for queries that found nothing, among names with the same first letter."""
    first = lambda c: F.substring(c, 1, 1)
    pairs = queries.select(F.col(query).alias("query")).distinct().join(names.select(F.col(name).alias("name")).distinct(), first("query") == first("name"))
    close = pairs.where(F.abs(F.length("query") - F.length("name")) <= (1 - cutoff) * (F.length("query") + F.length("name"))).withColumn("ratio", sequence_ratio("query", "name")).where(F.col("ratio") >= cutoff)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ratio"), "name"))
    return close.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")
