"""Names of issuing authorities: comparison by word stems, plausibility, repair of single letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions.similarity import indel_ratio, token_set_ratio
from caseframe.functions.text import ColumnOrName, bound, digits, fold, let
from caseframe.operators.likeness import pairs_within_edits

#: Abbreviations in full, and words that say nothing.
ABBREVIATIONS = (
    ("ОВД", "ОТДЕЛ ВНУТРЕННИХ ДЕЛ"), ("УВД", "УПРАВЛЕНИЕ ВНУТРЕННИХ ДЕЛ"), ("РОВД", "РАЙОННЫЙ ОТДЕЛ ВНУТРЕННИХ ДЕЛ"),
    ("ГОВД", "ГОРОДСКОЙ ОТДЕЛ ВНУТРЕННИХ ДЕЛ"), ("ОУФМС", "ОТДЕЛ УФМС"), ("ОФМС", "ОТДЕЛ ФМС"), ("ТП", "ТЕРРИТОРИАЛЬНЫЙ ПУНКТ"),
    ("ГУ", "ГЛАВНОЕ УПРАВЛЕНИЕ"), ("Г", "ГОРОД"), ("ГОР", "ГОРОД"), ("ОБЛ", "ОБЛАСТЬ"), ("Р-НА", "РАЙОНА"), ("Р-НЕ", "РАЙОНЕ"),
    ("Р-ОН", "РАЙОН"), ("ОТД", "ОТДЕЛЕНИЕ"), ("АДМ", "АДМИНИСТРАТИВНЫЙ"), ("КР", "КРАЙ"), ("РЕСП", "РЕСПУБЛИКА"), ("ОП", "ОТДЕЛ ПОЛИЦИИ"),
)
EMPTY_WORDS = ("ПО", "В", "И", "НА")
STEM = 5


def tokens(c: ColumnOrName) -> Column:
    """Upper-case words, inner hyphens kept."""
    return F.regexp_extract_all(fold(c), F.lit("[А-Я]+(?:-[А-Я]+)?"), 0)


@bound(1)
def stems(c: ColumnOrName) -> Column:
    """The first letters of the words, abbreviations written out, empty words left out."""
    full = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS for x in pair))
    words = F.flatten(F.transform(tokens(c), lambda t: F.split(F.coalesce(full[t], t), " ")))
    return F.transform(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS)), lambda w: F.substring(w, 1, STEM))


@bound(2)
def issuer_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100; 0 if a side has no words."""
    return token_set_ratio(F.array_join(stems(a), " "), F.array_join(stems(b), " "))


def looks_like_authority(c: ColumnOrName, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*map(F.lit, words)))


def vocabulary_share(c: ColumnOrName, words: tuple[str, ...]) -> Column:
    """Share of the words that a vocabulary has; repeats count, null without words."""
    own, known = tokens(c), F.array(*map(F.lit, words))
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: F.array_contains(known, w))) / F.size(own))


@bound(1)
def region_code(department: ColumnOrName, merged: dict[str, str]) -> Column:
    """The region's two digits of a six-digit department code, codes of merged regions replaced; null for other values."""
    d = digits(department)
    first = F.substring(d, 1, 2)
    table = F.create_map(*(F.lit(x) for pair in merged.items() for x in pair)) if merged else None
    return F.when(F.length(d) == 6, F.coalesce(table[first], first) if table is not None else first)


def regions_in(c: ColumnOrName, stems_of: dict[str, tuple[str, ...]]) -> Column:
    """Codes of the regions one of whose stems begins a word; a stem ending in $ is a whole word."""

    def has(words: Column, stem: str) -> Column:
        if stem.endswith("$"):
            return F.array_contains(words, stem[:-1])
        return F.exists(words, lambda t: t.startswith(stem))

    def found(words: Column) -> Column:
        hits = []
        for code, own in stems_of.items():
            hit = has(words, own[0])
            for stem in own[1:]:
                hit = hit | has(words, stem)
            hits.append(F.when(hit, code))
        return F.array_compact(F.array(*hits))

    return let(tokens(c), found) if stems_of else F.array().cast("array<string>")


#: Words before a city's name, what a region's kind is called, stems that name a region wherever they stand, endings of
#: cities in other cases by the ending of their name, letters of a stem from which misread words count, and how like it they are.
CITY_WORDS = ("Г", "ГОР", "ГОРОД", "ГОРОДА", "ГОРОДЕ", "ГОРОДУ", "ГОРОДОМ")
KINDS, KIND_STEMS, REPUBLIC = ("КРАЙ", "КРАЯ", "КРАЮ", "КРАЕ", "КР", "АО"), ("ОБЛ", "РЕСП", "АВТОНОМН"), "РЕСП"
CITY_ENDINGS = (
    (("Ь",), 1, ("И", "Ю", "Е")), (("А", "Я"), 1, ("Ы", "И", "Е", "У", "ОЙ")), (("ЫЙ", "ИЙ"), 2, ("ОГО", "ОМ", "ОМУ")), (("О", "Е", "Ы", "И", "У", "Э"), 0, ()), (("",), 0, ("А", "Е", "У", "ОМ")),
)
LONG_STEM, STEM_LIKE = 7, 88


def city_forms(city: str) -> list[str]:
    """A city's name in all cases, by the first rule of CITY_ENDINGS that fits its ending."""
    for endings, cut, others in CITY_ENDINGS:
        if city.endswith(endings):
            return [city, *(city[: len(city) - cut] + o for o in others)]
    return [city]


@bound(1)
def regions_named(c: ColumnOrName, regions: dict[str, tuple[tuple[str, ...], str | None]], anywhere: tuple[tuple[str, str], ...] = ()) -> Column:
    """Codes of the regions that an issuer's name names, in order: by a stem of `anywhere`, by a city after a word for city, or by a stem beside
    the region's kind: before it, after a republic's too. regions: code to (stems, capital); a stem ending in $ is a whole word, a
    long one may be misread."""
    every = F.regexp_extract_all(fold(c), F.lit("[А-ЯA-Z]+(?:-[А-ЯA-Z]+)*"), 0)

    def all_of(words: Column) -> Column:
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        city_of = {form: code for code, (_, city) in regions.items() if city for form in city_forms(city)}
        cities = F.create_map(*(F.lit(x) for pair in city_of.items() for x in pair)) if city_of else None
        is_kind = lambda w: w.isin(*KINDS) | w.startswith(KIND_STEMS[0]) | w.startswith(KIND_STEMS[1]) | w.startswith(KIND_STEMS[2])
        stems = [(stem, code) for code, (own, _) in regions.items() for stem in own]

        def fits(w: Column, stem: str) -> Column:
            if stem.endswith("$"):
                return w == stem[:-1]
            if len(stem) < LONG_STEM:
                return w.startswith(stem)
            head = F.substring(w, 1, len(stem))
            # so like are heads that differ in a letter or two: looked at only if most letters are there
            return w.startswith(stem) | ((F.length(w) >= len(stem)) & (F.levenshtein(head, F.lit(stem), 2) >= 0) & (indel_ratio(head, F.lit(stem)) >= STEM_LIKE))

        def codes_of(w: Column) -> Column:
            return F.array_compact(F.array(*(F.when(fits(w, stem), code) for stem, code in stems))) if stems else F.array().cast("array<string>")

        def one(w: Column, i: Column) -> Column:
            free = F.array_compact(F.array(*(F.when(w.startswith(stem), code) for stem, code in anywhere))) if anywhere else F.array().cast("array<string>")
            city = F.array_compact(F.array(F.when((i > 0) & at(i - 1).isin(*CITY_WORDS), cities[w]))) if cities is not None else F.array().cast("array<string>")
            before = F.when(i > 0, F.array(at(i - 1))).otherwise(F.array().cast("array<string>"))
            near = F.concat(before, F.when(w.startswith(REPUBLIC), F.slice(words, i + 2, 2)).otherwise(F.array().cast("array<string>")))
            beside = F.when(is_kind(w), F.flatten(F.transform(F.filter(near, lambda n: ~is_kind(n)), codes_of))).otherwise(F.array().cast("array<string>"))
            return F.concat(free, city, beside)

        return F.array_sort(F.array_distinct(F.flatten(F.transform(words, one))))

    return let(every, all_of)


def repair_words(words: DataFrame, vocabulary: DataFrame, least: int = 5, long: int = 9) -> DataFrame:
    """words (word) with `repaired`: the one vocabulary word nearest by edit distance (1 below `long` letters, else 2), where the
    word itself is unknown, has `least` letters or more, and no second vocabulary word is as near.

    Each distinct word is looked at once and meets only vocabulary words that share a part with it."""
    known = vocabulary.select(F.col("word").alias("candidate")).distinct()
    best = nearest_words(words, known, least, long).where(F.size("candidates") == 1)
    return words.join(best.select("word", F.get("candidates", F.lit(0)).alias("repaired")), "word", "left").withColumn("repaired", F.coalesce("repaired", "word"))


def nearest_words(words: DataFrame, known: DataFrame, least: int, long: int) -> DataFrame:
    """word and candidates: all words of known (candidate) that are as near as the nearest one, of unknown words of `least` letters."""
    distinct = words.select("word").distinct().join(known, F.col("word") == F.col("candidate"), "left_anti").where(F.length("word") >= least)
    near = pairs_within_edits(distinct, known, [], "word", "candidate", 2)
    near = near.where(F.col("edits") <= F.when(F.length("word") < long, 1).otherwise(2))
    least_edits = F.min("edits").over(W.partitionBy("word"))
    return near.withColumn("best", least_edits).where("edits = best").groupBy("word").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))


#: After an adjective of a region only this word can stand, however it is read.
REGION_ADJECTIVE, AREA, AREA_EDITS = "[СЦЗ]КОЙ$", "ОБЛАСТИ", 2
TOKEN = "[А-ЯA-Z]+(?:-[А-ЯA-Z]+)*"


def repair_in_context(texts: DataFrame, keys: list[str], body: str, vocabulary: DataFrame, neighbours: DataFrame | None = None, known: DataFrame | None = None, least: int = 5, long: int = 9) -> DataFrame:
    """keys, text (upper case, Ё as Е, misread words repaired) and fixes (array of struct(word, repaired), in order).

    A word in no list (vocabulary, or known: words of the language) becomes the one vocabulary word nearest to it. Of several as near, the
    one that most often stands beside its neighbours counts, if one does (neighbours: left, right, n; with columns of keys too, they
    count for the texts of those keys only). After a region's adjective, a word two letters from AREA at most is that word, even if it is one itself. Texts are cut before and after each
    token, so that all that lies between stays."""
    upper = F.translate(F.upper(F.coalesce(F.col(body), F.lit(""))), "Ё", "Е")
    # odd places of the array are tokens, even ones what lies between
    cut = F.regexp_replace(upper, f"({TOKEN})", "\u0001$1\u0001")
    parts = texts.select(*keys, F.posexplode(F.split(cut, "\u0001")).alias("i", "word"))
    tokens_ = parts.where("i % 2 = 1")
    beside = W.partitionBy(*keys).orderBy("i")
    tokens_ = tokens_.withColumn("left", F.lag("word").over(beside)).withColumn("right", F.lead("word").over(beside))
    words = vocabulary.select(F.col("word").alias("candidate")).distinct()
    own = tokens_.select("word").distinct()
    unknown = own.join(known.select("word").distinct(), "word", "left_anti") if known is not None else own
    options = nearest_words(unknown, words, least, long)
    area = own.join(words, F.col("word") == F.col("candidate"), "left_anti").where((F.length("word") >= least) & (F.levenshtein("word", F.lit(AREA), AREA_EDITS) >= 0)).select("word", F.lit(True).alias("area"))
    found = tokens_.join(options, "word", "left").join(area, "word", "left")
    single = found.where(F.col("candidates").isNotNull() & (F.size("candidates") == 1)).select(*keys, "i", F.get("candidates", F.lit(0)).alias("repaired"))
    if neighbours is not None:
        several = found.where(F.size("candidates") > 1).select(*keys, "i", "left", "right", F.explode("candidates").alias("candidate"))
        own_keys = [k for k in keys if k in neighbours.columns]
        pairs = neighbours.groupBy(*own_keys, "left", "right").agg(F.sum("n").alias("n"))
        before = pairs.select(*own_keys, "left", F.col("right").alias("candidate"), F.col("n").alias("before"))
        after = pairs.select(*own_keys, F.col("left").alias("candidate"), "right", F.col("n").alias("after"))
        seen = several.join(before, [*own_keys, "left", "candidate"], "left").join(after, [*own_keys, "right", "candidate"], "left").withColumn("n", F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0)))
        ranked = seen.groupBy(*keys, "i").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "candidate")))).alias("r"))
        first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
        single = single.unionByName(ranked.where((first["n"] > 0) & (first["n"] > second["n"])).select(*keys, "i", first["candidate"].alias("repaired")))
    by_area = found.where(F.col("area") & F.col("left").rlike(REGION_ADJECTIVE)).select(*keys, "i", F.lit(AREA).alias("is_area"))
    whole = parts.join(single, [*keys, "i"], "left").join(by_area, [*keys, "i"], "left").withColumn("new", F.coalesce("is_area", "repaired", "word"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "word", "new")))
    changed = F.transform(F.filter("all", lambda x: x["word"] != x["new"]), lambda x: F.struct(x["word"].alias("word"), x["new"].alias("repaired")))
    return whole.groupBy(*keys).agg(ordered.alias("all")).select(*keys, F.array_join(F.transform("all", lambda x: x["new"]), "").alias("text"), changed.alias("fixes"))
