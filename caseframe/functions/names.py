"""Personal names: order, grammatical case by suffix rules, comparison.

There is no dictionary: candidates for the nominative come from a table of endings, and a word that no rule fits stands
for itself. So words are 'known' only if a lexicon is given. Names have few parts, which keeps the folds short.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.similarity import indel_ratio
from caseframe.functions.text import ColumnOrName, bound, fold, let, text

#: Endings of patronymics in all cases, by gender, and particles that stand for them.
MALE_PATRONYMIC = r"(?:ВИЧ|ИЧ)(?:А|У|ЕМ|Е)?$|ОГЛЫ$|УУЛУ$"
FEMALE_PATRONYMIC = r"(?:ВН|ИЧН)(?:А|Ы|Е|У|ОЙ)$|КЫЗЫ$"
PATRONYMIC = r"(?:ВИЧ|ИЧ)(?:А|У|ЕМ|Е)?$|(?:ВН|ИЧН)(?:А|Ы|Е|У|ОЙ)$|^(?:ОГЛЫ|КЫЗЫ|УУЛУ)$"
NUMERIC_DATE = r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}"

#: Endings of oblique cases and what the nominative may have instead. Fixed values, in natural order.
ENDINGS = (
    ("ВИЧА", "ВИЧ"), ("ВИЧУ", "ВИЧ"), ("ВИЧЕМ", "ВИЧ"), ("ВИЧЕ", "ВИЧ"), ("ИЧА", "ИЧ"), ("ИЧУ", "ИЧ"), ("ИЧЕМ", "ИЧ"), ("ИЧЕ", "ИЧ"),
    ("ВНЫ", "ВНА"), ("ВНЕ", "ВНА"), ("ВНУ", "ВНА"), ("ВНОЙ", "ВНА"), ("ИЧНЫ", "ИЧНА"), ("ИЧНЕ", "ИЧНА"), ("ИЧНУ", "ИЧНА"), ("ИЧНОЙ", "ИЧНА"),
    ("ОВОЙ", "ОВА"), ("ЕВОЙ", "ЕВА"), ("ИНОЙ", "ИНА"), ("ЫНОЙ", "ЫНА"), ("ОВУ", "ОВА"), ("ЕВУ", "ЕВА"), ("ИНУ", "ИНА"), ("ЫНУ", "ЫНА"),
    ("ОВА", "ОВ"), ("ЕВА", "ЕВ"), ("ИНА", "ИН"), ("ЫНА", "ЫН"), ("ОВУ", "ОВ"), ("ЕВУ", "ЕВ"), ("ИНУ", "ИН"), ("ЫНУ", "ЫН"),
    ("ОВЫМ", "ОВ"), ("ЕВЫМ", "ЕВ"), ("ИНЫМ", "ИН"), ("ЫНЫМ", "ЫН"), ("ОВЕ", "ОВ"), ("ЕВЕ", "ЕВ"), ("ИНЕ", "ИН"),
    ("СКОГО", "СКИЙ"), ("СКОМУ", "СКИЙ"), ("СКИМ", "СКИЙ"), ("СКОМ", "СКИЙ"), ("СКОЙ", "СКАЯ"), ("СКУЮ", "СКАЯ"),
    ("ИИ", "ИЯ"), ("ИЮ", "ИЯ"), ("ИЕЙ", "ИЯ"), ("ИЯ", "ИЙ"), ("ИЮ", "ИЙ"), ("ИЕМ", "ИЙ"), ("ЕЯ", "ЕЙ"), ("ЕЮ", "ЕЙ"), ("ЕЕМ", "ЕЙ"),
    ("ЬИ", "ЬЯ"), ("ЬЮ", "ЬЯ"), ("ЬЕЙ", "ЬЯ"), ("ОЙ", "А"), ("ЕЙ", "А"), ("ЕЙ", "Я"), ("Ы", "А"), ("И", "А"), ("И", "Я"), ("И", "Ь"),
    ("Е", "А"), ("Е", "Я"), ("Е", ""), ("У", "А"), ("У", ""), ("Ю", "Я"), ("Ю", "Й"), ("Ю", "Ь"), ("Я", "Й"), ("Я", "Ь"), ("А", ""), ("ОМ", ""), ("ЕМ", "Ь"), ("ЕМ", "Й"),
)


@bound(1)
def gender(patronymic: ColumnOrName) -> Column:
    """'masc' or 'femn' by a patronymic in any case; null otherwise."""
    p = fold(patronymic)
    return F.when(p.rlike(MALE_PATRONYMIC), "masc").when(p.rlike(FEMALE_PATRONYMIC), "femn")


def is_patronymic(word: ColumnOrName) -> Column:
    return fold(word).rlike(PATRONYMIC)


def split_name(c: ColumnOrName) -> Column:
    """Cyrillic words of a text without its numeric dates; single letters only if upper-case."""
    words = F.regexp_extract_all(F.regexp_replace(text(c), NUMERIC_DATE, " "), F.lit(r"[А-ЯЁа-яё\-]+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 1) | (w == F.upper(w)) & (w != F.lower(w)))


@bound(1)
def ordered(words: Column) -> Column:
    """First name, patronymic, surname as surname, first name, patronymic; other orders unchanged."""
    turn = (F.size(words) == 3) & is_patronymic(F.get(words, F.lit(1))) & ~is_patronymic(F.get(words, F.lit(2)))
    return F.when(turn, F.array(F.get(words, F.lit(2)), F.get(words, F.lit(0)), F.get(words, F.lit(1)))).otherwise(words)


#: Words at which a name ends, and words before it that are no part of it. Fixed values.
STOP_WORDS = (
    r"^(?:(?:ЯНВАР|ФЕВРАЛ|АПРЕЛ|ИЮН|ИЮЛ|СЕНТЯБР|ОКТЯБР|НОЯБР|ДЕКАБР)[ЬЯЕ]|МАРТА?|МАРТЕ|МА[ЯЙЕ]|АВГУСТА?|АВГУСТЕ|ГОДА?|ГОДУ|ГР|РОЖДЕНИЯ|ПАСПОРТА?"
    r"|ПРОШУ|ПРОСИМ|ПРОСИТ|ПЕРЕДАТЬ|ПЕРЕДАЧЕ|ПРАВА?|ДАТА|СЕРИ[ЯИ]|НОМЕР|ВЫДАН[АО]?|ИНН|ПОЛ|МЕСТО|ГРАЖДАН(?:ИН|КА|КИ|ИНА|СТВО)|ЗАРЕГИСТРИРОВАН[А-Я]*"
    r"|ПРОЖИВАЮЩ[А-Я]*|АДРЕС|ДОМЕН[А-Я]*|ФИО|КОД|СНИЛС|ОГРН|ТЕЛ|ТЕЛЕФОН)$"
)
LEAD_WORDS = r"^(?:ГРАЖДАН[А-Я]*|ГР|РОССИЙСКОЙ|ФЕДЕРАЦИИ|РФ|ИП)$"


@bound(1)
def extract_name(c: ColumnOrName, most: int = 4) -> Column:
    """The name at the beginning of a text, as words in its order: a fold that skips what leads in, and ends at a stop
    word, a lower-case word, a patronymic in third place or after `most` words."""

    def step(s: Column, w: Column) -> Column:
        folded = fold(w)
        size = F.size(s["words"])
        lead = (size == 0) & folded.rlike(LEAD_WORDS)
        low = (F.substring(w, 1, 1) != F.upper(F.substring(w, 1, 1))) & ~folded.isin("ОГЛЫ", "КЫЗЫ", "УУЛУ")
        stop = folded.rlike(STOP_WORDS) | low | w.startswith("-")
        more = F.concat(s["words"], F.array(w))
        full = (size + 1 >= most) | ((size + 1 >= 3) & is_patronymic(w))
        taken = F.struct(more.alias("words"), full.alias("done"))
        ended = F.struct(s["words"].alias("words"), (size > 0).alias("done"))
        return F.when(s["done"] | lead, s).when(stop, ended).otherwise(taken)

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("done"))
    return F.aggregate(split_name(c), start, step)["words"]


def _ending(old: str, new: str) -> str:
    return f"named_struct('old', '{old}', 'n', {len(old)}, 'new', '{new}', 'of', '{'femn' if new.endswith(('А', 'Я')) else 'masc'}')"


@bound(2)
def nominatives(word: Column, own_gender: Column) -> Column:
    """Candidates for the nominative of a word in any case, the word itself included."""
    # a constant of the plan: the endings by their last letter, in their order
    by_last = {last: [_ending(old, new) for old, new in ENDINGS if old[-1] == last] for last in dict.fromkeys(old[-1] for old, _ in ENDINGS)}
    table = F.expr(f"map({', '.join(f'{chr(39)}{last}{chr(39)}, array({chr(44).join(own)})' for last, own in by_last.items())})")

    def all_of(w: Column) -> Column:
        fits = lambda e: w.endswith(e["old"]) & (F.length(w) > e["n"] + 1) & (own_gender.isNull() | (own_gender == e["of"]) | (e["n"] < 2))
        known = table[F.right(w, F.lit(1))]
        found = F.transform(F.filter(known, fits), lambda e: F.concat(F.substring(w, F.lit(1), F.length(w) - e["n"]), e["new"]))
        return F.when(known.isNull(), F.array(w)).otherwise(F.array_distinct(F.concat(F.array(w), found)))

    return let(fold(word), all_of)


@bound(1)
def to_nominative(c: ColumnOrName) -> Column:
    """A whole name in the nominative, surname first, by the first rule that fits each word and the name's gender."""
    return let(_words_and_gender(c), _nominative)


def _words_and_gender(c: Column) -> Column:
    return let(ordered(split_name(c)), lambda words: F.struct(words.alias("words"), F.when(F.size(words) >= 3, gender(F.element_at(words, -1))).alias("g")))


def _nominative(name: Column) -> Column:
    words, g = name["words"], name["g"]

    def one(w: Column, i: Column) -> Column:
        return let(nominatives(w, g), lambda forms: F.when(g.isNotNull() & (F.size(forms) > 1), F.get(forms, F.lit(1))).otherwise(F.get(forms, F.lit(0))))

    def female(w: Column, i: Column) -> Column:
        return F.when((i == 0) & (g == "femn") & w.rlike("(?:ОВ|ЕВ|ИН|ЫН)$"), F.concat(w, F.lit("А"))).otherwise(w)

    return F.array_join(F.transform(F.transform(words, one), female), " ")


@bound(2)
def name_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100, the mean over the parts in order: the best candidate of a's part against b's part (only a is inflected), 100
    for an initial that fits, 0 for a part that one side lacks. 0 if a side is empty."""
    return let(F.struct(_words_and_gender(a).alias("a"), ordered(split_name(b)).alias("y")), _similarity)


def _similarity(names: Column) -> Column:
    x, g, y = names["a"]["words"], names["a"]["g"], names["y"]

    def part(i: Column) -> Column:
        return F.when((i >= F.size(x)) | (i >= F.size(y)), 0.0).otherwise(let(F.struct(F.get(x, i).alias("w"), fold(F.get(x, i)).alias("own"), fold(F.get(y, i)).alias("target")), like))

    def like(p: Column) -> Column:
        best = F.array_max(F.transform(nominatives(p["w"], g), lambda c: indel_ratio(c, p["target"])))
        initial = (F.length(p["w"]) == 1) & p["target"].startswith(p["own"])
        # the word itself is one of its candidates
        return F.when((p["own"] == p["target"]) & (p["own"] != "") | initial, 100.0).otherwise(best)

    count = F.greatest(F.size(x), F.size(y))
    scores = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), part)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / count)


@bound(2)
def reading_error_only(stated: ColumnOrName, read: ColumnOrName, lexicon: tuple[str, ...]) -> Column:
    """The names differ only in a first name or patronymic that was read as an unknown word and is stated as a known one much
    like it. lexicon: known first names and patronymics, folded."""
    if not lexicon:
        return F.lit(False)
    x, y = split_name(stated), split_name(read)
    g = F.when(F.size(x) >= 3, gender(F.element_at(x, -1)))
    known = F.array(*map(F.lit, lexicon))

    def verdict(i: Column) -> Column:
        forms, target = nominatives(F.get(x, i), g), fold(F.get(y, i))
        like = F.exists(forms, lambda f: (indel_ratio(f, target) >= 85) & F.array_contains(known, f))
        return F.when(F.array_contains(forms, target), "same").when((i > 0) & like & ~F.array_contains(known, target), "error").otherwise("other")

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), verdict)
    return (F.size(x) == F.size(y)) & (F.size(x) >= 2) & F.array_contains(parts, "error") & ~F.array_contains(parts, "other")
