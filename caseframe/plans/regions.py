"""Fields of scanned forms by their printed labels: where each label stands, which region belongs to it, what the words there say.

words: keys, height, width (of the page), pass, block, par, line, word, text, conf, x, y, w, h. Forms are configuration: fields in the
order of the form, each with `scan`: anchor (variants of its label), region (dy0, dy1 in heights of the label's words, x0, x1 in shares
of the width) and clip. Pixels are an adapter's work: shares of blue and dark ink come as columns of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.functions.similarity import _best_window
from caseframe.functions.text import squeeze, text
from caseframe.operators import likeness, steps
from caseframe.operators.ranges import points_in_boxes
from caseframe.operators.words import LINE

#: Words of a label at most, how like a short and a long one a label must be, letters of a short one.
MOST_WORDS, SHORT_LIKE, LONG_LIKE, SHORT_LABEL = 9, 85, 72, 8
#: Least height, how printed lines are known, how like a label's word a word is.
LEAST_HEIGHT, PRINTED_CONF, PRINTED_LETTERS, PRINTED_LIKE, LABEL_WORD_LIKE = 20, 60, 6, 85, 75
#: Shares of ink, confidences and letters that decide whether a region is empty, printed or written by hand.
NO_BLUE, NO_DARK, SOME_BLUE, THIN, FAINT = 0.002, 0.01, 0.004, 0.004, 0.03
PRINTED_SURE, WRITTEN_BELOW, WHOLE_SURE, FAINT_SURE, LEAST_LETTERS = 75, 70, 70, 45, 4
#: A region is form text only if so large a share of its words, and of so many at least, is like the labels' words.
FORM_SHARE, FORM_WORDS, FORM_WORD_LIKE = 0.6, 3, 85


def anchors_of(form: Mapping) -> list[tuple[int, str, int, str]]:
    """(place in the form, field, place of the variant, variant in lower case) of every label that a field is found by."""
    fields = [(name, spec["scan"]) for name, spec in form["fields"].items() if spec.get("scan")]
    return [(i, name, j, v.lower()) for i, (name, scan) in enumerate(fields) for j, v in enumerate(scan["anchor"])]


def _lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with their words in order (ws) and the lowest edge of them."""
    good = steps.dealt(words.where((F.trim("text") != "") & (F.col("conf") >= 0)), keys)
    w = F.struct("word", "text", "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "h")
    return good.groupBy(*keys, "pass", *LINE).agg(F.array_sort(F.collect_list(w)).alias("ws"), F.max(F.col("y") + F.col("h")).alias("line_y1"))


def _boxes(runs: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Runs of words (first and size of a line's ws) with their phrase and box."""
    runs = runs.withColumn("part", F.slice("ws", F.col("first"), F.col("size")))
    of = lambda field: F.transform("part", lambda x: x[field])
    heights = F.array_sort(of("h"))
    middle = (F.get(heights, F.floor((F.col("size") - 1) / 2).cast("int")) + F.get(heights, F.floor(F.col("size") / 2).cast("int"))) / 2
    return runs.select(
        *keys, "pass", *LINE, "first", "size", "line_y1", *columns, F.lower(F.array_join(of("text"), " ")).alias("phrase"),
        F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"), middle.cast("int").alias("h"),
    )


def phrases(words: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of up to MOST_WORDS words of one line: phrase in lower case, place (line, first, size), box, median height, y1 of the line."""
    n = F.size("ws")
    lines = _lines(words, keys).withColumn("first", F.explode(F.sequence(F.lit(1), n)))
    return _boxes(lines.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), n - F.col("first") + 1)))), keys)


def find_anchors(words: DataFrame, keys: list[str], form: Mapping) -> DataFrame:
    """keys, field, x0, y0, x1, y1, h and score of each field's label: the run of words most like one of its variants, not above the
    label found for an earlier field; the first of equals.

    Each line's runs are held against the form's own few labels where the line is; the few runs that are like one are folded by page."""
    labels = words.sparkSession.createDataFrame(anchors_of(form), "place int, field string, variant int, label string")
    like = likeness.runs_like({v: SHORT_LIKE if len(v) <= SHORT_LABEL else LONG_LIKE for _, _, _, v in anchors_of(form)}, MOST_WORDS)
    lines = _lines(words, keys).withColumn("hits", like(F.transform("ws", lambda w: F.lower(w["text"]))))
    runs = lines.select(*keys, "pass", *LINE, "ws", "line_y1", F.inline("hits"))
    found = _boxes(runs, keys, "label", "score").join(F.broadcast(labels), "label")  # the form's own labels: a few dozen rows
    order = F.struct("pass", *LINE, "first", "size", "variant")
    hit = F.struct("place", (-F.col("score")).alias("minus"), order.alias("order"), "field", "x0", "y0", "x1", "y1", "h", "line_y1")
    pages = found.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    kind = "array<struct<place:int,field:string,x0:bigint,y0:bigint,x1:bigint,y1:bigint,h:int,score:double>>"
    start = F.struct(F.lit(0).cast("bigint").alias("below"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        last = F.try_element_at(s["out"], F.lit(-1))
        done = (F.size(s["out"]) > 0) & (last["place"] == x["place"])
        # hits of a field come best first: the first one that isn't above the earlier fields' label
        low = F.when(done, F.lit(True)).otherwise(x["line_y1"] < s["below"])
        new = F.struct(x["place"].alias("place"), x["field"].alias("field"), *(x[c].cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")), x["h"].alias("h"), (-x["minus"]).alias("score"))
        return F.when(low, s).otherwise(F.struct((x["y0"] - 5).cast("bigint").alias("below"), F.concat(s["out"], F.array(new)).alias("out")))

    return pages.select(*keys, F.inline(F.aggregate("hits", start, step)["out"])).drop("place")


def printed_lines(words: DataFrame, keys: list[str], form: Mapping) -> DataFrame:
    """keys, bx0, by0, bx1, by1 of lines that are the form's own print: much like one of its labels or fixed texts and not much longer.

    Lines that hold a label as it stands are not compared by windows, and texts that a batch holds again not at all."""
    good = steps.dealt(words.where((F.trim("text") != "") & (F.col("conf") >= 0)), keys)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    lines = good.groupBy(*keys, "pass", *LINE).agg(
        F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max(F.col("x") + F.col("w")).alias("bx1"), F.max(F.col("y") + F.col("h")).alias("by1"), F.avg("conf").alias("conf"), F.lower(joined).alias("text")
    )
    lines = lines.where((F.col("conf") >= PRINTED_CONF) & (F.length("text") >= PRINTED_LETTERS))
    labels = [v for spec in form["fields"].values() for v in (spec.get("scan") or {}).get("anchor", [])] + list(form.get("static_text") or []) + list(form["detect"]["keywords"])
    return lines.where(_printed([v.lower() for v in dict.fromkeys(labels)])(F.col("text"))).select(*keys, "bx0", "by0", "bx1", "by1")


def _printed(labels: list[str]) -> Callable[[Column], Column]:
    """A function of texts in lower case: whether one is much like a label, not much longer."""

    def like(text_: str) -> bool:
        near = [v for v in labels if len(text_) <= 1.6 * len(v) + 10]
        return any(v in text_ or text_ in v for v in near) or any(_best_window(*sorted((v, text_), key=len), PRINTED_LIKE - 1e-6)[0] >= PRINTED_LIKE for v in near if v and text_)

    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        known = {t: like(t) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t, False)).astype(bool)

    return run


def regions(anchors: DataFrame, pages: DataFrame, printed: DataFrame, keys: list[str], form: Mapping) -> DataFrame:
    """keys, field, x0, y0, x1, y1 of the region of each label found. pages: keys, width, height. A region that begins above its label
    doesn't reach into a printed line there: it begins below that line's middle."""
    spec = [(name, float(s["region"]["dy0"]), float(s["region"]["dy1"]), float(s["region"]["x0"]), float(s["region"]["x1"]), bool(s.get("clip", True))) for name, f in form["fields"].items() if (s := f.get("scan"))]
    table = F.broadcast(anchors.sparkSession.createDataFrame(spec, "field string, dy0 double, dy1 double, sx0 double, sx1 double, clip boolean"))  # a row a field
    a = anchors.select(*keys, "field", F.col("y0").alias("top"), F.greatest("h", F.lit(LEAST_HEIGHT)).alias("unit")).join(table, "field").join(pages.hint("merge"), keys)
    whole = lambda c: F.floor(c).cast("bigint")
    a = a.withColumn("y0", whole(F.greatest(F.lit(0.0), F.col("top") + F.col("dy0") * F.col("unit")))).withColumn("y1", whole(F.least(F.col("height"), F.col("top") + F.col("dy1") * F.col("unit"))))
    a = a.withColumn("x0", whole(F.col("sx0") * F.col("width"))).withColumn("x1", whole(F.least(F.col("width"), F.col("sx1") * F.col("width"))))
    across = lambda p: F.least(p["bx1"], F.col("x1")) - F.greatest(p["bx0"], F.col("x0")) > 0.3 * (p["bx1"] - p["bx0"])
    # a page's printed lines are few
    a = a.join(printed.groupBy(*keys).agg(F.collect_list(F.struct("bx0", "by0", "bx1", "by1")).alias("printed")).hint("merge"), keys, "left")
    above = F.filter("printed", lambda p: (p["by0"] < F.col("top") - 0.8 * F.col("unit")) & (p["by1"] > F.col("y0")) & across(p))
    cut = F.when((F.col("dy0") < 0) & F.col("clip"), F.array_max(F.transform(above, lambda p: F.floor((p["by0"] + p["by1"]) / 2))) + 1)
    return a.withColumn("y0", F.greatest("y0", F.coalesce(cut, F.lit(0)))).select(*keys, "field", "x0", "y0", "x1", "y1")


def words_in_regions(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, text (words whose middles lie in the region, by line and then from left to right) and conf of every region that holds
    words."""
    good = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    points = good.select(*keys, "pass", *LINE, "word", "text", "conf", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    inside = points_in_boxes(points, boxes, keys)
    ordered = F.array_sort(F.collect_list(F.struct("pass", *LINE, "word", "text")))
    return inside.groupBy(*keys, "field").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.avg("conf").alias("conf"))


def own_letters(found: DataFrame, keys: list[str], form: Mapping) -> DataFrame:
    """found with `rest`, a region's words that are not like a word of the form's labels, and `form_only`: most of its words are."""
    labels = [v for spec in form["fields"].values() for v in (spec.get("scan") or {}).get("anchor", [])] + list(form.get("static_text") or []) + list(form["detect"]["keywords"])
    printed = sorted({w.lower() for v in labels for w in _words(v)})
    like = likeness.most_like(printed, min(LABEL_WORD_LIKE, FORM_WORD_LIKE))
    own = F.transform(F.regexp_extract_all("text", F.lit(r"(?U)[\w@.]{2,}"), 0), F.lower)
    long = F.regexp_extract_all(F.lower("text"), F.lit("[а-яёa-z]{3,}"), 0)
    out = found.withColumns({"__own": own, "__long": long}).withColumns({"__own_like": like(F.col("__own")), "__long_like": like(F.col("__long"))})
    rest = F.filter("__own", lambda w, i: F.get("__own_like", i) < LABEL_WORD_LIKE - 1e-9)
    of_form = F.size(F.filter("__long_like", lambda x: x >= FORM_WORD_LIKE - 1e-9))
    form_only = (F.size("__long") >= FORM_WORDS) & (of_form / F.size("__long") >= FORM_SHARE)
    return out.select(*found.columns, F.coalesce(F.array_join(rest, " "), F.lit("")).alias("rest"), F.coalesce(form_only, F.lit(False)).alias("form_only"))


def _words(label: str) -> list[str]:
    out, word = [], ""
    for c in label + " ":
        if c.isalpha():
            word += c
        else:
            out += [word] if len(word) >= 2 else []
            word = ""
    return out


def goes_on(page_value: Column, region_text: Column) -> Column:
    """The page's text breaks a value off inside a word, and the region's goes on from there."""
    plain = lambda c: F.translate(F.lower(squeeze(F.regexp_replace(text(c), "_{2,}", " "))), "ё", "е")
    a, b = plain(page_value), plain(region_text)
    at = F.instr(b, a)
    after = F.substring(b, at + F.length(a), F.lit(1))
    return (F.length(a) >= 4) & (at > 0) & after.rlike(r"^\p{L}") & a.rlike(r"\p{L}$")


def field_values(found: DataFrame, by_hand: bool | None = None, model: bool = False) -> DataFrame:
    """found with `value`, `source`, `confidence`, `needs_review` and `handwritten` for each region.

    found: text, conf, rest and form_only of the region; blue, dark and dark_clean (shares of ink, with and without ruled lines); page_value and
    page_conf (what the text of the whole page gives, null if nothing); model_value where a model has read the region. by_hand: whether
    the form is known to be written by hand, None to tell by the ink. Without ink a field is empty; without words of its own, too. Print is
    taken from the page's text if that has it whole, else from the region. Handwriting is a model's to read, else the page's reading
    stays, unsure, to be confirmed."""
    page = F.length(text("page_value")) > 0
    value_there = F.coalesce(page, F.lit(False))
    sure = F.coalesce("conf", F.lit(0.0))
    blank = (F.col("blue") < NO_BLUE) & (F.col("dark") < NO_DARK)
    letters = F.length(F.replace(F.coalesce("rest", F.lit("")), F.lit(" ")))
    nothing = (F.col("blue") <= NO_BLUE) & ~value_there & ((F.col("dark_clean") < THIN) | (letters < LEAST_LETTERS) | ((sure < FAINT_SURE) & (F.col("dark_clean") < FAINT)))
    if by_hand is None:
        print_ = (F.col("blue") <= SOME_BLUE) & ((sure >= PRINTED_SURE) | value_there)
        written = ~print_ & ((F.col("blue") > SOME_BLUE) | (sure < WRITTEN_BELOW))
    else:
        written = F.lit(by_hand) & ~((F.col("blue") <= SOME_BLUE) & (sure >= PRINTED_SURE) & value_there)
    longer = ~written & value_there & (sure >= WHOLE_SURE) & goes_on(F.col("page_value"), F.col("text"))
    from_page = value_there & ~longer
    state = (
        F.when(blank, "blank").when(nothing, "nothing").when(~written & from_page, "page").when(written & F.lit(not model) & from_page, "unsure page").when(~written & F.coalesce("form_only", F.lit(False)), "form only").when(written, "written").otherwise("region")
    )
    out = found.withColumn("state", state)
    case = lambda **by: F.coalesce(*(F.when(F.col("state") == k.replace("_", " "), v) for k, v in by.items()))
    model_text = F.col("model_value") if model else F.lit("")
    empty = F.lit("")
    region = F.ltrim(text("text"), F.lit("):;,. "))
    return out.select(
        *found.columns,
        "state",
        case(blank=empty, nothing=empty, page=F.col("page_value"), unsure_page=F.col("page_value"), form_only=empty, written=F.coalesce(model_text, empty), region=region).alias("value"),
        case(blank=F.lit("scan"), nothing=F.lit("scan"), page=F.lit("page"), unsure_page=F.lit("page"), form_only=F.lit("scan"), written=F.lit("vlm+hand" if model else "hand"), region=F.lit("ocr")).alias("source"),
        case(
            blank=F.lit(0.9), nothing=F.lit(0.8), page=F.coalesce("page_conf", F.lit(0.0)), unsure_page=F.least(F.coalesce("page_conf", F.lit(0.0)), F.lit(0.55)), form_only=F.lit(0.6),
            written=F.when(F.length(F.coalesce(model_text, empty)) > 0, 0.6).otherwise(0.0), region=sure / 100,
        ).cast("double").alias("confidence"),
        case(blank=F.lit(False), nothing=F.lit(False), page=F.lit(False), unsure_page=F.lit(True), form_only=F.lit(True), written=F.lit(True), region=sure < 75).alias("needs_review"),
    )


def scan_fields(words: DataFrame, pages: DataFrame, keys: list[str], form: Mapping, ink: DataFrame, page_values: DataFrame | None = None, by_hand: bool | None = None, model: bool = False) -> DataFrame:
    """Every field of a scanned form whose label is found: its region, what stands there and what it comes to.

    pages: keys, width, height. ink: keys, field, blue, dark, dark_clean and, with a model, model_value. page_values: keys, field,
    page_value, page_conf. Tables with rows for each page are merged, however small their files look: none is broadcast. Regions are
    found once, though words are sought in them and they are kept where none lie."""
    anchors = find_anchors(words, keys, form)
    boxes = steps.written(regions(anchors, pages, printed_lines(words, keys, form), keys, form), "regions")
    said = own_letters(words_in_regions(words, boxes, keys), keys, form)
    found = boxes.where("y1 - y0 >= 10 AND x1 - x0 >= 10").join(said.hint("merge"), [*keys, "field"], "left").join(ink.hint("merge"), [*keys, "field"], "left")
    if page_values is None:
        found = found.withColumns({"page_value": F.lit(None).cast("string"), "page_conf": F.lit(None).cast("double")})
    else:
        found = found.join(page_values.hint("merge"), [*keys, "field"], "left")
    return field_values(found.fillna(0.0, ["blue", "dark", "dark_clean"]), by_hand, model)
