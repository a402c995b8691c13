"""Recognised pages: likeness, boxes, roles by place, consensus, precedence, labels and regions, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseframe.functions.similarity import _best_window, _row_ratio
from caseframe.operators import likeness, ranges
from caseframe.plans import passport, regions

WORDS = "page int, height int, width int, pass int, block int, par int, line int, word int, text string, conf double, x int, y int, w int, h int"


def words(lines: list[tuple[int, int, str]], page: int = 1, pass_: int = 0, conf: float = 90.0, start: int = 0) -> list[tuple]:
    """(line, y, text) as rows: words 100 pixels apart, 30 high."""
    return [(page, 2000, 1000, pass_, 0, 0, start + line, i, t, conf, 50 + 100 * i, y, 90, 30) for line, y, text in lines for i, t in enumerate(text.split())]


# ---------------------------------------------------------------------------------------------------------------
# likeness and boxes


@pytest.mark.parametrize("least", [72, 75, 80.0000001, 85])
def test_index_of_letter_pairs_loses_nothing(spark, least):
    draw = random.Random(int(least))
    letters = "абв"
    labels = ["".join(draw.choice(letters) for _ in range(n)) for n in (1, 2, 3, 4, 4, 5, 6, 7, 9, 13, 21)]
    values = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 16))) for _ in range(250)}
    for label in labels:  # near ones
        for _ in range(25):
            w = list(label)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(w) + 1)
                w[at : at + draw.randint(0, 1)] = draw.choice([[], [draw.choice(letters + "г")]])
            values.add("".join(w))
    values.discard("")
    want = {(v, b) for v in values for b in labels if _row_ratio(v, b) >= least}
    found = likeness.like_pairs(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame([(b,) for b in labels], "b string"), "b", least)
    got = {(r["v"], r["b"]): r["score"] for r in found.collect()}
    assert set(got) == want and all(abs(s - _row_ratio(*k)) < 1e-9 for k, s in got.items())


def test_likeness_of_nothing_and_null(spark):
    labels = spark.createDataFrame([("дата",)], "b string")
    rows = spark.createDataFrame([(None, 1), ("", 2), ("дата", 3), ("дета", 4), ("слово", 5)], "v string, n int")
    assert [r["v"] for r in likeness.like_pairs(rows, "v", labels, "b", 75).orderBy("v").collect()] == ["дата", "дета"]
    assert sorted(r["n"] for r in likeness.without_like(rows, "v", labels, "b", 75).collect()) == [1, 2, 5]
    assert likeness.like_pairs(rows.limit(0), "v", labels, "b", 75).count() == 0 and likeness.without_like(rows, "v", labels.limit(0), "b", 75).count() == 5
    with pytest.raises(ValueError, match="70"):
        likeness.short_sum(60)


@pytest.mark.parametrize("cell", [7, 64, 5000])
def test_points_in_boxes(spark, cell):
    draw = random.Random(cell)
    points = [(draw.randint(0, 2), i, draw.uniform(0, 300), float(draw.randint(0, 300))) for i in range(300)]
    boxes = [(draw.randint(0, 2), b, x, y, x + draw.randint(0, 150), y + draw.randint(-5, 90)) for b in range(40) for x, y in [(draw.randint(0, 250), draw.randint(0, 250))]]
    want = sorted((p[1], b[1]) for p in points for b in boxes if p[0] == b[0] and b[2] <= p[2] < b[4] and b[3] <= p[3] < b[5])
    found = ranges.points_in_boxes(spark.createDataFrame(points, "page int, id int, px double, py double"), spark.createDataFrame(boxes, "page int, box int, x0 int, y0 int, x1 int, y1 int"), ["page"], cell)
    assert sorted((r["id"], r["box"]) for r in found.collect()) == want


# ---------------------------------------------------------------------------------------------------------------
# the main page of a passport

PAGE = [
    (0, 100, "РОССИЙСКАЯ ФЕДЕРАЦИЯ"), (1, 240, "ОТДЕЛОМ МИЛИЦИИ"), (2, 290, "РАЙОНА КЕДРОВКА"), (3, 440, "12.05.2001 770-001"),
    (4, 1100, "ТЕСТОВ"), (5, 1180, "ПЁТР"), (6, 1260, "СЕРГЕЕВИЧ"), (7, 1320, "МУЖ. 15.03.1980"), (8, 1400, "ГОР. ЗАРЕЧНЫЙ"),
]


def roles(found) -> dict:
    return {r["role"]: r["value"] for r in found.collect()}


def test_main_text_by_place(spark):
    got = roles(passport.main_text(spark.createDataFrame(words(PAGE), WORDS), ["page"]))
    assert got == {
        "issue_date": "12.05.2001", "birth_date": "15.03.1980", "department_code": "770-001", "sex": "МУЖ", "surname": "ТЕСТОВ", "given_name": "ПЕТР", "patronymic": "СЕРГЕЕВИЧ",
        "issued_by": "ОТДЕЛОМ МИЛИЦИИ РАЙОНА КЕДРОВКА", "birth_place": "ГОР. ЗАРЕЧНЫЙ",
    }


def test_what_a_line_says_goes_before_its_place(spark):
    lines = [(0, 300, "рождения 15.03.1980"), (1, 1500, "выдан 12.05.2001"), (2, 1600, "31.02.2001")]
    assert roles(passport.main_text(spark.createDataFrame(words(lines), WORDS), ["page"])) == {"birth_date": "15.03.1980", "issue_date": "12.05.2001"}


def test_passes_vote_and_known_names_count_more(spark):
    bad = [(i, y, t.replace("ТЕСТОВ", "ТЕСТОР").replace("ПЁТР", "ЛЁТР").replace("2001 ", "2007 ")) for i, y, t in PAGE]
    rows = words(PAGE, conf=60.0) + words(bad, pass_=1, conf=90.0) + words(PAGE, page=2) + words(bad, page=3, pass_=1)
    frame = spark.createDataFrame(rows, WORDS)
    lexicon = spark.createDataFrame([("given_name", "ПЕТР"), ("surname", "ТЕСТОВ")], "kind string, word string")
    found = passport.main_text(frame, ["page"], lexicon).collect()
    by = {(r["page"], r["role"]): r for r in found}
    assert by[1, "surname"]["value"] == "ТЕСТОР" and by[1, "given_name"]["value"] == "ПЕТР"  # 60 x 3 against 90
    assert abs(by[1, "given_name"]["confidence"] - 0.6 * (0.6 + 0.4 * 180 / 270)) < 1e-9
    assert by[1, "issue_date"]["value"] == "12.05.2007"  # as many votes, read more surely
    assert by[2, "surname"]["value"] == "ТЕСТОВ" and by[3, "surname"]["value"] == "ТЕСТОР"


def test_weak_and_stray_words_of_names(spark):
    low = [(20, 1181, "ШУМ")]  # of low confidence, on the given name's line
    rows = words(PAGE) + words(low, conf=20.0, start=20) + words([(0, 1185, "Петров"), (1, 1184, "ВЫДАН")], pass_=2, start=60)
    got = roles(passport.main_text(spark.createDataFrame(rows, WORDS), ["page"]))
    assert (got["surname"], got["given_name"]) == ("ТЕСТОВ", "ПЕТР")
    no_patronymic = [x for x in PAGE if x[0] != 6]
    got = roles(passport.main_text(spark.createDataFrame(words(no_patronymic), WORDS), ["page"]))
    assert not {"surname", "given_name", "patronymic", "birth_place"} & set(got)


def test_value_lines_leave_labels_out(spark):
    lines = [(0, 100, "ВЫДАНО ОТДЕЛОМ Милиции ПО ДЕЛ"), (1, 200, "ЕДЕРАЦИЯ КЕДР-"), (2, 300, "01.02.2003 СЛОВО"), (3, 400, "ПОДРАЗДЕЛЕНИЕ МУЖ.")]
    frame = spark.createDataFrame(words(lines) + words([(9, 500, "ТИХО")], conf=10.0), WORDS)
    found = passport.value_lines(frame, passport.page_lines(frame, ["page"]), ["page"])
    assert sorted((r["y"], r["text"]) for r in found.collect()) == [(0.05, "ОТДЕЛОМ ПО"), (0.1, "КЕДР")]


def merged(readings: list[tuple[float, str, float]], known: set[str] | None) -> str:
    """Consensus in plain Python: rows by their first line, medoid by agreement, repeated rows left out."""
    rows: list[list] = []
    for r in sorted(readings):
        if rows and r[0] - rows[-1][0][0] < 0.012:
            rows[-1].append(r)
        else:
            rows.append([r])
    out: list[str] = []
    for row in rows:
        def score(t: str) -> float:
            s = sum(_row_ratio(t, o) / 100 * c * min(len(o), 40) for _, o, c in row)
            if known is None:
                return s
            own = [w for w in t.split() if len(w) >= 2]
            return s * (0.5 + (sum(w in known for w in own) / len(own) if own else 0))

        best = max(score(t) for _, t, _ in row)
        text = min((y, t) for y, t, _ in row if abs(score(t) - best) < 1e-9)[1]
        if not any(_best_window(*sorted((text, o), key=len))[0] > 85 for o in out):
            out.append(text)
    return " ".join(out)


@pytest.mark.parametrize("with_words", [False, True])
def test_consensus_is_the_reading_others_agree_with(spark, with_words):
    draw = random.Random(7)
    base = ["ОТДЕЛОМ МИЛИЦИИ", "РАЙОНА КЕДРОВКА", "ГОРОДА ЗАРЕЧНЫЙ", "ОТДЕЛОМ МИЛИЦИИ"]
    known = {"МИЛИЦИИ", "РАЙОНА", "ОТДЕЛОМ"}
    pages = {}
    for page in range(25):
        pages[page] = []
        for i, t in enumerate(base[: draw.randint(1, 4)]):
            for _ in range(draw.randint(1, 5)):
                w = list(t)
                if draw.random() < 0.5:
                    w[draw.randrange(len(w))] = draw.choice("ХЩЪ")
                pages[page].append((round(0.1 + 0.03 * i + draw.choice([0, 0.003, 0.007, 0.011]), 3), "".join(w), float(draw.randint(40, 95))))
    frame = spark.createDataFrame([(p, *r) for p, rs in pages.items() for r in rs], "page int, y double, text string, conf double")
    vocabulary = spark.createDataFrame([(w,) for w in known], "word string") if with_words else None
    got = {r["page"]: r["text"] for r in passport.consensus(frame, ["page"], vocabulary).collect()}
    assert got == {p: merged(rs, known if with_words else None) for p, rs in pages.items()}


def test_sources_by_precedence(spark):
    rows = [
        ("a", "surname", "ocr", "ТЕСТОР", 0.8, None), ("a", "surname", "mrz", "ТЕСТОВ", None, True), ("b", "surname", "ocr", "ТЕСТОР", 0.8, None), ("b", "surname", "mrz", "ТЕСТОВ", None, False),
        ("a", "department_code", "vlm", "770.001", None, None), ("b", "department_code", "ocr", "770-002", 0.59, None), ("b", "department_code", "vlm", "нет", None, None),
        ("a", "birth_date", "ocr", "01.01.1980", 0.5, None), ("a", "birth_date", "vlm", "15 марта 1980 г.", None, None), ("b", "birth_date", "ocr", "01.01.1980", 0.6, None), ("b", "birth_date", "vlm", "02.02.1982", None, None), ("b", "sex", "vlm", "", None, None),
    ]
    frame = spark.createDataFrame(rows, "id string, role string, source string, value string, confidence double, valid boolean")
    found = {(r["id"], r["role"]): r for r in passport.merge(frame, frame, ["id"]).collect()}
    assert len(found) == 2 * len(passport.ROLES)
    at = lambda k: tuple(found[k][c] for c in ("value", "confidence", "source", "alternatives", "needs_review"))
    assert at(("a", "surname")) == ("ТЕСТОВ", 0.99, "mrz", ["ТЕСТОР"], False) and at(("b", "surname")) == ("ТЕСТОР", 0.8, "ocr", [], False)
    assert at(("a", "department_code")) == ("770-001", 0.55, "vlm", [], True) and at(("b", "department_code")) == ("770-002", 0.59, "ocr", [], True)
    assert at(("a", "birth_date")) == ("15.03.1980", 0.55, "vlm", ["01.01.1980"], True) and at(("b", "birth_date")) == ("01.01.1980", 0.6, "ocr", [], False)
    assert at(("b", "sex")) == (None, None, None, [], True)


# ---------------------------------------------------------------------------------------------------------------
# scanned forms

FORM = {
    "id": "f", "detect": {"keywords": ["Заявление о передаче"]}, "static_text": ["(подпись)"],
    "fields": {
        "name": {"scan": {"anchor": ["Фамилия, имя", "ФИО"], "region": {"dy0": -1.0, "dy1": 1.2, "x0": 0.3, "x1": 1.0}}},
        "date": {"scan": {"anchor": ["Дата"], "region": {"dy0": 0, "dy1": 1.0, "x0": 0.2, "x1": 0.9}}},
        "other": {"text": ["x"]},
        "mail": {"scan": {"anchor": ["Адрес электронной почты"], "region": {"dy0": 0, "dy1": 1.0, "x0": 0.5, "x1": 1.0}}},
    },
}


def anchors(lines: list[tuple[int, int, str]]) -> dict[str, tuple]:
    """The best label of each field among all runs of up to nine words, by plain comparison."""
    below, out = 0, {}
    for field, spec in FORM["fields"].items():
        best = None
        for _, y, text in lines:
            if y + 30 < below or "scan" not in spec:
                continue
            ws = text.split()
            for i in range(len(ws)):
                for j in range(i + 1, min(len(ws), i + 9) + 1):
                    for v in spec["scan"]["anchor"]:
                        score = _row_ratio(" ".join(ws[i:j]).lower(), v.lower())
                        if score >= (85 if len(v) <= 8 else 72) and (best is None or score > best[0]):
                            best = (score, 50 + 100 * i, y, 50 + 100 * (j - 1) + 90)
        if best:
            out[field], below = best, best[2] - 5
    return out


def test_anchors_are_those_of_all_runs(spark):
    draw = random.Random(11)
    parts = ["Фамилия, имя", "Дата", "Адрес электронной почты", "ФИО", "Фамилия имя отчество", "Дата рождения", "Заявление о передаче прав на всё что есть у меня здесь и там", "слово", "почта"]
    pages = {}
    for page in range(30):
        pages[page] = []
        for n in range(draw.randint(1, 7)):
            w = list(draw.choice(parts) + " " + draw.choice(parts))
            for _ in range(draw.randint(0, 4)):
                w[draw.randrange(len(w))] = draw.choice("абв")
            pages[page].append((n, 100 + 60 * n, " ".join("".join(w).split())))
    frame = spark.createDataFrame([r for p, lines in pages.items() for r in words(lines, page=p)], WORDS)
    got = {(r["page"], r["field"]): (r["score"], r["x0"], r["y0"], r["x1"]) for r in regions.find_anchors(frame, ["page"], FORM).collect()}
    want = {(p, f): v for p, lines in pages.items() for f, v in anchors(lines).items()}
    assert got.keys() == want.keys() and all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_regions_stop_at_printed_lines(spark):
    lines = [(0, 150, "Заявление о передаче"), (1, 180, "далеко"), (2, 205, "Фамилия, имя ТЕСТОВ ПЕТР")]
    frame = spark.createDataFrame(words(lines), WORDS)
    pages = frame.select("page", "width", "height").distinct()
    boxes = regions.regions(regions.find_anchors(frame, ["page"], FORM), pages, regions.printed_lines(frame, ["page"], FORM), ["page"], FORM).collect()
    assert [(r["field"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in boxes] == [("name", 300, 175, 1000, 241)]
    plain = regions.regions(regions.find_anchors(frame, ["page"], FORM), pages, regions.printed_lines(frame.where("line > 0"), ["page"], FORM).where("by0 > 5000"), ["page"], FORM).collect()
    assert plain[0]["y0"] == 175


def test_what_ink_and_text_make_of_a_region(spark):
    rows = [
        ("blank", None, None, "", False, 0.001, 0.005, 0.0, None, None), ("nothing", "ab", 90.0, "ab", False, 0.001, 0.05, 0.05, None, None), ("page", "Иван", 90.0, "иван", False, 0.003, 0.05, 0.05, "Иван", 0.9),
        ("region", "Иван Андреев", 90.0, "иван андреев", False, 0.003, 0.05, 0.05, "Иван Андр", 0.9), ("unsure page", "Иван", 50.0, "иван", False, 0.01, 0.05, 0.05, "Иван", 0.9), ("written", "Иван", 90.0, "иван", False, 0.01, 0.05, 0.05, None, None),
        ("form only", "имя дата адрес", 90.0, "", True, 0.003, 0.05, 0.05, None, None), ("region", "; слово", 71.0, "слово", False, 0.003, 0.05, 0.05, None, None),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, want string, text string, conf double, rest string, form_only boolean, blue double, dark double, dark_clean double, page_value string, page_conf double")
    found = regions.field_values(frame).orderBy("i").collect()
    assert [r["state"] for r in found] == [r[0] for r in rows]
    assert [(r["value"], r["source"], r["needs_review"]) for r in found] == [("", "scan", False), ("", "scan", False), ("Иван", "page", False), ("Иван Андреев", "ocr", False), ("Иван", "page", True), ("", "hand", True), ("", "scan", True), ("слово", "ocr", True)]
    assert [round(r["confidence"], 3) for r in found] == [0.9, 0.8, 0.9, 0.9, 0.55, 0.0, 0.6, 0.71]
    asked = regions.field_values(frame.withColumn("model_value", F.lit("Пётр")), by_hand=True, model=True).where("want = 'written'").collect()[0]
    assert (asked["value"], asked["source"], asked["confidence"], asked["needs_review"]) == ("Пётр", "vlm+hand", 0.6, True)


def test_words_of_labels_don_t_count(spark):
    found = spark.createDataFrame([(1, "name", "Фамилея имя ТЕСТОВ ПЁТР о"), (1, "date", "адрес почты дата")], "page int, field string, text string")
    got = {r["field"]: (r["rest"], r["form_only"]) for r in regions.own_letters(found, ["page"], FORM).collect()}
    assert got == {"name": ("тестов пётр", False), "date": ("", True)}


def test_empty_tables_of_words(spark):
    none = spark.createDataFrame([], WORDS)
    assert passport.main_text(none, ["page"]).count() == 0 and regions.find_anchors(none, ["page"], FORM).count() == 0
    assert Counter(regions.phrases(spark.createDataFrame(words([(0, 0, "a b c")]), WORDS), ["page"]).select("phrase").toPandas()["phrase"]) == Counter(["a", "a b", "a b c", "b", "b c", "c"])


def _shuffles(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_labels_are_looked_for_where_lines_are(spark):
    """Runs of words are held against the form's labels without a shuffle of phrases or letter pairs; the same runs as by all pairs."""
    lines = ["фамилия имя отчество", "фамилея, имя тестов", "имя", "дата", "дота", "", "прочее здесь фамилия имя"]
    frame = spark.createDataFrame([(i, s.split()) for i, s in enumerate(lines)], "i int, ws array<string>")
    labels = {"фамилия, имя": 72.0, "дата": 75.0}
    got = {(r["i"], r["first"], r["size"], r["label"]): r["score"] for r in frame.select("i", F.inline(likeness.runs_like(labels, 9)(F.col("ws")))).collect()}
    want = {}
    for i, s in enumerate(lines):
        ws = s.split()
        for a in range(len(ws)):
            for z in range(a + 1, len(ws) + 1):
                for label, least in labels.items():
                    score = _row_ratio(" ".join(ws[a:z]), label)
                    if score >= least:
                        want[i, a + 1, z - a, label] = score
    assert got == want and len(want) >= 4
    empty = spark.createDataFrame(words([(0, 150, "Заявление о передаче"), (1, 205, "Фамилия, имя ТЕСТОВ ПЕТР")]), WORDS)
    assert _shuffles(regions.find_anchors(empty, ["page"], FORM)) <= 2
    found = spark.createDataFrame([(1, "name", "Фамилея имя ТЕСТОВ")], "page int, field string, text string")
    assert _shuffles(regions.own_letters(found, ["page"], FORM)) == 0
