"""Two-line machine-readable zones: found among lines, check digits, and repair of a few misread characters."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.functions.text import text

LENGTH = 44
#: The zone's alphabet for Cyrillic letters; letters read for digits; digits mistaken for each other.
ALPHABET = dict(zip("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "ABVGDE2JZIQKLMNOPRSTUFHC34WXY9678", strict=True))
READ_AS_DIGIT = {"O": "0", "Q": "0", "D": "0", "U": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "T": "7", "A": "4"}
MISTAKEN = {"0": "86", "1": "7", "2": "7", "3": "8", "4": "1", "5": "69", "6": "085", "7": "1", "8": "06", "9": "5"}
MOST_CHANGES, ENOUGH = 2, 30
RESULT = "surname string, given_name string, patronymic string, series string, number string, birth_date string, issue_date string, expiry_date string, department_code string, sex string, country string, valid boolean, corrections int, failed array<string>"


def normal_line(c: Column) -> Column:
    """Upper case without blanks, Cyrillic look-alikes as Latin letters, all else as fillers."""
    v = F.translate(F.replace(F.upper(text(c)), F.lit(" ")), "АВЕКМНОРСТХУ«‹", "ABEKMHOPCTXY<<")
    return F.regexp_replace(v, "[^A-Z0-9<]", "<")


def zone_lines(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """keys, line1 and line2: the first two neighbouring lines of a page that look like a zone."""
    w = W.partitionBy(*keys).orderBy(order)
    near = lines.withColumn("line1", normal_line(F.col(line))).withColumn("line2", F.lead("line1").over(w))
    fits = F.col("line1").startswith("P") & (F.length(F.regexp_replace("line1", "[^<]", "")) >= 5) & (F.length("line1") >= 36) & (F.length("line2") >= 36) & F.col("line2").rlike("[0-9]{6}")
    cut = lambda c: F.left(F.rpad(c, LENGTH, "<"), F.lit(LENGTH))
    first = near.where(fits).groupBy(*keys).agg(F.min_by(F.struct("line1", "line2"), order).alias("z"))
    return first.select(*keys, cut("z.line1").alias("line1"), cut("z.line2").alias("line2"))


@lru_cache(maxsize=100_000)
def _digit(field: str) -> str:
    values = (int(c) if c.isdigit() else ord(c) - 55 if c.isalpha() else 0 for c in field)
    return str(sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(values)) % 10)


def _as_digits(s: str) -> str:
    return "".join(READ_AS_DIGIT.get(c, c) for c in s)


def _candidates(value: str, check: str) -> list[tuple[str, int]]:
    """Readings of a field whose check digit fits, those with fewer changes first; the value itself at -1 if there are none."""
    found = [(value, 0)] if _digit(value) == check else []
    places = [i for i, c in enumerate(value) if c in MISTAKEN]
    for n in range(1, MOST_CHANGES + 1):
        for at in combinations(places, n):
            for new in product(*(MISTAKEN[value[i]] for i in at)):
                changed = list(value)
                for i, c in zip(at, new, strict=True):
                    changed[i] = c
                if _digit(other := "".join(changed)) == check:
                    found.append((other, n))
        if len(found) > ENOUGH:
            break
    return found or [(value, -1)]


def _date(s: str, year: int, future: bool = False) -> str | None:
    if not s.isdigit() or len(s) != 6:
        return None
    y = 2000 + int(s[:2])
    y -= 100 if not future and y > year else 0
    try:
        d = date(y, int(s[2:4]), int(s[4:]))
    except ValueError:
        return None
    return f"{d.day:02d}.{d.month:02d}.{d.year}"


def _names(field: str, home: bool) -> tuple[str, str, str]:
    field = field.rstrip("K<")  # fillers are often read as K
    surname, _, rest = field.partition("<<")
    parts = [p for p in rest.split("<") if p]
    if home and len(parts) == 1:
        for i, c in enumerate(parts[0]):
            if c == "K" and i >= 2 and parts[0][i + 1 :].endswith(("VI3", "VNA", "I3NA", "OGLY", "KYZY")):
                parts = [parts[0][:i], parts[0][i + 1 :]]
                break
    if home:
        back = {v: k for k, v in ALPHABET.items()}
        letters = lambda s: "".join(back.get(c, c) for c in s.replace("<", ""))
        return letters(surname), letters(parts[0]) if parts else "", letters("".join(parts[1:]))
    return surname.replace("<", " "), " ".join(parts), ""


def _parse(line1: str, line2: str, year: int) -> tuple:
    home = line1[:5] == "PNRUS"
    spans = {"number": (0, 9), "birth_date": (13, 19), "expiry_date": (21, 27), "optional": (28, 42)}
    read, checks, blanks = [], [], []
    for name, (a, b) in spans.items():
        value, check = line2[a:b], _as_digits(line2[b])
        blank = not value.strip("<") and (name == "expiry_date" or name == "optional" and not home)
        if name in ("birth_date", "expiry_date") or home and name == "number":
            value = _as_digits(value)
        if home and name == "optional":
            value = _as_digits(value[:13]) + value[13:]
        read.append(value)
        checks.append(line2[b] if blank else check)
        blanks.append(blank)
    total = _as_digits(line2[43])
    if _digit("".join(map("".join, zip(read, checks, strict=True)))) == total and all(blank or _digit(v) == c for v, c, blank in zip(read, checks, blanks, strict=True)):
        options = [[(v, 0)] for v in read]  # nothing needs a change
    else:
        options = [[(v, 0)] if blank else _candidates(v, c) for v, c, blank in zip(read, checks, blanks, strict=True)]
    best = None
    for combo in product(*options):
        cost = sum(abs(n) for _, n in combo)
        if best is not None and cost >= best[0]:
            continue
        whole = _digit("".join(v + c for (v, _), c in zip(combo, checks, strict=True))) == total
        cost += 0 if whole else 100
        if best is None or cost < best[0]:
            best = (cost, combo, whole)
    _, combo, whole = best
    number, born, expiry, optional = (v for v, _ in combo)
    failed = [n for n, (_, k) in zip(spans, combo, strict=True) if k < 0] + ([] if whole else ["composite"])
    surname, given, patronymic = _names(line1[5:], home)
    corrections = sum(max(0, n) for _, n in combo)
    sex = {"M": "М", "F": "Ж"}.get(line2[20], line2[20]) if home else line2[20]
    code = optional[7:13]
    own = (number[:3] + optional[0], number[3:], _date(optional[1:7], year), f"{code[:3]}-{code[3:]}" if code.isdigit() else "") if home else ("", number.rstrip("<"), None, "")
    return (surname, given, patronymic, own[0], own[1], _date(born, year), own[2], _date(expiry, year, True), own[3], sex, line1[2:5], not failed, corrections, failed)


def parse_zones(zones: DataFrame, keys: list[str], year: int) -> DataFrame:
    """keys and the decoded zone of rows with line1 and line2; two-digit years beyond `year` are of the century before."""
    columns = [c.split()[0] for c in RESULT.split(", ")]
    kinds = ", ".join(f"{k} {zones.schema[k].dataType.simpleString()}" for k in keys)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_parse(a.ljust(LENGTH, "<"), b.ljust(LENGTH, "<"), year) for a, b in zip(frame["line1"], frame["line2"], strict=True)]
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    return zones.select(*keys, "line1", "line2").mapInPandas(decode, f"{kinds}, {RESULT}")
