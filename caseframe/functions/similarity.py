"""String similarity. Short strings stay in the JVM as folds over arrays; long ones go through Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe.functions.text import ColumnOrName, bound, col, let, text


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


#: Letters of the shorter string up to which a long holds a bit for each.
BITS = 62


def common_subsequence(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common subsequence: a fold over the letters of one string, with a bit for each letter of the shorter one
    that says where the subsequence can grow; if both are long, with a row of the table."""
    both = let(F.struct(_letters(text(a)).alias("x"), _letters(text(b)).alias("y")), lambda s: F.when(F.size(s["x"]) <= F.size(s["y"]), s).otherwise(F.struct(s["y"].alias("x"), s["x"].alias("y"))))
    return let(both, lambda s: F.when(F.size(s["x"]) == 0, 0).when(F.size(s["x"]) <= BITS, _by_bits(s["x"], s["y"])).otherwise(_by_rows(s["x"], s["y"])))


def _by_bits(x: Column, y: Column) -> Column:
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    own = F.struct(F.reverse(x).alias("x"), F.lit((1 << BITS) - 1).alias("all"))

    def free(s: Column) -> Column:
        # the places of a letter in the shorter string, its first letter in the lowest bit
        places = lambda letter: F.aggregate(s["x"], zero, lambda m, c: F.shiftleft(m, 1).bitwiseOR(F.when(c == letter, one).otherwise(zero)))
        grow = lambda o, p: (o + o.bitwiseAND(p)).bitwiseOR(o.bitwiseAND(F.bitwise_not(p))).bitwiseAND(s["all"])
        return F.aggregate(F.transform(y, places), s["all"], grow)

    # bits above the string's own stay as they are
    return let(own, lambda s: (BITS - F.bit_count(free(s))).cast("int"))


def _by_rows(x: Column, y: Column) -> Column:
    def next_row(row: Column, letter: Column) -> Column:
        def extend(done: Column, i: Column) -> Column:
            above = F.element_at(row, i)
            corner = F.when(i > 1, F.element_at(row, F.greatest(i - 1, F.lit(1)))).otherwise(0)
            left = F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(0)
            best = F.when(F.element_at(y, i) == letter, corner + 1).otherwise(F.greatest(above, left))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(row)), F.array().cast("array<int>"), extend)

    return F.element_at(F.aggregate(x, F.transform(y, lambda _: F.lit(0)), next_row), -1)


@bound(2)
def indel_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100: twice the common subsequence over both lengths; two empty strings are alike."""
    size = F.length(text(a)) + F.length(text(b))
    return F.when(text(a) == text(b), F.lit(100.0)).otherwise(200.0 * common_subsequence(a, b) / size)


@bound(2)
def token_set_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Best indel ratio between the common words and the common words with either side's rest; words are sets."""
    words = lambda c: F.array_distinct(F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != ""))
    sides = let(
        F.struct(words(a).alias("x"), words(b).alias("y")),
        lambda s: F.struct((F.size(s["x"]) * F.size(s["y"]) == 0).alias("empty"), *(F.array_sort(c).alias(n) for n, c in (("both", F.array_intersect(s["x"], s["y"])), ("x", F.array_except(s["x"], s["y"])), ("y", F.array_except(s["y"], s["x"]))))),
    )
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")

    def score(s: Column) -> Column:
        # The common part is a prefix of each side, so that its ratios need no table.
        def best(t: Column) -> Column:
            prefix = [F.when(F.size(s["both"]) > 0, 200.0 * F.length(t["common"]) / (F.length(t["common"]) + F.length(t[c]))).otherwise(0.0) for c in "xy"]
            return F.greatest(indel_ratio(t["x"], t["y"]), *prefix)

        own = F.struct(joined(s["both"]).alias("common"), joined(s["both"], s["x"]).alias("x"), joined(s["both"], s["y"]).alias("y"))
        inside = (F.size(s["both"]) > 0) & ((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0))
        return F.when(s["empty"], 0.0).when(inside, 100.0).otherwise(let(own, best))

    return let(sides, score)


def _row_ratio(a: str, b: str) -> float:
    """Indel ratio of two strings, bit-parallel: a bit for each letter of a says where the common subsequence can grow."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit) | (open_ - hit)
    common = len(a) - (open_ & (1 << len(a)) - 1).bit_count()
    return 200.0 * common / (len(a) + len(b))


def _best_window(short: str, long: str, least: float = 0.0) -> tuple[float, int, int]:
    """The window of the longer string, cut at its ends too, that is most like the shorter one: (ratio, start, end).

    Letters that a window and the short string share bound its ratio; the counts move along with the window, so that only
    windows that can beat the best so far (and `least`) are compared."""
    n, m = len(short), len(long)
    if short and (at := long.find(short)) >= 0:
        return 100.0, at, at + n
    need = Counter(short)
    have: Counter = Counter()
    shared, best = 0, (0.0, 0, 0)
    for end in range(1, m + n):
        if end <= m:
            c = long[end - 1]
            have[c] += 1
            shared += have[c] <= need.get(c, 0)
        if end > n:
            c = long[end - n - 1]
            shared -= have[c] <= need.get(c, 0)
            have[c] -= 1
        a, z = max(end - n, 0), min(end, m)
        bound = 200.0 * shared / (n + z - a)
        if bound > best[0] and bound > least and (score := _row_ratio(short, long[a:z])) > best[0]:
            best = (score, a, z)
    return best


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio for long strings."""
    return pd.Series([_row_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio of the shorter string with the best window of the longer one."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 100.0 if x == y else 0.0
        return _best_window(*sorted((x, y), key=len))[0]

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def near_keywords(source: pd.Series, keywords: pd.Series, above: pd.Series) -> pd.Series:
    """The keywords of each row that a window of its text is like by more than `above`; a null text is not looked at."""

    letters: dict[str, list[tuple[str, int]]] = {}

    def may_be(text_: str, k: str, least: float) -> bool:
        """A window of w letters that shares s of them, w >= s, is like a keyword of n by 200 s / (n + w) at most."""
        if (own := letters.get(k)) is None:
            own = letters[k] = list(Counter(k).items())
        shared = sum(min(text_.count(c), n) for c, n in own)
        return len(k) > len(text_) or 200.0 * shared > least * (len(k) + shared)

    def one(text_: str | None, words, least: float) -> list[str] | None:
        if text_ is None:
            return None
        return [k for k in words if k and text_ and may_be(text_, k, least) and (_best_window(k, text_, least) if len(k) <= len(text_) else _best_window(text_, k, least))[0] > least]

    return pd.Series([one(*row) for row in zip(source, keywords, above, strict=True)], dtype=object)


#: How like a keyword a word is that counts for it, as a whole and in its best piece.
WORD_LIKE, PIECE_LIKE, PIECE_LEAST = 75.0, 90.0, 5


@F.pandas_udf(T.ArrayType(T.StringType()))
def like_words(words: pd.Series, keywords: pd.Series) -> pd.Series:
    """The keywords of each row that one of its words is like; a null list is not looked at."""

    def like(w: str, k: str) -> bool:
        if 200.0 * min(len(w), len(k)) >= WORD_LIKE * (len(w) + len(k)) and _row_ratio(w, k) >= WORD_LIKE:
            return True
        return len(w) >= PIECE_LEAST and _best_window(*sorted((w, k), key=len), PIECE_LIKE - 0.001)[0] >= PIECE_LIKE

    return pd.Series([None if ws is None else [k for k in ks if any(like(w, k) for w in ws)] for ws, ks in zip(words, keywords, strict=True)], dtype=object)


@F.pandas_udf(T.StructType().add("score", T.DoubleType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
def best_alignment(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    """Where in the source the quote stands, as well as it can be found."""
    rows = [_best_window(q, s) if q and s and len(q) <= len(s) else (_row_ratio(q or "", s or ""), 0, len(s or "")) for q, s in zip(quote, source, strict=True)]
    return pd.DataFrame(rows, columns=["score", "start", "end"])


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 1: twice the letters in the longest matching blocks, found recursively, over both lengths."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def within_edits(a: ColumnOrName, b: ColumnOrName, most: int) -> Column:
    """Edit distance where it is at most `most`, else null; lengths that differ by more are not looked at."""
    close = F.abs(F.length(text(a)) - F.length(text(b))) <= most
    return F.when(close, F.nullif(F.levenshtein(col(a), col(b), most), F.lit(-1)))
