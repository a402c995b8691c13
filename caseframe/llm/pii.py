"""Personal data: base patterns, and a linear-chain conditional random field for the ways of writing that they miss.

Base spans are the leftmost non-overlapping matches of fixed patterns with their checks. The field labels every token of every
text O, B-kind or I-kind from word-shape features (character class, length, cue words, neighbours' shapes, blanks before). It is
trained here by gradient ascent on the likelihood of a small labelled table (once for a table: the weights are stored
in the shared folder under a digest of it and of this code), and decoded by Viterbi in numpy, many stretches of text at a time. A span that it finds is
added if it overlaps no base span and holds what its kind must: digits that pass the kind's check, or an at sign
and a dot, written in any way, between names. Failing numbers (Luhn, parts above 255) do not come back.

Texts are decoded whole, in stretches of STRETCH tokens; each is decoded with OVERLAP tokens more on both sides, whose labels
only count in their own stretch. So a task holds a bounded number of tokens, however long a text is.

Null and empty texts have no spans. Rows that repeat a doc_id are looked at one by one, rows without doc_id give no result (and
redact() keeps them); other columns are ignored. An empty table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import inspect
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.llm.common import release, shared_folder, whole_texts

#: The kinds, in the order of spans that start together.
KINDS = ("email", "ip", "card", "phone")
#: Tokens that a stretch labels, tokens on each side that it sees besides, and tokens (with padding) decoded at once.
STRETCH, OVERLAP, AT_ONCE = 256, 32, 200_000
LABELLED_ROWS = 1500

# ---------------------------------------------------------------------------------------------------------------
# base patterns (fixed values)

EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(number)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in re.findall("[0-9]+", text)))


def is_card(text: str) -> bool:
    return 14 <= len(d := digits(text)) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 10 <= len(digits(text)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and EMAIL_LOCAL.match(text, start - 1):
                start -= 1
            host = EMAIL_HOST.match(text, at + 1) if start < at else None
            if host:
                found.append(("email", start, host.end()))
                done = host.end()
            at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        for kind, pattern, passes in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(m.group())]
    return found


# ---------------------------------------------------------------------------------------------------------------
# the labelled table


def labelled_table(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 7) -> DataFrame:
    """text and spans (kind, start, end) of small invented sentences: usual and unusual spellings, and decoys without any."""
    return spark.createDataFrame([(t, s) for t, s in labelled_rows(rows, seed)], "text string, spans array<struct<kind:string,start:int,end:int>>")


def labelled_rows(rows: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    r = random.Random(seed)
    pick = r.choice
    number = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick(("an", "er", "ti", "on", "sh", "le", "ou", "ein", "ra", "cion", "mi", "ta")) for _ in range(r.randint(1, 4)))
    blank = lambda s: pick((s, f" {s} "))

    def valid(n: int) -> str:
        body = number(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        at = pick((" (at) ", " [at] ", " at ", " @ ", "@", "(at)", "[at]", " arobase ", " arroba ", " AT ", " -at- ", "_at_", " {at} ", "{at}", "  at  ", " <at> "))
        dot = pick((" (dot) ", " [dot] ", " dot ", " . ", " punkt ", " punto ", " point ", " DOT ", "[dot]", "(dot)", " -dot- ", "_dot_", " {dot} ", "{dot}", " <dot> ", ".", ".", ".", "."))
        if r.random() < 0.5:  # both written alike
            at, dot = pick(((" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" at ", "."), (" @ ", " . "), (" @ ", " . "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" arroba ", " punto "), (" arobase ", " point ")))
        host = [*(word() for _ in range(pick((1, 1, 1, 2, 2, 3)))), pick(("com", "org", "net", "de", "fr", "es", "example", "uk", "io"))]
        name = word() + pick(("", ".", "_", "-", dot)) + pick(("", word(), number(2))) if r.random() < 0.6 else word()
        return name.rstrip("._- ") + at + dot.join(host)

    def ip() -> str:
        dot = pick((" . ", "[.]", " dot ", "(.)", "[dot]", " [.] ", "{.}", " (dot) ", " punkt ", "."))
        return dot.join(str(r.randint(0, pick((9, 99, 255, 255)))) for _ in range(4))

    def card() -> str:
        v, gap = valid(16), pick((".", "  ", " - ", "/", "_", " ", "-", ""))
        return gap.join(v[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c, d = number(3), number(3), number(4), number(2)
        if r.random() < 0.5:  # national and international prefixes, groups of any sizes
            first = pick((f"0{d}", f"0{a}", f"00{d} {number(2)}", f"00{d} {a}", f"+{d} {number(2)}", f"(0{d})", f"0{d}{a}"))
            return first + pick(("/", " / ", " ", "-", " - ", "/ ")) + pick((b + c, f"{b} {c}", f"{b}{a}", f"{c} {a}", f"{b}-{c}", f"{b} {d} {number(2)}", f"{d} {number(2)} {number(2)} {number(2)}", f"{c} {number(4)}", f"{a} {c}", f"{a}-{c}"))
        return pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}", f"+{number(1)} ({a}) {b}-{c}", f"0{number(2)}/{b}{c}", f"+{number(2)} / {a} / {b} {c}", f"({a}) {b} {c}"))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    cues = {"email": ("mail", "contact", "write to", ""), "ip": ("host", "server", "ip", ""), "card": ("card", "visa", "karte", ""), "phone": ("tel", "phone", "call", "telefon", "fax", "mobile", "mobil", "", "", "")}
    decoys = (
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{number(2)}.{number(2)}.{1900 + r.randint(0, 130)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}",
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: number(r.randint(1, 9)), lambda: f"{number(1)},{number(3)}.{number(2)}", lambda: f"section {number(1)}.{number(1)}.{number(1)}",
        lambda: f"at the {word()} dot", lambda: f"look at {word()} . {word()}", lambda: f"{number(2)} % {number(3)}", lambda: f"page {number(3)} - {number(3)}", lambda: f"{word()} ### {number(4)} $$$",
        lambda: f"CC BY-NC {number(1)}.{number(1)}", lambda: f"{number(20)}", lambda: f"{number(3)} {number(2)}", lambda: f"a point at {word()} point {word()}",
        lambda: f"{number(2)}/{number(2)}/{number(4)}", lambda: f"{number(1)}/{number(1)} {word()}", lambda: f"{number(3)} {number(3)} {word()}", lambda: f"({number(4)})", lambda: f"{number(4)}/{number(2)}",
        lambda: f"{number(1)} . {number(1)} {word()}", lambda: f"stay at {word()}. {word()} {word()}", lambda: f"{word()} at the {word()}. {word()}",
    )
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            if text or r.random() < 0.7:  # others begin the text
                text += " ".join(word() for _ in range(r.randint(1, 6))) + pick((" ", ", ", ". ", ": "))
            if r.random() < 0.55:
                kind = pick(KINDS)
                cue = pick(cues[kind])
                text += f"{cue}{pick((' ', ': '))}" if cue else ""
                value = makers[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += pick(decoys)()
            text += pick((" ", ". ", ", ", "\n"))
        text += " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


# ---------------------------------------------------------------------------------------------------------------
# features

TOKEN = re.compile(r"\s+|[^\W\d_]+|[0-9]+|\S", re.UNICODE)
AT_WORDS = {"at": "AT", "arobase": "SIGN", "arroba": "SIGN"}
DOT_WORDS = frozenset(("dot", "punkt", "punto", "point"))
CUES = {w: i for i, ws in enumerate((("mail", "email", "contact", "write"), ("host", "server", "ip"), ("card", "visa", "karte"), ("tel", "phone", "call", "telefon", "fax", "mobile", "mobil", "cell"))) for w in ws}
SHAPES = ("<end>", "AT", "SIGN", "DOT", "cue0", "cue1", "cue2", "cue3", "d1", "d2", "d3", "d4", "d5-9", "d10-13", "d14-19", "d20+", "octet", "Xx", "X", "x1-3", "x4-8", "x9+", "@", ".", "-", "(", ")", "[", "]", "/", "+", "_", ":", ",", '"', "other")
SHAPE = {s: i for i, s in enumerate(SHAPES)}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_N, _S = len(LABELS), len(SHAPES)
#: Tables of weights by place: two before; before and own; own and after; two after; own with a blank before it or not.
TABLES = (_S, _S * _S, _S * _S, _S, 2 * _S)
WIDTH = sum(TABLES)
_FROM = tuple(int(x) for x in np.cumsum((0, *TABLES[:-1])))


def shape(token: str) -> int:
    if token[0] in "0123456789":
        n = len(token)
        if n <= 3 and int(token) <= 255 and (n == 1 or token[0] != "0") and n > 1:
            return SHAPE["octet"]
        return SHAPE[f"d{n}" if n < 5 else "d5-9" if n < 10 else "d10-13" if n < 14 else "d14-19" if n < 20 else "d20+"]
    if token[0].isalpha():
        low = token.lower()
        if low in AT_WORDS:
            return SHAPE[AT_WORDS[low]]
        if low in DOT_WORDS:
            return SHAPE["DOT"]
        if low in CUES:
            return SHAPE[f"cue{CUES[low]}"]
        if token[0].isupper():
            return SHAPE["X"] if token.isupper() and len(token) > 1 else SHAPE["Xx"]
        return SHAPE["x1-3"] if len(token) < 4 else SHAPE["x4-8"] if len(token) < 9 else SHAPE["x9+"]
    return SHAPE.get(token, SHAPE["other"])


class Shapes(dict):
    """token -> shape, remembered; -1 for white space."""

    def __missing__(self, token: str) -> int:
        found = -1 if token.isspace() else shape(token)
        if len(token) <= 24 and len(self) < 300_000:
            self[token] = found
        return found


class Tokens:
    """A text's tokens: where they begin and end in code points, their shapes, and whether a blank stands before."""

    def __init__(self, text: str, known: Shapes):
        parts, at = [(np.empty(0, np.int32), np.empty(0, np.int8), 0)], 0
        while at < len(text):  # Python objects of a part of the text at a time, cut at a blank
            blank = re.compile(r"\s").search(text, at + 200_000)
            end = blank.start() if blank else len(text)
            found = TOKEN.findall(text[at:end])
            parts.append((np.fromiter(map(len, found), np.int32, len(found)), np.fromiter(map(known.__getitem__, found), np.int8, len(found)), at))
            at = end
        length, shapes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ends = np.cumsum(length, dtype=np.int64)
        blank = np.concatenate([[True], shapes[:-1] < 0]) if len(shapes) else np.empty(0, bool)
        own = shapes >= 0
        self.starts, self.ends, self.shapes, self.blank = (ends - length)[own], ends[own], shapes[own], blank[own].astype(np.int8)

    def __len__(self) -> int:
        return len(self.shapes)


def features(shapes: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """rows x tokens x tables: numbers of weights. Shapes are 0 (no token) beyond a text's ends; rows have two more on each side."""
    before2, before, own, after, after2 = (shapes[:, i : shapes.shape[1] - 4 + i].astype(np.int32) for i in range(5))
    return np.stack([before2, _FROM[1] + before * _S + own, _FROM[2] + own * _S + after, _FROM[3] + after2, _FROM[4] + blank.astype(np.int32) * _S + own], -1)


# ---------------------------------------------------------------------------------------------------------------
# the field


class Field:
    """Weights of a linear-chain conditional random field: emit[feature, label] and move[label, label]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @staticmethod
    def allowed() -> np.ndarray:
        """I-kind only follows B-kind or I-kind."""
        ok = np.zeros((_N, _N))
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                ok[:, j] = -1e4
                for i, other in enumerate(LABELS):
                    if other[2:] == label[2:] and other != "O":
                        ok[i, j] = 0
        return ok

    def decode(self, many: list[Tokens]) -> list[np.ndarray]:
        """The best labels of each text's tokens. Stretches of like length go through the recursion together."""
        out = [np.zeros(len(t), np.int8) for t in many]
        cuts = [(i, at) for i, t in enumerate(many) for at in range(0, len(t), STRETCH)]
        size = np.array([min(len(many[i]), at + STRETCH + OVERLAP) - max(0, at - OVERLAP) for i, at in cuts], np.int64)
        order = np.argsort(size, kind="stable")
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * size[order[end]] <= AT_ONCE:
                end += 1
            part = [(*cuts[k], int(size[k])) for k in order[begin:end].tolist()]
            longest = part[-1][2]
            shapes, blank = np.zeros((len(part), longest + 4), np.int8), np.zeros((len(part), longest), np.int8)
            for row, (i, at, n) in enumerate(part):
                t, first = many[i], max(0, at - OVERLAP)
                lo, hi = max(0, first - 2), min(len(t), first + n + 2)
                shapes[row, 2 - (first - lo) : 2 - (first - lo) + hi - lo] = t.shapes[lo:hi]
                blank[row, :n] = t.blank[first : first + n]
            labels = self._viterbi(shapes, blank, np.array([n for _, _, n in part]))
            for row, (i, at, _) in enumerate(part):
                first, stop = max(0, at - OVERLAP), min(len(many[i]), at + STRETCH)
                out[i][at:stop] = labels[row, at - first : stop - first]
            begin = end
        return out

    def _viterbi(self, shapes: np.ndarray, blank: np.ndarray, length: np.ndarray) -> np.ndarray:
        move = (self.move + self.allowed()).astype(np.float32)
        table, found = self.emit.astype(np.float32), features(shapes, blank)
        emit = table[found[..., 0]]
        for k in range(1, len(TABLES)):
            emit += table[found[..., k]]
        n, longest = blank.shape
        # O and B follow anything; I follows its own B or I only.
        free = np.array([0, *range(1, _N, 2)])
        begin, inner = np.arange(1, _N, 2), np.arange(2, _N, 2)
        into, from_begin, from_inner = np.ascontiguousarray(move[:, free].T), move[begin, inner], move[inner, inner]
        best, back = emit[:, 0] + move[0], np.zeros((longest, n, _N), np.int8)
        for t in range(1, longest):
            paths = best[:, None, :] + into
            via = paths.argmax(2)
            new = emit[:, t].copy()
            new[:, free] += np.take_along_axis(paths, via[..., None], 2)[..., 0]
            started, gone_on = best[:, begin] + from_begin, best[:, inner] + from_inner
            new[:, inner] += np.maximum(started, gone_on)
            back[t][:, free] = via
            back[t][:, inner] = np.where(gone_on > started, inner, begin)
            best = np.where((t < length)[:, None], new, best)
        label, labels, rows = best.argmax(1), np.zeros((n, longest), np.int8), np.arange(n)
        for t in range(longest - 1, -1, -1):
            inside = t < length
            labels[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[t, rows, label], label)
        return labels


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 160, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on all rows at once; forward and backward sums in numpy, scaled to 1 at every token."""
    known = Shapes()
    many, spans = zip(*((t, own) for text, own in rows if len(t := Tokens(text, known))), strict=True)
    length = np.array([len(t) for t in many])
    B, T, K = len(many), int(length.max()), len(TABLES)
    shapes, blank = np.zeros((B, T + 4), np.int8), np.zeros((B, T), np.int8)
    gold = np.zeros((B, T), np.int64)
    for b, (tokens, own) in enumerate(zip(many, spans, strict=True)):
        shapes[b, 2 : 2 + length[b]], blank[b, : length[b]] = tokens.shapes, tokens.blank
        for t, (a, z) in enumerate(zip(tokens.starts.tolist(), tokens.ends.tolist(), strict=True)):
            for kind, start, end in own:
                if start <= a and z <= end:
                    gold[b, t] = LABELS.index(f"{'B' if a == start else 'I'}-{kind}")
    # Tokens come before rows from here on: one step of the recursions is one block of memory.
    inside = (np.arange(T) < length[:, None]).T
    found, gold = features(shapes, blank).transpose(1, 0, 2)[inside], gold.T
    after = np.argwhere(inside[1:])
    t1, b1 = after[:, 0] + 1, after[:, 1]
    own = np.zeros((T, B, _N))
    np.put_along_axis(own, gold[..., None], 1, 2)
    moves = np.zeros((_N, _N))
    np.add.at(moves, (gold[t1 - 1, b1], gold[t1, b1]), 1)
    moves[0] += own[0].sum(0)  # a text begins as after an O
    emit, move, allowed = np.zeros((WIDTH, _N)), np.zeros((_N, _N)), Field.allowed()
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    flat, by_token = found.ravel(), np.zeros((T, B, _N))
    forward, backward, total = np.empty((T, B, _N)), np.empty((T, B, _N)), np.ones((T, B, 1))
    for step in range(1, steps + 1):
        score = emit[found].sum(1)
        by_token[inside] = np.exp(score - score.max(1, keepdims=True))
        go = np.exp(move + allowed)
        for t in range(T):
            new = (forward[t - 1] @ go if t else np.tile(go[0], (B, 1))) * by_token[t]
            total[t] = np.where(inside[t, :, None], new.sum(1, keepdims=True), 1)
            forward[t] = np.where(inside[t, :, None], new / total[t], forward[t - 1])
        backward[T - 1] = 1
        for t in range(T - 2, -1, -1):
            backward[t] = np.where(inside[t + 1, :, None], (by_token[t + 1] * backward[t + 1] / total[t + 1]) @ go.T, 1)
        p = forward * backward
        error = np.repeat((p - own)[inside], K, 0)
        g_emit = np.stack([np.bincount(flat, error[:, label], WIDTH) for label in range(_N)], 1)
        pairs = go * (forward[t1 - 1, b1].T @ (by_token[t1, b1] * backward[t1, b1] / total[t1, b1])) - moves
        pairs[0] += p[0].sum(0)
        for k, (w, g) in enumerate(((emit, g_emit / B + ridge * emit), (move, pairs / B + ridge * move))):
            a, v = state[2 * k], state[2 * k + 1]
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            w -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move)


# ---------------------------------------------------------------------------------------------------------------
# spans

_AT = re.compile(r"@|(?<![^\W\d_])(?:at|arobase|arroba)(?![^\W\d_])", re.IGNORECASE)
_DOT = re.compile(r"\.|(?<![^\W\d_])(?:dot|punkt|punto|point)(?![^\W\d_])", re.IGNORECASE)


def is_address(text: str) -> bool:
    """One at sign, by whatever sign or word, with a name before it and, after it, names on both sides of a last dot."""
    at = list(_AT.finditer(text))
    if len(at) != 1 or not text[:1].isalnum() or not text[-2:].isalpha():
        return False
    dots = list(_DOT.finditer(text, at[0].end()))
    return bool(dots) and any(c.isalnum() for c in text[: at[0].start()]) and any(c.isalnum() for c in text[at[0].end() : dots[-1].start()]) and "\n" not in text


#: What a span that the field finds must hold, besides overlapping no base span.
CHECKS = {
    "email": is_address,
    "ip": lambda s: len(re.findall("[0-9]+", s)) == 4 and is_ip(s),
    "card": is_card,
    "phone": lambda s: is_phone(s) and not re.search(r"[^\x20().0-9+/-]", s) and not is_card(s) and len(re.findall("[0-9]+", s)) >= 2,
}


def spans_of(texts: list[str], field: Field, base: list[list[tuple[str, int, int]]] | None = None, known: Shapes | None = None) -> list[list[tuple[str, int, int]]]:
    """All spans of each text by start, then kind."""
    found = [list(b) for b in base] if base is not None else [base_spans(t) for t in texts]
    known = Shapes() if known is None else known
    many = [Tokens(t, known) for t in texts]
    for i, (tokens, labels) in enumerate(zip(many, field.decode(many), strict=True)):
        marked = np.flatnonzero(labels)
        t = -1
        for at in marked.tolist():
            if at < t or LABELS[labels[at]][0] != "B":
                continue
            t, kind = at + 1, LABELS[labels[at]][2:]
            while t < len(labels) and LABELS[labels[t]] == f"I-{kind}":
                t += 1
            a, z = int(tokens.starts[at]), int(tokens.ends[t - 1])
            if CHECKS[kind](texts[i][a:z]) and not any(a < e and b < z for _, b, e in found[i]):
                found[i].append((kind, a, z))
    return [sorted(f, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for f in found]


def stored_field(spark: SparkSession, rows: int = LABELLED_ROWS, seed: int = 7) -> Field:
    """The field trained on the labelled table, from the shared folder if a query has stored it there before."""
    table = labelled_rows(rows, seed)
    digest = hashlib.sha256((repr(table) + inspect.getsource(sys.modules[__name__])).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/caseframe/pii-field-{digest}"
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(f"{path}/_SUCCESS")
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        row = spark.read.parquet(path).first()
        return Field(*(np.frombuffer(bytes(row[c])).reshape(-1, _N) for c in ("emit", "move")))
    field = train(table)
    spark.createDataFrame([(field.emit.tobytes(), field.move.tobytes())], "emit binary, move binary").write.mode("overwrite").parquet(path)
    return field


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and spans (each an array of kind, start, end) of every document."""
    return whole_texts(docs).mapInArrow(_looker(field or stored_field(docs.sparkSession), "doc_id"), f"doc_id long, {_FOUND}")


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = f"base {_SPANS}, spans {_SPANS}"
#: Code points that are looked at together, or one text.
_SLICE = 1_000_000


def _looker(field: Field, *carried: str):
    """base and spans of each row's text, after the columns carried over."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda rows: pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in r] for r in rows], span)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shapes()
        for batch in batches:
            size = pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < batch.num_rows:
                end, total = begin + 1, int(size[begin])
                while end < batch.num_rows and end - begin < 1024 and total + size[end] <= _SLICE:
                    total += int(size[end])
                    end += 1
                part = batch.slice(begin, end - begin)
                texts = part.column("text").to_pylist()
                base = [sorted(base_spans(t), key=lambda s: (s[1], KINDS.index(s[0]))) for t in texts]
                every = spans_of(texts, field, base, known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), listed(base), listed(every)], [*carried, "base", "spans"])
                begin = end
        release()

    return look


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents, with all their columns, with every span replaced by its kind in angle brackets; overlapping spans by the
    first one's. Null texts stay null."""
    field = field or stored_field(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), batch.column("text").to_pylist()
            out, known = [], Shapes()
            for text in texts:
                parts, done = [], 0
                for kind, start, end in spans_of([text], field, known=known)[0] if text else []:
                    if start >= done:
                        parts += [text[done:start], f"<{kind}>"]
                        done = end
                out.append(None if text is None else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)
