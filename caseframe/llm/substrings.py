"""Repeated passages across documents by prefix-partitioned suffix trees over words.

Every word of every document begins a suffix; only its first WINDOW words matter, since a longer repeat shows itself at each of its
suffixes in turn. The work goes in four looks at buckets of documents, whose texts are shuffled once:

1. Each part of a bucket (PART words at most; long documents are cut with an overlap) finds its distinct suffixes and sends their
   fingerprints, cut to a few bits more than the number of suffixes needs, to screening groups, and counts suffixes by
   their anchors' hashed prefixes of 2, 4 and 8 words. A screening group answers which fingerprints came from two parts. That only
   leaves suffixes out that can't have a partner; it decides nothing else.
2. A suffix's anchor is the place in its first WINDOW words whose prefix of 2 words is the smallest by hash; suffixes that begin
   near each other have one anchor, travel to one group and are sent as one run of words. The counts say which prefixes anchor
   more suffixes than one subtree should hold: these are made longer, to 4, 8 or all words, so that prefixes of several lengths
   split the suffixes into groups that fit in memory. Each part sends what is left, once for all its documents that
   share it, to the group of its prefix: as words, with the smallest doc_id.
3. Each group sorts its suffixes by their words and takes the common-prefix lengths of neighbours: the leaves of a node of
   depth WINDOW are the places of one repeat. It answers those whose document isn't the smallest, with the smallest.
4. Each bucket removes the words that its repeats cover. Consecutive suffixes with one source are one maximal repeat.

Words are compared as words: fingerprints that agree for two texts cost time but never a word. A suffix in a third of all
documents is sent once for each part. Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Null and empty texts have
none. Texts below 13 words have no window and stay whole. Rows with one doc_id never remove each other's words; rows without doc_id
are left out. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseframe.llm import mail
from caseframe.llm.common import chain, group_slices, mix, release, span_digests, window_digests

WINDOW = 13
LEVELS = (2, 4, 8)
#: Hashed prefixes that are counted at each level, and the groups that add the counts up.
CELLS, COUNTERS = 1 << 16, 8
#: Suffixes that a prefix may begin before it is made longer.
HEAVY = 500_000
#: Words of a part.
PART = 1_000_000
_BLANK = re.compile(rb"[ \t-\r]")


class Numbers(dict):
    """word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbers_of(text: bytes, known: Numbers) -> np.ndarray:
    """The numbers of a text's words; Python objects of a megabyte at a time."""
    out, at = [np.empty(0, np.int32)], 0
    while at < len(text):
        cut = _BLANK.search(text, at + (1 << 20))
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(out)


class Part:
    """The distinct suffixes (classes) of some stretches of words: (row, first word, numbers)."""

    def __init__(self, stretches: list[tuple[int, int, np.ndarray]], doc_ids: np.ndarray, symbols: np.ndarray, window: int):
        self.words, self.window = np.concatenate([s[2] for s in stretches]), window
        size = np.array([len(s[2]) for s in stretches])
        begins = np.cumsum(size) - size
        leaves = np.maximum(size - window + 1, 0)
        self.first = np.arange(leaves.sum()) + np.repeat(begins - (np.cumsum(leaves) - leaves), leaves)
        self.row = np.repeat([s[0] for s in stretches], leaves)
        self.place = self.first - np.repeat(begins, leaves) + np.repeat([s[1] for s in stretches], leaves)
        self.doc = doc_ids[self.row]
        self.levels: dict[int, np.ndarray] = {}
        label = window_digests(symbols[self.words], window, levels=self.levels)[self.first]
        order = np.argsort(label, kind="stable")  # documents ascend within a class
        new = np.concatenate([[True], label[order][1:] != label[order][:-1]]) if len(label) else np.empty(0, bool)
        again = np.flatnonzero(~new)
        unlike = self._differ(self.first[order[again]], self.first[order[again - 1]], window)
        if unlike.any():  # one fingerprint of different words: by the words, then
            matrix = self.words[self.first[:, None] + np.arange(window)]
            order = np.lexsort((*matrix.T[::-1], label))
            new = np.concatenate([[True], (label[order][1:] != label[order][:-1]) | (matrix[order][1:] != matrix[order][:-1]).any(1)])
        heads = order[new]
        self.label, self.head, self.least = label[heads], self.first[heads], self.doc[heads]
        self.of = np.empty(len(label), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def _differ(self, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(window):
            out |= self.words[a + k] != self.words[b + k]
        return out

    def prefixes(self, level: int) -> np.ndarray:
        """The smallest fingerprint of `level` consecutive words among the first words of each suffix."""
        n, least, width = self.window - level + 1, self.levels[level], 1
        while 2 * width <= n:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        return np.minimum(least[self.head], least[self.head + n - width])

    def screens(self, bits: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct cut fingerprints, ascending, and their screening groups, ascending too)."""
        cut = self.label >> np.uint64(64 - bits)
        cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])] if len(cut) else cut
        return cut, spread(cut << np.uint64(64 - bits), groups)


def spread(values: np.ndarray, groups: int) -> np.ndarray:
    """Groups of 64-bit values by their highest 32 bits, in order."""
    return ((values >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def parts_of(ids: np.ndarray, texts: list[bytes], window: int, part: int) -> Iterator[tuple[int, Part, Numbers]]:
    """(number, part, words) of a bucket's documents in order."""
    known, waiting, size, n = Numbers(), [], 0, 0
    digests = np.empty(0, np.uint64)

    def done() -> Part:
        nonlocal digests
        if len(known) > len(digests):
            words = list(known)[len(digests) :]
            ends = np.cumsum([len(w) for w in words])
            digests = np.concatenate([digests, span_digests(b"".join(words), np.append(0, ends[:-1]), ends)])
        return Part(waiting, ids, digests, window)

    for row, text in enumerate(texts):
        words = numbers_of(text, known)
        for start in range(0, len(words) - window + 1, part):
            piece = words[start : start + part + window - 1]
            if waiting and size + len(piece) > part + window:
                yield n, done(), known
                waiting, size, n = [], 0, n + 1
            waiting.append((row, start, piece))
            size += len(piece)
    if waiting:
        yield n, done(), known


def common_prefixes(suffixes: np.ndarray) -> np.ndarray:
    """How many first words each of some sorted suffixes has in common with the one before it."""
    unlike = suffixes[1:] != suffixes[:-1]
    return np.where(unlike.any(1), unlike.argmax(1), suffixes.shape[1]) if len(suffixes) else np.empty(0, np.int64)


def sorted_suffixes(suffixes: np.ndarray, words: int) -> np.ndarray:
    """The order of suffixes (rows of ranks below `words`): several ranks in one key."""
    bits = max(1, int(words - 1).bit_length())
    each = 63 // bits
    keys = []
    for at in range(0, suffixes.shape[1], each):
        key = np.zeros(len(suffixes), np.int64)
        for column in suffixes[:, at : at + each].T:
            key = key << bits | column
        keys.append(key)
    return np.lexsort(keys[::-1])


def nodes(depths: np.ndarray, least: int) -> np.ndarray:
    """The number of each leaf's node of at least this depth; leaves without one have a number of their own."""
    return np.cumsum(np.concatenate([[0], depths < least]))


def cut_repeats(docs: DataFrame, window: int = WINDOW, unit: int = mail.UNIT, part: int = PART, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and repeats (first word, number of words and source
    document of each maximal repeat of an earlier document; those of different sources may overlap)."""
    own = mail.bucketed(docs, unit=unit)
    groups = -(-own.words // own.unit)
    bits = min(64, int(own.words).bit_length() + 12)
    levels = [n for n in LEVELS if n < window]
    each = CELLS // COUNTERS

    def ask(table: pa.Table) -> pa.Table:
        rows, bucket = [], table.column("bucket")[0].as_py()
        counts = np.zeros((len(levels), CELLS), np.int64)
        ids, texts, _ = mail.ordered(table)
        for n, p, _ in parts_of(ids, texts, window, part):
            cut, group = p.screens(bits, groups)
            rows += [(bucket, n, g, mail.pack_sorted(cut[s])) for g, s in group_slices(group)]
            for k, level in enumerate(levels):
                counts[k] += np.bincount((p.prefixes(level) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        for c in range(COUNTERS):
            rows.append((bucket, -1, -1 - c, mail.squeeze(counts[:, c * each : (c + 1) * each].astype("<u4").tobytes())))
        release()
        return mail.mail_table(rows)

    def screen(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        where = list(zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), strict=True))
        payloads = table.column("payload")
        if group < 0:  # prefixes that begin too many suffixes
            total = sum(np.frombuffer(mail.stretch(p.as_py()), "<u4").astype(np.int64) for p in payloads)
            mask = mail.squeeze(np.packbits(total > heavy).tobytes())
            return mail.mail_table([(bucket, n, group, mask) for bucket, n in where])
        found = [mail.unpack_sorted(p.as_py()) for p in payloads]
        every = np.sort(np.concatenate(found))
        twice = every[1:][every[1:] == every[:-1]]
        rows = []
        for (bucket, n), cut in zip(where, found, strict=True):
            hit = twice[np.minimum(np.searchsorted(twice, cut), len(twice) - 1)] == cut if len(twice) else np.zeros(len(cut), bool)
            if hit.any():
                rows.append((bucket, n, group, mail.squeeze(np.packbits(hit).tobytes())))
        release()
        return mail.mail_table(rows)

    def leaves(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, bucket = [], (left if len(left) else right).column("bucket")[0].as_py()
        told = mail.letters(right)
        many = np.concatenate([np.unpackbits(np.frombuffer(mail.stretch(told[-1, -1 - c]), np.uint8)).reshape(len(levels), each) for c in range(COUNTERS)], 1).astype(bool)
        ids, texts, _ = mail.ordered(left)
        for n, p, known in parts_of(ids, texts, window, part):
            names = list(known)
            for group, chosen in sent(p, told, n, many):
                at = p.head[chosen]
                step = np.minimum(np.diff(at, append=at[-1] + window), window)
                flat = p.words[np.arange(step.sum()) + np.repeat(at - (np.cumsum(step) - step), step)]
                marked = np.zeros(len(names), bool)
                marked[flat] = True
                used = np.flatnonzero(marked)
                local = (np.cumsum(marked, dtype=np.int32) - 1)[flat]
                kind = "<u2" if len(used) <= 1 << 16 else "<u4"
                body = b"\n".join(names[w] for w in used.tolist())
                fields = [mail.squeeze(body), mail.planes(local.astype(kind)), mail.squeeze(step.astype("<u1").tobytes()), mail.planes(p.least[chosen].astype("<i8")), mail.planes(chosen.astype("<u4"))]
                head = np.array([len(used), *(len(f) for f in fields)], "<u4").tobytes()
                rows.append((bucket, n, group, head + b"".join(fields)))
        release()
        return mail.mail_table(rows)

    def sent(p: Part, told: dict[tuple[int, int], bytes], n: int, many: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, classes) of what the screens have left of a part."""
        cut, group = p.screens(bits, groups)
        open_ = np.zeros(len(cut), bool)
        for g, s in group_slices(group):
            if (n, g) in told:
                open_[s] = np.unpackbits(np.frombuffer(mail.stretch(told[n, g]), np.uint8), count=s.stop - s.start).astype(bool)
        chosen = np.flatnonzero(open_[np.searchsorted(cut, p.label >> np.uint64(64 - bits))])
        to, left = mix(p.label[chosen]), np.arange(len(chosen))
        for k, level in enumerate(levels):
            prefix = p.prefixes(level)[chosen[left]]
            light = ~many[k][(prefix & np.uint64(CELLS - 1)).astype(np.int64)]
            to[left[light]] = chain(prefix[light], np.full(light.sum(), level, np.uint64))
            left = left[~light]
        to = spread(to, groups)
        order = np.argsort(to, kind="stable")
        for g, s in group_slices(to[order]):
            own = chosen[order[s]]
            yield g, own[np.argsort(p.head[own])]

    def subtree(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        read = []
        for payload in table.column("payload").to_pylist():
            head = np.frombuffer(payload[:24], "<u4").astype(np.int64)
            a, b, c, d, e = 24 + np.cumsum(head[1:])
            names = mail.stretch(payload[24:a]).split(b"\n")
            local = mail.unplanes(payload[a:b], "<u2" if head[0] <= 1 << 16 else "<u4")
            step = np.frombuffer(mail.stretch(payload[b:c]), "<u1").astype(np.int64)
            read.append((names, local[(np.cumsum(step) - step)[:, None] + np.arange(window)], mail.unplanes(payload[c:d], "<i8"), payload[d:e]))
        alphabet = sorted({w for names, *_ in read for w in names})
        rank = {w: i for i, w in enumerate(alphabet)}
        suffixes = np.concatenate([np.fromiter(map(rank.__getitem__, names), np.int32, len(names))[local] for names, local, *_ in read])
        doc = np.concatenate([r[2] for r in read])
        order = sorted_suffixes(suffixes, len(alphabet))
        node = nodes(common_prefixes(suffixes[order]), window)
        least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[order])
        first = np.empty(len(doc), np.int64)
        first[order] = least[node]
        rows, at = [], 0
        for bucket, n, (*_, d, number) in zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), read, strict=True):
            mine = first[at : at + len(d)]
            at += len(d)
            later = mine < d
            if later.any():
                numbers = mail.planes(mail.unplanes(number, "<u4")[later])
                rows.append((bucket, n, group, len(numbers).to_bytes(4, "little") + numbers + mail.planes(mine[later].astype("<i8"))))
        release()
        return mail.mail_table(rows)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        told = defaultdict(list)
        for n, payload in zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True):
            told[n].append(payload)
        ids, texts, _ = mail.ordered(left)
        gone: dict[int, list[np.ndarray]] = defaultdict(list)
        runs: dict[int, list[dict]] = defaultdict(list)
        for n, p, _ in parts_of(ids, texts, window, part):
            least = p.least.copy()
            for payload in told[n]:
                cut = 4 + int.from_bytes(payload[:4], "little")
                least[mail.unplanes(payload[4:cut], "<u4")] = mail.unplanes(payload[cut:], "<i8")
            least = least[p.of]
            again = np.flatnonzero(least < p.doc)
            row, place, source = p.row[again], p.place[again], least[again]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1])]) if len(again) else np.empty(0, bool)
            at = np.flatnonzero(new)
            for i, size in zip(at.tolist(), np.diff(np.append(at, len(again))).tolist(), strict=True):
                runs[int(row[i])].append({"first": int(place[i]), "words": size + window - 1, "source": int(source[i])})
            for r, s in group_slices(row):
                gone[r].append(place[s])
        out = []
        for row, text in enumerate(texts):
            words = text.split()
            if row not in gone:
                out.append((ids[row], len(words), 0, b" ".join(words), []))
                continue
            steps = np.zeros(len(words) + 1, np.int64)
            places = np.concatenate(gone[row])
            np.add.at(steps, places, 1)
            np.add.at(steps, places + window, -1)
            cut = np.cumsum(steps[:-1]) > 0
            out.append((ids[row], len(words), int(cut.sum()), b" ".join(w for w, c in zip(words, cut.tolist(), strict=True) if not c), runs[row]))
        doc_id, n_words, n_removed, kept, repeats = zip(*out, strict=True) if out else ([],) * 5
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("source", pa.int64())]))
        release()
        return pa.table([pa.array(doc_id, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(repeats, kind)], ["doc_id", "n_words", "n_removed", "kept", "repeats"])

    schema = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first:long,words:long,source:long>>"
    screened = own.texts.groupBy("bucket").applyInArrow(ask, mail.MAIL).groupBy("grp").applyInArrow(screen, mail.MAIL)
    sent_ = own.texts.groupBy("bucket").cogroup(screened.groupBy("bucket")).applyInArrow(leaves, mail.MAIL)
    answered = sent_.groupBy("grp").applyInArrow(subtree, mail.MAIL)
    return own.texts.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(finish, schema)


#: Windows are grouped by their words, so that the SQL shares no fingerprint with the operator.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
v AS (SELECT s.doc_id, s.i, array_to_string(ws[s.i:s.i + 12], ' ') AS h FROM s JOIN w ON s.doc_id = w.doc_id),
g AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN g USING (h) WHERE doc_id <> least),
p AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
e AS (SELECT w.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.p WHERE c.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN r ON w.doc_id = r.doc_id
"""
