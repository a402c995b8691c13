"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. VOTERS look at whole texts. Those of SEEDS are word lists written here, one for each kind and language; patterns look at
   capitals, exclamation marks, symbols and words of address. These owe nothing to labels. MINED more are lists of the features that
   say most of the label in at most SAMPLE labelled training rows (the first by a hash of doc_id). Features of a text are its
   lower-cased words, their beginnings and their endings, as fingerprints; Spark counts them by label and brings VOCABULARY of them.
2. One look at all documents writes, for each, the vocabulary's features that it holds, how often, and the figures of its form:
   a few dozen bytes each. Votes of all training documents are counted by pattern.
3. The label model is P(class) and, along a maximum spanning tree of the voters' conditional mutual information, P(vote | another's
   vote, class), so that correlated voters don't count twice. Accuracies begin as the labelled rows have them (without any, as
   those of a vote that is right more often than not) and are then estimated by expectation maximisation on the patterns of all
   training rows. A row's own label is one more witness, as accurate as the model finds it.
4. A logistic regression on the features is fitted to the posterior labels of at most SAMPLE training rows.

Training rows are those with crc32(doc_id as text) mod 5 other than 0; others only get scores. lang, source, doc_id and
labels are no inputs of a score. Null and empty texts get the score of a text without features. With no labelled training row
(or one class only) every score is PRIOR. Labels that are null or neither 0 nor 1 are left out; of several labels of a doc_id the
larger counts. Rows that repeat a doc_id are scored each for itself, rows without doc_id get no score (and stay in drop_toxic());
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import NOT_ALNUM, Words, Written, slices, span_digests, tidy, whole_texts

#: Labelled training rows that choose the vocabulary, and training rows that fit the classifier, at most.
SAMPLE = 8_000
VOCABULARY = 3_000
#: Labelled rows that must hold a feature.
LEAST_ROWS = 4
#: Word lists that vote, one voter each (fixed values: common abusive words).
SEEDS = {
    "insults": "idiot idiots moron morons imbecile cretin fool fools dumbass dimwit halfwit jerk jerks stupid dumb",
    "contempt": "loser losers pathetic worthless useless scum trash garbage filth vermin disgusting clown clowns pig pigs",
    "profanity": "fuck fucking fucked shit shitty bullshit bitch bitches bastard bastards asshole assholes crap damn",
    "threats": "kill die hate hated despise destroy burn rot hang",
    "german": "idiotin dummkopf trottel versager arschloch scheisse scheiße depp abschaum dreck wertlos erbärmlich blödmann hurensohn",
    "french": "imbécile crétin abruti connard connasse salaud salope merde ordure minable débile bouffon raté",
    "spanish": "imbécil estúpido estúpida tonto basura inútil cabrón mierda escoria payaso perdedor patético asqueroso",
}
#: Words of address.
ADDRESS = "you your yours yourself du dich dir dein deine tu te toi ton tes tú ti usted vous"
MINED, WORDS_OF_A_LEXICON = 6, 12
PATTERNS = 6
VOTERS = len(SEEDS) + MINED + PATTERNS
PRIOR = 0.1
_BEGINNINGS, _ENDINGS = (5, 7), (5,)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
    """(features, the text of each) and the words: whole words, beginnings and endings, each kind apart."""
    words = Words([t.lower() for t in texts], NOT_ALNUM)
    found, of = [words.hashes], [words.text_of]
    size = words.ends - words.starts
    for k, n in enumerate((*_BEGINNINGS, *(-n for n in _ENDINGS))):
        long = size > abs(n)
        starts, ends = words.starts[long], words.ends[long]
        found.append(span_digests(words.buffer, starts, starts + n, 10 + k) if n > 0 else span_digests(words.buffer, ends + n, ends, 10 + k))
        of.append(words.text_of[long])
    return np.concatenate(found), np.concatenate(of), words


def word_features(words: str) -> np.ndarray:
    return text_features([words.encode()])[2].hashes


def _counted(features: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times), by text and feature."""
    order = np.lexsort((features, of))
    features, of = features[order], of[order]
    begins = np.flatnonzero(np.concatenate([[True], (features[1:] != features[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.empty(0, np.int64)
    return of[begins], features[begins], np.diff(np.concatenate([begins, [len(of)]]))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, n (labelled texts that hold it) and one (those labelled 1), added up in each slice; feature null: all texts."""
    for batch in batches:
        label_of = dict(zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), strict=True))
        renamed = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text")], ["doc_id", "text"])
        for rows, texts in slices(iter([renamed])):
            of, features, _ = _counted(*text_features(texts)[:2])
            label = np.array([label_of[r] for r in rows.tolist()], np.int64)
            known, which = np.unique(features, return_inverse=True)
            n, one = np.bincount(which, minlength=len(known)), np.bincount(which, label[of], len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*known.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, len(texts))), pa.array(np.append(one, label.sum()))], ["feature", "n", "one"])


def choose_vocabulary(labelled: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(features, log odds), those that say most of the label first, by the gain of the likelihood ratio test. labelled: row, text,
    label. Features are counted and chosen in Spark; `most` rows come back."""
    counts = Written(labelled.select("row", "text", "label").mapInArrow(tidy(_feature_counts), "feature long, n long, one long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("one").alias("one")), "features")
    total = counts.df.where("feature IS NULL").first()
    if not total or total["one"] in (0, total["n"]):
        counts.drop()
        return np.empty(0, np.uint64), np.empty(0)
    base = total["one"] / total["n"]
    rate = (F.col("one") + base) / (F.col("n") + 1)
    gain = F.col("one") * F.log(rate / base) + (F.col("n") - F.col("one")) * F.log(F.greatest(1 - rate, F.lit(1e-9)) / (1 - base))
    chosen = counts.df.where(F.col("feature").isNotNull() & (F.col("n") >= LEAST_ROWS)).select("feature", rate.alias("rate"), gain.alias("gain"))
    found = chosen.where("gain > 2").orderBy(F.desc("gain"), "feature").limit(most).select("feature", "rate").toPandas()
    counts.drop()
    odds = np.log(found["rate"] / (1 - found["rate"])) - np.log(base / (1 - base))
    return found["feature"].to_numpy(np.int64).view(np.uint64), odds.to_numpy(float)


def capital_shares(texts: list[bytes]) -> np.ndarray:
    """The share of A to Z among all bytes of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    before = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    ends = np.cumsum(length)
    return (before[ends] - before[ends - length]) / np.maximum(length, 1)


_TABLE = "doc_id long, size long, caps double, shouts double, symbols double, which binary, times binary"


def _looker(vocabulary: np.ndarray):
    """Each document's vocabulary features (numbers as <u2, times as <u4) and figures of its form."""
    order = np.argsort(vocabulary)
    ordered = vocabulary[order]

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            features, of, words = text_features(texts)
            at = np.minimum(np.searchsorted(ordered, features), max(0, len(ordered) - 1))
            known = ordered[at] == features if len(ordered) else np.zeros(len(features), bool)
            of, which, times = _counted(order[at[known]].astype(np.uint64), of[known])
            cuts = np.searchsorted(of, np.arange(len(texts) + 1))
            size = np.diff(words.first)
            form = [(sum(map(t.count, (b"!", b"?"))), sum(map(t.count, (b"#", b"$", b"%", b"&", b"*", b"|"))), len(t)) for t in texts]
            shouts, symbols, length = (np.array(c, float) for c in zip(*form, strict=True))
            capitals = capital_shares(texts)
            least = np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(capitals), pa.array(shouts / least), pa.array(symbols / least),
                    pa.array([which[a:b].astype("<u2").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([times[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                ["doc_id", "size", "caps", "shouts", "symbols", "which", "times"],
            )

    return look


def _vocabulary_table(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    return whole_texts(docs).mapInArrow(_looker(vocabulary), _TABLE)


class Rows:
    """Rows of the vocabulary table as arrays."""

    def __init__(self, frame: pd.DataFrame):
        self.n = len(frame)
        self.which = np.frombuffer(b"".join(frame["which"]), "<u2").astype(np.int64)
        self.times = np.frombuffer(b"".join(frame["times"]), "<u4").astype(float)
        counts = np.fromiter((len(w) // 2 for w in frame["which"]), np.int64, self.n)
        self.row = np.repeat(np.arange(self.n), counts)
        self.size = frame["size"].to_numpy(float)
        self.form = frame[["caps", "shouts", "symbols"]].to_numpy(float).reshape(self.n, 3)


class Voters:
    """What the vocabulary's features mean to the voters."""

    def __init__(self, mined: np.ndarray, odds: np.ndarray):
        """mined: features chosen by labels, the strongest first, with their log odds. Seed words are added to the vocabulary."""
        own = [word_features(words) for words in SEEDS.values()]
        address = word_features(ADDRESS)
        extra = np.setdiff1d(np.concatenate([*own, address]), mined)
        self.vocabulary = np.concatenate([mined, extra])
        self.odds = np.concatenate([odds, np.zeros(len(extra))])
        self.seeds = [np.isin(self.vocabulary, words) for words in own]
        self.address = np.isin(self.vocabulary, address)
        self.mined = np.full(len(self.vocabulary), -1, np.int64)
        strongest = np.flatnonzero(self.odds > 1.5)[: MINED * WORDS_OF_A_LEXICON]
        self.mined[strongest] = np.arange(len(strongest)) % MINED

    def votes(self, rows: Rows) -> np.ndarray:
        """A bit for each voter."""
        out, size = np.zeros(rows.n, np.int64), np.maximum(rows.size, 1)
        count = lambda mask: np.bincount(rows.row[mask[rows.which]], rows.times[mask[rows.which]], rows.n)
        seeds = [count(mask) for mask in self.seeds]
        fires = [c > 0 for c in seeds] + [count(self.mined == k) > 0 for k in range(MINED)]
        address = count(self.address)
        caps, shouts, symbols = rows.form.T
        fires += [sum(seeds) >= 2, (sum(seeds) > 0) & (address > 0), sum(seeds) / size > 0.01, caps > 0.3, shouts > 0.2, symbols > 0.5]
        for k, fired in enumerate(fires):
            out |= fired.astype(np.int64) << k
        return out


class LabelModel:
    """P(class) and a tree-shaped P(votes | class), fitted to counts of (pattern, label or -1)."""

    def __init__(self, patterns: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = 40):
        self.bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.n = n.astype(float)
        known = label >= 0
        seeds = self.bits[:, : len(SEEDS)]
        if known.any() and 0 < np.average(label[known], weights=self.n[known]) < 1:
            # What labelled rows say of each voter, carried over to all patterns.
            share = np.average(label[known], weights=self.n[known])
            odds = np.full(len(self.n), np.log(share / (1 - share)))
            for i in range(VOTERS):
                hit = [(self.n[known] * self.bits[known, i] * (label[known] == y)).sum() + 0.5 for y in (0, 1)]
                rate = [h / (self.n[known & (label == y)].sum() + 1) for y, h in enumerate(hit)]
                odds += np.where(self.bits[:, i] == 1, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))
            q = 1 / (1 + np.exp(-np.clip(odds, -5, 5)))
        else:
            q = np.where(seeds.any(1), 0.5 + 0.4 * seeds.mean(1), PRIOR / 2)
        for step in range(rounds):
            if step in (0, 5):
                self._tree(q)
            self._fit(q, label)
            new = self.posterior(self.bits, label)
            done, q = np.abs(new - q).max() < 1e-4, new
            if done and step > 6:
                break

    def _tree(self, q: np.ndarray) -> None:
        """Each voter's parent (-1: none) along the strongest conditional dependences."""
        info = np.zeros((VOTERS, VOTERS))
        for weight in (self.n * q, self.n * (1 - q)):
            total = weight.sum() + 4
            for i in range(VOTERS):
                for j in range(i):
                    joint = (np.bincount(self.bits[:, i] * 2 + self.bits[:, j], weight, 4) + 1) / total
                    a, b = joint.reshape(2, 2).sum(1), joint.reshape(2, 2).sum(0)
                    info[i, j] += total * (joint * np.log(joint / np.outer(a, b).ravel())).sum()
        info += info.T
        self.parent, inside, self.order = np.full(VOTERS, -1), {0}, [0]
        while len(inside) < VOTERS:
            best = max(((info[i, j], -i, -j) for i in range(VOTERS) if i not in inside for j in inside), default=None)
            i, j = -best[1], -best[2]
            self.parent[i] = j if best[0] > 0.002 * self.n.sum() else -1
            inside.add(i)
            self.order.append(i)

    def _fit(self, q: np.ndarray, label: np.ndarray) -> None:
        self.prior = ((self.n * q).sum() + 1) / (self.n.sum() + 2)
        self.fire = np.empty((2, VOTERS, 2))  # class, voter, parent's vote
        for y, weight in enumerate((self.n * (1 - q), self.n * q)):
            for i in range(VOTERS):
                above = self.bits[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(weight), np.int64)
                hit, all_ = (np.bincount(above, w, 2) for w in (weight * self.bits[:, i], weight))
                self.fire[y, i] = (hit + 0.5) / (all_ + 1)
        known = label >= 0
        right = (self.n * np.where(label == 1, q, 1 - q))[known].sum()
        self.label_right = min(0.98, (right + 9) / (self.n[known].sum() + 10))

    def posterior(self, bits: np.ndarray, label: np.ndarray) -> np.ndarray:
        odds = np.full(len(bits), np.log(self.prior / (1 - self.prior)))
        for i in range(VOTERS):
            above = bits[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(bits), np.int64)
            p = self.fire[:, i, :][:, above]
            odds += np.where(bits[:, i] == 1, np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])))
        odds += np.where(label < 0, 0, np.where(label == 1, 1, -1)) * np.log(self.label_right / (1 - self.label_right))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Classifier:
    """Logistic regression: presence of each feature and its density, figures of form, and the strongest words' density."""

    def __init__(self, strength: np.ndarray):
        self.strength, self.width = strength, 2 * len(strength) + 6
        self.weights, self.bias = np.zeros(self.width), np.log(PRIOR / (1 - PRIOR))

    def _entries(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, size = len(self.strength), np.maximum(rows.size, 1)
        positive = np.maximum(self.strength, 0)[rows.which] if v else np.empty(0)
        strong = positive > 2
        figures = np.column_stack([
            np.log1p(np.bincount(rows.row[strong], rows.times[strong], rows.n)),
            np.log1p(200 * np.bincount(rows.row[strong], rows.times[strong], rows.n) / size),
            np.log1p(20 * np.bincount(rows.row, positive, rows.n) / size),
            rows.form[:, 0], np.minimum(rows.form[:, 1], 2), np.minimum(rows.form[:, 2], 2),
        ])
        row = np.concatenate([rows.row, rows.row, np.repeat(np.arange(rows.n), 6)])
        column = np.concatenate([rows.which, v + rows.which, np.tile(np.arange(2 * v, 2 * v + 6), rows.n)])
        value = np.concatenate([np.ones(len(rows.row)), np.log1p(100 * rows.times / size[rows.row]), figures.ravel()])
        return row.astype(np.int32), column.astype(np.int32), value.astype(np.float32)

    def fit(self, blocks: list[tuple[Rows, np.ndarray]], steps: int = 250, rate: float = 0.05, ridge: float = 2e-4) -> None:
        """blocks: rows with their targets, a part at a time."""
        entries, n = [(self._entries(rows), rows.n, target) for rows, target in blocks], sum(rows.n for rows, _ in blocks)
        m, v = np.zeros(self.width + 1), np.zeros(self.width + 1)
        for t in range(1, steps + 1):
            g = np.append(ridge * self.weights, 0)
            for (row, column, value), size, target in entries:
                error = (self._p(row, column, value, size) - target) / max(1, n)
                g[:-1] += np.bincount(column, value * error[row], self.width)
                g[-1] += error.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            self.weights -= step[:-1]
            self.bias -= step[-1]

    def _p(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, value * self.weights[column], n), -30, 30)))

    def score(self, rows: Rows) -> np.ndarray:
        return self._p(*self._entries(rows), rows.n)


#: Rows of the fit that are unpacked at once.
_BLOCK = 1_000


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    training = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    training = training.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    first = training.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = whole_texts(docs).join(F.broadcast(first), "doc_id").withColumn("row", F.monotonically_increasing_id())
    voters = Voters(*choose_vocabulary(labelled))

    table = Written(_vocabulary_table(docs, voters.vocabulary), "toxicity-features").df

    @tidy
    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"pattern": voters.votes(Rows(frame)), "label": frame["label"]})

    model = Classifier(np.where(voters.odds > 0, voters.odds, 0.5 * voters.odds))
    if voters.odds.any():
        learning = table.where(~held_out()).join(training, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
        counts = learning.mapInPandas(vote, "pattern long, label int").groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
        labeller = LabelModel(counts["pattern"].to_numpy(), counts["label"].to_numpy(), counts["n"].to_numpy())
        fitted = learning.orderBy(-F.sign(F.col("label") + 0.5), F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
        blocks = []
        for at in range(0, len(fitted), _BLOCK):
            part = fitted.iloc[at : at + _BLOCK]
            rows = Rows(part)
            bits = (voters.votes(rows)[:, None] >> np.arange(VOTERS)) & 1
            blocks.append((rows, labeller.posterior(bits, part["label"].to_numpy())))
        model.fit(blocks)

    @tidy
    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(Rows(frame))})

    scored = table.mapInPandas(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    bad = score(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
