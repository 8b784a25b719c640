"""Toxicity scores by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. Stems (whole words and word beginnings, A-Z lower-cased) that set toxic development texts apart become lexicon
   voters: "the stem comes at least once" or "at least so often in a thousand words". Pattern voters look at the
   share of capitals, of marks, of digits in words, of repeated words, and at all stems together. A voter says toxic, clean or
   nothing.
2. Label model. It sees votes only, of labelled and unlabelled rows alike. A voter that says something is right with an accuracy
   better than chance; saying nothing tells nothing, as most voters know the words of one language only.
   Expectation-maximisation, started from the votes' majority, estimates how often each voter says toxic or clean in texts of either
   class, and so its accuracy, and the share of toxic texts; signed correlations
   of the voters given the class, where they exceed chance, say how much of a vote each has (a word and its beginnings say
   the same and share one; voters that avoid each other count for more). The result is a posterior label for each text.
3. Classifier. Logistic regression on the posterior labels, over counts and rates of the stems and the patterns.

Gold labels choose the voters, set their bars, and give the share of toxic rows that scores are for; they are neither a
vote nor a start of the label model, nor what the classifier is trained on.

Ids are integers. Fitting takes a bounded sample, chosen by hashes of the id: about SAMPLE labelled rows of either label and
UNLABELLED other rows; where many rows share an id, the first 4 * SAMPLE and 2 * UNLABELLED by hashes of id and text. Scoring is a
row-wise map over whole texts, long ones included. Null and empty texts get the score of a text without any stem; rows without an id
are scored, count as held in, and are not learned from. Repeated rows are scored alike. Without labelled rows every score is 0.
Columns named as the results are replaced; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import table
from . import bytetext
from .arrowrows import bounded, kept

U64 = np.uint64
#: Labelled rows of either label and other rows that are learned from; stems kept; beginnings of words in bytes.
SAMPLE, UNLABELLED, STEMS, BEGINNINGS = 1200, 1200, 256, range(4, 10)
THRESHOLD = 0.7
#: Toxic texts times the log of their lift that a stem must reach: less is found by chance among so many stems.
SURE = 12.0
#: Occurrences in a thousand words from which a lexicon voter votes (0: at least one).
RATES = (0.0, 2.0, 5.0, 10.0)
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[0x41:0x5B] = _NOT_LETTER[0x61:0x7B] = _NOT_LETTER[0x80:] = False
PATTERNS = ("capitals", "marks", "digits in words", "repeated words")


def stems_of(data: np.ndarray, offsets: np.ndarray):
    """Stem hashes (one array for words and one for each length of beginnings), first word of each row, words per row."""
    low = bytetext.LOWER[data]
    starts, ends, first = bytetext.word_bounds(low, offsets, _NOT_LETTER)
    words = bytetext.word_hashes(low, starts, ends)
    return [words, *bytetext.prefix_hashes(low, starts, ends, BEGINNINGS)], first


def patterns_of(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows' shares of capitals, marks, digits next to letters, and words equal to the one before."""
    lo, hi = offsets[:-1], offsets[1:]
    n_bytes, n_words = np.maximum(hi - lo, 1), np.maximum(np.diff(first), 1)
    capital = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    letter = ~_NOT_LETTER[data]
    mark = (data > 0x20) & (data < 0x80) & ~letter & ~digit
    inside = np.zeros(len(data), bool)
    inside[1:] = digit[1:] & letter[:-1]
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (capital, mark, inside, same)]
    shares = [(s[hi] - s[lo]) / n_bytes for s in sums[:3]] + [(sums[3][first[1:]] - sums[3][first[:-1]]) / n_words]
    return np.stack(shares, axis=1)


class Counter:
    """Counts of the chosen stems and the patterns of texts."""

    def __init__(self, stems: np.ndarray):
        self.stems = np.sort(stems.astype(U64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """counts (rows x stems), words per row, patterns (rows x patterns)."""
        levels, first = stems_of(data, offsets)
        n, m = len(offsets) - 1, len(self.stems)
        counts = np.zeros((n, m))
        if m and len(levels[0]):
            row = bytetext.spans_rows(first)
            for h in levels:
                place = np.minimum(np.searchsorted(self.stems, h), m - 1)
                hit = np.flatnonzero(self.stems[place] == h)
                counts += np.bincount(row[hit] * m + place[hit], minlength=n * m).reshape(n, m)
        return counts, np.diff(first), patterns_of(data, offsets, levels[0], first)


def words_held(counter: Counter, text: bytes, rates: np.ndarray) -> int:
    """How many words of a text have a stem that comes often enough; the stems of one word count once."""
    data = np.frombuffer(text, np.uint8)
    levels, first = stems_of(data, np.array([0, len(data)]))
    m = len(counter.stems)
    if not m or not len(levels[0]):
        return 0
    places = [np.minimum(np.searchsorted(counter.stems, h), m - 1) for h in levels]
    hits = [counter.stems[place] == h for place, h in zip(places, levels)]
    counts = sum(np.bincount(place[hit], minlength=m) for place, hit in zip(places, hits))
    over = (counts > 0) & (1000.0 * counts / max(1, first[-1]) >= rates)
    held = np.zeros(len(levels[0]), bool)
    for place, hit in zip(places, hits):
        held |= hit & over[place]
    return int(held.sum())


def choose_stems(texts: list[bytes], toxic: np.ndarray, limit: int = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """The stems that set toxic texts apart best, and for each the rate from which its voter votes."""
    held: dict[bool, list] = {True: [], False: []}
    for text, y in zip(texts, toxic.tolist()):
        data = np.frombuffer(text, np.uint8)
        levels, first = stems_of(data, np.array([0, len(data)]))
        h = np.concatenate(levels)
        stem, n = np.unique(h[h != 0], return_counts=True)
        held[bool(y)].append((stem, 1000.0 * n / max(1, first[-1])))
    stems, times = np.unique(np.concatenate([s for s, _ in held[True]] or [np.zeros(0, U64)]), return_counts=True)
    least = max(4, 0.004 * len(held[True]))
    stems = stems[times >= least]
    if not len(stems):
        return np.zeros(0, U64), np.zeros(0)
    seen = {y: np.zeros((len(RATES), len(stems))) for y in held}
    for y, rows in held.items():
        for stem, rate in rows:
            place = np.minimum(np.searchsorted(stems, stem), len(stems) - 1)
            own = stems[place] == stem
            for k, r in enumerate(RATES):
                hit = own & (rate >= r)
                seen[y][k, place[hit]] += 1
    a, b = seen[True], seen[False]
    gain = np.log((a + 0.5) / (len(held[True]) + 1)) - np.log((b + 0.5) / (len(held[False]) + 1))
    worth = np.where((a >= least) & (a >= 4 * b * len(held[True]) / max(1, len(held[False]))), a * gain, 0)
    rate = worth.argmax(axis=0)
    best = worth.max(axis=0)
    top = np.argsort(-best, kind="stable")[:limit]
    top = top[best[top] >= SURE]
    order = np.argsort(stems[top])
    return stems[top][order], np.array(RATES)[rate[top][order]]


def lexicon_of(counts: np.ndarray, words: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Whether each stem comes as often as its voter asks."""
    return (counts > 0) & (1000.0 * counts / np.maximum(words, 1)[:, None] >= rates)


def votes_of(lexicon: np.ndarray, held: np.ndarray, patterns: np.ndarray, bars: np.ndarray, many: int) -> np.ndarray:
    """-1 (clean), 0 (nothing) or 1 (toxic) of each voter: a voter for each stem, which speaks where a text holds two words with a stem
    at least, one for each pattern, and two over all such words, one that says clean where there is none, one that says toxic from
    ``many`` on, else clean."""
    held = held[:, None]
    return np.hstack([lexicon & (held >= 2), patterns > bars, np.where(held > 0, 0, -1), np.where(held >= many, 1, -1)]).astype(np.int8)


def label_model(votes: np.ndarray, over_all: int = 0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability of toxic for each row, each voter's accuracy (how often it is right when it says something) and its
    share of a vote; from the votes alone. The last ``over_all`` voters sum up the others: their shares are their own."""
    n, m = votes.shape
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    post, share = np.where(votes.sum(axis=1) > 0, 0.9, 0.1), np.ones(m)
    for step in range(rounds):
        mass = np.stack([1 - post, post])
        says_yes, says_no = ((mass @ v + 1) / (mass.sum(axis=1, keepdims=True) + 2) for v in (yes, no))
        # No voter is worse than chance: saying toxic never speaks for clean, nor the other way round.
        for_toxic = np.maximum(0, np.log(says_yes[1]) - np.log(says_yes[0]))
        for_clean = np.maximum(0, np.log(says_no[0]) - np.log(says_no[1]))
        if step in (0, 1, 2, 4, 8, 16):
            rest = (yes - mass.T @ says_yes) * yes.any(axis=0)
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            tied = np.clip((rest.T @ rest) / n / np.outer(scale, scale), -1, 1)
            tied[np.abs(tied) < 2 / np.sqrt(n)] = 0
            tied[m - over_all :, : m - over_all] = tied[: m - over_all, m - over_all :] = 0
            np.fill_diagonal(tied, 1)
            share = 1 / np.maximum(0.5, tied.sum(axis=1))
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        logit = yes @ (share * for_toxic) - no @ (share * for_clean) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    right = post @ yes + (1 - post) @ no
    return post, (right + 1) / (yes.sum(axis=0) + no.sum(axis=0) + 2), share


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last one is the bias) of ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def design(counts: np.ndarray, words: np.ndarray, patterns: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The classifier's inputs."""
    per = 1000.0 * counts / np.maximum(words, 1)[:, None]
    over = (counts > 0) & (per >= rates)
    total = over.sum(axis=1, keepdims=True)
    return np.hstack([over, np.sqrt(np.where(over, per, 0)) / 3, np.minimum(total, 8) / 2, total > 0, patterns])


class Model:
    """Stems, the rates their voters ask, and the classifier's weights: some kilobytes."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, others: list[bytes], share: float):
        stems, self.rates = choose_stems(texts, toxic) if len(texts) else (np.zeros(0, U64), np.zeros(0))
        self.counter, self.weights = Counter(stems), None
        if not len(texts) or toxic.min() == toxic.max():
            self.weights = None if not len(texts) or not toxic.max() else np.append(np.zeros(len(self._inputs(texts[:1])[0])), 4.0)
            return
        counts, words, patterns = (np.concatenate(p) for p in zip(*(self._count(t) for t in [*texts, *others])))
        lexicon, clean = lexicon_of(counts, words, self.rates), np.flatnonzero(toxic == 0)
        every = np.array([words_held(self.counter, t, self.rates) for t in [*texts, *others]])
        bars, held = np.quantile(patterns[clean], 0.98, axis=0), every[: len(toxic)]
        # Where "many" begins: where it parts the labels best.
        many = max(range(2, 13), key=lambda n: (held[toxic == 1] >= n).mean() - 4 * (held[clean] >= n).mean())
        # As with stems, a pattern has a voter only if toxic texts show it at least four times as often.
        often = [(patterns[np.flatnonzero(toxic == y)] > bars).mean(axis=0) for y in (0, 1)]
        bars = np.where(often[1] >= 4 * np.maximum(often[0], 0.005), bars, np.inf)
        self.posterior, self.accuracies, self.shares = label_model(votes_of(lexicon, every, patterns, bars, many), over_all=2)
        self.weights = logistic(design(counts, words, patterns, self.rates), self.posterior)
        # Toxic rows are more frequent in the sample than among all; scores are for their share among all.
        own, share = (min(max(p, 1e-4), 1 - 1e-4) for p in (self.posterior.mean(), share))
        self.weights[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own))

    def _count(self, text: bytes):
        return self.counter(np.frombuffer(text, np.uint8), np.array([0, len(text)]))

    def _inputs(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([design(*self._count(t), self.rates) for t in texts])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(offsets) - 1)
        logit = design(*self.counter(data, offsets), self.rates) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """Fit on about ``sample`` rows of either label among the labelled rows that meet learn (a condition on the id), and on
    ``unlabelled`` rows of docs that meet it too, whose labels are not looked at.

    Rows without a label or an id are not learned from; a row's label is its largest where it has several."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    hashed, full = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 24)), 1 << 24
    few = F.lit(False)
    for label, n in counts.items():
        few = few | ((F.col("_label") == label) & (hashed < int(min(1.0, sample / n) * full) + 1))
    # Bounded by the sample, so the ids are local data of known size and texts stay where they are.
    picked = known.where(few).orderBy(hashed, id_col).limit(4 * sample).collect()
    chosen = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array([r[0] for r in picked], pa.int64()), "_label": pa.array([r[1] for r in picked], pa.int32())}))
    texts = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    order = F.xxhash64("_id", F.lit(3)), F.xxhash64("text")
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(*order).limit(4 * sample).select("_label", "text").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)
    others = []
    if rows and unlabelled:
        n = texts.count()
        drawn = F.pmod(F.xxhash64(F.col("_id"), F.lit(4)), F.lit(full)) < int(min(1.0, unlabelled / max(1, n)) * full) + 1
        other = texts.where(drawn).join(F.broadcast(chosen), "_id", "left_anti")
        others = sorted(bytes(r[0]) for r in other.orderBy(F.xxhash64("_id", F.lit(4)), F.xxhash64("text")).limit(2 * unlabelled).select("text").collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return Model([r[1] for r in rows], np.array([r[0] for r in rows], np.int64), others, share)


def scored(docs: DataFrame, text_col: str, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of each whole text appended (a column of this name is replaced)."""
    base = docs.drop(name)
    place = base.columns.index(text_col)
    schema = T.StructType([*base.schema, T.StructField(name, T.DoubleType())])

    def run(batches):
        kept(None)
        for b in batches:
            data, offsets = bytetext.column_bytes(b.column(place))
            out = [model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in bytetext.row_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())], names=[*b.schema.names, name])

    return bounded(base).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out())
    found = scored(docs, "text", model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
