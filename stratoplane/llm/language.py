"""Language identification by hierarchical discrimination with linear support vector machines.

A text is a vector of hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, blanks unified), square roots of counts at unit
length. A first set of machines, one family against the others, tells the language family; inside a family one machine for
each two languages votes, and the sum of margins settles ties. Families are a fixed table; a language that is not in it is a
family of its own.

The machines are fitted on the driver on a bounded sample: about SAMPLE rows, the same number of each language, chosen by a
hash of the id; where many rows share an id, the first 2 * SAMPLE by hashes of id and vector. Only the counts of n-grams
that a text has travel to the driver. Everything else is a row-wise map. Null texts and texts without a letter are ``und`` with
score 0, and so is every text if there is nothing to learn from. Rows without a label or an id are predicted but not learned
from, and count as held in. Repeated rows are predicted alike, and learned from as often as the sample has them; ties of votes go
to the first language in order. Long texts are counted in segments. Columns named as the results are replaced; an empty table
gives an empty result.
"""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import table
from . import bytetext
from .arrowrows import bounded, kept

#: Hashed n-grams; rows that the machines are fitted on in all.
DIMS, SAMPLE = 4096, 4000
UNKNOWN = "und"
#: Families of closely related languages.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "da", "no", "nb", "nn", "sv", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "sl", "sk", "cs", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
}
_FAMILY_OF = {lang: family for family, members in FAMILIES.items() for lang in members}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_SQUARE = np.arange(256, dtype=np.uint32)
_SQUARE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_SQUARE = np.where((_SQUARE >= 0x41) & (_SQUARE <= 0x5A), _SQUARE + 0x20, _SQUARE).astype(np.uint32)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="replace"))


def ngram_vector(text: np.ndarray, segment: int = 1 << 19) -> np.ndarray:
    """The unit vector of a text's hashed byte n-grams."""
    counts = np.zeros(DIMS, np.int64)
    for k in range(0, max(1, len(text)), segment):
        b = _SQUARE[text[k : k + segment + 2]]
        own = min(segment, len(text) - k)
        for code, n in ((b, own), ((b[:-1] << np.uint32(8)) | b[1:] | np.uint32(1 << 24), own), ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:] | np.uint32(1 << 25), own)):
            slot = (code[:n] * np.uint32(2654435761)) >> np.uint32(32 - 12)
            counts += np.bincount(slot, minlength=DIMS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / (np.linalg.norm(x) or 1)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 25, seed: int = 11) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss on some rows of x, by dual coordinate
    descent. x is read in place, never copied."""
    w, bias, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(rows))
    size, draw = np.einsum("ij,ij->i", x, x)[rows] + 1.0 + 0.5 / cost, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            one = x[rows[i]]
            new = max(0.0, alpha[i] - (y[i] * (float(one @ w) + bias) - 1 + alpha[i] * 0.5 / cost) / size[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * one
                bias, alpha[i] = bias + step, new
    return np.append(w, np.float32(bias))


class Model:
    """Families, and the machines between them and inside them; a few kilobytes for each language."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        langs = sorted(set(labels))
        lang = np.array(labels, dtype=object)
        family = np.array([_FAMILY_OF.get(v, v) for v in labels], dtype=object)
        self.members = {f: sorted(v for v in langs if _FAMILY_OF.get(v, v) == f) for f in sorted(set(family.tolist()))}
        self.families = list(self.members)
        every = np.arange(len(x))
        weights = [svm(x, every, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(f, a, b) for f, own in self.members.items() for a, b in itertools.combinations(own, 2)]
        for _, a, b in self.pairs:
            at = np.flatnonzero((lang == a) | (lang == b))
            weights.append(svm(x, at, np.where(lang[at] == a, 1.0, -1.0)))
        self.weights = np.array(weights, np.float32).reshape(len(weights), DIMS + 1)

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNKNOWN, 0.0
        margin = self.weights[:, :-1] @ vector + self.weights[:, -1]
        between = margin[: len(self.families)] if len(self.families) > 1 else np.ones(1)
        k = int(np.argmax(between))
        sure = 1 / (1 + np.exp(-2.0 * between[k]))
        family = self.families[k]
        votes = {v: [0, 0.0] for v in self.members[family]}
        skip = len(self.families) if len(self.families) > 1 else 0
        for (f, a, b), m in zip(self.pairs, margin[skip:].tolist()):
            if f == family:
                win = votes[a if m >= 0 else b]
                win[0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(sorted(votes), key=lambda v: votes[v])
        others = len(votes) - 1
        inside = 1 / (1 + np.exp(-2.0 * votes[best][1] / others)) if others else 1.0
        return best, float(np.clip(sure * inside, 0, 1))


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` rows that meet learn, the same number of each language."""
    usable = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(sample).collect()}
    each = max(1, sample // max(1, len(counts)))
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (hashed < int(min(1.0, each / n) * (1 << 20)) + 1))

    def vectors(batches):
        kept(None)
        for b in batches:
            rows = []
            for lang, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if has_letter(text.as_buffer().to_pybytes()):
                    x = ngram_vector(np.frombuffer(text.as_buffer(), np.uint8))
                    at = np.flatnonzero(x)
                    packed = at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()
                    rows.append((lang, key, zlib.crc32(packed), packed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["lang", "key", "mark", "x"])

    found = bounded(usable).where(chosen).select(F.col(lang_col).cast("string"), F.xxhash64(F.col(id_col), F.lit(6)), text_col).mapInArrow(vectors, "lang string, key long, mark long, x binary")
    rows = found.orderBy("key", "mark").limit(2 * sample).select("lang", "x").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x, labels = np.zeros((len(rows), DIMS), np.float32), [r[0] for r in rows]
    for k in range(len(rows)):
        packed, rows[k] = bytes(rows[k][1]), None
        n = len(packed) // 6
        x[k, np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return Model(x, labels)


def identified(docs: DataFrame, text_col: str, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score appended (columns of these names are replaced)."""
    base = docs.drop(*names)
    place = base.columns.index(text_col)
    schema = T.StructType([*base.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        kept(None)
        for b in batches:
            found = []
            for text in b.column(place):
                raw = text.as_buffer() if text.is_valid else None
                found.append((UNKNOWN, 0.0) if raw is None or not has_letter(raw.to_pybytes()) else model.predict(ngram_vector(np.frombuffer(raw, np.uint8))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, *names])

    return bounded(base).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, "text", "lang", "doc_id", ~held_out())
    found = identified(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
