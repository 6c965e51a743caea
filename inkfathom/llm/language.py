"""Hierarchical language identification: the family first, then pairwise linear support vector machines within it.

Features: hashed counts of byte 2- and 3-grams of the lower-cased words, and of whole words; square roots, unit length.
Families are told apart by one-versus-rest linear SVMs; within a family every pair of languages has an SVM of its own,
and the language with most won pairs (then the larger sum of margins) is predicted. All are trained here, on a bounded
sample of labelled rows; prediction reads every whole text in parts of a fixed size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

UNDETERMINED = "und"
#: The bound on labelled rows that are fitted, shared evenly by the labels.
TRAIN_ROWS = 3_000
N_GRAM_BITS, WORD_BITS = 11, 11
PART_CHARS = 1_000_000
#: Family of a language by its ISO 639-1 code. A label not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_WORDLIKE = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is a Unicode letter: of those in words, numerals such as ½ are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _counts(text: str) -> np.ndarray | None:
    """Hashed counts of a whole text; None without a letter."""
    out, any_letter = np.zeros((1 << N_GRAM_BITS) + (1 << WORD_BITS)), False
    at = 0
    while at < len(text):
        end = at + PART_CHARS
        if end < len(text) and (m := _OTHER.search(text, end)):  # parts end between words
            end = m.end()
        part = _OTHER.sub(" ", text[at : end if end < len(text) else len(text)].lower()).strip()
        at = max(end, at + 1)
        if not part:
            continue
        any_letter = True
        b = np.frombuffer(f" {part} ".encode(), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        shift = np.uint32(32 - N_GRAM_BITS)
        for codes in (two, three):
            out[: 1 << N_GRAM_BITS] += np.bincount((codes * np.uint32(2654435761)) >> shift, minlength=1 << N_GRAM_BITS)
        # a word's hash: sum of its bytes times powers by their place from the word's start
        gaps = np.flatnonzero(b == 32)
        place = np.arange(len(b), dtype=np.uint32)
        place -= np.repeat(gaps, np.diff(np.append(gaps, len(b)))).astype(np.uint32)
        mixed = (b + np.uint32(1)) * (place * np.uint32(2246822519) + np.uint32(3266489917))
        words = np.add.reduceat(mixed ^ (mixed >> np.uint32(15)), gaps, dtype=np.uint32)[:-1]
        out[1 << N_GRAM_BITS :] += np.bincount((words * np.uint32(668265263)) >> np.uint32(32 - WORD_BITS), minlength=1 << WORD_BITS)
    return out if any_letter else None


def features(text: str | None) -> np.ndarray | None:
    counts = _counts(text) if text and has_letter(text) else None
    if counts is None:
        return None
    x = np.sqrt(counts)
    half = 1 << N_GRAM_BITS
    for part in (x[:half], x[half:]):  # n-grams and words weigh alike
        part /= max(np.linalg.norm(part), 1e-9) * 2**0.5
    return x.astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights, the bias last, of a linear SVM (squared hinge loss, classes weighing alike) by accelerated gradient descent."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (2 * 2 + strength)  # rows have a squared length of 2, bias included
    for i in range(steps):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - rate * (strength * v - 2 * np.append(pull @ x, pull.sum()))
        v = new + (i / (i + 3)) * (new - w)
        w = new.astype(np.float32)
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # one row a family
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]  # positive: the first

    def predict(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        x = np.append(x, np.float32(1))
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.family_weights @ x
            best = int(margins.argmax())
            family, sure = self.families[best], _logistic(margins[best] - np.delete(margins, best).max())
        names = self.languages[family]
        won, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        low = np.inf
        margins = {pair: float(self.pairs[pair] @ x) for pair in itertools.combinations(names, 2)}
        for (a, b), m in margins.items():
            won[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = max(names, key=lambda n: (won[n], total[n]))
        low = min((m if best == pair[0] else -m for pair, m in margins.items() if best in pair), default=np.inf)
        return best, float(sure * (_logistic(2 * low) if low < np.inf else 1.0))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * x, -50, 50))))


def fit(x: np.ndarray, labels: list[str]) -> Model:
    names = sorted(set(labels))
    family_of = {n: _FAMILY.get(n, f"only:{n}") for n in names}
    families = sorted(set(family_of.values()))
    which = np.array([family_of[n] for n in labels])
    weights = np.array([fit_svm(x, np.where(which == f, 1, -1).astype(np.float32)) for f in families]) if len(families) > 1 else np.zeros((len(families), 0), np.float32)
    languages = {f: [n for n in names if family_of[n] == f] for f in families}
    of, pairs = np.array(labels), {}
    for f in families:
        for a, b in itertools.combinations(languages[f], 2):
            rows = (of == a) | (of == b)
            pairs[a, b] = fit_svm(x[rows], np.where(of[rows] == a, 1, -1).astype(np.float32))
    return Model(families, weights, languages, pairs)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the identifier as text, mod 4, is 2; a null identifier is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of at most `rows` labelled rows that are not held out, rows // labels of each label, by a hash of the
    identifier and text; repeated rows count once. `rows` is at least the number of labels; it bounds rows only, so every
    label is learned."""
    bounded_batches(df.sparkSession)
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(~held_out("id") & F.col("label").isNotNull())
    sizes = labelled.groupBy("label").count().limit(rows + 1).collect()
    if not sizes:
        return Model([], np.zeros((0, 0), np.float32), {}, {})
    if len(sizes) > rows:
        raise ValueError(f"more than {rows} labels: learn from more rows")
    each = max(1, rows // len(sizes))
    place = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*itertools.chain(*((F.lit(r["label"]), F.lit(min(1.0, each / r["count"]))) for r in sizes))), F.col("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, n in zip(*(c.to_pylist() for c in b.columns)):
                x = features(t)
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i], b.schema.field(0).type), pa.array([n]), pa.array([x.astype(np.float16).tobytes()])], names=["id", "label", "x"])

    kind = labelled.schema["id"].dataType.simpleString()
    # more than are wanted, so that no label comes out empty by chance; of those each label's first by the hash
    drawn = labelled.filter(place < 4 * share).select("id", "text", "label", place.alias("place")).distinct()
    first = F.row_number().over(Window.partitionBy("label").orderBy("place", "id", "text"))
    drawn = drawn.withColumn("_nth", first).filter(F.col("_nth") <= each)
    sample = drawn.select("id", "text", "label").mapInArrow(run, f"id {kind}, label string, x binary").collect()
    sample.sort(key=lambda r: (r["id"] is None, r["id"], r["label"], r["x"]))
    if not sample:
        return Model([], np.zeros((0, 0), np.float32), {}, {})
    x = np.empty((len(sample), len(sample[0]["x"]) // 2), np.float32)
    for i, r in enumerate(sample):
        x[i] = np.frombuffer(r["x"], np.float16)
    return fit(x, [r["label"] for r in sample])


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score added; a column of df so named is replaced. Only the text is read by the model."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    rest = df.select(*[c for c in df.columns if c not in ("lang_pred", "score")])
    schema = rest.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    at, arrow = rest.columns.index(text_col), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(features(t.as_py())) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=arrow.names)

    return rest.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of df: id_col, held_out, lang_pred, score.

    Null texts and those without a letter are `und` with a score of 0, as are all where no labelled row can be learned
    from. Null labels are not learned from but predicted; repeated rows get equal results; an empty table gives an empty
    one. Other columns are not read.
    """
    model = train(df, id_col, text_col, label_col, rows)
    docs = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(docs, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
