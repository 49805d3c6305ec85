"""Language identification in two levels: the family first, then, inside it,
linear support vector machines between each two of its languages.

Features are hashed byte trigrams of the lower-cased text with runs of other
bytes than letters as spaces: square roots of the counts, scaled to length 1.
Both levels use the same machines (squared hinge loss, dual coordinate
descent); the family level sets one family against another.  A level's winner
has the most won duels, then the largest sum of margins.

Training rows are labelled documents with letters outside the held-out quarter.  The fit
takes documents of every labelled language, those with the smallest hash of
their id: at most ``SAMPLE_PER_LANG`` of each, and an equal share of
``SAMPLE_ROWS`` for all together, but one of each at least; it takes their
whole texts.  So the rows that reach the driver are bounded by these
parameters, or the number of languages, whatever the size of the corpus;
everything is predicted for all documents.  The machines are fitted on the
driver, in time and number as the square of the languages (families, and
languages of one family).

Cases: a null text or one without letters is ``und`` with score 0; so is every
text if there is no training row (``drop_unknown`` then keeps the texts with
letters); with one language that one is predicted; a
row without id is neither held out nor trained on; texts of any length count
whole; repeated rows each get their row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, TextBlock, byte_table, fresh, map_text, text_blocks

SAMPLE_PER_LANG = 250
SAMPLE_ROWS = 6000
BUCKETS = 4096
HELD_OUT = 2
UNKNOWN = "und"

FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "finnic": "et fi",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "turkic": "az kk ky tr tt uz",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A))
_PART = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def features(block: TextBlock) -> np.ndarray:
    """One row of trigram features for each text of the block."""
    n, size = len(block), np.diff(block.offsets)
    data = np.where(_PART[block.data], LOWER[block.data], 32).astype(np.uint8)
    wide = np.zeros(len(data), bool)  # capital letters of the Latin-1 range, as two bytes
    wide[1:] = (block.data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[wide] += 32
    doc = np.repeat(np.arange(n), size)
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint32)
    padded[np.arange(len(data)) + 2 * doc + 2] = data
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    real = ~((b == 32) & ((a == 32) | (c == 32)))
    # a trigram belongs to the text in which its middle lies, or else its end
    owner = np.repeat(np.arange(n), size + 2)[:len(b) - 1]
    owner = np.append(owner, n - 1) if n else owner
    code = ((a << 16) | (b << 8) | c) * np.uint32(2654435761)
    bucket = (code >> np.uint32(20)).astype(np.int64)
    counts = np.bincount(owner[real] * BUCKETS + bucket[real], minlength=n * BUCKETS)[:n * BUCKETS].reshape(n, BUCKETS)
    rows = np.sqrt(counts, dtype=np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def has_letters(block: TextBlock) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTERS[block.data])])[block.offsets]
    found = np.diff(ascii_letters) > 0
    rest = np.flatnonzero(~found & (np.diff(block.offsets) > 0))
    for k in rest.tolist():
        raw = block.data[block.offsets[k]:block.offsets[k + 1]].tobytes()
        found[k] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return found


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    square = (x * x).sum(1) + 0.5 / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


@dataclass
class Level:
    """Duels between ``names``: weights of each pair, in order."""

    names: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Level:
        kinds = sorted(set(names.tolist()))
        rows = []
        for a, b in combinations(kinds, 2):
            of = (names == a) | (names == b)
            rows.append(fit_machine(x[of], np.where(names[of] == a, 1.0, -1.0)))
        return cls(kinds, np.array(rows, np.float32).reshape(len(rows), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the winner, its mean confidence over its duels)."""
        k = len(self.names)
        won, margin, sure = (np.zeros((len(x), k)) for _ in range(3))
        duels = x @ self.weights[:, :-1].T + self.weights[:, -1]
        for d, (a, b) in enumerate(combinations(range(k), 2)):
            m = duels[:, d].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
            won[:, a] += m >= 0
            won[:, b] += m < 0
            margin[:, a] += m
            margin[:, b] -= m
            sure[:, a] += p
            sure[:, b] += 1 - p
        best = np.argmax(won + 1e-3 * np.tanh(margin), axis=1) if k > 1 else np.zeros(len(x), np.int64)
        return best, (sure[np.arange(len(x)), best] / max(1, k - 1)) if k > 1 else np.ones(len(x))


@dataclass
class Model:
    families: Level
    languages: list[Level]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> Model | None:
        if not len(x):
            return None
        family = np.array([FAMILY.get(lang, lang) for lang in langs])
        top = Level.fit(x, family)
        return cls(top, [Level.fit(x[family == f], langs[family == f]) for f in top.names])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, sure = self.families.predict(x)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for f, level in enumerate(self.languages):
            of = np.flatnonzero(top == f)
            if len(of):
                best, p = level.predict(x[of])
                names[of] = [level.names[k] for k in best]
                score[of] = sure[of] * p
        return names.tolist(), np.clip(score, 0.0, 1.0)


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4))


def fit_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              sample_per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the labelled rows of ``df`` that are not held out."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                     F.col(f"`{text_col}`").cast("string").alias("text"),
                     _remainder(id_col).alias("part")).where((F.col("part") != HELD_OUT) & F.col("lang").isNotNull()
                                                             & F.col("text").rlike(r"\p{L}"))  # as has_letters
    langs = rows.agg(F.countDistinct("lang").alias("langs"))
    share = F.greatest(F.lit(1), F.least(F.lit(sample_per_lang), F.floor(F.lit(sample_rows) / F.col("langs"))))
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (rows.select("id", "lang", F.xxhash64("id").alias("h"))
              .distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_per_lang)
              .crossJoin(F.broadcast(langs)).where(F.col("n") <= share).select("id", "lang"))
    # at most sample_rows rows, or one a language, so small enough to broadcast
    sample = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "lang", "text")

    def run(batches):
        for batch in batches:
            for lo, hi, block in text_blocks(batch.column(2)):
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                                   pa.array([r.tobytes() for r in features(block)], pa.binary())],
                                                  names=["id", "lang", "x"])
                yield rows.filter(pa.array(has_letters(block)))

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, lang string, x binary").dropDuplicates(["id", "lang"]).orderBy("lang", "id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(len(got), BUCKETS)
    return Model.fit(x, np.array([r["lang"] for r in got], object))


def identify(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred and score of every row."""
    def make():
        def work(block: TextBlock) -> list[pa.Array]:
            letters = has_letters(block)
            if model is None:
                names, score = [UNKNOWN] * len(block), np.zeros(len(block))
            else:
                names, score = model.predict(features(block))
                names = [n if ok else UNKNOWN for n, ok in zip(names, letters.tolist())]
                score = np.where(letters, score, 0.0)
            return [pa.array(names, pa.string()), pa.array(score, pa.float64())]
        return work

    return map_text(df, text_col, keep or ["doc_id"], [("lang_pred", "string"), ("score", "double")], make)


def predict_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the id, held_out, lang_pred and score; fitted on ``df``."""
    found = identify(df, fit_model(df, id_col, text_col, lang_col), text_col, [id_col])
    pred, score = found.columns[1:]
    return found.select(F.col(f"`{id_col}`"), F.coalesce(_remainder(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
                        F.col(pred).alias("lang_pred"), F.col(score).alias("score"))


def drop_unknown(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without the rows whose text has no language (``und``); without
    a model, those whose text has no letter."""
    names = df.columns
    mark = fresh("lang_pred", names)
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(mark))
    model = fit_model(df, id_col, text_col, lang_col)
    if model is None:
        found = map_text(source, mark, names, [("letters", "boolean")], lambda: lambda block: [pa.array(has_letters(block))])
        known = F.col(f"`{found.columns[len(names)]}`")
    else:
        found = identify(source, model, mark, names)
        known = F.col(f"`{found.columns[len(names)]}`") != UNKNOWN
    return found.where(known).select(*[F.col(f"`{c}`") for c in names])
