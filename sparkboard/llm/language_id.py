"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed one- to three-character n-grams of the lower-cased whole text,
with each run of anything but letters as one space. Inverse document frequencies count
all labelled training documents. The weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of every language: ``PER_LANGUAGE`` texts
of one at most, fewer where there are many languages. A sixth of the sample is held back;
short pieces of its texts set the temperature, for whole texts are told apart without
any doubt and would say nothing about how sure a score may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import free_name, give_back, released, small_batches, small_table

FEATURES = 1 << 16
PER_LANGUAGE, SAMPLE = 400, 80_000  # the sample's bounds: texts of a language, texts (one of each language at least)
PIECES = (6, 12, 24, 48, 96)  # characters of the pieces that set the temperature
UNKNOWN = "und"
_PIECE = 1 << 18  # characters of a long text that are hashed at once
_DRAWS = 1 << 30
_A, _B, _C, _D = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def _letters() -> np.ndarray:
    """The lower case of each letter, a space for all other code points; the last entry stands for all beyond."""
    table = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x33480)]
    return np.array([*table, 32], np.uint32)


_LETTERS = _letters()


def _decoded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and spaces of the texts raw[offsets[i]:offsets[i + 1]], and where each text begins among them."""
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    text = raw.tobytes().decode("utf-8", "replace")
    if len(text) != first[-1]:  # not UTF-8
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        first, text = np.concatenate([[0], np.cumsum([len(x) for x in parts])]), "".join(parts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _LETTERS[np.minimum(points, len(_LETTERS) - 1)], first


def _grams(p: np.ndarray, n: int) -> np.ndarray:
    """Feature numbers of the n-grams that begin at each place."""
    m = len(p) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = p[:m] * _A
    for k, odd in zip(range(1, n), (_B, _C), strict=False):
        h ^= p[k : m + k] * odd
    return (h * _D) >> np.uint32(16)


def _of_block(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    p, first = _decoded(raw, offsets)
    owner = np.repeat(np.arange(n, dtype=np.uint32), np.diff(first))
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    keep[first[:-1][first[:-1] < len(p)]] = True
    p, owner = p[keep], owner[keep]
    lettered = np.bincount(owner[p != 32], minlength=n) > 0
    keys = [(owner[: len(g)] << np.uint32(16) | g)[owner[: len(g)] == owner[k:]] for k in range(3) for g in [_grams(p, k + 1)] if len(g)]
    every, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint32), return_counts=True)
    some = lettered[every >> np.uint32(16)]
    every, counts = every[some], counts[some]
    return np.searchsorted(every >> np.uint32(16), np.arange(n + 1)), (every & np.uint32(0xFFFF)).astype(np.int64), counts


def _of_long(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long text, piece by piece; the last two characters of a piece go with the next one."""
    counts, held, lettered = np.zeros(FEATURES, np.int64), np.zeros(0, np.uint32), False
    text = raw.tobytes().decode("utf-8", "replace")
    for at in range(0, len(text), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        p = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
        before = np.concatenate([held[-1:] if len(held) else [np.uint32(0)], p[:-1]])
        p = p[(p != 32) | (before != 32)]
        lettered = lettered or bool((p != 32).any())
        both = np.concatenate([held, p])
        for n in (1, 2, 3):
            counts += np.bincount(_grams(both[max(0, len(held) - n + 1) :], n), minlength=FEATURES)
        held = both[-2:]
    some = np.flatnonzero(counts) if lettered else np.zeros(0, np.int64)
    return np.array([0, len(some)]), some, counts[some]


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bounds, features, counts) of blocks of texts: the features of text + k, ascending,
    lie between bounds[k] and bounds[k + 1]. A text without letters, null or empty has none."""
    data, offsets = wh.buffers(column)
    for i, j in wh.blocks(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > wh.SEGMENT:
            yield i, *_of_long(data[offsets[i] : offsets[j]])
            continue
        for a in range(i, j, 1 << 15):
            b = min(j, a + (1 << 15))
            yield a, *_of_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, bounds, at, _ in vectors(batch.column(0)):
            df += np.bincount(at, minlength=FEATURES)
            docs += int((np.diff(bounds) > 0).sum())
    step = FEATURES // 16
    yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int32()), pa.array([*(df[k * step : (k + 1) * step].tobytes() for k in range(16)), np.array([docs]).tobytes()], pa.binary())], names=["part", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _held_back(draw: float) -> bool:
    return int(draw * _DRAWS) % 6 == 5


def _pieces(text: str) -> list[str]:
    """Short stretches from all over a text."""
    return [text[at : at + n] for k, n in enumerate(PIECES) for at in [max(0, len(text) - n) * k // len(PIECES)]]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of the sample's texts, and of the pieces of those held back."""
    for batch in batches:
        texts, langs, draws = (batch.column(c) for c in ("text", "lang", "draw"))
        own = [(x, i, False) for i, x in enumerate(texts.to_pylist())]
        own += [(p, i, True) for x, i, _ in own if x and _held_back(draws[i].as_py()) for p in _pieces(x)]
        rows = [(i, piece, at[a:b].astype(np.uint16).tobytes(), n[a:b].astype(np.uint32).tobytes()) for k, bounds, at, n in vectors(pa.array([x for x, _, _ in own], pa.string())) for (_, i, piece), a, b in zip(own[k:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=False) if a < b]
        which, piece, at, n = zip(*rows, strict=True) if rows else ([],) * 4
        which = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([langs.take(which), draws.take(which), pa.array(piece, pa.bool_()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "draw", "piece", "at", "n"])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The features seen, and their weights (features, classes), after ``rounds`` of FTRL-proximal over sparse rows."""
    seen = np.unique(np.concatenate([at for at, _ in rows]))
    rows = [(np.searchsorted(seen, at), x) for at, x in rows]
    z, n = np.zeros((len(seen), classes)), np.zeros((len(seen), classes))
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i]
            z_, n_ = z[at], n[at]
            w = weights(z_, n_)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] = z_ + g - (np.sqrt(n_ + g * g) - np.sqrt(n_)) / alpha * w
            n[at] = n_ + g * g
    return seen, weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search."""

    def loss(ln_t: float) -> float:
        s = scores / np.exp(ln_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, inverse document frequencies, sparse weights and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, seen: np.ndarray, weights: np.ndarray, heat: float = 1.0) -> None:
        self.languages, self.idf, self.heat = languages, idf, heat
        row, self.language = np.nonzero(weights)
        self.value = weights[row, self.language].astype(np.float32)
        self.language = self.language.astype(np.int32)
        self.first = np.searchsorted(seen[row], np.arange(FEATURES + 1)) if len(row) else np.zeros(FEATURES + 1, np.int64)

    def scores(self, bounds: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts, languages) scores before the temperature: one sparse product for a block."""
        texts, classes = len(bounds) - 1, len(self.languages)
        text = np.repeat(np.arange(texts), np.diff(bounds))
        x = tfidf(text, at, n, self.idf, texts)
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(np.repeat(text, many) * classes + self.language[entry], np.repeat(x, many) * self.value[entry], texts * classes).reshape(texts, classes)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.predict_all(pa.array([text], pa.string()))[0].as_py()
        return found["lang_pred"], found["score"]

    def predict_all(self, column: pa.Array) -> pa.StructArray:
        best, sure = np.full(len(column), -1), np.zeros(len(column))
        for i, bounds, at, n in vectors(column):
            some = np.diff(bounds) > 0
            if self.languages and some.any():
                s = self.scores(bounds, at, n) / self.heat
                s -= s.max(axis=1, keepdims=True)
                p = np.exp(s)
                best[i : i + len(s)] = np.where(some, p.argmax(axis=1), -1)
                sure[i : i + len(s)] = np.where(some, p.max(axis=1) / p.sum(axis=1), 0.0)
        return pa.StructArray.from_arrays([pa.array([*self.languages, UNKNOWN], pa.string()).take(pa.array(best % (len(self.languages) + 1))), pa.array(sure)], ["lang_pred", "score"])


def tfidf(text: np.ndarray, at: np.ndarray, n: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """Logarithmic counts times inverse document frequencies, of length 1 for each text."""
    x = np.log1p(n) * idf[at]
    return x / np.sqrt(np.bincount(text, x * x, texts))[text]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from (text, lang, draw): draw is a number in [0, 1) that fixes the sample.

    Rows with a null lang or without letters teach nothing; without any other row
    the model knows no language and answers ``und`` always. Rows of one language with
    the same draw are one row of the sample, so repeated rows do not crowd it.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.where("lang is not null")
    counted = labelled.select("text").mapInArrow(released(_document_counts), "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()  # 17 rows of a fixed size
    parts = {x.part: np.frombuffer(x.counts, np.int64) for x in counted}
    docs = int(parts[16][0]) if 16 in parts else 0
    if not docs:
        return Model([], np.zeros(FEATURES), np.zeros(0, np.int64), np.zeros((0, 0)))
    idf = np.log((1 + docs) / (1 + np.concatenate([parts[k] for k in range(16)]))) + 1
    known = labelled.groupBy("lang").count().collect()
    per_language = min(per_language, max(1, SAMPLE // len(known)))
    share = small_table(spark, [(x.lang, min(1.0, 1.2 * per_language / x["count"])) for x in known], "lang string, share double")
    drawn = labelled.join(F.broadcast(share), "lang").where("draw < share").groupBy("lang", "draw").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # about as many rows as the sample has
    schema = "lang string, draw double, piece boolean, at binary, n binary"
    found = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang", "draw").mapInArrow(released(_sampled), schema).collect()
    if missed := sorted({x.lang for x in known} - {x.lang for x in found}):  # one text of each language that the draw passed over
        rest = labelled.join(F.broadcast(small_table(spark, [(x,) for x in missed], "lang string")), "lang").where(F.col("text").rlike(r"\p{L}"))
        found += rest.groupBy("lang").agg(F.min(F.struct("draw", "text")).alias("x")).select("x.text", "lang", "x.draw").mapInArrow(released(_sampled), schema).collect()
    found.sort(key=lambda x: (x.draw, x.lang, x.at))
    languages = sorted({x.lang for x in found})
    number = {x: k for k, x in enumerate(languages)}
    taught = {number[x.lang] for x in found if not x.piece and not _held_back(x.draw)}
    whole = [x for x in found if not x.piece and (not _held_back(x.draw) or number[x.lang] not in taught)]  # each language has a text to learn from
    vector = lambda x: (np.frombuffer(x.at, np.uint16).astype(np.int64), np.frombuffer(x.n, np.uint32))
    rows = [(at, tfidf(np.zeros(len(at), np.int64), at, n, idf, 1)) for at, n in map(vector, whole)]
    model = Model(languages, idf, *fit_ftrl(rows, np.array([number[x.lang] for x in whole]), len(languages)))
    if pieces := [x for x in found if x.piece]:
        ats, counts = zip(*map(vector, pieces), strict=True)
        scores = model.scores(np.concatenate([[0], np.cumsum([len(x) for x in ats])]), np.concatenate(ats), np.concatenate(counts))
        model.heat = temperature(scores, np.array([number[x.lang] for x in pieces]))
    return model


def predicted(text: Column, model: Model, documents: DataFrame) -> Column:
    """struct(lang_pred, score) for a column of whole texts; only that column goes to Python.

    A null, empty or letterless text is ``und`` with score 0. Score is the calibrated
    probability of the language named.
    """
    small_batches(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield known.value.predict_all(column)
        give_back()

    return predict(text.cast("string"))


def learnable(documents: DataFrame) -> DataFrame:
    """(text, lang, draw) of the documents whose crc32(doc_id as text) mod 4 is not 2."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return documents.where(F.coalesce(code % 4 != 2, F.lit(False))).select("text", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) / float(_DRAWS)).alias("draw"))


def identify(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learns from the rows that are
    not held out, and predicts from the whole text alone, however long.

    A null doc_id is neither held out nor learned from. Repeated rows come out as often;
    other columns play no part; an empty table gives an empty table.
    """
    model = train(learnable(documents))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = documents.select("doc_id", predicted(F.col("text"), model, documents).alias("p"))
    return found.select("doc_id", F.coalesce(code % 4 == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """``documents`` without those whose language is ``und`` or named with a score under ``least``.

    Null, empty and letterless texts go; so does every document where no row has a
    language to learn from. Repeated rows stay repeated, all columns stay as they are,
    whatever their names; an empty table gives an empty table.
    """
    model = train(learnable(documents))
    own = [F.col(f"`{c}`") for c in documents.columns]
    p = free_name(documents, "language")
    found = documents.select(*own, predicted(F.col("text"), model, documents).alias(p))
    return found.where((F.col(p)["lang_pred"] != UNKNOWN) & (F.col(p)["score"] >= least)).select(*own)
