"""Quality classifier by co-training.

Two classifiers look at different views of a document: its text content (byte pairs, repeated words)
and its page metadata (language, source, length and layout figures). Both start from the labelled
rows. In every round each scores all unlabelled documents and names those it is surest of, and these pseudo-labels
train the *other* one. Labelled rows held back from training then calibrate each view (Platt scaling) and the
weights with which the two calibrated views are combined; every document is scored by the result.

Fitting uses a bounded sample of labelled rows, chosen by hash (at most ``max_labelled``), and ``surest`` new
pseudo-labels a view and round; these are the surest of the whole corpus, whose views are staged once and scored every
round without an exchange. Models are fitted in one task of that bounded size; scoring is one more pass over all documents.

Defined cases: a null text is empty; a null language or source is a value of its own; labels other
than 0 and 1 and ids with both labels are left out; repeated rows get equal scores; with no labels, or
labels of one kind only, nothing can be learned: scores are null and all rows are kept; an empty table
gives no rows; other columns are ignored, or carried by ``filter_quality``.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PAIRS = 256
HASHED = 32
MAX_LABELLED = 8_000
SUREST = 400
#: Bytes whose pairs are counted at a time: bounds a task's memory for very long texts.
CHUNK = 1 << 20
_UPPER, _DIGIT, _MARK, _BREAK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")] = True
_BREAK[10] = True


def text_view(text: bytes) -> np.ndarray:
    """Root frequencies of hashed byte pairs, share of words equal to the word before, share of distinct words."""
    pairs = np.zeros(PAIRS)
    for at in range(0, len(text) - 1, CHUNK):
        b = np.frombuffer(text[at : at + CHUNK + 1], np.uint8).astype(np.uint32)
        pairs += np.bincount((((b[:-1] << 8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(24), minlength=PAIRS)
    words = text.split()
    n = max(1, len(words))
    again = sum(map(operator.eq, words, words[1:])) / n
    return np.concatenate((np.sqrt(pairs / max(1.0, pairs.sum())), [np.sqrt(again), len(set(words)) / n, float(len(words) > 0)]))


def metadata_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source (hashed), length, and layout: lines, line and word length, shares of kinds of characters."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, lines = max(1, len(text)), int(counts[_BREAK].sum()) + 1
    spaces = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    named = np.zeros(2 * HASHED)
    named[zlib.crc32((lang or "(none)").encode()) % HASHED] = 1
    named[HASHED + zlib.crc32((source or "(none)").encode()) % HASHED] = 1
    shares = [np.sqrt(counts[kind].sum() / size) for kind in (_UPPER, _DIGIT, _MARK)]
    return np.concatenate((named, [np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), np.log1p(len(text) / (spaces + 1)), *shares]))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, np.inf)
        z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    share: float  # of the text view in the combination
    exchanged: int  # pseudo-labels given in all rounds

    def scores(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, combined."""
        t = self.text_scale.logit(self.text.logit(text_x)[:, None])
        m = self.meta_scale.logit(self.meta.logit(meta_x)[:, None])
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.both.logit(combined(t, m, self.share)[:, None]))

    def packed(self) -> bytes:
        """The model's numbers, one after the other."""
        parts = [self.text, self.meta, self.text_scale, self.meta_scale, self.both]
        return np.concatenate([v for p in parts for v in (p.mean, p.scale, p.weights)] + [[self.share, self.exchanged]]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> CoTrained:
        values, parts, at = np.frombuffer(raw), [], 0
        for width in (PAIRS + 3, 2 * HASHED + 7, 1, 1, 1):
            cut = np.cumsum([at, width, width, width + 1])
            parts.append(Logistic(*(values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))))
            at = int(cut[-1])
        return cls(*parts, float(values[at]), int(values[at + 1]))


def combined(t: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Weighted calibrated logits; their ends say little about certainty and are cut, so that no view outvotes the other by them alone."""
    return share * np.clip(t, -6, 6) + (1 - share) * np.clip(m, -6, 6)


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


Given = tuple[dict[str, int], dict[str, int]]  # pseudo-labels by id, for the text view and for the metadata view


def fit_views(ids: list[str], x: np.ndarray, label: np.ndarray, given: Given) -> CoTrained | None:
    """Both views' models from the labelled rows (``label`` 0 or 1) and what each was given, calibrated and combined on labelled rows held
    back by hash. None if the training or the calibration rows are of one class."""
    fold = np.array([zlib.crc32(i.encode()) % 4 == 0 for i in ids], bool)
    train, held = np.flatnonzero((label >= 0) & ~fold), np.flatnonzero((label >= 0) & fold)
    if len(set(label[train])) < 2 or len(set(label[held])) < 2:
        return None
    place = {i: k for k, i in enumerate(ids)}
    views = x[:, : PAIRS + 3], x[:, PAIRS + 3 :]
    models = []
    for view, extra in zip(views, given, strict=True):
        more = sorted((place[i], v) for i, v in extra.items() if i in place)
        rows = np.concatenate((train, np.array([k for k, _ in more], np.int64)))
        models.append(Logistic.fit(view[rows], np.concatenate((label[train], np.array([v for _, v in more], np.int64))).astype(float)))
    y = label[held].astype(float)
    scale = [Logistic.fit(m.logit(v[held])[:, None], y, 0.1) for m, v in zip(models, views, strict=True)]
    logits = [s.logit(m.logit(v[held])[:, None]) for s, m, v in zip(scale, models, views, strict=True)]
    fits = []
    for share in np.linspace(0, 1, 21):  # the weights that explain the held-back labels best
        mixed = combined(*logits, share)[:, None]
        both = Logistic.fit(mixed, y, 0.1)
        fits.append((_loss(both.logit(mixed), y), -share, both))
    _, share, both = min(fits, key=lambda f: f[:2])
    return CoTrained(*models, *scale, both, -share, sum(map(len, given)))


def surest_rows(views: DataFrame, model: CoTrained, given: Given, quota: dict[int, int], sure: float) -> list[tuple[int, int, str]]:
    """(view that names it, label, id) of the unlabelled rows that a view is surest of: at most ``quota`` of a label, of those it
    gives ``sure`` or more and has not named before. A task passes on its best rows only, and the best of all are taken."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)
            for mine, (fitted, part) in enumerate(((model.text, x[:, : PAIRS + 3]), (model.meta, x[:, PAIRS + 3 :]))):
                p = _sigmoid(fitted.logit(part))
                fresh = ~pc.is_in(batch.column("id"), value_set=pa.array(list(given[1 - mine]), pa.string())).to_numpy(zero_copy_only=False)
                for value, certain in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(fresh & (certain >= sure))
                    at = at[np.argsort(-certain[at], kind="stable")[: 2 * quota[value]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), mine, np.int32)), pa.array(np.full(len(at), value, np.int32)), batch.column("id").take(pa.array(at)), pa.array(certain[at])], ["view", "value", "id", "certain"])

    named = common.staged(views.where("y IS NULL").select("id", "x").mapInArrow(best, "view int, value int, id string, certain double"), "named")
    out = []
    for mine in (0, 1):
        for value, most in quota.items():
            rows = named.where((F.col("view") == mine) & (F.col("value") == value)).groupBy("id").agg(F.max("certain").alias("certain"))
            out += [(mine, value, r["id"]) for r in rows.orderBy(F.col("certain").desc(), "id").limit(most).collect()]  # a quota
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch with ``text``, ``lang`` and ``source``."""
    rows = list(zip(batch.column("__text"), batch.column("__lang").to_pylist(), batch.column("__source").to_pylist(), strict=True))
    text = np.array([text_view(t.as_py()) for t, _, _ in rows]).reshape(len(rows), PAIRS + 3)
    meta = np.array([metadata_view(t.as_py(), lang, source) for t, lang, source in rows]).reshape(len(rows), 2 * HASHED + 7)
    return text, meta


def _inputs(text_col: str, lang_col: str, source_col: str) -> list:
    return [common.text_bytes(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source")]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, surest: int = SUREST, rounds: int = 5, sure: float = 0.95, seed: int = 11,
) -> CoTrained | None:
    """Co-train over all of ``docs``; None if there is nothing to learn from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    agreed = known.agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__top")).where("__y = __top").select("__id", "__y")
    chosen = agreed.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_labelled)
    slim = docs.select(F.col(id_col).alias("__id"), *_inputs(text_col, lang_col, source_col)).where("__id IS NOT NULL")
    rows = slim.join(F.broadcast(chosen), "__id", "left")  # max_labelled rows of 12 bytes

    def views(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, meta = _views(batch)
        packed = [v.astype(np.float32).tobytes() for v in np.hstack((text, meta))]
        yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("__y").cast(pa.int32()), pa.array(packed, pa.binary())], ["id", "y", "x"])

    staged, path = common.staged_at(common.arrow_map(rows, views, "id string, y int, x binary"), "views")
    given: Given = ({}, {})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.string()), ("y", pa.int32()), ("x", pa.binary())])).sort_by("id")
        if not table.num_rows:
            return
        x = np.array([np.frombuffer(v.as_py(), np.float32) for v in table["x"]], np.float64)
        label = np.array([-1 if v is None else v for v in table["y"].to_pylist()])
        model = fit_views(table["id"].to_pylist(), x, label, given)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary()), pa.array([float(label[label >= 0].mean())])], ["model", "good"])

    model = None
    for turn in range(rounds + 1):
        used = docs.sparkSession.createDataFrame([(i,) for i in sorted({*given[0], *given[1]})], "id string")
        taking_part = staged.where("y IS NOT NULL").union(staged.where("y IS NULL").join(F.broadcast(used), "id", "left_semi"))
        one = taking_part.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x"))  # one row for each id, whatever their number
        # max_labelled rows and 2 * surest a round: fitted in one task
        made = one.repartition(1).mapInArrow(fit, "model binary, good double").collect()
        if not made:
            break
        model = CoTrained.unpacked(bytes(made[0]["model"]))
        if turn == rounds:
            break
        quota = {1: max(1, round(surest * made[0]["good"])), 0: max(1, round(surest * (1 - made[0]["good"])))}
        named = surest_rows(staged, model, given, quota, sure)
        for mine, value, ident in named:
            given[1 - mine][ident] = value
        if not named:
            break
    common.remove(docs.sparkSession, path)
    return model


def _scored(rows: DataFrame, model: CoTrained | None, threshold: float) -> DataFrame:
    """``rows`` (with the view columns) plus p_text, p_meta, score and kept."""
    names = ["__p_text", "__p_meta", "__score", "__kept"]
    carried = [c for c in rows.columns if c not in ("__text", "__lang", "__source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                added = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n, pa.bool_())]
            else:
                t, m, both = model.scores(*_views(batch))
                added = [pa.array(t), pa.array(m), pa.array(both), pa.array(both >= threshold)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *added], [*carried, *names])

    schema = rows.select(*[F.col(f"`{c}`") for c in carried]).schema
    for name in names[:3]:
        schema = schema.add(name, "double")
    return rows.mapInArrow(run, schema.add(names[3], "boolean"))


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Per row: id, ``p_text``, ``p_meta``, ``score`` and ``kept``."""
    out = _scored(docs.select(F.col(id_col).alias("__id"), *_inputs(text_col, lang_col, source_col)), model, threshold)
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__{c}").alias(c) for c in ("p_text", "p_meta", "score", "kept")])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Train and score: id, ``p_text``, ``p_meta``, ``score``, ``kept``."""
    return score(docs, train(docs, labels, **options), threshold=threshold, **{k: v for k, v in options.items() if k in ("id_col", "text_col", "lang_col", "source_col")})


def filter_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    model = train(docs, labels, text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_inputs(text_col, lang_col, source_col))
    return _scored(rows, model, threshold).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
