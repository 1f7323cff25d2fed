"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Content: hashed word counts and character shares of the whole text. Metadata: language, source, length and line layout.
Each view has a logistic regression. In every round both are trained on their labelled rows, calibrated, and judge a pool of
unlabelled documents. For each class a view hands its most confident documents to the other view: those whose calibrated odds
are `lift` times the class's own odds or more, each with its calibrated probability as label, so that a weak view
teaches both classes without claiming to be sure. After the last round each view is calibrated (Platt) on labelled rows kept out of the training; the calibrated log odds, less the prior that both
hold, are added up, calibrated once more, and score all documents over their whole texts.

The fit is bounded: `most_labelled` labelled and `most_pool` unlabelled documents, drawn by a hash of doc_id over
all of them; scoring covers every document.

Defined cases: null text counts as empty, null metadata as a value of its own; labels that are null or of unknown documents are
not used, repeated labels of a document count by their mean (ties are good); without labels of both classes every document gets
the share of good ones (0.5 without any) and stays; extra columns are kept in `doc`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import map_documents, table
from syncproof.llm.fingerprint import WordHashes

WORD_BUCKETS, META_BUCKETS = 2048, 96
META = ["lang", "source", "n_chars"]


def content_features(texts: list[bytes], known: WordHashes) -> np.ndarray:
    """(texts, WORD_BUCKETS + 10)."""
    out = np.zeros((len(texts), WORD_BUCKETS + 10), np.float32)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if words:
            ids = np.fromiter(map(known.__getitem__, words), np.uint32, len(words)) % WORD_BUCKETS
            counts = np.log1p(np.bincount(ids, minlength=WORD_BUCKETS)).astype(np.float32)
            out[i, :WORD_BUCKETS] = counts / np.linalg.norm(counts)
        at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n = max(1, len(text))
        alpha_up, alpha_low, digits, high = at[65:91].sum(), at[97:123].sum(), at[48:58].sum(), at[128:].sum()
        marks = at[33:127].sum() - alpha_up - alpha_low - digits
        out[i, WORD_BUCKETS:] = [alpha_up / n, alpha_low / n, digits / n, high / n, marks / n, (at[46] + at[44]) / n, (at[33] + at[63]) / n, at[124] / n, len(set(words)) / max(1, len(words)), min(len(words) and n / len(words), 40) / 40]
    out[:, WORD_BUCKETS:] *= 3
    return out


def metadata_features(rows: list[dict], texts: list[bytes]) -> np.ndarray:
    """(rows, META_BUCKETS): one-hot language, source and length, and line layout."""
    out = np.zeros((len(rows), META_BUCKETS), np.float32)
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        out[i, xxhash.xxh32_intdigest(str(row.get("lang"))) % 16] = 1
        out[i, 16 + xxhash.xxh32_intdigest(str(row.get("source"))) % 48] = 1
        out[i, 64 + min(19, int(math.log2(max(row.get("n_chars") or 0, 0) + 1)))] = 1
        lines = text.count(b"\n") + 1
        out[i, 84 + min(9, int(math.log2(max(1, len(text) / lines))))] = 1
        out[i, 94], out[i, 95] = math.log1p(lines) / 5, float(row.get("n_chars") is None)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 250, rate: float = 0.3) -> np.ndarray:
    """Weights, the last of them the bias."""
    w, m, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        d = ((sigmoid(x @ w[:-1] + w[-1]) - y) * weight).astype(np.float32)
        g = np.append(d @ x + l2 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by Newton steps, with Platt's smoothed targets; the slope is not negative."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w * [1, 0])
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    calibration: list[tuple[float, float]]  # content, metadata, both
    prior: float  # log odds
    constant: float | None = None
    handed: dict | None = None  # (teaching view, class) -> documents handed over in all rounds

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        """Calibrated probabilities: content, metadata, both."""
        if self.constant is not None:
            return [np.full(len(content), self.constant)] * 3
        logits = [s * (x @ w[:-1] + w[-1]) + o for x, w, (s, o) in zip((content, metadata), (self.content, self.metadata), self.calibration, strict=False)]
        s, o = self.calibration[2]
        return [sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(s * (logits[0] + logits[1] - self.prior) + o)]


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], calibrating: np.ndarray, rounds: int = 4, lift: float = 2.0, share: float = 0.1) -> Model:
    """x, pool: (content, metadata) features. calibrating: the labelled rows that only calibrate."""
    if y.min(initial=1) == y.max(initial=0) or len(set(y[~calibrating])) < 2 or len(set(y[calibrating])) < 2:
        return Model(np.zeros(0), np.zeros(0), [], 0.0, float(y.mean()) if len(y) else 0.5)
    train = [(view[~calibrating], y[~calibrating], np.ones((~calibrating).sum())) for view in x]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]  # what a view may still be taught
    rate = float(y[~calibrating].mean())
    yc = y[calibrating]
    prior = math.log((yc.sum() + 1) / (len(yc) - yc.sum() + 1))
    handed = {(teacher, label): 0 for teacher in (0, 1) for label in (0, 1)}
    models = [logistic(*t) for t in train]
    for _ in range(rounds if len(pool[0]) else 0):
        for (teacher, label), taken, target in confident(x, yc, pool, calibrating, models, free, prior, rate, math.log(lift), share):
            pupil = 1 - teacher
            free[pupil][taken] = False
            handed[teacher, label] += len(taken)
            a, b, c = train[pupil]
            train[pupil] = (np.concatenate([a, pool[pupil][taken]]), np.append(b, target), np.append(c, np.full(len(taken), 0.3)))
        models = [logistic(*t) for t in train]
    raw = [view[calibrating] @ w[:-1] + w[-1] for view, w in zip(x, models, strict=True)]
    each = [platt(r, yc) for r in raw]
    both = sum(s * r + o for r, (s, o) in zip(raw, each, strict=True)) - prior
    return Model(models[0], models[1], [*each, platt(both, yc)], prior, handed=handed)


def confident(x, yc, pool, calibrating, models, free, prior, rate, least, share):
    """Yields ((teacher, class), rows of the pool, calibrated probabilities): what each view hands to the other in a round."""
    for teacher, (view, rest, w) in enumerate(zip(x, pool, models, strict=True)):
        s, o = platt(view[calibrating] @ w[:-1] + w[-1], yc)
        logit = s * (rest @ w[:-1] + w[-1]) + o
        for label, gain, part in ((1, logit - prior, rate), (0, prior - logit, 1 - rate)):
            most = max(1, int(share * part * len(logit)))
            order = np.argsort(-gain, kind="stable")
            taken = order[free[1 - teacher][order] & (gain[order] >= least)][:most]
            if len(taken):
                yield (teacher, label), taken, sigmoid(logit[taken])


def _texts_and_rows(docs: pa.StructArray) -> list[dict]:
    fields = {f.name: docs.field(f.name).to_pylist() for f in docs.type if f.name in META}
    return [dict(zip(fields, v, strict=True)) for v in zip(*fields.values(), strict=True)] if fields else [{}] * len(docs)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, most_pool: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **settings) -> Model:
    judged = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    ids = docs.filter(F.col(doc_id).isNotNull()).select(doc_id)
    n_labelled, n_all = judged.count(), ids.count()
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    slim = docs.select(doc_id, text, *[c for c in META if c in docs.columns])
    # drawn by a hash of the id, each id once, so that no repeated row and no order of partitions has a say
    rows = slim.join(F.broadcast(judged.filter(draw < most_labelled / max(n_labelled, 1)).limit(2 * most_labelled)), doc_id).dropDuplicates([doc_id])
    others = slim.filter(draw < most_pool / max(n_all - n_labelled, 1)).join(judged, doc_id, "left_anti").dropDuplicates([doc_id])
    drawn = [_features(d, text) for d in (rows, others)]
    (x, y, key), (pool, _, _) = (_collected(d, doc_id) for d in drawn)
    calibrating = np.array([xxhash.xxh32_intdigest(str(k)) % 4 == 0 for k in key], bool)
    return co_train(x, y, pool, calibrating, **settings)


def _features(docs: DataFrame, text: str) -> DataFrame:
    def make():
        known = WordHashes()

        def run(texts, rows):
            plain = [t or b"" for t in texts]
            return [[f.tobytes() for f in content_features(plain, known).astype(np.float16)], [f.tobytes() for f in metadata_features(_texts_and_rows(rows), plain).astype(np.float16)]]

        return run

    return map_documents(docs, make, [T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())], text, rows=True)


def _collected(found: DataFrame, doc_id: str):
    has_label = "_y" in found.schema["doc"].dataType.names
    got = sorted(found.select(F.col(f"doc.{doc_id}").cast("string").alias("k"), (F.col("doc._y") if has_label else F.lit(0)).alias("y"), "content", "metadata").toLocalIterator(), key=lambda r: (r.k is None, r.k or ""))
    shape = lambda name, width: np.frombuffer(b"".join(bytes(r[name]) for r in got), np.float16).reshape(-1, width).astype(np.float32)
    return (shape("content", WORD_BUCKETS + 10), shape("metadata", META_BUCKETS)), np.array([r.y for r in got], int), [r.k for r in got]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc struct, content_score, metadata_score, score): calibrated probabilities of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = WordHashes()

        def run(texts, rows):
            plain = [t or b"" for t in texts]
            return [s.tolist() for s in shared.value.scores(content_features(plain, known), metadata_features(_texts_and_rows(rows), plain))]

        return run

    return map_documents(docs, make, [T.StructField(n, T.DoubleType()) for n in ("content_score", "metadata_score", "score")], text, rows=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc.doc_id", "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("keep"))
