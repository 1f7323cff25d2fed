"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Every byte position gets a label distribution from a forward and a backward GRU that read the bytes around it; a document's
probability of a language is the mean over all positions of its whole text. Texts are read in windows of `window` bytes,
in which the recurrent state starts anew, so that any length is worked in bounded memory and all windows of
many documents advance together, one byte at a time, as one matrix.

Training is backpropagation through time over such windows with Adam, on the driver, over a bounded sample: of each
language at most `per_language` different documents (those of the smallest hash of id and text, one at least) and of each of these
`train_windows` windows spread over the whole text. Spark cuts the windows, so that no more than they come to the driver: 46 MB
at the default bounds, whatever the documents are. Nothing but text is ever an input of a prediction.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language first in order; with
no training rows at all every document is `und`. Repeated rows are judged alike and learned from once; a null id is not held out,
and documents of one id or of none are drawn one by one, by their texts. Texts of any length are read whole by predictions, in
windows, and learned from by windows spread over them. Extra columns are kept in `doc`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import cut, map_documents, table
from syncproof.llm.linking import bounded

WINDOW = 96
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


@dataclass
class Network:
    """Weights of both directions (index 0 forward, 1 backward) and of the output layer. Arrays are (features, windows)."""

    languages: list[str]
    inputs: list[np.ndarray]  # (256, 3H): what a byte adds to update gate, reset gate and candidate
    recurrent: list[np.ndarray]  # (3H, H)
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L, 1)

    @staticmethod
    def fresh(languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            languages,
            [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [draw(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)],
            draw(len(languages), 2 * hidden, scale=0.3),
            np.zeros((len(languages), 1), np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]

    def read(self, codes: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States (T, H, N) after each byte of codes (T, N) in one direction, in the order of positions."""
        steps, n = codes.shape
        size = self.recurrent[way].shape[1]
        gates, candidate = self.recurrent[way][: 2 * size], self.recurrent[way][2 * size :]
        table = np.ascontiguousarray(self.inputs[way].T)
        h, out = np.zeros((size, n), np.float32), np.empty((steps, size, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = table.take(codes[t], axis=1)
            zr = sigmoid(x[: 2 * size] + gates @ h)
            z, r = zr[:size], zr[size:]
            c = np.tanh(x[2 * size :] + candidate @ (r * h))
            new = h + z * (c - h)
            if keep is not None:
                keep.append((t, z, r, c, h))
            out[t] = h = new
        return out

    def position_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(T, L, N): the label distribution at every position."""
        half = self.out.shape[1] // 2
        logits = np.matmul(self.out[:, :half], self.read(codes, 0)) + np.matmul(self.out[:, half:], self.read(codes, 1)) + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        steps, n = codes.shape
        size = self.recurrent[0].shape[1]
        kept: list[list] = [[], []]
        states = [self.read(codes, way, kept[way]) for way in (0, 1)]
        both = np.concatenate(states, axis=1)
        logits = np.matmul(self.out, both) + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(np.maximum(p[:, label, np.arange(n)], 1e-9)).mean())
        d = p
        d[:, label, np.arange(n)] -= 1
        d /= steps * n
        d_out = np.einsum("tln,thn->lh", d, both, optimize=True)
        d_states = np.matmul(self.out.T, d)
        d_in, d_rec = [], []
        for way in (0, 1):
            u = self.recurrent[way]
            gi, gr, dh = np.zeros_like(self.inputs[way]), np.zeros_like(u), np.zeros((size, n), np.float32)
            for t, z, r, c, h in reversed(kept[way]):
                dh = dh + d_states[t, way * size : (way + 1) * size]
                dc = dh * z * (1 - c * c)
                drh = u[2 * size :].T @ dc
                dz = dh * (c - h) * z * (1 - z)
                dr = drh * h * r * (1 - r)
                dx = np.concatenate([dz, dr, dc])
                gr[: 2 * size] += dx[: 2 * size] @ h.T
                gr[2 * size :] += dc @ (r * h).T
                np.add.at(gi, codes[t], dx.T)
                dh = dh * (1 - z) + drh * r + u[: 2 * size].T @ dx[: 2 * size]
            d_in.append(gi)
            d_rec.append(gr)
        return [*d_in, *d_rec, d_out.astype(np.float32), d.sum(axis=(0, 2))[:, None].astype(np.float32)], loss


def windows(text: bytes, width: int) -> np.ndarray:
    """(windows, width): the whole text, the last window filled up with spaces."""
    n = max(1, -(-len(text) // width))
    return np.frombuffer(text + b" " * (n * width - len(text)), np.uint8).reshape(n, width)


def train(samples: list[tuple[str, list[bytes]]], hidden: int = 8, width: int = WINDOW, steps: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network fitted to (language, windows of one document); short windows are filled up with spaces."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    label = np.array([languages.index(lang) for lang, ws in samples for _ in ws])
    codes = np.array([np.frombuffer(bytes(w).ljust(width), np.uint8) for _, ws in samples for w in ws])
    net, rng = Network.fresh(languages, hidden, seed), np.random.default_rng(seed)
    by_language = [np.flatnonzero(label == k) for k in range(len(languages))]
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, max(1, batch // len(languages))) for i in by_language])
        grads, _ = net.gradients(np.ascontiguousarray(codes[pick].T), label[pick])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        speed = rate * (1 - step / (steps + 1))
        for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            g = g * np.float32(min(1, 1 / max(norm, 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(speed) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode(errors="replace")))


def labeller(net: Network | None, width: int = WINDOW, block: int = 2048):
    """f(texts) -> [languages, scores]."""
    def run(texts: list[bytes | None]) -> list[list]:
        known = [bool(net and t and has_letter(t)) for t in texts]
        parts = [windows(t, width) for t, k in zip(texts, known, strict=True) if k]
        if not parts:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
        rows, counts = np.concatenate(parts), [len(w) for w in parts]
        lengths = np.array([len(t) for t, k in zip(texts, known, strict=True) if k])
        sums = np.empty((len(rows), len(net.languages)), np.float64)
        filled = np.full(len(rows), width)  # bytes of the text itself in each window
        last = np.cumsum(counts) - 1
        filled[last] = lengths - (np.array(counts) - 1) * width
        for i in range(0, len(rows), block):
            p = net.position_probabilities(np.ascontiguousarray(rows[i : i + block].T))
            if (filled[i : i + block] < width).any():
                p *= (np.arange(width)[:, None] < filled[i : i + block])[:, None, :]
            sums[i : i + block] = p.sum(axis=0, dtype=np.float64).T
        pooled = np.add.reduceat(sums, last - np.array(counts) + 1, axis=0) / lengths[:, None]
        best = pooled.argmax(axis=1)
        found = iter(zip(best.tolist(), np.clip(pooled[np.arange(len(best)), best], 0, 1).tolist(), strict=True))
        named, scores = [], []
        for ok in known:
            k, score = next(found) if ok else (None, 0.0)
            named.append(UNKNOWN if k is None else net.languages[k])
            scores.append(score)
        return [named, scores]

    return run


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, most_documents: int = 80_000, train_windows: int = 6, width: int = WINDOW) -> DataFrame:
    """(lang, draw, windows): of each language the documents of the smallest draws, a hash of id and text, and windows of their bytes.

    Only documents that are not held out and have a language, a text and a letter in it. Documents are first told apart and counted by draw alone;
    where one language's shares of most_documents are under one document, it still has one.
    """
    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(F.lit(7), F.col(doc_id).cast("string"), F.col(text)).alias("draw"), F.col(text).alias("text"))
    draws = cut(rows.select("lang", "draw").distinct())
    counts = cut(draws.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")))
    per_language = max(1, min(per_language, most_documents // max(1, counts.count())))
    # draws fall evenly on the longs: those under a share of their span are few more than wanted, and are ranked
    span = F.lit(-float(1 << 63)) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(1.2 * per_language + 20) / F.col("n"))
    near = draws.join(bounded(counts.withColumnRenamed("lang", "_lang"), most_documents), F.col("lang") == F.col("_lang")).filter((F.col("draw") <= span) | (F.col("draw") == F.col("least")))
    drawn = near.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("_at") <= per_language).select(F.col("lang").alias("_lang"), F.col("draw").alias("_draw"))
    chosen = rows.join(F.broadcast(drawn), (F.col("lang") == F.col("_lang")) & (F.col("draw") == F.col("_draw")))
    raw = F.encode("text", "UTF-8")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / width)).cast("long")
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(train_windows - 1)), lambda i: F.floor(i * (n - 1) / max(1, train_windows - 1)).cast("long")))
    cut_out = F.transform(at, lambda k: F.substr(raw, (k * width + 1).cast("int"), F.lit(width)))
    return chosen.select("lang", "draw", cut_out.alias("windows")).dropDuplicates(["lang", "draw"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, most_documents: int = 80_000, train_windows: int = 6, width: int = WINDOW, **settings) -> Network | None:
    """Trains on sample(). Every language is learned."""
    rows = sample(docs, doc_id, text, lang, per_language, most_documents, train_windows, width).collect()
    return train([(r.lang, r.windows) for r in sorted(rows, key=lambda r: (r.lang, r.draw))], width=width, **settings)


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """(doc struct, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return map_documents(docs, lambda: labeller(shared.value), [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    return predict(docs, fit(docs, doc_id, text, lang, **settings), text)


def keep_identified(docs: DataFrame, least_score: float = 0.4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs whose language is recognised with at least that score; the rest (no letters, mixed scripts) are rejected."""
    return identify(docs, doc_id, text, lang).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs)
    return predict(docs.select("doc_id", "text"), net).select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def crc_fold(doc_id) -> int:
    """held_out()'s remainder, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
