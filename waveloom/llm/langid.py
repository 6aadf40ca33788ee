"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table
from .textbytes import blocks, text_bytes

HIDDEN = 8
WINDOW = 128           # bytes that the network reads at a time; every byte of a text is in exactly one window
BATCH = 4096           # windows that are read together
SAMPLE_DOCS = 250      # labelled documents of a language that the network learns from, at most
SAMPLE_WINDOWS = 8     # windows of each of them, spread over the whole text
TRAIN_WINDOW, TRAIN_BATCH, STEPS, RATE = 64, 256, 260, 0.03
SEED = 5
MIN_SCORE = 0.5        # the pipeline keeps documents with at least this pooled probability
UNKNOWN = "und"


class Network:
    """One gated recurrent layer in each direction; the sum of their outputs gives a distribution at every position.

    Parameters of direction d: x{d} (256, 3H) input part of update, reset and new state for each byte, u{d} (H, 3H) recurrent
    part, b{d} (H) bias inside the reset, o{d} (H, C) output; c (C) output bias.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng, self.langs, self.hidden, n = np.random.default_rng(seed), langs, hidden, len(langs)
        self.p = {"c": np.zeros(n, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(hidden, np.float32)
            self.p[f"o{d}"] = rng.normal(0, 0.3, (hidden, n)).astype(np.float32)

    def _forward(self, d: str, text: np.ndarray) -> list[tuple]:
        """States of one direction over text (time, batch), with what the gradient needs."""
        h, n = np.zeros((text.shape[1], self.hidden), np.float32), self.hidden
        out = [None] * len(text)
        for t in range(len(text)) if d == "f" else range(len(text) - 1, -1, -1):
            x, a = self.p[f"x{d}"][text[t]], h @ self.p[f"u{d}"]
            gates = 1 / (1 + np.exp(-(x[:, :2 * n] + a[:, :2 * n])))
            z, r, inner = gates[:, :n], gates[:, n:], a[:, 2 * n:] + self.p[f"b{d}"]
            new = np.tanh(x[:, 2 * n:] + r * inner)
            out[t] = (h, z, r, inner, new)
            h = new + z * (h - new)
            out[t] += (h,)
        return out

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions of text (time, batch), and its gradient by backpropagation through time."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        state = {d: self._forward(d, text) for d in "fb"}
        length, batch = text.shape
        hot = np.eye(len(self.langs), dtype=np.float32)[label]
        loss, errors = 0.0, []
        for t in range(length):
            logits = state["f"][t][5] @ self.p["of"] + state["b"][t][5] @ self.p["ob"] + self.p["c"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
            loss -= float(np.log(prob[np.arange(batch), label] + 1e-9).sum())
            err = (prob - hot) / (batch * length)
            errors.append(err)
            g["c"] += err.sum(0)
            for d in "fb":
                g[f"o{d}"] += state[d][t][5].T @ err
        n = self.hidden
        for d in "fb":
            back = np.zeros((batch, n), np.float32)
            for t in range(length - 1, -1, -1) if d == "f" else range(length):
                h, z, r, inner, new, _ = state[d][t]
                dh = back + errors[t] @ self.p[f"o{d}"].T
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                into = np.concatenate([dz, dr, dnew], 1)
                rec = np.concatenate([dz, dr, dnew * r], 1)
                np.add.at(g[f"x{d}"], text[t], into)
                g[f"u{d}"] += h.T @ rec
                g[f"b{d}"] += (dnew * r).sum(0)
                back = dh * z + rec @ self.p[f"u{d}"].T
        return loss / (batch * length), g

    def train(self, windows: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = TRAIN_BATCH, rate: float = RATE, seed: int = SEED) -> "Network":
        """Adam over seeded batches in which every language has the same share. windows: (n, time) bytes."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, -(-batch // len(by_label))) for rows in by_label])
            _, g = self.gradients(np.ascontiguousarray(windows[pick].T), label[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (x - m[k])
                v2[k] += 0.01 * (x * x - v2[k])
                self.p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-6)
        return self

    def ready(self) -> "Reader":
        return Reader(self)


class Reader:
    """A trained network arranged for reading: separate tables for the gates, sigmoid as half a tanh."""

    def __init__(self, net: Network):
        n, p = net.hidden, net.p
        self.n, self.classes = n, len(net.langs)
        self.parts = {d: [np.ascontiguousarray(a) for a in (
            p[f"x{d}"][:, :n] / 2, p[f"x{d}"][:, n:2 * n] / 2, p[f"x{d}"][:, 2 * n:], p[f"u{d}"][:, :n] / 2, p[f"u{d}"][:, n:2 * n] / 2,
            p[f"u{d}"][:, 2 * n:], p[f"b{d}"], p[f"o{d}"])] for d in "fb"}
        self.c = p["c"]

    def _step(self, d: str, now: np.ndarray, h: np.ndarray) -> np.ndarray:
        xz, xr, xn, uz, ur, un, b, _ = self.parts[d]
        z, r, inner = h @ uz, h @ ur, h @ un
        z += xz[now]
        r += xr[now]
        np.tanh(z, out=z)
        np.tanh(r, out=r)
        inner += b
        r += 1
        r *= 0.5
        r *= inner
        r += xn[now]
        np.tanh(r, out=r)                       # the new state
        z += 1
        z *= 0.5
        h = h - r
        h *= z
        h += r
        return h

    def pooled(self, text: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """Sum over positions of the distributions. text (time, batch), valid: flags of the same shape, None if all are."""
        length, batch = text.shape
        h = np.zeros((batch, self.n), np.float32)
        ahead = np.empty((length, batch, self.n), np.float32)
        for t in range(length):
            h = ahead[t] = self._step("f", text[t], h)
        h = np.zeros((batch, self.n), np.float32)
        total = np.zeros((batch, self.classes), np.float32)
        of, ob = self.parts["f"][7], self.parts["b"][7]
        for t in range(length - 1, -1, -1):
            h = self._step("b", text[t], h)
            if valid is not None:
                h *= valid[t][:, None]
            e = ahead[t] @ of
            e += h @ ob
            e += self.c
            np.exp(e, out=e)
            e /= e.sum(1, keepdims=True)
            if valid is not None:
                e *= valid[t][:, None]
            total += e
        return total

    def texts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean distribution of every text (zeros for empty ones)."""
        size = np.diff(off)
        n = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), n)
        start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        left = np.minimum(off[1:][doc] - start, WINDOW)
        sums = np.zeros((len(size), self.classes))
        order = np.argsort(left < WINDOW, kind="stable")  # whole windows first, so that few batches need flags
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            place = start[rows][None, :] + np.arange(WINDOW)[:, None]
            valid = None if left[rows].min() == WINDOW else np.arange(WINDOW)[:, None] < left[rows][None, :]
            text = data[np.minimum(place, len(data) - 1)]
            if valid is not None:
                text = text * valid
            np.add.at(sums, doc[rows], self.pooled(text, valid))
        return sums / np.maximum(size, 1)[:, None]


def _fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, seed: int = SEED) -> Network | None:
    """The network of the labelled documents outside the held-out fold; None without any.

    Of each language the ``sample_docs`` documents with the smallest seeded hash are used, chosen in two levels so that a frequent
    language is not ranked in one task; windows come from places spread over their whole texts. This bounds what the driver gets.
    """
    ok = docs.where(F.col("lang").isNotNull() & (_fold() != 1) & (F.octet_length("text") > 0))
    keys = ok.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    one = Window.partitionBy("lang", F.pmod("h", F.lit(512))).orderBy("h", "doc_id")
    two = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = keys.withColumn("r", F.row_number().over(one)).where(F.col("r") <= sample_docs)
    few = few.withColumn("r", F.row_number().over(two)).where(F.col("r") <= sample_docs).select("doc_id", "lang").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(2))
            ids, langs, out = [], [], []
            for k in range(b.num_rows):
                room = max(0, off[k + 1] - off[k] - TRAIN_WINDOW)
                for w in range(min(sample_windows, 1 + room // TRAIN_WINDOW)):
                    at = off[k] + room * w // max(1, sample_windows - 1)
                    out.append(data[at:min(at + TRAIN_WINDOW, off[k + 1])].tobytes().ljust(TRAIN_WINDOW, b" "))
                    langs.append(b.column(1)[k].as_py())
                    ids.append(str(b.column(0)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["id", "lang", "w"])

    # Bounded by sample_docs rows a language.
    texts = ok.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"])
    rows = sorted({(r.lang, r.id, bytes(r.w)) for r in texts.mapInArrow(cut, "id string, lang string, w binary").collect()})
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    place = {x: k for k, x in enumerate(langs)}
    windows = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), TRAIN_WINDOW)
    return Network(langs).train(windows, np.array([place[r[0]] for r in rows]))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Every column of docs(text, ...) in a struct ``row``, with lang_pred and score.

    lang_pred is the language with the highest mean probability over all bytes of the text (ties: the first by name), score that
    mean. Null texts, texts without any letter and all texts of an untrained network are ``und`` with score 0.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    flagged = docs.select(whole, F.col("text").alias("t"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has"))
    reader = net.ready() if net is not None else None
    langs = net.langs if net is not None else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = np.asarray(b.column("has"))
            name, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if reader is not None and b.num_rows:
                data, off = text_bytes(b.column("t"))
                for i, j in blocks(off, BATCH * WINDOW * 2):
                    mean = reader.texts(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    best = mean.argmax(1)
                    name[i:j] = np.where(has[i:j], np.array(langs, object)[best], UNKNOWN)
                    score[i:j] = np.where(has[i:j], np.clip(mean[np.arange(j - i), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(name, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    schema = flagged.select("row").schema.add("lang_pred", "string").add("score", "double")
    return flagged.mapInArrow(read, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(_fold() == 1, F.lit(False))
    keep = docs.select("doc_id", "text", held.alias("held_out"))
    out = predict(keep.select("doc_id", "held_out", "text"), learn(docs))
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows: ``und`` and pooled probabilities under MIN_SCORE go."""
    return predict(docs, learn(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")
