"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A word's input is its own embedding (words of the sample) beside the mean embedding of its hashed character
n-grams (any word). Texts are scored in overlapping windows of `WINDOW` words, `SCORE_STRIDE` apart (half a window, so that a run of
as many words lies whole in one), and a document's logit is its highest window's; learning takes windows `STRIDE` apart. Labels are per document, so training picks the window of a toxic document that
looks worst at the time (first by log-odds of its words, then by the model itself), and random and worst
windows of the others. The threshold that separates the sample best becomes score 0.5.

Learning takes a bounded sample: at most `TRAIN_ROWS` labelled ids of the two classes, chosen by hash, one text of each, of at most
`TRAIN_CHARS` characters. Scoring reads whole texts, runs without spaces in overlapping pieces.

Rows: a null or empty text, or one without words, has one empty window; repeated rows are each scored; a null
toxic label is not learned from; with rows of one class only, or none, every score is 0. Conflicting labels of a doc_id
count as toxic. Other columns pass through; input columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import crc_bucket, ranges, table, with_text_columns

WINDOW, STRIDE, SCORE_STRIDE = 32, 24, 16
#: Rows of class 0 and of class 1.
TRAIN_ROWS, TRAIN_CHARS = (3000, 1500), 20_000
D, H = 12, 8
VOCAB, BUCKETS, NGRAMS = 20_000, 1 << 15, (3, 4)
#: Passes over the sample at least, and updates at least (a small sample gets more passes).
EPOCHS, UPDATES, BATCH, RATE = 8, 400, 128, 0.1
CACHE_WORDS = 200_000
WORD = re.compile(r"\w+")
#: Letters of a word at most, and how many of them two pieces of a longer run share.
LONGEST, SHARED = 40, 20


def words(text: str | None) -> list[str]:
    """Words of a text; a run of over LONGEST letters is cut into overlapping pieces, each of which counts as a word."""
    found = WORD.findall(text.lower()) if text else []
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[a : a + LONGEST] for w in found for a in range(0, max(1, len(w) - SHARED), LONGEST - SHARED)]


def ngrams(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words between marks, word after word, and how many each has."""
    marked = [f"<{w}>".encode() for w in some]
    sizes = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(some)), sizes)
    hashes, owners = [], []
    for n in NGRAMS:
        h = np.full(max(0, len(data) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ data[k : k + len(h)]) * np.uint32(0x01000193)
        inside = owner[: len(h)] == owner[n - 1 :]
        hashes.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))[inside])
        owners.append(owner[: len(h)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(hashes)[order].astype(np.int64), np.bincount(owners, minlength=len(some))


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the overlapping windows of n words, the last one reaching the end."""
    return list(range(0, max(1, n - WINDOW + stride), stride))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Network:
    """Parameters, forward pass over precomputed word inputs, and gradients."""

    def __init__(self, n_words: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"Ew": f(n_words + 1, D, s=0.1), "Ec": f(BUCKETS, D, s=0.1)}
        self.p["Ew"][0] = 0
        for d in "fb":
            self.p |= {f"W{d}": f(2 * D, 3 * H, s=1 / math.sqrt(2 * D)), f"U{d}": f(H, 3 * H, s=1 / math.sqrt(H)), f"c{d}": np.zeros(3 * H, np.float32)}
        self.p |= {"A": f(2 * H, H, s=1 / math.sqrt(2 * H)), "a": np.zeros(H, np.float32), "v": f(H, s=0.5), "w": f(2 * H, s=0.3), "b": np.zeros(1, np.float32)}

    def inputs(self, word_ids: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(n, 2D) of words; their n-grams lie one after the other, at least one each."""
        if not len(counts):
            return np.zeros((0, 2 * D), np.float32)
        total = np.add.reduceat(self.p["Ec"][grams], np.cumsum(counts) - counts)
        return np.concatenate([self.p["Ew"][word_ids], total / counts[:, None].astype(np.float32)], 1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(n, 6H): what a word's input adds to the gates of both directions."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def forward(self, g: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows from gate inputs g (T, B, 6H) and mask (T, B)."""
        T, B = mask.shape
        states = np.empty((T, B, 2 * H), np.float32)
        for k, d in enumerate("fb"):
            U, h, steps = self.p[f"U{d}"], np.zeros((B, H), np.float32), []
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                gx, gh = g[t, :, 3 * H * k : 3 * H * (k + 1)], h @ U
                zr = sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
                new = n + z * (h - n)
                m = mask[t][:, None]
                if tape is not None:
                    steps.append((t, h, z, r, n, gh[:, 2 * H :], m))
                h = new if m.all() else np.where(m, new, h)
                states[t, :, H * k : H * (k + 1)] = h
            if tape is not None:
                tape.append(steps)
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[..., None] * states).sum(0)
        if tape is not None:
            tape.append((states, u, alpha, pooled))
        return pooled @ self.p["w"] + self.p["b"][0]

    def backward(self, tape: list, dlogit: np.ndarray, shape: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of g."""
        fsteps, bsteps, (states, u, alpha, pooled) = tape
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("Ew", "Ec")}
        grad["w"], grad["b"] = dlogit @ pooled, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * self.p["w"]
        dstates = alpha[..., None] * dpool
        dalpha = (states * dpool).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        grad["v"] = (de[..., None] * u).sum((0, 1))
        du = de[..., None] * self.p["v"] * (1 - u * u)
        grad["a"] = du.sum((0, 1))
        grad["A"] = states.reshape(-1, 2 * H).T @ du.reshape(-1, H)
        dstates += du @ self.p["A"].T
        dg = np.zeros(shape, np.float32)
        for k, (d, steps) in enumerate((("f", fsteps), ("b", bsteps))):
            U, dh = self.p[f"U{d}"], np.zeros((shape[1], H), np.float32)
            for t, h, z, r, n, hn, m in reversed(steps):
                dh = dh + dstates[t, :, H * k : H * (k + 1)]
                dnew = dh * m
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dgx = np.concatenate([dz, dr, dn], 1)
                dgh = np.concatenate([dz, dr, dn * r], 1)
                dg[t, :, 3 * H * k : 3 * H * (k + 1)] = dgx
                grad[f"U{d}"] += h.T @ dgh
                dh = dh * ~m + dnew * z + dgh @ U.T
        return grad, dg


class Lexicon:
    """Words of texts as numbers, new ones appended as they come."""

    def __init__(self, ids: dict[str, int]):
        self.ids, self.row, self.done = ids, {}, 0

    def rows(self, text_words: list[str]) -> list[int]:
        row = self.row
        for w in text_words:
            if w not in row:
                row[w] = len(row)
        return [row[w] for w in text_words]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, n-grams and their counts of the words since the last call."""
        new = list(islice(self.row, self.done, None))
        self.done = len(self.row)
        if not new:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = self.ids.get
        return np.array([get(w, 0) for w in new], np.int64), *ngrams(new)


def train(texts: list[str], labels: list[int], seed: int = 1) -> dict | None:
    """A model from labelled texts: parameters, vocabulary and threshold."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    split = [words(t) for t in texts]
    seen: dict[str, list[int]] = {}
    for ws, label in zip(split, labels):
        for w in set(ws):
            seen.setdefault(w, [0, 0])[label] += 1
    common = sorted((w for w, c in seen.items() if sum(c) >= 2), key=lambda w: (-sum(seen[w]), w))[:VOCAB]
    ids = {w: i + 1 for i, w in enumerate(common)}
    lex = Lexicon(ids)
    docs = [np.array(lex.rows(ws), np.int64) for ws in split]
    word_ids, grams, counts = lex.arrays()
    net = Network(len(ids))

    # Windows: row numbers, -1 for padding.
    cut = [np.full((len(windows(len(d))), WINDOW), -1, np.int32) for d in docs]
    for c, d in zip(cut, docs):
        for i, a in enumerate(windows(len(d))):
            part = d[a : a + WINDOW]
            c[i, : len(part)] = part
    # Log-odds of words and n-grams, by documents of each class that hold them.
    total = np.bincount(y, minlength=2) + 1.0
    odds = lambda c: math.log((c[1] + 1.0) / total[1]) - math.log((c[0] + 1.0) / total[0])
    gram_at = np.cumsum(counts) - counts
    gram_seen = np.zeros((BUCKETS, 2))
    for d, label in zip(docs, labels):
        own = np.unique(d)
        gram_seen[np.unique(grams[ranges(gram_at[own], counts[own])]), label] += 1
    gram_odds = np.log((gram_seen[:, 1] + 1) / total[1]) - np.log((gram_seen[:, 0] + 1) / total[0])
    hint = np.array([odds(seen[w]) for w in lex.row])
    hint = np.maximum(hint, np.maximum.reduceat(gram_odds[grams], gram_at)) if len(hint) else hint
    hint = np.append(hint, -9.0)  # padding
    worst = [int(hint[c].max(1).argmax()) for c in cut]

    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("Ew", "Ec")}
    scale = {"Ew": 0.0, "Ec": 0.0}  # one step size per table, so that rare features learn less than common ones
    step = 0

    def table_() -> np.ndarray:
        return np.concatenate([net.gates(net.inputs(word_ids, grams, counts)), np.zeros((1, 6 * H), np.float32)])

    def logits(rows: np.ndarray, gates: np.ndarray) -> np.ndarray:
        return np.concatenate([net.forward(gates[rows[a : a + 2048].T], rows[a : a + 2048].T >= 0) for a in range(0, len(rows), 2048)])

    ends = np.cumsum([len(c) for c in cut])[:-1]
    per_epoch = math.ceil((y.sum() + 3 * (y == 0).sum()) / BATCH)
    epochs = max(EPOCHS, min(60, math.ceil(UPDATES / per_epoch)))
    for epoch in range(epochs):
        if epoch and epoch % (epochs // 4) == 0:
            worst = [int(part.argmax()) for part in np.split(logits(np.concatenate(cut), table_()), ends)]
        picks, targets = [], []
        for i, c in enumerate(cut):
            chosen = {worst[i]} if labels[i] else {worst[i], int(rng.integers(len(c))), int(rng.integers(len(c)))}
            picks += [c[j] for j in chosen]
            targets += [labels[i]] * len(chosen)
        picks, targets = np.array(picks), np.array(targets, np.float32)
        weight = np.where(targets == 1, (targets == 0).sum() / max(1, targets.sum()), 1.0).astype(np.float32)
        order = rng.permutation(len(picks))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            rows = picks[batch].T
            used, back = np.unique(rows, return_inverse=True)
            back = back.reshape(rows.shape)
            real = used >= 0
            live = used[real]
            own = grams[ranges(gram_at[live], counts[live])]
            x = np.zeros((len(used), 2 * D), np.float32)
            x[real] = net.inputs(word_ids[live], own, counts[live])
            tape: list = []
            g = net.gates(x)[back]
            out = net.forward(g, rows >= 0, tape)
            dlogit = ((sigmoid(out) - targets[batch]) * weight[batch] / weight[batch].sum()).astype(np.float32)
            grad, dg = net.backward(tape, dlogit, g.shape)
            dgates = np.zeros((len(used), 6 * H), np.float32)
            np.add.at(dgates, back.ravel(), dg.reshape(-1, 6 * H))
            dx = np.zeros((len(used), 2 * D), np.float32)
            for k, d in enumerate("fb"):
                part = dgates[:, 3 * H * k : 3 * H * (k + 1)]
                grad[f"W{d}"], grad[f"c{d}"] = x.T @ part, part.sum(0)
                dx += part @ net.p[f"W{d}"].T
            step += 1
            for k, gr in grad.items():
                m, v = adam[k]
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                net.p[k] -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            each = dx[real, D:] / np.maximum(counts[live], 1)[:, None].astype(np.float32)
            for k, at, gr in (("Ew", word_ids[live], dx[real, :D]), ("Ec", own, np.repeat(each, counts[live], axis=0))):
                rows_, inv = np.unique(at, return_inverse=True)
                summed = np.zeros((len(rows_), D), np.float32)
                np.add.at(summed, inv, gr)
                scale[k] += 0.02 * (float((summed**2).sum(1).max(initial=0)) - scale[k])
                net.p[k][rows_] -= RATE * summed / math.sqrt(scale[k] / (1 - 0.98**step) + 1e-12)
            net.p["Ew"][0] = 0

    model = {"p": net.p, "ids": ids, "threshold": 0.0}
    tops = Scorer(model).logits(texts)
    # The threshold with the best mean of both classes' accuracy; in the middle of its gap.
    order = np.sort(tops)
    middles = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2])
    pos, neg = np.sort(tops[y == 1]), np.sort(tops[y == 0])
    balance = (len(pos) - np.searchsorted(pos, middles)) / len(pos) + np.searchsorted(neg, middles) / len(neg)
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    return model | {"threshold": float(middles[best].mean())}


class Scorer:
    def __init__(self, model: dict | None):
        self.model = model
        if model:
            self.net = Network(0)
            self.net.p = model["p"]
            self._reset()

    def _reset(self) -> None:
        self.lex = Lexicon(self.model["ids"])
        self.gates = np.zeros((4096, 6 * H), np.float32)  # grows by doubling; row 0 is padding, a word's row is its number + 1

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.model:
            return [0.0] * len(texts)
        return sigmoid(self.logits(texts) - self.model["threshold"]).tolist()

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's highest window's."""
        return np.concatenate([np.zeros(0), *[self._some(texts[a : a + 256]) for a in range(0, len(texts), 256)]])

    def _some(self, texts):
        if len(self.lex.row) > CACHE_WORDS:
            self._reset()
        docs = [self.lex.rows(words(t)) for t in texts]
        done = self.lex.done + 1
        new = self.net.gates(self.net.inputs(*self.lex.arrays()))
        while done + len(new) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        self.gates[done : done + len(new)] = new
        flat = np.concatenate([np.array(d, np.int64) for d in docs] + [np.full(WINDOW, -1, np.int64)]) + 1
        gates = self.gates
        starts, stops, owner, at = [], [], [], 0
        for k, d in enumerate(docs):
            for a in windows(len(d), SCORE_STRIDE):
                starts.append(at + a)
                stops.append(at + len(d))
                owner.append(k)
            at += len(d)
        starts, stops, owner = np.array(starts), np.array(stops), np.array(owner)
        out = np.full(len(texts), -np.inf)
        for a in range(0, len(starts), 1024):
            place = starts[a : a + 1024, None] + np.arange(WINDOW)
            live = place < stops[a : a + 1024, None]
            rows = np.where(live, flat[np.minimum(place, len(flat) - 1)], 0).T
            np.maximum.at(out, owner[a : a + 1024], self.net.forward(gates[rows], live.T))
        return out


def sample(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: `rows` of the two classes at most, by hash, doc_ids with crc32 mod 5 = 0 left out."""
    marks = labels.filter("toxic is not null and doc_id is not null").filter(crc_bucket("doc_id", 5) != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):
        part = marks.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[value])
        chosen = part if chosen is None else chosen.union(part)
    side = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))  # sum(rows) at most
    texts = docs.filter(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(side, F.col("doc_id") == F.col("_id"))
    # One text of each doc_id, so that what reaches the driver is bounded whatever ids repeat.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic").distinct()
    found = sorted((r.text, r.toxic) for r in texts.collect())
    return [t for t, _ in found], [int(v) for _, v in found]


def with_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """Add score and predicted to `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            s = scorer.scores(texts)
            return s, [int(x >= 0.5) for x in s]

        return run

    return with_text_columns(docs, "text", "score double, predicted int", make)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(*sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return with_toxicity(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
