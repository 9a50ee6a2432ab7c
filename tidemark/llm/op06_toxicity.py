"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word's input is an embedding of the word and the scaled sum of the embeddings of its
character n-grams, both from hashed tables.  Two GRUs read each window of words, one each way; attention
weighs the words' states and a logistic unit scores their mean.  A document's score is that of
its most toxic window.  The network is trained here, in numpy, on at most SAMPLE_TOXIC +
SAMPLE_CLEAN labelled documents, of TRAIN_CHARS characters of each kind together; a toxic document teaches by the window that scores highest,
a clean one by that and a random one.

Windows overlap and cover every word of every text; a text shorter than a window is one window.

Cases: null and empty texts have the score of a window without words; texts of any length are
scored whole; repeated rows are each returned; a null id is not held out.  Labels other than 0 and 1
teach nothing; of different labels of one id the larger counts.  Without labels of both
kinds the score is the share of toxic labels, or 0.  An empty table gives an empty result.
Columns of any name may stand beside those named; labels are read only of documents that are not
held out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, give_back, kept, rows_in_arrow, staged, utf8

WINDOW, STRIDE = 48, 32
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
TRAIN_CHARS = 1 << 23
BUCKETS = 1 << 15
WIDTH, HIDDEN = 6, 8
GRAMS = (3, 4, 5)
STEPS, BATCH, RATE = 270, 128, 0.05
RANKED = 54  # steps after which each document's top window is chosen anew
THRESHOLD = 0.7
KNOWN = 1 << 16
LANES = 1024
# fixed value: marks that are stripped from a word's ends
MARKS = ".,;:!?\"'()[]{}<>|*_-¡¿«»…"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Inputs:
    """Hashed rows of words and of their character n-grams, many words at once."""

    @staticmethod
    def of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word; rows of all n-grams; index of the word each belongs to)."""
        plain = [(w.lower().strip(MARKS) or w).encode(errors="replace") for w in words]
        flat = np.frombuffer(b"".join(b"<" + w + b">" for w in plain), np.uint8).astype(np.uint64)
        size = np.array([len(w) + 2 for w in plain], np.int64)
        ends = np.cumsum(size)
        of = np.repeat(np.arange(len(plain)), size)
        left = ends[of] - np.arange(len(flat))  # bytes of the word from here on
        prime = np.uint64(0x100000001B3)
        h, rows, owners = np.zeros(len(flat), np.uint64), [], []
        for k in range(max(GRAMS)):
            shifted = np.zeros(len(flat), np.uint64)
            shifted[: len(flat) - k] = flat[k:]
            h = (h ^ (shifted + np.uint64(1))) * prime
            if k + 1 in GRAMS:
                ok = left > k
                rows.append(Inputs.bucket(h[ok]))
                owners.append(of[ok])
        # a word's own hash: a sum over its bytes, each weighted by its place
        place = np.arange(len(flat)) - (ends - size)[of]
        own = (flat + np.uint64(1)) * (prime ** (place % 61 + 1).astype(np.uint64)) + place.astype(np.uint64) * np.uint64(0x9E3779B9)
        word = Inputs.bucket(np.add.reduceat(own, ends - size)) if len(plain) else np.zeros(0, np.int64)
        return word, np.concatenate(rows), np.concatenate(owners)

    @staticmethod
    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, the scoring of windows and the training."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        d = 2 * WIDTH
        self.p = {
            "word": r.normal(0, 0.05, (BUCKETS, WIDTH)),
            "gram": r.normal(0, 0.05, (BUCKETS, WIDTH)),
            "b": np.zeros(1),
            "v": r.normal(0, 0.5, 2 * HIDDEN),
            "w": r.normal(0, 0.5, 2 * HIDDEN),
        }
        for k in "fb":
            self.p |= {f"x{k}": r.normal(0, 0.5, (3 * HIDDEN, d)), f"u{k}": r.normal(0, 0.3, (3 * HIDDEN, HIDDEN)), f"c{k}": np.zeros(3 * HIDDEN)}
        self.constant: float | None = None

    def embed(self, words: list[str]) -> np.ndarray:
        """The inputs of words, one row each."""
        word, gram, owner = Inputs.of(words)
        grams = np.stack([np.bincount(owner, self.p["gram"][gram, k], len(words)) for k in range(WIDTH)], axis=1)
        return np.concatenate((self.p["word"][word], grams / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(words))))[:, None]), axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows: x is (words, lanes, inputs), mask (words, lanes)."""
        n, lanes, _ = x.shape
        kept: dict = {"x": x, "mask": mask}
        states = np.zeros((n, lanes, 2 * HIDDEN))
        for k, steps in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            gx = x @ self.p[f"x{k}"].T + self.p[f"c{k}"]
            h, rows = np.zeros((lanes, HIDDEN)), {}
            for t in steps:
                gh = h @ self.p[f"u{k}"].T
                zr = _sigmoid(gx[t, :, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(gx[t, :, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                new = ((1 - z) * c + z * h) * mask[t][:, None]
                rows[t] = (h, z, r, c, gh[:, 2 * HIDDEN :])
                h = new
                states[t, :, (0 if k == "f" else HIDDEN) :][:, :HIDDEN] = h
            kept[k] = rows
        s = states @ self.p["v"] + np.where(mask > 0, 0, -1e9)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        y = states @ self.p["w"]
        out = (a * y).sum(axis=0) + self.p["b"][0]
        return out, kept | {"a": a, "y": y, "states": states, "mean": out - self.p["b"][0]}

    def backward(self, d: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the inputs, from those of the logits."""
        x, mask, a, y, states = (kept[k] for k in ("x", "mask", "a", "y", "states"))
        n = len(x)
        dy = a * d
        ds = a * (y - kept["mean"]) * d
        g = {"b": np.array([d.sum()]), "w": np.einsum("tb,tbh->h", dy, states), "v": np.einsum("tb,tbh->h", ds, states)}
        dstates = dy[:, :, None] * self.p["w"] + ds[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for k, steps in (("f", range(n - 1, -1, -1)), ("b", range(n))):
            u, rows = self.p[f"u{k}"], kept[k]
            dh = np.zeros((x.shape[1], HIDDEN))
            dgx = np.zeros((*x.shape[:2], 3 * HIDDEN))
            du = np.zeros_like(u)
            for t in steps:
                h, z, r, c, ghc = rows[t]
                top = (dh + dstates[t, :, (0 if k == "f" else HIDDEN) :][:, :HIDDEN]) * mask[t][:, None]
                dc = top * (1 - z) * (1 - c * c)
                dz = top * (h - c) * z * (1 - z)
                dr = dc * ghc * r * (1 - r)
                dgh = np.concatenate((dz, dr, dc * r), axis=1)
                dgx[t] = np.concatenate((dz, dr, dc), axis=1)
                du += dgh.T @ h
                dh = top * z + dgh @ u
            g |= {f"u{k}": du, f"x{k}": np.einsum("tbg,tbd->gd", dgx, x), f"c{k}": dgx.sum(axis=(0, 1))}
            dx += dgx @ self.p[f"x{k}"]
        return g, dx

    def train(self, texts: list[str], toxic: list[int], seed: int = 5) -> None:
        """Adagrad over windows.  The first input of each table starts as the log-odds of its rows."""
        if len(set(toxic)) < 2:
            self.constant = float(np.mean(toxic)) if toxic else 0.0
            return
        r, label = np.random.default_rng(seed), np.array(toxic)
        vocabulary: dict[str, int] = {}
        ids = []
        for t in texts:  # words are held once, documents as numbers
            ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int32))
        words = list(vocabulary)
        del vocabulary
        word, gram, counts = np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
        for s in range(0, len(words), 1 << 14):
            own, rows, of_word = Inputs.of(words[s : s + (1 << 14)])
            word[s : s + len(own)] = own
            gram.append(rows[np.argsort(of_word, kind="stable")].astype(np.uint16))
            counts[s : s + len(own)] = np.bincount(of_word, minlength=len(own))
        gram = np.concatenate(gram) if gram else np.zeros(0, np.uint16)
        begin = np.cumsum(counts) - counts
        seen = np.zeros((2, 2, BUCKETS))  # documents of each kind that have a word's or an n-gram's row
        for d, y in zip(ids, label, strict=True):
            u = np.unique(d)
            seen[0, y, np.unique(word[u])] += 1
            seen[1, y, np.unique(np.concatenate([gram[begin[k] : begin[k] + counts[k]] for k in u]) if len(u) else gram[:0])] += 1
        odds = np.log((seen[:, 1] + 0.5) / ((label == 1).sum() + 1)) - np.log((seen[:, 0] + 0.5) / ((label == 0).sum() + 1))
        odds[seen.sum(axis=1) < 2] = 0
        self.p["word"][:, 0], self.p["gram"][:, 0] = odds[0] / 3, odds[1] / 3
        square = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        weight = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean())
        windows = [(k, s) for k, d in enumerate(ids) for s in window_starts(len(d))]
        of = np.array([k for k, _ in windows])
        step, ranked = 0, -RANKED
        while step < STEPS:
            if step >= ranked + RANKED:
                score = self._rank(ids, windows, words, first=not step)
                best = np.lexsort((score, of))
                top = best[np.concatenate((np.flatnonzero(np.diff(of[best])), [len(best) - 1]))]
                ranked = step
            clean = np.flatnonzero(label[of] == 0)
            # besides each document's top window: random clean ones, and clean ones (minus) of one word repeated
            picks = np.concatenate((top, r.choice(clean, min(len(clean), len(top)) // 2), -1 - r.choice(clean, min(len(clean), len(top)) // 4)))
            r.shuffle(picks)
            for s in range(0, len(picks), BATCH):
                part, step = picks[s : s + BATCH], step + 1
                rows = np.full((WINDOW, len(part)), -1)
                for j, k in enumerate(part):
                    d, at = windows[max(k, -1 - k)]
                    own = ids[d][at : at + WINDOW]
                    rows[: len(own), j] = own if k >= 0 or not len(own) else r.choice(own)
                used, where = np.unique(rows, return_inverse=True)
                real = used >= 0
                own = used[real]
                g_rows = np.concatenate([gram[begin[k] : begin[k] + counts[k]] for k in own]) if len(own) else gram[:0]
                g_of = np.repeat(np.arange(len(own)), counts[own])
                inv = 1 / np.sqrt(np.maximum(1, counts[own]))
                e = np.zeros((len(used), 2 * WIDTH))
                e[real, :WIDTH] = self.p["word"][word[own]]
                e[real, WIDTH:] = np.stack([np.bincount(g_of, self.p["gram"][g_rows, c], len(own)) for c in range(WIDTH)], axis=1) * inv[:, None]
                out, kept = self.forward(e[where.reshape(rows.shape)], (rows >= 0).astype(float))
                doc = of[np.maximum(part, -1 - part)]
                d_out = (_sigmoid(out) - label[doc]) * weight[doc] / len(part)
                g, dx = self.backward(d_out, kept)
                de = np.stack([np.bincount(where.ravel(), dx[:, :, c].ravel(), len(used)) for c in range(2 * WIDTH)], axis=1)[real]
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    square[name] += grad * grad
                    self.p[name] -= RATE * grad / np.sqrt(square[name])
                for name, at, grad in (("word", word[own], de[:, :WIDTH]), ("gram", g_rows, (de[:, WIDTH:] * inv[:, None])[g_of])):
                    rows_used, back = np.unique(at, return_inverse=True)
                    total = np.stack([np.bincount(back, grad[:, c], len(rows_used)) for c in range(WIDTH)], axis=1)
                    square[name][rows_used] += total * total
                    self.p[name][rows_used] -= RATE * total / np.sqrt(square[name][rows_used])

    def _rank(self, ids: list[np.ndarray], windows: list[tuple[int, int]], words: list[str], first: bool) -> np.ndarray:
        """A score of each window: of the network, or before training of its words' log-odds."""
        if first:
            value = np.zeros(len(words))
            for s in range(0, len(words), 1 << 14):
                e = self.embed(words[s : s + (1 << 14)])
                value[s : s + len(e)] = np.maximum(e[:, 0], 0) + np.maximum(e[:, WIDTH], 0)
            return np.array([value[ids[d][s : s + WINDOW]].sum() for d, s in windows])
        scorer = Scorer(self.frozen(), len(words) + 1)
        scorer.learn(words)
        return scorer.logits([d + 1 for d in ids], windows)  # words are new to it, so their rows are in their order

    def frozen(self) -> dict:
        return {"constant": self.constant} | {k: v.astype(np.float32) for k, v in self.p.items()}


class Scorer:
    """Scores whole texts; a word's share of the gates is computed once while it is remembered."""

    def __init__(self, p: dict, room: int = 1 << 12) -> None:
        self.p, self.row = p, {}
        self.net = Network.__new__(Network)
        self.net.p = p
        self.size = 1  # row 0 is no word
        self.gates = np.zeros((6 * HIDDEN, room), np.float32)
        self.most = KNOWN

    def learn(self, words) -> None:
        missing = list(dict.fromkeys(w for w in words if w not in self.row))
        for s in range(0, len(missing), 1 << 14):
            part = missing[s : s + (1 << 14)]
            e = self.net.embed(part).astype(np.float32)
            g = np.concatenate([self.p[f"x{k}"] @ e.T + self.p[f"c{k}"][:, None] for k in "fb"])
            while self.size + len(part) > self.gates.shape[1]:
                self.gates = np.concatenate((self.gates, np.zeros_like(self.gates)), axis=1)
            self.gates[:, self.size : self.size + len(part)] = g
            self.row.update(zip(part, range(self.size, self.size + len(part)), strict=True))
            self.size += len(part)

    def logits(self, rows: list[np.ndarray], windows: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(len(windows), np.float32)
        for s in range(0, len(windows), LANES):
            part = windows[s : s + LANES]
            at = np.zeros((WINDOW, len(part)), np.int64)
            short = False
            for j, (d, k) in enumerate(part):
                own = rows[d][k : k + WINDOW]
                at[: len(own), j] = own
                short |= len(own) < WINDOW
            out[s : s + LANES] = self._block(at, short)
        return out

    def _block(self, at: np.ndarray, short: bool) -> np.ndarray:
        p, h3, n = self.p, 3 * HIDDEN, at.shape[1]
        score = np.zeros((2, WINDOW, n), np.float32)  # attention, and the output's share, of each word
        mask = (at > 0).astype(np.float32) if short else None
        for k, steps in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
            u, table = p["ub" if k else "uf"], self.gates[k * h3 : (k + 1) * h3]
            both = np.stack((p["v"], p["w"]))[:, k * HIDDEN : (k + 1) * HIDDEN]
            h = np.zeros((HIDDEN, n), np.float32)
            for t in steps:
                gx = table.take(at[t], axis=1)
                gh = u @ h
                zr = gx[: 2 * HIDDEN]
                zr += gh[: 2 * HIDDEN]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = gh[2 * HIDDEN :]
                c *= zr[HIDDEN:]
                c += gx[2 * HIDDEN :]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:HIDDEN]
                h += c
                if short:
                    h *= mask[t]
                score[:, t] += both @ h
        if short:
            score[0] += np.where(mask > 0, 0, np.float32(-1e9))
        a = np.exp(score[0] - score[0].max(axis=0))
        return (a * score[1]).sum(axis=0) / a.sum(axis=0) + p["b"][0]

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        if self.p["constant"] is not None:
            return np.array([self.p["constant"] for _ in texts])
        out, part, n = [], [], 0
        for t in texts:
            part.append(t.split())
            n += len(part[-1])
            if n >= 1 << 16:
                out.append(self._slice(part))
                part, n = [], 0
        out.append(self._slice(part))
        return np.concatenate(out)

    def _slice(self, docs: list[list[str]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        if len(self.row) > self.most:
            self.row, self.size, self.gates = {}, 1, np.zeros((6 * HIDDEN, 1 << 12), np.float32)
        self.learn(w for d in docs for w in d)
        get = self.row.__getitem__
        rows = [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]
        windows = [(k, s) for k, r in enumerate(rows) for s in window_starts(len(r))]
        logit = self.logits(rows, windows)
        first = np.flatnonzero(np.diff([k for k, _ in windows], prepend=-1))
        return _sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> dict:
    """The network's parameters, from a bounded sample of documents that are not held out."""
    docs = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = columns_as(labels, doc_id=label_id, toxic=label_col).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = staged(labels, "labels")
    many = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def kind(toxic: int, n: int) -> DataFrame:
        """The n labels of least hash; a bound on the hash lets few more leave their partitions."""
        bound = int((1 << 30) * min(1.0, (1.2 * n + 100) / max(1, many.get(toxic, 0))))
        return labels.where((F.col("toxic") == toxic) & (order <= bound)).orderBy(order, "doc_id").limit(n)

    chosen = staged(kind(1, SAMPLE_TOXIC).union(kind(0, SAMPLE_CLEAN)), "chosen")  # at most the two bounds' rows
    sizes = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"), F.first(order).alias("h"))
    taken, room = [], {0: TRAIN_CHARS, 1: TRAIN_CHARS}
    for r in sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id)):
        if r.n <= room[int(r.toxic)]:  # one that does not fit is passed over
            room[int(r.toxic)] -= r.n
            taken.append((r.doc_id, int(r.toxic)))
    ids, marks = zip(*taken, strict=True) if taken else ((), ())
    wanted = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(marks, pa.int32())})))  # as Arrow: no Python workers
    rows = docs.join(wanted, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    net = Network()
    net.train([r.text for r in rows], [int(r.toxic) for r in rows])
    del rows
    give_back()
    return net.frozen()


def _scorer(shared) -> Scorer:
    scorers = kept("toxicity")
    if shared.id not in scorers:
        scorers.clear()
        scorers[shared.id] = Scorer(shared.value)
    return scorers[shared.id]


def _strings(column: pa.Array) -> Iterator[str]:
    return (x.decode() for x in utf8(column))


def _score(shared) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            scores = scorer.scores(_strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


class _Shared:
    """A broadcast with a number of its own, for finding this worker's scorer."""

    def __init__(self, broadcast) -> None:
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def reject(docs: DataFrame, parameters: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores below `threshold`; null and empty texts
    have the score of no words, equal rows go or stay together."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(parameters))
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            clean = scorer.scores(_strings(b.column(at))) < threshold
            yield b.filter(pa.array(clean))

    return rows_in_arrow(docs, run)


def scores(docs: DataFrame, parameters: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = columns_as(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(parameters))
    scored = docs.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
