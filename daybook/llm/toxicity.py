"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word (hashed) and the mean of embeddings of its
character trigrams (hashed, with marks at both ends), so unseen forms of a known stem
are recognised. A forward and a backward gated recurrent layer run over a window of
``WINDOW`` words, attention pools their outputs, and a logistic unit scores the window.
A document's score is that of its highest window; all windows, ``STRIDE`` words apart
and so half overlapping, are scored, to the last word.

Training: at most ``MAX_DOCS`` labelled documents of each class (those whose id hashes
lowest, never of the held-out third), whole, all windows of each, by Adam on the driver;
the bound on their number holds whatever the table's size. Then the network,
a few hundred KB, goes to the tasks, and scoring is a map without a shuffle.

Defined cases: a null text is an empty text; a text without words gets the score of
an empty window; a null id is held out of training and belongs to no fold
(``held_out`` false); repeated rows give repeated rows; an id that ``labels`` has with both
classes isn't learned from, and one that ``documents`` has more than once is learned from
once, by the text that hashes lowest; an empty table gives an empty
table; without labels of both classes every score is the share of toxic labels (0 if
there are none); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held, materialise, trim

WINDOW, STRIDE = 48, 24
WORD_BITS, CHAR_BITS = 16, 12
WORD_DIM, CHAR_DIM, HIDDEN = 12, 12, 12
MAX_DOCS = 1500
EPOCHS, LEAST_STEPS, BATCH, RATE = 10, 200, 64, 0.01
PICKS = 5
DROP = 0.3
LEAST_DOCS, PRIOR_DOCS = 3, 8
#: The embeddings learn slower than the layers above, which first use the log-odds they start with.
SLOWER = {"words": 0.1, "chars": 0.1}
REJECT = 0.7
CHUNK = 1024
F32 = np.float32


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().split()


class Words:
    """Hashed features of distinct words: the word's bucket, and its trigrams' buckets in one run a word."""

    def __init__(self, distinct: list[bytes]):
        self.n = len(distinct)
        if not self.n:
            self.word = np.zeros(0, np.int64)
            self.grams, self.heads, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        octets = np.frombuffer(b"\x02" + b"\x03\x02".join(distinct) + b"\x03", np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, distinct), np.int64, self.n) + 2
        heads = np.cumsum(lengths) - lengths
        place = np.arange(len(octets)) - np.repeat(heads, lengths)
        powers = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        h = np.add.reduceat(octets * powers[place], heads)
        self.word = ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        gram = octets[:-2] * np.uint64(1 << 16) + octets[1:-1] * np.uint64(1 << 8) + octets[2:]
        inside = place[:-2] < np.repeat(lengths, lengths)[:-2] - 2
        self.grams = (gram[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        self.sizes = lengths - 2  # an empty word can't be
        self.heads = np.cumsum(self.sizes) - self.sizes

    def some(self, rows: np.ndarray) -> Words:
        """The features of these rows alone, in their order."""
        out = object.__new__(Words)
        out.n, out.word, out.sizes = len(rows), self.word[rows], self.sizes[rows]
        out.heads = np.cumsum(out.sizes) - out.sizes
        out.grams = self.grams[np.repeat(self.heads[rows] - out.heads, out.sizes) + np.arange(out.sizes.sum())]
        return out

    def inputs(self, net: dict[str, np.ndarray]) -> np.ndarray:
        """One row a word: its embedding and the mean of its trigrams'."""
        if not self.n:
            return np.zeros((0, WORD_DIM + CHAR_DIM), F32)
        chars = np.add.reduceat(net["chars"][self.grams], self.heads, axis=0) / self.sizes[:, None].astype(F32)
        return np.concatenate([net["words"][self.word], chars], axis=1)


def new_net(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"words": (1 << WORD_BITS, WORD_DIM), "chars": (1 << CHAR_BITS, CHAR_DIM)}
    for d in "fb":  # forward, backward
        shape |= {f"W{d}": (WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"U{d}": (HIDDEN, 3 * HIDDEN), f"c{d}": (3 * HIDDEN,)}
    shape |= {"attend": (2 * HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,)}
    scale = {"words": 0.05, "chars": 0.05, "bias": 0.0, "cf": 0.0, "cb": 0.0}
    return {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(F32) for k, s in shape.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def recur(x: np.ndarray, valid: np.ndarray, u: np.ndarray, backward: bool, keep: bool = False) -> tuple[np.ndarray, list]:
    """Outputs (steps, windows, HIDDEN) of one layer; x: (steps, windows, 3 HIDDEN); kept values for the gradient."""
    steps, n, _ = x.shape
    out, h, kept = np.empty((steps, n, HIDDEN), F32), np.zeros((n, HIDDEN), F32), []
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        after = new + z * (h - new)
        if not valid[t].all():
            after = np.where(valid[t][:, None], after, h)
        if keep:
            kept.append((t, h, r, z, new, hu[:, 2 * HIDDEN :]))
        out[t] = h = after
    return out, kept


def pool(h: np.ndarray, valid: np.ndarray, net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention (steps, windows) and pooled outputs."""
    a = np.where(valid, h @ net["attend"], F32(-1e9))
    a = np.exp(a - a.max(axis=0)) * valid
    a /= np.maximum(a.sum(axis=0), F32(1e-9))
    pooled = np.einsum("tn,tnk->nk", a, h)
    return pooled @ net["out"] + net["bias"][0], a, pooled


def window_logits(ids: np.ndarray, table: dict[str, np.ndarray], net: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of windows (steps, windows) of word rows; -1 marks what lies past the end."""
    valid = ids >= 0
    at = np.maximum(ids, 0)
    h = np.concatenate([recur(table[d][at], valid, net[f"U{d}"], d == "b")[0] for d in "fb"], axis=2)
    return pool(h, valid, net)[0]


def gradients(ids: np.ndarray, label: np.ndarray, weight: np.ndarray, words: Words, net: dict[str, np.ndarray], seen: np.ndarray | float = 1) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of windows and its gradient by each part of the network; ``seen``: factors of the words' inputs."""
    valid, at = ids >= 0, np.maximum(ids, 0)
    inputs = words.inputs(net) * seen
    x = inputs[at]
    layer = {d: recur(x @ net[f"W{d}"] + net[f"c{d}"], valid, net[f"U{d}"], d == "b", True) for d in "fb"}
    h = np.concatenate([layer[d][0] for d in "fb"], axis=2)
    logit, a, pooled = pool(h, valid, net)
    p = sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
    dl = (weight * (p - label)).astype(F32)
    g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
    dpool = dl[:, None] * net["out"]
    da = np.einsum("nk,tnk->tn", dpool, h)
    ds = a * (da - (a * da).sum(axis=0))
    g["attend"] = np.einsum("tn,tnk->k", ds, h)
    dh = a[:, :, None] * dpool + ds[:, :, None] * net["attend"]
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, w = net[f"U{d}"], net[f"W{d}"]
        du, dgate, back = np.zeros_like(u), np.zeros((*ids.shape, 3 * HIDDEN), F32), np.zeros((ids.shape[1], HIDDEN), F32)
        for t, before, r, z, new, hn in reversed(layer[d][1]):
            full = dh[t, :, k * HIDDEN : (k + 1) * HIDDEN] + back
            live = full * valid[t][:, None]
            dnew = live * (1 - z) * (1 - new * new)
            dz = live * (before - new) * z * (1 - z)
            dr = dnew * hn * r * (1 - r)
            gate = np.concatenate([dr, dz, dnew], axis=1)
            dhu = np.concatenate([dr, dz, dnew * r], axis=1)
            du += before.T @ dhu
            back = dhu @ u.T + live * z + full * ~valid[t][:, None]
            dgate[t] = gate
        flat = dgate.reshape(-1, 3 * HIDDEN)
        g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = du, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        dx += dgate @ w.T
    din = np.zeros_like(inputs)
    np.add.at(din, at[valid], dx[valid])
    din *= seen
    g["words"], g["chars"] = np.zeros_like(net["words"]), np.zeros_like(net["chars"])
    np.add.at(g["words"], words.word, din[:, :WORD_DIM])
    np.add.at(g["chars"], words.grams, np.repeat(din[:, WORD_DIM:] / words.sizes[:, None].astype(F32), words.sizes, axis=0))
    return loss, g


def windows_of(n: int) -> list[int]:
    """First words of a text's windows: each ``STRIDE`` words, and one that ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Windows:
    """The windows of texts, whose words are rows of a table: ``counts`` of them by text, from ``heads`` on."""

    def __init__(self, runs: list[np.ndarray]):
        starts = [windows_of(len(r)) for r in runs]
        self.counts = np.fromiter(map(len, starts), np.int64, len(runs))
        self.heads = np.cumsum(self.counts) - self.counts
        self.flat = np.concatenate([*runs, np.full(WINDOW, -1, np.int32)])
        base = np.cumsum([0, *map(len, runs)])
        self.first = np.concatenate([np.zeros(0, np.int64), *[np.array(s, np.int64) + b for s, b in zip(starts, base, strict=False)]])
        self.length = np.repeat(np.minimum(np.diff(base), WINDOW), self.counts)

    def ids(self, windows: np.ndarray | slice) -> np.ndarray:
        """(steps, windows) of word rows; -1 marks what lies past the end."""
        span, at = np.arange(WINDOW)[:, None], self.first[windows]
        return np.where(span < self.length[windows], self.flat[np.minimum(at + span, len(self.flat) - 1)], -1)

    def logits(self, table: dict[str, np.ndarray], net: dict[str, np.ndarray]) -> np.ndarray:
        """Of every window, ``CHUNK`` at a time."""
        parts = [window_logits(self.ids(slice(k, k + CHUNK)), table, net) for k in range(0, len(self.first), CHUNK)]
        return np.concatenate([np.zeros(0, F32), *parts])


def by_direction(inputs: np.ndarray, net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What each word gives to both layers; one more row stands for an empty window's word, which no window reads."""
    return {d: np.concatenate([inputs @ net[f"W{d}"] + net[f"c{d}"], np.zeros((1, 3 * HIDDEN), F32)]) for d in "fb"}


def fit(sample: list[tuple[list[bytes], int]], seed: int = 7) -> dict[str, np.ndarray] | float:
    """A network from documents (their words) and labels; a bare score if a class is missing.

    A document's score is its highest window's, and so is trained: after the first
    epoch, which takes a random window of each document, a batch learns from the
    window of each document that the network scored highest, of all its windows, at
    the last of ``PICKS`` looks.
    """
    labels = np.array([y for _, y in sample], F32)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    rng, net = np.random.default_rng(seed), new_net(seed)
    index: dict[bytes, int] = {}
    docs = [np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)) for words, _ in sample]
    every = Words(list(index))
    share = labels.mean()
    # A word that few training documents have could only be learned by heart: it keeps no
    # embedding. One dimension of each embedding starts as the shrunk log-odds of a toxic
    # label among the training documents that have the word or trigram.
    have = {"words": np.zeros((2, 1 << WORD_BITS)), "chars": np.zeros((2, 1 << CHAR_BITS))}
    for doc, (_, y) in zip(docs, sample, strict=True):
        own = every.some(np.unique(doc))
        have["words"][y][np.unique(own.word)] += 1
        have["chars"][y][np.unique(own.grams)] += 1
    for name, (clean, toxic) in have.items():
        rate = (toxic + PRIOR_DOCS * share) / (clean + toxic + PRIOR_DOCS)
        net[name][:, 0] = (np.log(rate / (1 - rate)) - np.log(share / (1 - share))) / 2
    known = have["words"].sum(axis=0) >= LEAST_DOCS
    net["words"] *= known[:, None]
    # Rows that learn: of the words' table the known ones, else all.
    learns = {"words": np.nonzero(known)[0]}
    moment = {k: [np.zeros_like(v[learns.get(k, slice(None))])] * 2 for k, v in net.items()}
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(F32)
    steps = -(-len(sample) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // steps))
    step, total = 0, epochs * steps
    picked, look = np.zeros(len(sample), np.int64), max(1, epochs // PICKS)
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            distinct, first, at = np.unique(np.concatenate([docs[i] for i in own]), return_index=True, return_inverse=True)
            if not len(distinct):
                continue
            met = np.argsort(first)  # words in the order in which the batch has them
            rows, words = np.argsort(met).astype(np.int32)[at], every.some(distinct[met])
            batch = Windows(np.split(rows, np.cumsum([len(docs[i]) for i in own])[:-1]))
            if not epoch:
                picked[own] = rng.integers(0, batch.counts)
            elif epoch % look == 1 % look:
                logits = batch.logits(by_direction(words.inputs(net), net), net)
                picked[own] = [logits[h : h + c].argmax() for h, c in zip(batch.heads, batch.counts, strict=True)]
            pick = batch.heads + picked[own]
            seen, chosen = (rng.random((words.n, 1)) >= DROP).astype(F32), batch.ids(pick)
            used, at = np.unique(chosen[chosen >= 0], return_inverse=True)
            if not len(used):
                continue
            chosen[chosen >= 0] = at
            _, g = gradients(chosen, labels[own], importance[own] / len(own), words.some(used), net, seen[used])
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / total)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in g.items():
                at = learns.get(name, slice(None))
                v = v[at] * min(1, 1 / (norm + 1e-9))
                m = moment[name]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.99 * m[1] + 0.01 * v * v
                net[name][at] -= (rate * SLOWER.get(name, 1) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(F32)
    return net


def score(texts: list[str], net: dict[str, np.ndarray] | float) -> np.ndarray:
    """The highest window's score of each whole text."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    if not texts:
        return np.zeros(0)
    index: dict[bytes, int] = {}
    windows = Windows([np.array([index.setdefault(w, len(index)) for w in tokens(t)], np.int32) for t in texts])
    logits = windows.logits(by_direction(Words(list(index)).inputs(net), net), net)
    return sigmoid(np.maximum.reduceat(logits, windows.heads).astype(np.float64))


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> list[tuple[list[bytes], int]]:
    """The words of at most ``max_docs`` documents of each class, outside the held-out third, in order of their ids."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("label_id") != 1))
    once = usable.groupBy("label_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter(F.col("toxic") == F.col("most")).drop("most")
    # Labels of documents that aren't here take up no place.
    once = materialise(docs.select("doc_id").join(once, F.col("doc_id") == F.col("label_id")).select("label_id", "toxic").distinct(), "labelled")
    chosen = [r for y in (0, 1) for r in once.filter(F.col("toxic") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(max_docs).collect()]
    if not chosen:
        return []
    small = F.broadcast(spark.createDataFrame(chosen, "label_id bigint, toxic int"))
    rows = docs.join(small, F.col("doc_id") == F.col("label_id")).select("label_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # One text an id, so what is collected is bounded by the number of ids however often they are repeated.
    least = rows.groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("label_id", "t.text", "toxic").collect()
    return [(tokens(r.text), r.toxic) for r in sorted(least, key=lambda r: r.label_id)]


def scored(docs: DataFrame, net: dict[str, np.ndarray] | float, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds each row's score."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{into}` double"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            made = score([t or "" for t in batch.column(at).to_pylist()], net)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], [*batch.schema.names, into])
        trim()

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | float:
    """The network from ``labels`` and the documents they name."""
    return fit(training_sample(docs.select("doc_id", "text"), labels))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    net = trained(docs, labels)
    rows = scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), net)
    return rows.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op6(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
