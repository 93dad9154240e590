"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes run over overlapping chunks that cover the whole document; each chunk is max-pooled, and the
chunks' mean and maximum combine into one probability.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import labelled_ids, labelled_texts, remainder

#: Bound of the fit: documents of each class, each with its whole text.
PER_CLASS = 1500
MODULUS, HELD_OUT = 5, 0
WIDTH, FILTERS, EMBED = 8, 16, 8
CHUNK, OVERLAP = 512, 32
PIECE = 1 << 15
#: Chunks that a training step holds at once.
PART = 64
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 6, 32, 0.01
LEAST_STEPS = 900


class Network:
    """Weights and the forward pass; all are float32 arrays, about 20 kB."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)  # 256 pads
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.shift = 0.0

    def tables(self) -> np.ndarray:
        """Each byte's part in each filter at each of the filter's places."""
        return np.einsum("be,wef->wbf", self.embed, self.filters)

    def document(self, data: bytes, tables: np.ndarray) -> float:
        """Logit of a whole text. It is padded to whole steps, so that a text always gives the same windows."""
        step = CHUNK - OVERLAP
        raw = np.frombuffer(data, np.uint8)
        n = max(1, -(-max(1, len(raw) - OVERLAP) // step))
        padded = np.full(n * step + OVERLAP + WIDTH - 1, 256, np.int64)
        padded[: len(raw)] = raw
        blocks = np.empty((n * step // OVERLAP + 1, FILTERS), np.float32)
        for at in range(0, len(blocks), PIECE // OVERLAP):
            k = min(PIECE // OVERLAP, len(blocks) - at)
            here = padded[at * OVERLAP : (at + k) * OVERLAP + WIDTH - 1]
            total = tables[0][here[: k * OVERLAP]]
            for w in range(1, WIDTH):
                total += tables[w][here[w : w + k * OVERLAP]]
            blocks[at : at + k] = total.reshape(k, OVERLAP, FILTERS).max(1)
        per = CHUNK // OVERLAP
        tops = np.lib.stride_tricks.sliding_window_view(blocks, per, 0)[:: per - 1].max(2)
        hidden = np.maximum(tops + self.bias, 0)
        return float(np.concatenate([hidden.mean(0), hidden.max(0)]) @ self.out + self.out_bias[0] + self.shift)


def chunked(data: bytes) -> np.ndarray:
    """All overlapping chunks of a text, one per row, as codes; 256 pads. An empty text is one chunk of padding."""
    step = CHUNK - OVERLAP
    raw = np.frombuffer(data, np.uint8)
    n = max(1, -(-max(1, len(raw) - OVERLAP) // step))
    padded = np.full(n * step + OVERLAP + WIDTH - 1, 256, np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::step]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the log loss of whole documents; the gradient goes through the pooled maxima to the bytes that made them.

    A step reads every chunk of its documents: PART chunks at a time give each document's maxima and sums, and only the windows that made a maximum are kept for the gradient.
    """
    net = Network(seed)
    rng = np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "out", "out_bias")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    t, epochs = 0, max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            chunks = [chunked(texts[i]) for i in pick]
            owner = np.repeat(np.arange(len(pick)), [len(c) for c in chunks])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            many = np.diff(np.append(first, len(owner)))[:, None].astype(np.float32)
            tables, tops, made = net.tables(), [], []
            for x in (c[i : i + PART] for c in chunks for i in range(0, len(c), PART)):
                response = tables[0][x[:, :CHUNK]]
                for w in range(1, WIDTH):
                    response += tables[w][x[:, w : w + CHUNK]]
                where = response.argmax(1)  # chunks x filters
                tops.append(np.take_along_axis(response, where[:, None, :], 1)[:, 0])
                made.append(x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(WIDTH)])
            top, windows = np.concatenate(tops) + net.bias, np.concatenate(made)  # windows: chunks x filters x width
            hidden = np.maximum(top, 0)
            mean = np.add.reduceat(hidden, first) / many
            high = np.maximum.reduceat(hidden, first)
            features = np.concatenate([mean, high], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias[0], -30, 30)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grads = {"out": features.T @ g + 1e-4 * net.out, "out_bias": np.array([g.sum()], np.float32)}
            gf = g[:, None] * net.out
            is_top = hidden == high[owner]
            gh = gf[owner, :FILTERS] / many[owner] + gf[owner, FILTERS:] * is_top
            gh *= top > 0
            grads["bias"] = gh.sum(0)
            e = net.embed[windows]
            grads["filters"] = np.einsum("cf,cfwe->wef", gh, e, optimize=True)
            ge = np.einsum("cf,wef->cfwe", gh, net.filters, optimize=True)
            grads["embed"] = np.stack([np.bincount(windows.ravel(), ge[..., d].ravel(), 257) for d in range(EMBED)], 1).astype(np.float32)
            t += 1
            rate = RATE * (1 - 0.9 * (epoch * len(order) + at) / (epochs * len(order)))
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                setattr(net, n, (getattr(net, n) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> Network:
    """Learns from the whole texts of at most per_class documents of each class that aren't held out. Without examples of both classes (no labels, or no documents for them) every
    score is the share of label 1 among the labels that aren't held out, or 0.5 without labels. Of documents with the same id the one of the least text is the example."""
    ids, counts = labelled_ids(labels, "quality", modulus, held_out, per_class)

    def squeezed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([zlib.compress(t.encode(), 1) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "y", "data"])

    rows = labelled_texts(docs, ids).select("doc_id", "text", "y").mapInArrow(squeezed, "doc_id bigint, y int, data binary").collect()
    rows = sorted((r["doc_id"], r["y"], zlib.decompress(r["data"])) for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        net, total = Network(), sum(counts.values())
        share = float(np.clip(counts.get(1, 0) / total, 0.0025, 0.9975)) if total else 0.5
        net.out[:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    net = train([r[2] for r in rows], y)
    # the sample's classes are levelled; scores are for the shares of all labels
    net.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score_documents(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted for every row, from its whole text. A null text counts as empty, which is scored as padding; a very long text is read in pieces.

    Rows are scored one by one, so ties and repeats get equal scores; no rows give no rows. No shuffle. Columns that aren't kept are not read; a kept column of the name of a new one is refused.
    """
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be there twice")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches):
        import pyarrow as pa

        tables = net.tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                logits = np.array([net.document((t or "").encode(), tables) for t in part.column(len(keep)).to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
                columns = [*(part.column(i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, net).select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
