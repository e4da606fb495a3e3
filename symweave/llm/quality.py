"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.common import held, release, stored, text_batches

#: Filters, bytes that a filter sees, bytes of a block; blocks of a chunk and from one chunk to the next; hidden units.
FILTERS, SPAN, BLOCK, CHUNK, STEP, HIDDEN = 16, 6, 32, 8, 4, 12
#: Labelled rows that a model is fitted on at most, and the bytes of all their texts, which the driver holds.
SAMPLE, SAMPLE_BYTES = 2000, 64_000_000
#: Blocks that are convolved at once; rows, and bytes of texts, that are laid out at once.
AT_ONCE, ROWS_AT_ONCE, BYTES_AT_ONCE = 2048, 512, 1 << 20
_OUT = np.float32(-1e9)


@dataclass
class Network:
    """tables[k][byte]: what each filter adds for a byte at offset k; two dense layers on pooled activations."""

    tables: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.w1, self.b1, self.w2, self.b2]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each padded to whole blocks; each text's first block and blocks; padding positions."""
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = (sizes + SPAN - 1) // BLOCK + 1
    first = np.cumsum(blocks) - blocks
    buffer = np.zeros(int(blocks.sum()) * BLOCK + SPAN, np.uint8)
    for t, at in zip(texts, (first * BLOCK).tolist(), strict=True):
        buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
    ends = first * BLOCK + sizes
    room = blocks * BLOCK - sizes
    padding = np.repeat(ends, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    return buffer, first, blocks, padding


def _chunks(first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end block of each chunk, and each text's first chunk and chunks. Chunks overlap and leave out nothing."""
    n = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
    start_of = np.cumsum(n) - n
    start = np.repeat(first, n) + STEP * (np.arange(n.sum()) - np.repeat(start_of, n))
    return start, np.minimum(start + CHUNK, np.repeat(first + blocks, n)), start_of, n


def _pooled(maxima: np.ndarray, net: Network, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Of each text, the mean and the maximum over its chunks of the chunk's largest activations."""
    start, end, start_of, n = _chunks(first, blocks)
    edges = np.column_stack([start, end]).ravel()
    top = np.maximum.reduceat(np.vstack([maxima, np.full((1, FILTERS), _OUT, np.float32)]), edges, axis=0)[::2]
    active = np.maximum(top + net.bias, 0)
    mean = np.add.reduceat(active.astype(np.float64), start_of, axis=0) / n[:, None]
    return np.hstack([mean, np.maximum.reduceat(active, start_of, axis=0)])


def _probability(net: Network, features: np.ndarray) -> np.ndarray:
    hidden = np.maximum(features @ net.w1 + net.b1, 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))


class Scorer:
    """A network made ready for scoring: the tables of neighbouring offsets are combined, one look-up for two bytes."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs = [(net.tables[k][:, None, :] + net.tables[k + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for k in range(0, SPAN, 2)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        buffer, first, blocks, padding = _laid_out(texts)
        total = int(blocks.sum())
        maxima = np.empty((total, FILTERS), np.float32)
        for at in range(0, total, AT_ONCE):
            a, b = at * BLOCK, min(total, at + AT_ONCE) * BLOCK
            pair = buffer[a : b + SPAN - 2].astype(np.int32) * 256 + buffer[a + 1 : b + SPAN - 1]
            z = self.pairs[0].take(pair[: b - a], axis=0)
            for k in range(1, SPAN // 2):
                z += self.pairs[k].take(pair[2 * k : b - a + 2 * k], axis=0)
            lo, hi = np.searchsorted(padding, [a, b])
            z[padding[lo:hi] - a] = _OUT
            maxima[at : at + AT_ONCE] = z.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return np.round(_probability(self.net, _pooled(maxima, self.net, first, blocks)).ravel(), 6)


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 1200, batch: int = 24, seed: int = 5) -> Network:
    """Trains on whole texts by Adam on the log loss; the same input gives the same network. One class or no rows at
    all give a network that answers with the (smoothed) share of label 1."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(
        rng.normal(0, 0.25, (SPAN, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.25, (2 * FILTERS, HIDDEN)),
        np.zeros(HIDDEN), rng.normal(0, 0.2, (HIDDEN, 1)), np.array([np.log(share / (1 - share))]),
    )
    if len(set(labels.tolist())) < 2:
        net.w2[:] = 0
        return net
    moments = [(np.zeros_like(x, np.float64), np.zeros_like(x, np.float64)) for x in net.arrays()]
    step, rounds = 0, -(-steps // -(-len(texts) // batch))
    steps = rounds * -(-len(texts) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            grads = _gradients(net, [texts[i] for i in chosen], labels[chosen])
            step += 1
            rate = 0.004 * (1 - 0.9 * step / steps)
            for x, g, (m, v) in zip(net.arrays(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(x.dtype)
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    buffer, first, blocks, padding = _laid_out(texts)
    size = int(blocks.sum()) * BLOCK
    z = net.tables[0].take(buffer[:size], axis=0)
    for k in range(1, SPAN):
        z += net.tables[k].take(buffer[k : size + k], axis=0)
    z[padding] = _OUT
    z = z.reshape(-1, BLOCK, FILTERS)
    where = z.argmax(axis=1) + (np.arange(len(z)) * BLOCK)[:, None]
    maxima = z.max(axis=1)
    start, end, start_of, n = _chunks(first, blocks)
    top = np.full((len(start), FILTERS), 2 * _OUT, np.float32)
    best = np.zeros((len(start), FILTERS), np.int64)
    for k in range(CHUNK):
        block = np.minimum(start + k, end - 1)
        better = maxima[block] > top
        top, best = np.where(better, maxima[block], top), np.where(better, where[block], best)
    active = np.maximum(top + net.bias, 0).astype(np.float64)
    mean, highest = np.add.reduceat(active, start_of, axis=0) / n[:, None], np.maximum.reduceat(active, start_of, axis=0)
    features = np.hstack([mean, highest])
    pre = features @ net.w1 + net.b1
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
    d_out = (p - labels[:, None]) / len(texts)
    d_hidden = (d_out @ net.w2.T) * (pre > 0)
    d_features = d_hidden @ net.w1.T
    owner = np.repeat(np.arange(len(texts)), n)
    d_active = d_features[owner, :FILTERS] / n[owner, None] + d_features[owner, FILTERS:] * (active == highest[owner])
    d_active *= active > 0
    d_tables = np.zeros(net.tables.shape)
    for k in range(SPAN):
        np.add.at(d_tables[k], (buffer[best + k], np.broadcast_to(np.arange(FILTERS), best.shape)), d_active)
    return [d_tables, d_active.sum(axis=0), features.T @ d_hidden + 1e-4 * net.w1, d_hidden.sum(axis=0), hidden.T @ d_out + 1e-4 * net.w2, d_out.sum(axis=0)]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, quality) to learn from: whole texts, one for each of at most sample ids, in the order of the ids'
    hashes as long as the texts together have at most sample_bytes bytes."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    texts = stored(texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size"))  # at most sample rows
    fits = sizes.withColumn("total", F.sum("size").over(so_far)).where(F.col("total") <= sample_bytes).select("doc_id")
    return texts.join(F.broadcast(fits), "doc_id")


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted on the labelled rows of training_rows(), whose parameters bound what comes to the driver.

    labels: doc_id, quality (0 or 1; rows with nulls are left out). Of an id that is labelled twice the higher label
    counts; of one with several texts, the first in their order. Null texts are empty. An empty table on either side, or
    one class alone, gives a network that answers with the share of label 1. Other columns have no part.
    """
    rows = training_rows(docs, labels, sample, sample_bytes).toPandas().sort_values("doc_id")
    net = fit([t.encode("utf-8", "surrogatepass") for t in rows["text"]], rows["quality"].to_numpy(np.int64))
    del rows
    release()
    return net


def score_quality(docs: DataFrame, net: Network, out_col: str = "score") -> DataFrame:
    """docs with out_col (0 to 1, higher: good quality likelier), from the whole text alone, however long; null is empty.

    Equal texts have equal scores, whatever rows are beside them, so repeated rows do and ties stay ties. An empty table
    gives no rows. A column of docs that is called out_col is replaced; all others stay.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    key = ("quality", net.tables.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            column, out = batch.column("text"), []
            texts: list[bytes] = []
            held_bytes = 0
            for i in range(len(column)):
                texts.append((column[i].as_py() or "").encode("utf-8", "surrogatepass"))
                held_bytes += len(texts[-1])
                if len(texts) == ROWS_AT_ONCE or held_bytes >= BYTES_AT_ONCE or i + 1 == len(column):
                    out.append(scorer.scores(texts))
                    texts, held_bytes = [], 0
            found = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out_col}` double")
