"""Quality by a byte-level convolutional network in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes slide over the whole text. Their responses are max-pooled over
overlapping chunks (``CHUNK`` bytes, every ``STEP`` bytes); a document's features are the mean and the maximum over
its chunks, which one logistic unit combines into a probability. A filter is a table of byte weights per position,
so a response is a sum of WIDTH look-ups.

Trained by Adam on a sample of labelled rows outside the held-out fold, bounded in rows (``SAMPLE``), one per id; scoring runs in
tasks. Both take whole texts, in slices of bounded memory.

Defined results: null and empty texts are one chunk of zero bytes. Texts shorter than a filter are padded with zero bytes.
Rows with null ids are scored and are not held out. Without labelled rows every score is 0.5. Repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, training_sample, whole_text

SAMPLE = 2000  # labelled rows that the network is fitted on
FILTERS, WIDTH, STEP, CHUNK = 8, 5, 256, 512  # CHUNK is two STEPs, so that neighbours overlap by half
EPOCHS, RATE, SEED = 4, 0.03, 11
SLICE = 1 << 18  # bytes whose responses are held at once; a multiple of STEP


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    unit: np.ndarray  # 2 * FILTERS weights and one bias
    fitted: bool = True


def as_bytes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    return raw if len(raw) >= WIDTH else np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])


def responses(net: Network, raw: np.ndarray) -> np.ndarray:
    """Filter responses at every position."""
    n = len(raw) - WIDTH + 1
    out = net.tables[0][raw[:n]]
    for j in range(1, WIDTH):
        out += net.tables[j][raw[j : j + n]]
    return out


def steps(net: Network, raw: np.ndarray) -> np.ndarray:
    """The largest response of each run of STEP positions, slice by slice."""
    found = []
    for at in range(0, len(raw) - WIDTH + 1, SLICE):
        part = responses(net, raw[at : at + SLICE + WIDTH - 1])
        found.append(np.maximum.reduceat(part, np.arange(0, len(part), STEP), axis=0))
    return np.concatenate(found)


def chunks(best: np.ndarray) -> np.ndarray:
    """The largest response of each chunk of two neighbouring runs; a single run is a chunk."""
    return np.maximum(best[:-1], best[1:]) if len(best) > 1 else best


def score(net: Network, text: str | None) -> float:
    """The probability of label 1."""
    if not net.fitted:
        return 0.5
    pooled = np.maximum(chunks(steps(net, as_bytes(text))) + net.bias, 0)
    x = float(np.concatenate([pooled.mean(0), pooled.max(0), [1.0]]) @ net.unit)
    return 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def _peaks(net: Network, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the largest response of each run of STEP positions, slice by slice."""
    spots, values = [], []
    for at in range(0, len(raw) - WIDTH + 1, SLICE):
        part = responses(net, raw[at : at + SLICE + WIDTH - 1])
        for s in range(0, len(part), STEP):
            run = part[s : s + STEP]
            best = run.argmax(0)
            spots.append(best + (at + s))
            values.append(run[best, np.arange(FILTERS)])
    return np.stack(spots), np.stack(values)


def _gradient(net: Network, raw: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spots, values = _peaks(net, raw)
    col = np.arange(FILTERS)
    if len(spots) > 1:
        first = values[:-1] >= values[1:]
        spots, values = np.where(first, spots[:-1], spots[1:]), np.where(first, values[:-1], values[1:])
    raw_pool = values + net.bias
    pooled, top = np.maximum(raw_pool, 0), raw_pool.argmax(0)
    x = np.concatenate([pooled.mean(0), pooled.max(0), [1.0]])
    off = 1 / (1 + np.exp(-np.clip(x @ net.unit, -30, 30))) - y
    back = np.tile(off * net.unit[:FILTERS] / len(pooled), (len(pooled), 1))
    back[top, col] += off * net.unit[FILTERS : 2 * FILTERS]
    back *= raw_pool > 0
    tables = np.zeros_like(net.tables)
    for j in range(WIDTH):
        np.add.at(tables[j], (raw[spots + j], np.broadcast_to(col, spots.shape)), back)
    return tables, back.sum(0), off * x


def train(texts: list[str], labels: list[float]) -> Network:
    """A network fitted to the given texts; the order of the rows is shuffled with a fixed seed."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS + 1))
    if not texts:
        return Network(net.tables, net.bias, net.unit, False)
    rate = min(max(float(np.mean(labels)), 0.01), 0.99)
    net.unit[-1] = np.log(rate / (1 - rate))
    raws, names = [as_bytes(t) for t in texts], ("tables", "bias", "unit")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    done, batch = 0, 16
    for _ in range(max(EPOCHS, -(-EPOCHS * 500 // len(raws)))):  # small samples are gone through more often
        order = rng.permutation(len(raws))
        for at in range(0, len(order), batch):
            picked, done = order[at : at + batch], done + 1
            parts = [_gradient(net, raws[i], labels[i]) for i in picked]
            for k, name in enumerate(names):
                g = sum(p[k] for p in parts) / len(picked)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                change = RATE * (first[name] / (1 - 0.9**done)) / (np.sqrt(second[name] / (1 - 0.999**done)) + 1e-8)
                setattr(net, name, (getattr(net, name) - change).astype(getattr(net, name).dtype))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted to about ``sample`` labelled rows at most, which the driver holds, in the order of their ids.

    Of the rows that repeat an id one is taken, the first by a hash of its text, so that the sample is bounded in rows. Texts are
    whole, as they are in scoring; slices bound the memory that a long one takes beside itself.
    """
    rows = training_sample(docs, labels, label, sample)
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["label"].astype(float).tolist())


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    net = fit(docs, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score(net, t) for t in texts], dtype="float64")

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(whole_text()).alias("score"))
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
