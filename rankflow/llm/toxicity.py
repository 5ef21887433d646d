"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of learned rows for the hash of the word and of its prefixes, so that
forms of one stem share weight. Filters of several widths slide over the words; each filter's
largest answer and its mean answer in a segment feed a logistic layer. A text is scored in segments of
bounded length, all of them, so that long and short texts meet the same kind of input; its
score is the mean of its segments' log odds.

The threshold is calibrated for each language on all labelled rows that are neither held out nor part of
the fit: Spark counts them by language, label and bin of log odds, and the counts are weighted to the
mix of classes that all labelled rows have. Language is guessed from the function words in the text,
so that no column but the text enters a score. Scores are shifted so that every language's threshold
becomes 0.7.

The fit uses a bounded sample of labelled rows (``max_rows`` of each class); it runs on the driver in
time that does not depend on the size of the corpus. A quarter of the labelled rows never enters it.
Calibration and scoring are maps over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.session import ready, released
from rankflow.llm.text_arrays import Words, constants, mix, slices, words

THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
WIDTHS = (1, 2, 3)
SEGMENT = 256
_BITS = 16
#: Bins of log odds in calibration: how many in a unit, and the value at which they end on both sides.
BINS, BIN_LIMIT = 128, 64

# Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that with for was are this by from",
    "es": "el los las del y que por con una para su lo",
    "de": "der die das und den von mit ist nicht ein eine dem des",
    "fr": "le les et des du est dans pour que une sur pas au",
}
LANGUAGES = tuple(FUNCTION_WORDS)


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    words: list[np.ndarray]
    scale: float = 1.0


def _function_words() -> list[np.ndarray]:
    lists = [pa.array([FUNCTION_WORDS[name]]) for name in LANGUAGES]
    return [np.sort(words(x).hashes) for x in lists]


def word_rows(found: Words) -> np.ndarray:
    """Rows of the embedding table for every word: the word, then its prefixes (in bytes)."""
    n = len(found.hashes)
    out = np.empty((n, 1 + len(PREFIXES)), np.uint16)
    out[:, 0] = found.hashes >> np.uint64(64 - _BITS)
    size = found.ends - found.starts
    value = np.zeros(n, np.uint64)
    last = len(found.data) - 1
    for j, key in enumerate(constants(PREFIXES[-1], 20)):
        there = size > j
        byte = found.data[np.minimum(found.starts + j, last)].astype(np.uint64)
        value += np.where(there, (byte + np.uint64(1)) * key, np.uint64(0))
        if j + 1 in PREFIXES:
            hashed = mix(value + np.uint64(j)) >> np.uint64(64 - _BITS)
            # a word shorter than the prefix has no further feature: row 0 stays zero
            out[:, 1 + PREFIXES.index(j + 1)] = np.where(size > j, hashed, 0)
    return out


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of equal segments of at most SEGMENT words, and the row each belongs to."""
    n = np.diff(offsets)
    counts = -(-n // SEGMENT)
    row = np.repeat(np.arange(len(n)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[row] + n[row] * place // np.maximum(counts[row], 1)
    return starts, row


def _embed(model: Model, rows: np.ndarray) -> np.ndarray:
    out = model.table[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        out += model.table[rows[:, j]]
    return out


def _answers(model: Model, embedded: np.ndarray, starts: np.ndarray):
    """Filter answers at every word; a filter sees zeros past the end of its segment."""
    n = len(embedded)
    ends = np.append(starts[1:], n)
    outs = []
    for width, weight in zip(WIDTHS, model.filters, strict=True):
        z = embedded @ weight[0]
        for j in range(1, width):
            z[:-j] += embedded[j:] @ weight[j]
        for j in range(1, width):  # the last words of a segment must not see the next one
            for k in range(j, width):
                at = ends - j
                at = at[(at >= starts) & (at + k < n)]
                z[at] -= embedded[at + k] @ weight[k]
        outs.append(z)
    z = np.concatenate(outs, axis=1)
    z += model.bias
    np.maximum(z, 0, out=z)
    return z


def _pool(z: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.append(starts, len(z)))[:, None]
    return np.maximum.reduceat(z, starts), np.add.reduceat(z, starts) / size


def segment_logits(model: Model, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log odds of every segment, a bounded number of words at a time."""
    out = np.empty(len(starts), np.float64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 16384)))
        high = starts[to] if to < len(starts) else len(rows)
        local = starts[at:to] - starts[at]
        z = _answers(model, _embed(model, rows[starts[at] : high]), local)
        top, mean = _pool(z, local)
        f = z.shape[1]
        out[at:to] = top @ model.weights[:f] + mean @ model.weights[f : 2 * f] + model.weights[-1]
        at = to
    return out


def text_logits(model: Model, found: Words) -> np.ndarray:
    """Mean log odds of the segments of each row; a row without a word has those of the bias."""
    out = np.full(len(found.offsets) - 1, float(model.weights[-1]))
    if len(found.hashes):
        starts, row = segments(found.offsets)
        value = segment_logits(model, word_rows(found), starts)
        n = np.bincount(row, minlength=len(out))
        total = np.bincount(row, value, minlength=len(out))
        out[n > 0] = total[n > 0] / n[n > 0]
    return out


def languages(model: Model, found: Words) -> np.ndarray:
    """The language with the most function words in each row; the first one on a tie."""
    counts = []
    row = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    for known in model.words:
        at = np.minimum(np.searchsorted(known, found.hashes), len(known) - 1)
        counts.append(np.bincount(row[known[at] == found.hashes], minlength=len(found.offsets) - 1))
    return np.argmax(np.stack(counts), axis=0)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    found = words(texts)
    logit = text_logits(model, found) * model.scale - model.shift[languages(model, found)]
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.step = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def update(self, grad: np.ndarray) -> None:
        self.step += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        m, v = self.m / (1 - 0.9**self.step), self.v / (1 - 0.99**self.step)
        self.value -= self.rate * m / (np.sqrt(v) + 1e-6)


def _parts(texts: Iterable[str], max_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``max_chars``, so that work arrays stay small on the driver."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= max_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _segmented(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of all words, first words of all segments, and the text each belongs to."""
    rows, starts, row = [np.zeros((0, 1 + len(PREFIXES)), np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n_words = n_texts = 0
    for part in _parts(texts):
        found = words(pa.array(part, pa.string()))
        first, text = segments(found.offsets)
        rows.append(word_rows(found))
        starts.append(first + n_words)
        row.append(text + n_texts)
        n_words, n_texts = n_words + len(found.hashes), n_texts + len(part)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(row)


def fit_network(
    texts: Iterable[str], labels: np.ndarray, dim: int = 8, filters: int = 8, epochs: int = 6,
    batch_segments: int = 64, seed: int = 5,
) -> Model:
    """Train on whole texts, cut into segments that carry their text's label; texts are read once."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (1 << _BITS, dim)).astype(np.float32)
    table[0] = 0
    n_f = filters * len(WIDTHS)
    model = Model(
        table,
        [rng.normal(0, (2 / (w * dim)) ** 0.5, (w, dim, filters)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_f, np.float32),
        rng.normal(0, 0.2, 2 * n_f + 1).astype(np.float32),
        np.zeros(len(LANGUAGES)),
        _function_words(),
    )
    model.weights[-1] = 0
    rows, starts, row = _segmented(texts)
    if not len(starts) or len(np.unique(labels)) < 2:
        model.weights[:] = 0
        return model
    ends = np.append(starts[1:], len(rows))
    y = labels[row].astype(np.float32)
    weight = (1 / np.bincount(row, minlength=len(labels)))[row].astype(np.float32)
    weight /= weight.mean()
    dense = [_Adam(x, 0.01) for x in (*model.filters, model.bias, model.weights)]
    squares = np.zeros(len(table), np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(starts))
        for low in range(0, len(order), batch_segments):
            pick = order[low : low + batch_segments]
            size = ends[pick] - starts[pick]
            first = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(starts[pick] - first, size)
            local = rows[at]
            embedded = _embed(model, local)
            z = _answers(model, embedded, first)
            top, mean = _pool(z, first)
            logit = top @ model.weights[:n_f] + mean @ model.weights[n_f : 2 * n_f] + model.weights[-1]
            error = (1 / (1 + np.exp(-logit)) - y[pick]) * weight[pick] / len(pick)
            g_weights = np.concatenate([top.T @ error, mean.T @ error, [error.sum()]]).astype(np.float32)
            segment = np.repeat(np.arange(len(pick)), size)
            g_z = (np.outer(error, model.weights[n_f : 2 * n_f]) / size[:, None])[segment]
            g_top = np.outer(error, model.weights[:n_f])
            where, which = np.nonzero((z == top[segment]) & (z > 0))
            g_z[where, which] += g_top[segment[where], which]
            g_z = np.where(z > 0, g_z, 0).astype(np.float32)
            g_embedded = np.zeros_like(embedded)
            grads = []
            for i, width in enumerate(WIDTHS):
                own = g_z[:, i * filters : (i + 1) * filters]
                g_w = np.zeros_like(model.filters[i])
                for j in range(width):
                    ok = np.flatnonzero(np.arange(len(at)) + j < (first + size)[segment])
                    g_w[j] = embedded[ok + j].T @ own[ok]
                    g_embedded[ok + j] += own[ok] @ model.filters[i][j].T
                grads.append(g_w)
            for param, grad in zip(dense, [*grads, g_z.sum(axis=0), g_weights], strict=True):
                param.update(grad + 1e-5 * param.value)
            _update_table(model.table, squares, local, g_embedded)
    return model


def _update_table(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """One Adagrad step on the rows that the batch used."""
    used, slot = np.unique(rows, return_inverse=True)
    slot = slot.reshape(rows.shape)
    total = np.zeros((len(used), table.shape[1]), np.float32)
    for c in range(table.shape[1]):
        column = grad[:, c]
        total[:, c] = sum(
            np.bincount(slot[:, j], column, minlength=len(used)) for j in range(rows.shape[1])
        )
    total[used == 0] = 0
    squares[used] += (total * total).mean(axis=1)
    table[used] -= 0.05 * total / (np.sqrt(squares[used]) + 1e-6)[:, None]


def _best_threshold(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut between bins with the highest F1, in the middle of the gap below it."""
    values, slot = np.unique(-bins, return_inverse=True)
    everything = np.cumsum(np.bincount(slot, weights))
    hits = np.cumsum(np.bincount(slot, weights * labels))
    k = int(np.argmax(2 * hits / (everything + hits[-1])))
    low = -values[k] / BINS
    below = (1 - values[k + 1]) / BINS if k + 1 < len(values) else low - 1
    return float(low + below) / 2


def calibrate(
    model: Model, lang: np.ndarray, bins: np.ndarray, labels: np.ndarray, seen: np.ndarray, n: np.ndarray,
    min_rows: int = 30,
) -> None:
    """Set the languages' thresholds from counts ``n`` of labelled rows.

    Rows that the fit has ``seen`` count only for the mix of classes; the others are weighted to it. A
    language with fewer than ``min_rows`` unseen positive rows takes the common threshold. Without unseen
    rows of both classes every text without a word scores below the threshold.
    """
    odds = np.log(THRESHOLD / (1 - THRESHOLD))

    def cut(own: np.ndarray, least: int) -> float | None:
        weights = np.zeros(len(n))
        for c in (0, 1):
            of_class = own & (labels == c)
            unseen = of_class & ~seen
            if n[unseen].sum() < (least if c else 1):
                return None
            weights[unseen] = n[unseen] * (n[of_class].sum() / n[unseen].sum())
        there = weights > 0
        return _best_threshold(bins[there], labels[there], weights[there]) - odds

    common = cut(np.ones(len(n), bool), 1) if model.weights.any() else None
    model.shift[:] = 1 - odds if common is None else common
    if common is not None:
        for i in range(len(LANGUAGES)):
            own = cut(lang == i, min_rows)
            model.shift[i] = common if own is None else own


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_chars: int = 16_000_000) -> Model:
    """Fit on labelled rows that are not held out: at most ``max_rows`` of each class, whole texts.

    The sample is the rows with the least hash of doc_id, one text for each doc_id. A text that would take
    its class beyond half of ``max_chars`` is passed over and later ones are still taken, so that neither
    class nor a long text crowds out others. Texts are streamed to the driver, which keeps only their
    word rows. All other labelled rows that are not held out calibrate the thresholds. Repeated labels
    of a document count as 1 if any of them is 1; null labels, ids and texts are left out.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit(3))
    pool = labels.where(F.pmod(F.shiftright(draw, 8), F.lit(4)) != 0)
    picked = [pool.where(F.col("toxic") == c).orderBy(draw, "doc_id").limit(max_rows) for c in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 max_rows rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(text) > 0")
    sample = _within(texts.join(picked, "doc_id"), max_chars // 2)
    model = fit_network(_stream(texts, sample), np.array([toxic for _, _, toxic in sample], np.int64))
    calibrate(model, *_label_counts(texts, labels, model, [i for i, _, _ in sample]))
    return model


def _within(rows: DataFrame, class_chars: int) -> list[tuple[int, int, int]]:
    """(doc_id, hash of the text, label) of the rows in order of draw that fit into the bound of their class."""
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n"))).alias("one")
    sizes = rows.groupBy("doc_id", "toxic").agg(one).withColumn("draw", F.xxhash64("doc_id", F.lit(3)))
    left, out = {0: class_chars, 1: class_chars}, []
    for r in sorted(sizes.collect(), key=lambda r: (r["draw"], r["doc_id"])):  # one row for each picked label
        if r["one"]["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["one"]["n"]
            out.append((r["doc_id"], r["one"]["hash"], r["toxic"]))
    return out


def _stream(texts: DataFrame, sample: list[tuple[int, int, int]]) -> Iterator[str]:
    """The texts of the sample in its order, a partition at a time."""
    rows = [(i, doc_id, value) for i, (doc_id, value, _) in enumerate(sample)]
    wanted = texts.sparkSession.createDataFrame(rows, "place long, doc_id long, hash long")
    found = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "hash"])
    for r in found.dropDuplicates(["place"]).orderBy("place").select("text").toLocalIterator():
        yield r["text"]


def _label_counts(texts: DataFrame, labels: DataFrame, model: Model, fitted: list[int]) -> list[np.ndarray]:
    """Language, bin of log odds, label, whether the fit saw it, and number of the labelled rows.

    Texts are scored where they lie, and only their bins are shuffled to the labels.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    unheld = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    scored = unheld.mapInArrow(released(_bin_rows(sent)), "doc_id long, lang int, bin int")
    seen = spark.createDataFrame([(i, True) for i in fitted], "doc_id long, seen boolean")  # at most the sample
    rows = scored.join(labels, "doc_id").join(F.broadcast(seen), "doc_id", "left")
    columns = ["lang", "bin", "toxic", F.coalesce("seen", F.lit(False)).alias("seen")]
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the bins
    counts.sort()
    kinds = (np.int64, np.int64, np.int64, bool, np.int64)
    return [np.array([r[i] for r in counts], kind) for i, kind in enumerate(kinds)]


def _bin_rows(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = words(batch.column("text"))
                logit = np.clip(text_logits(model.value, found), -BIN_LIMIT, BIN_LIMIT)
                lang = pa.array(languages(model.value, found), pa.int32())
                bins = pa.array(np.floor(logit * BINS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, bins], names=["doc_id", "lang", "bin"])

    return run


def _score_rows(model: Broadcast, keep: list[str], below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                value = scores(model.value, batch.column("text"))
                if below is not None:
                    yield batch.filter(pa.array(value < below))
                else:
                    columns = [batch.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=[*keep, "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts get the score of a text without a word. Repeated rows and rows with a null
    doc_id are scored like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(train(docs, labels, **sample))
    scored = docs.mapInArrow(released(_score_rows(model, ["doc_id"], None)), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; nothing is shuffled.

    ``labelled`` holds the texts of the labels; it may be ``docs`` itself.
    """
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(train(labelled, labels, **sample))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return docs.mapInArrow(released(_score_rows(model, [], THRESHOLD)), schema)
