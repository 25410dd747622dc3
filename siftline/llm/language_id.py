"""Language ID by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded, filters of several widths slide over them, each filter's maximum over a window goes into a softmax.
Texts of any length are cut into fixed-length windows that overlap by a filter's width, windows of many texts run as one
batch, and a text's prediction is the mean of its windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, release, slices, small_batches, table

#: Bytes of a window. Consecutive windows share what the widest filter spans, less one, so that no place is missed.
WINDOW = 128
WIDTHS = (2, 3, 5)
FILTERS = 16
EMBED = 8
#: The bound on the labelled texts that training sees.
SAMPLE_ROWS = 4000
STEPS, BATCH, RATE = 400, 96, 0.01
#: Windows that run as one batch.
RUN_WINDOWS = 256
UNKNOWN = "und"
#: A text stays if its score is at least SLACK times the lowest that labelled texts of its length get; the lowest
#: scores are taken by powers of two of characters up to 2^LEVELS, from TRIALS stretches each of texts kept from training.
SLACK, LEVELS, TRIALS = 0.9, 12, 400
_LETTER = regex.compile(r"\p{L}")
#: ASCII in lower case; bytes that are no letters are as a space, so that a window is told by its words.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


@dataclass
class Network:
    """embed: byte by EMBED; kernels: for each width, (width * EMBED) by FILTERS, and bias; out: features by classes, and bias."""

    classes: list[str]
    params: list[np.ndarray]
    floors: tuple[float, ...] = ()

    def least(self, chars: np.ndarray, most: float) -> np.ndarray:
        """The score that a text of so many characters needs: what labelled texts of that length reach, at most `most`."""
        if not self.floors:
            return np.full(len(chars), most)
        level = np.clip(np.log2(np.maximum(chars, 1)).astype(int), 0, len(self.floors) - 1)
        return np.minimum(most, SLACK * np.array(self.floors)[level])

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """Each filter's largest activation in each window; and where, for training."""
        x = self.params[0][windows]  # n, window, embed
        n, length, e = x.shape
        pooled, kept = [], []
        for k, w in enumerate(WIDTHS):
            weight, bias = self.params[1 + 2 * k], self.params[2 + 2 * k]
            cols = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x.reshape(n, length * e), w * e, axis=1)[:, ::e])
            act = cols.reshape(-1, w * e) @ weight
            act = act.reshape(n, length - w + 1, -1)
            top = act.max(axis=1) + bias
            pooled.append(np.maximum(top, 0))
            kept.append((cols, act, top))
        return np.concatenate(pooled, axis=1), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows)[0] @ self.params[-2] + self.params[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def start(classes: list[str], rng: np.random.Generator) -> Network:
    f = np.float32
    params = [rng.normal(0, 0.5, (256, EMBED)).astype(f)]
    for w in WIDTHS:
        params += [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f)]
    n = FILTERS * len(WIDTHS)
    return Network(classes, [*params, rng.normal(0, n**-0.5, (n, len(classes))).astype(f), np.zeros(len(classes), f)])


def gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    h, kept = net.features(windows)
    z = h @ net.params[-2] + net.params[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    dz = z / z.sum(axis=1, keepdims=True)
    n = len(y)
    dz[np.arange(n), y] -= 1
    dz /= n
    grads: list[np.ndarray] = [np.zeros_like(net.params[0])]
    dh = dz @ net.params[-2].T
    for k, w in enumerate(WIDTHS):
        cols, act, top = kept[k]
        d = dh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
        at = act.argmax(axis=1)  # n, filters
        picked = np.take_along_axis(cols, at[:, :, None], axis=1)  # n, filters, width * embed
        grads += [np.einsum("nfe,nf->ef", picked, d).astype(np.float32), d.sum(axis=0)]
        back = d[:, :, None] * net.params[1 + 2 * k].T[None]
        for j in range(w):
            np.add.at(grads[0], np.take_along_axis(windows, at + j, axis=1), back[:, :, j * EMBED : (j + 1) * EMBED])
    return [*grads, h.T @ dz, dz.sum(axis=0)]


def cut(data: bytes) -> np.ndarray:
    """All windows of a text: (n, WINDOW), short ones filled with spaces."""
    x = _FOLD[np.frombuffer(data, np.uint8)]
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(x) - WINDOW) // step) + 1)
    out = np.full(step * (n - 1) + WINDOW, 32, np.uint8)
    out[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::step]


def train(texts: list[str], langs: list[str], seed: int = 7) -> Network | None:
    """Adam over windows drawn at random from texts drawn at random; none where there is nothing to learn from."""
    rows = [(t.encode("utf-8", "replace"), y) for t, y in zip(texts, langs, strict=True) if _LETTER.search(t)]
    classes = sorted({y for _, y in rows})
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    net = start(classes, rng)
    windows = [cut(t) for t, _ in rows]
    labels = np.array([classes.index(y) for _, y in rows])
    by_class = [np.flatnonzero(labels == k) for k in range(len(classes))]
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    for step in range(1, STEPS + 1):
        y = rng.integers(len(classes), size=BATCH)
        row = [int(rng.choice(by_class[k])) for k in y]
        x = np.stack([windows[r][rng.integers(len(windows[r]))] for r in row]).astype(np.int64)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for p, g, a, b in zip(net.params, gradients(net, x, y), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def floors(net: Network, texts: list[str], seed: int = 5) -> tuple[float, ...]:
    """The lowest score of stretches of 2^k characters, for each k up to LEVELS; never lower for more characters."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if _LETTER.search(t)]
    out: list[float] = []
    for k in range(LEVELS + 1):
        cuts = []
        for _ in range(TRIALS if texts else 0):
            t = texts[int(rng.integers(len(texts)))]
            n = 2**k
            a = int(rng.integers(max(1, len(t) - n)))
            if _LETTER.search(t[a : a + n]):
                cuts.append(t[a : a + n])
        low = min(predict_batch(net, cuts)[1], default=0.0)
        out.append(max(low, out[-1] if out else 0.0))
    return tuple(out)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled texts (columns text, lang): those with the smallest hashes, each once, with the language that
    most of its rows name (of several, the alphabetically first), sorted by hash.

    The share of hashes to look at follows from a count of labels, so that tasks send little more than what is used,
    however many there are. Where texts repeat, fewer than `rows` may come of it.
    """
    labelled = labelled.filter(F.col("lang").isNotNull())
    share = 1.25 * rows / max(1, labelled.select("lang").count())
    return (
        labelled.filter(F.col("text").isNotNull())
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .withColumn("h", F.xxhash64("text"))
        .filter(F.col("h") < F.lit(int(-(2**63) + min(share, 1) * (2**64 - 2048))))
        .groupBy("h", "lang")
        .agg(F.count("*").alias("n"), F.min("text").alias("text"))
        .groupBy("h")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "lang", "text")).alias("row"))
        .orderBy("h")
        .limit(rows)
        .select("row.text", "row.lang")
    )


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Network | None:
    """labelled: columns text and lang. Rows without either are left out; null where none is left.

    Training runs in one task, over the sample alone; the driver gets the weights.
    """
    small_batches(labelled.sparkSession)

    def run(batches):
        texts, langs = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            langs += b.column(1).to_pylist()
        kept = slice(4, None, 5) if len(texts) >= 50 else slice(0, 0)  # a fifth tells what scores to expect
        apart = set(range(len(texts))[kept])
        net = train([t for i, t in enumerate(texts) if i not in apart], [y for i, y in enumerate(langs) if i not in apart], seed)
        if net:
            data, low = [p.tobytes() for p in net.params], list(floors(net, texts[kept])) if apart else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([net.classes], pa.list_(pa.string())), pa.array([data], pa.list_(pa.binary())), pa.array([[list(p.shape) for p in net.params]], pa.list_(pa.list_(pa.int32()))), pa.array([low], pa.list_(pa.float64()))],
                ["classes", "params", "shapes", "floors"],
            )

    got = sample(labelled, rows).coalesce(1).mapInArrow(run, "classes array<string>, params array<binary>, shapes array<array<int>>, floors array<double>").collect()
    if not got:
        return None
    return Network(list(got[0]["classes"]), [np.frombuffer(bytes(p), np.float32).reshape(s) for p, s in zip(got[0]["params"], got[0]["shapes"], strict=True)], tuple(got[0]["floors"]))


def predict_batch(net: Network | None, texts: list[str]) -> tuple[list[str], list[float]]:
    lettered = [i for i, t in enumerate(texts) if net and _LETTER.search(t)]
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not lettered:
        return lang, score
    n = len(net.classes)
    total = np.zeros((len(texts), n))
    weight = np.zeros(len(texts))
    held, rows, size = [], [], 0

    def run():
        w, r = np.concatenate(held), np.concatenate(rows)
        for a in range(0, len(w), RUN_WINDOWS):
            part = w[a : a + RUN_WINDOWS]
            letters = (part != 32).sum(axis=1)
            p = net.probabilities(part) * letters[:, None]
            for k in range(n):
                total[:, k] += np.bincount(r[a : a + RUN_WINDOWS], p[:, k], len(texts))
            weight[:] += np.bincount(r[a : a + RUN_WINDOWS], letters, len(texts))

    for i in lettered:
        w = cut(texts[i].encode("utf-8", "replace"))
        held.append(w)
        rows.append(np.full(len(w), i))
        size += len(w)
        if size >= 16 * RUN_WINDOWS:
            run()
            held, rows, size = [], [], 0
    if held:
        run()
    for i in lettered:
        p = total[i] / max(weight[i], 1)
        best = int(p.argmax())
        lang[i], score[i] = net.classes[best], min(1.0, float(p[best]))
    return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score (0 to 1) of each whole text.

    Null texts, texts without a letter, and all texts where the network is null: `und` and 0. Of languages with equal
    scores the alphabetically first wins. Repeated rows stay repeated; equal texts have equal results up to rounding.
    """

    def make() -> Callable[[list[str]], dict]:
        def run(texts: list[str]) -> dict:
            lang, score = predict_batch(net, texts)
            return {"lang_pred": lang, "score": score}

        return run

    return map_texts(docs, make, "lang_pred string, score double", id_col, text_col)


def keep_known(docs: DataFrame, net: Network | None, most: float, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, but those of no known language: without a letter, or with a lower score than a text as
    long gets where its language is known (see Network.least); a score of `most` is always enough. Where there is no
    network, all texts with a letter stay."""
    small_batches(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                texts = [t or "" for t in b.column(text_col).to_pylist()]
                if net is None:
                    yield b.filter(pa.array([bool(_LETTER.search(t)) for t in texts], pa.bool_()))
                    continue
                lang, score = predict_batch(net, texts)
                known = np.array([x != UNKNOWN for x in lang], bool)
                yield b.filter(pa.array(known & (np.array(score) >= net.least(np.array([len(t) for t in texts]), most))))
        release()

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0).select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(training_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
