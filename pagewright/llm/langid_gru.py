"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its UTF-8 bytes with ASCII letters in lower case and every run of other ASCII
bytes as one space.  The network runs over windows that cover the whole text: ``SPAN``
bytes each, with ``CONTEXT`` bytes of their neighbours on either side, so states cross
words and window borders.  At every byte the forward and backward states give a
distribution over the languages; a document's probabilities are the normalised geometric
mean of these over all its bytes.  As the distributions are softmaxes of linear outputs,
that mean is the softmax of the outputs of the mean state, which is what is summed.

Training is numpy, by backpropagation through time with Adam and a fixed seed, on at most
``DOCS`` different rows of each language (those with the smallest hashes of id and text)
and the whole of their texts, as many in that order as fit into ``BYTES`` bytes; texts of more
than an eighth of that are not learned from.  At most ``LANGS`` languages are learned, those with
the most rows (of equal numbers the first by name).  Languages weigh alike.

``label_spans`` gives the labels of all bytes, as spans of the text of one language each.

Defined cases: texts that are null or have no letter get ``und`` and score 0; null
languages and null ids are not learned from; without any learned language all rows are
``und``; a text's result does not depend on the texts beside it, but for rounding in single
precision; rows equal in id and text are learned from once; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_fold, let_go, sole_memory, trimmed

UND = "und"
HIDDEN = 16
SPAN, CONTEXT, SIDE_BY_SIDE = 256, 16, 2048  # bytes of a window, on either side of it, windows at a time
STEPS, BATCH, RATE, EPOCHS = 96, 256, 0.01, 1  # in training, windows are of STEPS bytes and their context
LEAST_BATCHES = 250  # few windows are gone over more often
DOCS, BYTES, LANGS = 200, 8 << 20, 500  # of the sample, at most: different rows and bytes of each language, and languages
_plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_letter = regex.compile(r"\p{L}")
CHUNK = 1 << 19
DIRECTIONS = ("f", "b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]


def initial(langs: Sequence[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    p = {}
    for d in DIRECTIONS:
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))  # a row a byte: input weights with their bias
        p[f"u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h))
        p[f"c{d}"] = np.zeros(h)
    p["out"] = rng.normal(0, 0.1, (2 * h, len(langs)))
    p["bias"] = np.zeros(len(langs))
    return Model(list(langs), {k: v.astype(np.float32) for k, v in p.items()})


def _run(x: np.ndarray, p: dict, d: str, keep: list | None = None) -> np.ndarray:
    """States after each step, (steps, sequences, HIDDEN), over bytes (sequences, steps) in the direction's order."""
    n, steps = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    table, u, c = p[f"x{d}"], p[f"u{d}"], p[f"c{d}"]
    for t in range(steps):
        a = table[x[:, t]]
        hu = h @ u
        zr = _sigmoid(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        hn = hu[:, 2 * HIDDEN :] + c
        new = np.tanh(a[:, 2 * HIDDEN :] + r * hn)
        if keep is not None:
            keep.append((h, z, r, hn, new))
        h = new + z * (h - new)
        out[t] = h
    return out


def _softmax(y: np.ndarray) -> np.ndarray:
    e = np.exp(y - y.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Language probabilities at every byte: (sequences, steps, languages)."""
    p = model.params
    both = np.concatenate([_run(x, p, "f"), _run(x[:, ::-1], p, "b")[::-1]], 2)
    return _softmax(both @ p["out"] + p["bias"]).transpose(1, 0, 2)


def gradients(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions (sequences may weigh differently), and its gradient by backpropagation through time."""
    p = model.params
    n, steps = x.shape
    weight = np.ones(n, np.float32) if weight is None else weight
    kept = {d: [] for d in DIRECTIONS}
    hf, hb = _run(x, p, "f", kept["f"]), _run(x[:, ::-1], p, "b", kept["b"])
    both = np.concatenate([hf, hb[::-1]], 2)
    prob = _softmax(both @ p["out"] + p["bias"])
    loss = float((-np.log(prob[:, np.arange(n), y] + 1e-9) * weight).mean())
    dy = prob
    dy[:, np.arange(n), y] -= 1
    dy *= (weight / (n * steps))[:, None]
    flat = dy.reshape(steps * n, -1)
    g = {"out": both.reshape(steps * n, -1).T @ flat, "bias": flat.sum(0)}
    dboth = dy @ p["out"].T
    for d, dh_all, seq in (("f", dboth[:, :, :HIDDEN], x), ("b", dboth[::-1, :, HIDDEN:], x[:, ::-1])):
        gu, gc = np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"c{d}"])
        u = p[f"u{d}"]
        dh = np.zeros((n, HIDDEN), p["out"].dtype)
        da_all = np.empty((steps, n, 3 * HIDDEN), p["out"].dtype)
        for t in range(steps - 1, -1, -1):
            h, z, r, hn, new = kept[d][t]
            dh = dh + dh_all[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dhn = dnew * r
            dr = dnew * hn * r * (1 - r)
            da_all[t] = np.concatenate([dz, dr, dnew], 1)
            dhu = np.concatenate([dz, dr, dhn], 1)
            gu += h.T @ dhu
            gc += dhn.sum(0)
            dh = dh * z + dhu @ u.T
        # a byte's row gets the sum over all places of that byte
        byte = seq.T.ravel()
        order = np.argsort(byte, kind="stable")
        met, first = np.unique(byte[order], return_index=True)
        gx = np.zeros_like(p[f"x{d}"])
        gx[met] = np.add.reduceat(da_all.reshape(steps * n, -1)[order], first)
        g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
    return loss, g


def spelled(text: str | None) -> bytes:
    """What the network reads of a text, with a space at either end."""
    return b" " + b" ".join((text or "").encode("utf-8", "replace").translate(_plain).split()) + b" "


def windows(raw: bytes, span: int = SPAN, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(windows, span + 2 context) bytes that cover raw, spaces beyond its ends, and how many bytes of each window's middle count."""
    n = -(-len(raw) // span)
    padded = np.full(n * span + 2 * context, 32, np.uint8)
    padded[context : context + len(raw)] = np.frombuffer(raw, np.uint8)
    counts = np.full(n, span)
    counts[-1] = len(raw) - (n - 1) * span
    return np.lib.stride_tricks.sliding_window_view(padded, span + 2 * context)[::span], counts


def fit(samples: Sequence[tuple[str, str | None]], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """samples: language and whole text of each document."""
    langs = sorted({lang for lang, _ in samples})
    model = initial(langs, seed)
    if len(langs) < 2:
        return model
    parts = [(windows(spelled(text), STEPS, CONTEXT)[0], langs.index(lang)) for lang, text in samples]
    x = np.concatenate([w for w, _ in parts])
    y = np.repeat([k for _, k in parts], [len(w) for w, _ in parts])
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weight = (1 / (share[y] * len(langs))).astype(np.float32)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.params.items()}
    per_epoch = -(-len(x) // BATCH)
    epochs = max(epochs, -(-LEAST_BATCHES // per_epoch))
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            pick = order[k : k + BATCH]
            _, g = gradients(model, x[pick], y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - 0.95 * step / total)
            for name, grad in g.items():
                m1, m2 = moments[name]
                grad = np.clip(grad, -1, 1)
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                model.params[name] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


class Pooler:
    """Pooled probabilities of documents.

    A state h is held as q = (1 - h) / 2 and a logistic function as the 1 + exp(-x) that divides by it, so a step
    is exponentials, sums and quotients; the signs and constants of that are folded into the weights once.  The
    gates are the first axis of all arrays, so every operation goes over consecutive numbers.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.weights = model, {}
        for d in DIRECTIONS:
            x, u = (model.params[k + d].astype(float).reshape(-1, 3, HIDDEN).transpose(1, 0, 2) for k in "xu")
            ones = u.sum(1)  # what a state of all ones adds
            table = np.stack([-(x[0] + ones[0]), -(x[1] + ones[1]), 2 * x[2]])
            self.weights[d] = tuple(np.ascontiguousarray(w, np.float32) for w in (table, u * np.array([2, 2, -4])[:, None, None], 2 * (ones[2] + model.params[f"c{d}"])))

    def _sums(self, x: np.ndarray, counts: np.ndarray, d: str) -> np.ndarray:
        """The sum of states over each sequence's counted steps, those behind its first CONTEXT; x is (steps, sequences), the longest first."""
        table, u, c = self.weights[d]
        n, k = len(counts), HIDDEN
        q, total = np.full((n, k), 0.5, np.float32), np.zeros((n, k), np.float32)
        inputs, passed = np.empty(3 * n * k, np.float32), np.empty(3 * n * k, np.float32)
        scratch, const = np.empty((n, k), np.float32), np.tile(c, (n, 1))
        goes_on = np.searchsorted(-counts, CONTEXT - np.arange(len(x)), "left")  # how many sequences have a step t
        now = 0
        with np.errstate(over="ignore"):  # an infinite divisor is a gate of 0
            for t, going in enumerate(goes_on.tolist()):
                if going != now:
                    now = going
                    a, b = (held[: 3 * now * k].reshape(3, now, k) for held in (inputs, passed))
                    gates, state, summed, new = b[:2], q[:now], total[:now], scratch[:now]
                np.take(table, x[t, :now], 1, a, "clip")
                np.matmul(state, u, b)
                gates += a[:2]
                np.exp(gates, gates)
                gates += 1
                np.add(b[2], const[:now], new)
                new /= b[1]
                new += a[2]
                np.exp(new, new)
                new += 1
                np.reciprocal(new, new)
                state -= new
                state /= b[0]
                state += new
                if t >= CONTEXT:
                    summed += state
        return counts[:, None] - 2 * total.astype(float)

    def _states(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of both directions' states over what counts of each window, the longest first."""
        steps = CONTEXT + int(counts[0])  # the context behind a direction's last counted byte tells it nothing
        back = np.maximum(2 * CONTEXT + counts - 1 - np.arange(steps)[:, None], 0)
        return np.concatenate([self._sums(np.ascontiguousarray(x[:, :steps].T), counts, "f"), self._sums(np.take_along_axis(x.T, back, 0), counts, "b")], 1)

    def documents(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Pooled probabilities; None where there is no letter."""
        held, owner, counts = [], [], []
        for k, t in enumerate(texts):
            if t and _letter.search(t):
                x, n = windows(spelled(t))
                held.append(x)
                counts.append(n)
                owner.append(np.full(len(n), k))
        out: list[np.ndarray | None] = [None] * len(texts)
        if not held:
            return out
        x, counts, owner = np.concatenate(held), np.concatenate(counts), np.concatenate(owner)
        total, bytes_ = np.zeros((len(texts), 2 * HIDDEN)), np.bincount(owner, counts, len(texts))
        # windows with about as many counted bytes go side by side, as each ends by itself and few left are slow
        order = np.argsort(-counts, kind="stable")
        for k in range(0, len(order), SIDE_BY_SIDE):
            pick = order[k : k + SIDE_BY_SIDE]
            longest = int(counts[pick[0]]) + 2 * CONTEXT
            np.add.at(total, owner[pick], self._states(x[pick, :longest], counts[pick]))
        p = self.model.params
        prob = _softmax(total / np.maximum(bytes_, 1)[:, None] @ p["out"] + p["bias"])
        for k in np.unique(owner):
            out[k] = prob[k]
        return out


HASHES = 1 << 30  # what rows are ranked by first


def ranked_below(rows: int, docs_each: int) -> int:
    """The hash below which about four times ``docs_each`` of a language's rows are.  The product passes 64 bits, so it is Python's."""
    return min(HASHES, -(-4 * docs_each * HASHES // rows))


def sample_rows(docs: DataFrame, text: str, lang: str, doc_id: str, docs_each: int, bytes_each: int = BYTES, langs: int = LANGS) -> list[tuple[str, str | None]]:
    """Language and text of the bounded sample, on the driver, in a fixed order."""
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    known = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    known = known.filter(F.coalesce(F.octet_length(t), F.lit(0)) <= bytes_each // 8)
    known = known.select(F.col(f"`{lang}`").alias("lang"), t.alias("t"), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), t).alias("h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    if not counts:
        return []
    bounds = spark.createDataFrame([(r.lang, ranked_below(r.n, docs_each)) for r in counts], "b_lang string, below long")
    known = known.join(F.broadcast(bounds), F.col("lang") == F.col("b_lang"))  # a row a language, at most ``langs``
    # ranked among about four times as many, and where rows repeat so often that too few are left, among all
    near = known.filter(F.pmod("h", F.lit(HASHES)) < F.col("below"))

    def ranked(rows: DataFrame) -> list:
        each = rows.groupBy("lang", "h").agg(F.first("t").alias("t"))
        order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(HASHES)), "h")
        each = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= docs_each)
        size = F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
        fits = size <= bytes_each
        return each.select("lang", "rank", F.when(fits, F.col("t")).alias("t"), fits.alias("fits")).collect()

    rows = ranked(near)
    got = Counter(r.lang for r in rows)
    short = [r.lang for r in counts if got[r.lang] < min(docs_each, r.n)]
    if short:
        rows = [r for r in rows if r.lang not in short]
        mine = known.filter(F.col("lang").isin(short))
        heads = mine.select("lang", "h", F.pmod("h", F.lit(HASHES)).alias("u")).distinct()
        least = heads.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("u", "h"))).filter(F.col("k") <= docs_each)
        least = least.select(F.col("lang").alias("l_lang"), F.col("h").alias("l_h"))  # docs_each rows a language
        rows += ranked(mine.join(F.broadcast(least), (F.col("lang") == F.col("l_lang")) & (F.col("h") == F.col("l_h"))).select("lang", "t", "h"))
    return [(r.lang, r.t) for r in sorted(rows, key=lambda r: (r.lang, r.rank)) if r.fits]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_each: int = DOCS) -> Model:
    model = fit(sample_rows(docs, text, lang, doc_id, docs_each))
    let_go()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score."""
    kinds = dict(docs.dtypes)
    n = len(keep)

    def label(p: np.ndarray | None) -> tuple[str, float]:
        if p is None or not model.langs:
            return UND, 0.0
        k = int(p.argmax())
        return model.langs[k], float(min(1.0, p[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("languages", lambda: None)
        pool = Pooler(model)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            got, held, size = [], [], 0
            for t in texts if model.langs else ():
                held.append(t)
                size += len(t or "")
                if size >= CHUNK:  # a whole text at least
                    got += pool.documents(held)
                    held, size = [], 0
            got = got + pool.documents(held) if model.langs else [None] * len(texts)
            pairs = [label(p) for p in got]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(n)], pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.float64())],
                [f"c{k}" for k in range(n + 2)],
            )

    schema = ", ".join([*[f"c{k} {kinds[c]}" for k, c in enumerate(keep)], f"c{n} string, c{n + 1} double"])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(trimmed(run), schema).toDF(*keep, "lang_pred", "score")


def byte_labels(model: Model, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities of them) of a spelled text's bytes, by windows as documents are read."""
    x, counts = windows(spelled(text))
    labels, scores = [], []
    for k in range(0, len(x), SIDE_BY_SIDE // 16):
        prob = positions(model, x[k : k + SIDE_BY_SIDE // 16])[:, CONTEXT : CONTEXT + SPAN]
        best = prob.argmax(2)
        inside = np.arange(SPAN)[None] < counts[k : k + SIDE_BY_SIDE // 16, None]
        labels.append(best[inside])
        scores.append(np.take_along_axis(prob, best[:, :, None], 2)[:, :, 0][inside])
    return np.concatenate(labels), np.concatenate(scores)


def spans_of(model: Model, text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, language, mean probability) of a text's runs of equal labels, in code points, ends exclusive.

    Bytes that are read as space have no label of their own: they are inside a span if its run goes on behind them.
    """
    if not model.langs or not text or not _letter.search(text):
        return []
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    read = np.flatnonzero(np.frombuffer(_plain, np.uint8)[raw] != 32)  # where the words' bytes are
    labels, scores = byte_labels(model, text)
    words = np.flatnonzero(np.frombuffer(spelled(text), np.uint8) != 32)
    labels, scores = labels[words], scores[words]
    first = np.flatnonzero(np.diff(labels, prepend=-1))
    last = np.append(first[1:], len(labels)) - 1
    point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
    mean = np.add.reduceat(scores, first) / (last - first + 1)
    return [(int(point[read[a]]) - 1, int(point[read[b]]), model.langs[labels[a]], float(p)) for a, b, p in zip(first, last, mean)]


def label_spans(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, lang, score): the labels of every position, a row a run.  Texts without a letter have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):  # a text at a time
                found = spans_of(model, t)
                if found:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(), pa.int32(), pa.string(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found))), *columns], ["k", "start", "end", "lang", "score"])

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, start int, end int, lang string, score double").withColumnRenamed("k", key)


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_fold(F.col("doc_id"), 3) != 1)


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learned_rows(docs))
    return predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Filtering stage: rows whose language is found; a null lang becomes it.

    A score does not grow with evidence, so by default none is too low and only rows
    without a letter go.  Where no language could be learned, all rows stay as they are.
    """
    plain = docs.toDF(*[f"k{k}" for k in range(len(docs.columns))])
    text, lang = (f"k{docs.columns.index(c)}" for c in ("text", "lang"))
    model = train(learned_rows(docs))
    if not model.langs:
        return docs
    out = predict(plain, model, text, plain.columns).filter((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return out.withColumn(lang, F.coalesce(lang, "lang_pred")).drop("lang_pred", "score").toDF(*docs.columns)
