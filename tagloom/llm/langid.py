"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import settle, text_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE = 400  # labelled documents of a language that are fitted on, at most, whole
SAMPLE_BYTES = 8 << 20  # of windows of a language that the network is fitted on, at most
MOST_LANGUAGES = 1000
EPOCHS = 6
FOLDS = 5
SEED = 10
AT_ONCE = 64
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def held_out(doc) -> bool:
    """Documents that are never learned from: the CRC-32 of the identifier's text leaves 0 by 5."""
    return zlib.crc32(str(doc).encode()) % FOLDS == 0


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All of ``raw`` in rows of ``size`` bytes; the last row is filled with bytes 0."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


@dataclass
class Network:
    """Embedded bytes, filters of several widths, the maximum of each over a window, and a softmax over languages."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * EMBED, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    letters: frozenset[str] = frozenset()  # characters of the texts that were learned from

    def tables(self) -> list[list[np.ndarray]]:
        """What each byte adds at each place of a filter; the first two places are one table of byte pairs."""
        if not hasattr(self, "_tables"):
            self._tables = []
            for width, f, b in zip(WIDTHS, self.filters, self.bias):
                one = [(self.embed @ f[k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(width)]
                own = [(one[0][:, None, :] + one[1][None, :, :] + b.astype(np.float32)).reshape(65536, -1)]
                k = 2
                while k < width:
                    if k + 1 < width:
                        own.append((one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1))
                    else:
                        own.append(one[k])
                    k += 2
                self._tables.append(own)
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages) for rows of bytes, a few dozen at once so that what is looked up stays near the core."""
        tables, parts = self.tables(), []
        for a in range(0, len(x), AT_ONCE):
            part = x[a : a + AT_ONCE].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for width, own in zip(WIDTHS, tables):
                n = part.shape[1] - width + 1
                at = own[0].take(pairs[:, :n], axis=0)
                k = 2
                for t in own[1:]:
                    at += t.take(pairs[:, k : k + n] if len(t) == 65536 else part[:, k : k + n], axis=0)
                    k += 2
                pooled.append(at.max(axis=1))
            h = np.maximum(np.hstack(pooled), 0)
            parts.append(_softmax(h @ self.out.astype(np.float32) + self.out_bias.astype(np.float32)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3) -> Network:
    """Adam on cross-entropy over shuffled windows; the maximum passes a gradient to the place that it came from."""
    rng = np.random.default_rng(SEED)
    net = Network(
        langs,
        rng.normal(0, 0.5, (256, EMBED)),
        [rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))),
        np.zeros(len(langs)),
    )
    net.embed[0] = 0
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            t += 1
            for p, g, mm, vv in zip(params, _gradients(net, x[at].astype(np.int64), y[at]), m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(x)
    e = net.embed[x].astype(np.float32)
    pooled, where = [], []
    for width, f, b in zip(WIDTHS, net.filters, net.bias):
        places = x.shape[1] - width + 1
        conv = sum(e[:, k : k + places] @ f[k * EMBED : (k + 1) * EMBED].astype(np.float32) for k in range(width)) + b.astype(np.float32)
        best = conv.argmax(axis=1)
        where.append(best)
        pooled.append(np.take_along_axis(conv, best[:, None], 1)[:, 0])
    pooled = np.hstack(pooled).astype(np.float64)
    h = np.maximum(pooled, 0)
    p = _softmax(h @ net.out + net.out_bias)
    p[np.arange(n), y] -= 1
    p /= n
    g_h = (p @ net.out.T) * (pooled > 0)
    g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
    for i, (width, f) in enumerate(zip(WIDTHS, net.filters)):
        g = g_h[:, i * FILTERS : (i + 1) * FILTERS]
        g_bias.append(g.sum(0))
        gf = np.zeros_like(f)
        for k in range(width):
            seen = np.take_along_axis(x, where[i] + k, 1)  # the byte at that place of each filter's best match
            own = slice(k * EMBED, (k + 1) * EMBED)
            gf[own] = np.einsum("nfe,nf->ef", net.embed[seen], g)
            np.add.at(g_embed, seen.reshape(-1), (g[:, :, None] * f[own].T[None]).reshape(-1, EMBED))
        g_filters.append(gf)
    return [g_embed, *g_filters, *g_bias, h.T @ p, p.sum(0)]


def labelled_windows(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The windows of at most ``size`` documents of each language, never of held-out ones, and of these ``SAMPLE_BYTES`` at most.

    What goes to the driver is thus bounded for each language, however long its texts are: beyond the bound it is the windows
    with the least hashes. More than ``MOST_LANGUAGES`` labels are an error, as each is an output of the network.

    Identifiers are chosen first, those with the least hashes in their language, all languages in one pass; texts come by a
    broadcast of the chosen. Of several rows with an identifier and a language the least text stands for all.
    """
    text_batches(df.sparkSession)  # before the texts are read here, not only where the network is applied
    k, y = F.col(f"`{doc}`"), F.col(f"`{lang}`")
    fit = k.isNotNull() & y.isNotNull() & (F.pmod(F.crc32(k.cast("string").cast("binary")), F.lit(FOLDS)) != 0) & (F.trim(y) != "")
    rows = settle(df.where(fit).select(k.alias("doc"), y.alias("lang")).distinct())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in counts.limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are no labels that a network can learn")
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    # rows far beyond a language's border stay where they are, so that no window sees many more than are chosen; counts are a
    # row a language, of which the network has an output each
    h = F.xxhash64(F.lit(SEED), "doc")
    place = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(2.0**53)
    near = rows.join(F.broadcast(counts), "lang").where(place < F.lit(1.5 * size) / F.col("n")).select("doc", "lang", h.alias("h"))
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc"))).where(F.col("r") <= size)
    chosen = settle(ranked.select("doc", "lang"))
    texts = df.select(k.alias("doc"), y.alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(chosen), ["doc", "lang"]).groupBy("doc", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if _letter.search(t):
                    cut = [w.tobytes() for w in windows(t.encode())]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.string()), pa.array(cut, pa.binary())], ["lang", "window"])

    cut = settle(picked.mapInArrow(run, "lang string, window binary"))
    many = cut.groupBy("lang").agg(F.count("*").alias("n"))
    least = W.partitionBy("lang").orderBy(F.xxhash64(F.lit(SEED), "window"), "window")
    cut = cut.join(F.broadcast(many), "lang")
    few, more = cut.where(F.col("n") <= SAMPLE_BYTES // WINDOW), cut.where(F.col("n") > SAMPLE_BYTES // WINDOW)
    more = more.withColumn("r", F.row_number().over(least)).where(F.col("r") <= SAMPLE_BYTES // WINDOW)
    got = sorted(few.select("lang", "window").unionByName(more.select("lang", "window")).collect(), key=lambda r: (r.lang, bytes(r.window)))
    x = np.frombuffer(b"".join(bytes(r.window) for r in got), np.uint8).reshape(-1, WINDOW)
    return x, np.array([langs.index(r.lang) for r in got], np.int64), langs


def fit_on(df: DataFrame, size: int = SAMPLE, **names: str) -> Network | None:
    """A network trained on ``df``'s labelled documents; None where there is nothing to learn from."""
    x, y, langs = labelled_windows(df, size=size, **names)
    if not len(x):
        return None
    net = train(x, y, langs)
    net.letters = frozenset("".join(bytes(w).decode(errors="ignore") for w in x))
    return net


def foreign(net: Network, text: str) -> bool:
    """Whether most of a text's letters are ones that no text has that the network learned from, in either case."""
    unseen = {c for c in set(text) - net.letters if _letter.match(c) and c.lower() not in net.letters and c.upper() not in net.letters}
    return bool(unseen) and sum(map(text.count, unseen)) > 0.5 * len(_letter.findall(text))


def predict(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the mean of its windows' probabilities, all of them, weighted by their bytes."""
    langs, scores = [], np.zeros(len(texts))
    held, sizes, owners = [], [], []

    def flush() -> np.ndarray:
        return net.probabilities(np.concatenate(held))

    total = np.zeros((len(texts), len(net.langs) if net else 0))
    for i, t in enumerate(texts):
        s = t.as_py() if t.is_valid else None
        if net and s and _letter.search(s):
            raw = s.encode()
            w = windows(raw)
            held.append(w)
            n = np.full(len(w), WINDOW, np.float64)
            n[-1] = len(raw) - WINDOW * (len(w) - 1)
            sizes.append(n)
            owners.append(np.full(len(w), i))
            if sum(map(len, sizes)) >= 4096:
                np.add.at(total, np.concatenate(owners), flush() * np.concatenate(sizes)[:, None])
                held, sizes, owners = [], [], []
    if held:
        np.add.at(total, np.concatenate(owners), flush() * np.concatenate(sizes)[:, None])
    for i in range(len(texts)):
        n = total[i].sum() if net else 0
        if n:
            best = int(total[i].argmax())
            langs.append(net.langs[best])
            scores[i] = min(1.0, total[i][best] / n)
        else:
            langs.append(UNKNOWN)
    return langs, scores


def identify(df: DataFrame, net: Network | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, held_out, lang_pred, score`` of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows are rows; an
    empty table has an empty result. Columns besides ``doc`` and ``text`` are not looked at.
    """
    text_batches(df.sparkSession)
    slim = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(net, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(langs, pa.string()), pa.array(scores)], ["doc", "lang_pred", "score"])

    rest = F.coalesce(F.pmod(F.crc32(F.col("doc").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    out = slim.mapInArrow(run, f"doc {kind}, lang_pred string, score double")
    return out.select(F.col("doc").alias(doc), rest.alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, net: Network | None, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``df``, all columns, whose language is known with a score of ``least`` or more.

    Texts mostly of letters that no learned text has are in no known language, whatever their score.
    """
    text_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(net, b.column(at))
            known = (x != UNKNOWN and not (net.letters and foreign(net, t.as_py())) for x, t in zip(langs, b.column(at)))
            yield b.filter(pa.array(list(known), pa.bool_()).to_numpy(zero_copy_only=False) & (scores >= least))

    return df.mapInArrow(run, df.schema)
