"""Language identification with a small convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftsim.llm.text import column_at, slices, text_buffer, trimmed

#: Bytes of one window; windows follow one another over the whole text.
WINDOW = 256
#: Filters of each width.
WIDTHS, FILTERS = (2, 3, 4), 12
#: Labelled rows learned from, and characters taken from each.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 400
UNKNOWN = "und"
#: Windows worked through at once, so that their activations stay in the cache.
BLOCK = 64


@dataclass
class Network:
    """tables[w][j, byte, filter]: weight of a byte at place j of a filter of width w.

    A filter's value is the sum of its places' weights; the largest value over the window
    is taken, and a linear layer with softmax follows.
    """

    labels: list[str]
    tables: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """The tables joined to two bytes each, so that a filter takes one look-up per pair of bytes."""
        out = []
        for width, table in self.tables.items():
            parts = []
            for j in range(0, width - 1, 2):
                parts.append((table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1))
            if width % 2:
                parts.append(np.tile(table[width - 1][None, :, :], (256, 1, 1)).reshape(65536, -1))
            out.append([np.ascontiguousarray(p, dtype=np.float32) for p in parts])
        return out


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over each row (zeros after its end), their rows and byte counts."""
    counts = -(-(ends - starts) // WINDOW)
    row = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[row] + nth * WINDOW
    size = np.minimum(ends[row] - begin, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    at = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    return np.where(np.arange(WINDOW) < size[:, None], at, np.uint8(0)), row, size


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], rounds: int = 6, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Fit a network to labelled texts; None if there are none. The same input gives the same network."""
    names = sorted(set(labels))
    if not names:
        return None
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    windows, row, size = _windows(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    y = np.array([names.index(x) for x in labels])[row]
    # A short rest of a text is left out, a short text is not.
    first = np.append(True, row[1:] != row[:-1])
    windows, y = windows[(size >= 8) | first], y[(size >= 8) | first]
    draw = np.random.default_rng(seed)
    weights = {f"t{w}": draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    weights["dense"] = draw.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32)
    weights["bias"] = np.zeros(len(names), np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    share = np.bincount(y, minlength=len(names)).clip(1)
    step = 0
    for _ in range(rounds):
        order = draw.permutation(len(y))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            x, step = windows[pick], step + 1
            hidden, best = [], []
            for w in WIDTHS:
                value = sum(weights[f"t{w}"][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                best.append(value.argmax(axis=1))
                hidden.append(value.max(axis=1))
            h = np.concatenate(hidden, axis=1)
            grad = _softmax(h @ weights["dense"] + weights["bias"])
            grad[np.arange(len(pick)), y[pick]] -= 1
            grad *= (len(y) / (len(names) * share[y[pick]]) / len(pick))[:, None]
            grads = {"dense": h.T @ grad, "bias": grad.sum(axis=0)}
            back = grad @ weights["dense"].T
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(weights[f"t{w}"])
                part, at = back[:, k * FILTERS : (k + 1) * FILTERS], best[k]
                for j in range(w):
                    byte = np.take_along_axis(x, at + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), part)
                grads[f"t{w}"] = g
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(names, {w: weights[f"t{w}"] for w in WIDTHS}, weights["dense"], weights["bias"])


def _probabilities(windows: np.ndarray, pairs: list[list[np.ndarray]], net: Network) -> np.ndarray:
    out = np.zeros((len(windows), len(net.labels)), np.float32)
    for lo in range(0, len(windows), BLOCK):
        x = windows[lo : lo + BLOCK].astype(np.uint16)
        two = (x[:, :-1] << 8) | x[:, 1:]
        hidden = []
        for width, parts in zip(WIDTHS, pairs, strict=True):
            n, value = WINDOW - width + 1, None
            for k, table in enumerate(parts):
                # A last odd byte is the second byte of the pair that ends with it.
                at = 2 * k if 2 * k + 1 < width else width - 2
                found = table.take(two[:, at : at + n], axis=0)
                value = found if value is None else np.add(value, found, out=value)
            hidden.append(value.max(axis=1))
        out[lo : lo + BLOCK] = _softmax(np.concatenate(hidden, axis=1) @ net.dense + net.bias)
    return out


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled texts that are not held out, an equal share for each label.

    A row is taken by a hash of its id, and of its text ``chars`` characters from a place
    given by the same hash. A label with fewer rows gives all of them.
    """
    learn = docs.filter((F.coalesce(fold(), F.lit(0)) != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30))
    # Twice the share expected, of which the smallest hashes are then taken.
    bars = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (2 << 30) * each // n + 1))])
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    taken = (
        learn.filter(draw < F.element_at(bars, F.col("lang")))
        .select("lang", draw.alias("draw"), F.substring("text", place.cast("int") + 1, F.lit(chars)).alias("text"))
        .orderBy("draw", "lang", "text")
        .limit(4 * rows)
        .collect()
    )
    left, texts, labels = dict.fromkeys(counts, each), [], []
    for r in taken:
        if left[r["lang"]] > 0:
            left[r["lang"]] -= 1
            texts.append(r["text"])
            labels.append(r["lang"])
    return texts, labels


def with_language(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with (lang_pred, score) of ``text``: the mean of its windows' probabilities by bytes.

    A null text, one without a letter, and every text if nothing was learned, is UNKNOWN
    with score 0. ``docs`` must not have the two columns already; pack a row with such
    names into a struct first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs() if net else []
        for batch in batches:
            for part in slices(batch, text):
                texts = column_at(part, text)
                letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                n = part.num_rows
                total = np.zeros((n, max(1, len(net.labels) if net else 1)))
                weight = np.zeros(n)
                if net and n:
                    windows, row, size = _windows(*text_buffer(texts))
                    np.add.at(total, row, _probabilities(windows, pairs, net) * size[:, None])
                    np.add.at(weight, row, size)
                mean = total / np.maximum(weight, 1)[:, None]
                best = mean.argmax(axis=1)
                known = letter & (weight > 0)
                names = np.array([*(net.labels if net else [UNKNOWN])], dtype=object)[best]
                names[~known] = UNKNOWN
                score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"]
                )

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(trimmed(run), T.StructType(fields))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` (doc_id, text, lang) and predict every row.

    Returns (document, lang_pred, score), ``document`` being the whole input row as a
    struct. Repeated rows get equal predictions; of languages that tie, the first in
    order of their names is taken. A very long text is many windows, a megabyte at once.
    Rows whose crc32(doc_id) modulo 3 is 1 are never learned from (a null doc_id
    is, under the remainder 0); language, source and id are no input of a prediction.
    """
    texts, labels = sample(docs)
    return with_language(docs.select(F.struct("*").alias("document")), train(texts, labels), "document.text")
