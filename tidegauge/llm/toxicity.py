"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import fresh, trim
from tidegauge.llm.textops import Words, mix64, slices, utf8

WINDOW, STRIDE = 32, 16
#: Hashed words and hashed character n-grams, numbers in the vector of each, and the state's size in each direction.
WORD_ROWS, GRAM_ROWS, WIDTH, STATE = 1 << 14, 1 << 15, 8, 8
#: Labelled documents of each class, and characters of one, that the network learns from at most.
SAMPLE, SAMPLE_CHARS = 2000, 200_000
#: Bytes of texts, and distinct words, that a vocabulary takes in at once.
PIECE_BYTES, PIECE_WORDS = 1_000_000, 20_000
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32


def _grams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of the character 3- and 4-grams of words, one word after the other, and how many each has."""
    # bytes of all words, each between two zeros
    room = size + 2
    at = np.cumsum(room) - room
    b = np.zeros(int(room.sum()), np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    b[np.repeat(at + 1, size) + inner] = _LOW[data[np.repeat(start, size) + inner]] + np.uint64(1)
    owner = np.repeat(np.arange(len(room), dtype=np.int32), room)
    grams, owners = [], []
    for n in (3, 4):
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + b[i : len(b) - n + 1 + i]
        own = owner[: len(h)] == owner[n - 1 :]
        grams.append((mix64(h[own]) % np.uint64(GRAM_ROWS)).astype(np.int32))
        owners.append(owner[: len(h)][own])
    owners = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(room))


class Vocabulary:
    """The distinct words of a batch of texts: ids of all words in order, hashed rows of each distinct word and of its character 3- and 4-grams."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        # texts in pieces, then distinct words in pieces: what a piece takes on the way is many times what stays of it
        cuts = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(PIECE_BYTES, len(data), PIECE_BYTES)), len(offsets) - 1])
        pieces, self.first = [], np.zeros(len(offsets), np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            words = Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], lower=True)
            own, where, ids = np.unique(words.hash, return_index=True, return_inverse=True)
            pieces.append((own, words.start[where] + offsets[a], (words.end - words.start)[where], ids.astype(np.int32)))
            self.first[a : z + 1] = words.first + self.first[a]
            del words, where, ids
        some, start, size = (np.concatenate([x[i] for x in pieces]) if pieces else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        distinct, where, ids = np.unique(some, return_index=True, return_inverse=True)
        at = np.cumsum([0, *(len(x[0]) for x in pieces)])
        self.ids = np.concatenate([ids[b : b + len(x[0])].astype(np.int32)[x[3]] for b, x in zip(at.tolist(), pieces, strict=False)]) if pieces else np.zeros(0, np.int32)
        self.word = (distinct >> np.uint64(17)).astype(np.int64) % WORD_ROWS
        start, size = start[where], size[where]
        grams = [_grams(data, start[i : i + PIECE_WORDS], size[i : i + PIECE_WORDS]) for i in range(0, len(distinct), PIECE_WORDS)]
        self.grams = np.concatenate([x for x, _ in grams]) if grams else np.zeros(0, np.int32)
        self.gram_first = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(n for _, n in grams)]))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, text) of every window: one each STRIDE words until the text's end is covered."""
        size = np.diff(self.first)
        n = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1, 0)
        text = np.repeat(np.arange(len(size)), n)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        return self.first[text] + start, np.minimum(WINDOW, size[text] - start), text


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        return cls({"word": n(WORD_ROWS, WIDTH, s=0.1), "gram": n(GRAM_ROWS, WIDTH, s=0.1), "W": n(2 * WIDTH, 6 * STATE, s=0.3), "bias": np.zeros(6 * STATE, np.float32), "U": n(2, STATE, 3 * STATE, s=0.3), "a": n(2 * STATE, s=0.3), "w": n(2 * STATE, s=0.3), "b": np.zeros(1, np.float32)})

    def inputs(self, v: Vocabulary, some: np.ndarray) -> np.ndarray:
        """The vector of each of `some` distinct words: its own, and the sum of its character n-grams' over the root of their number."""
        size = v.gram_first[some + 1] - v.gram_first[some]
        grams = self.p["gram"][v.grams[_ranges(v.gram_first[some], size)]]
        sums = np.zeros((len(some), WIDTH), np.float32)
        if len(grams):
            full = np.flatnonzero(size)
            sums[full] = np.add.reduceat(grams, (np.cumsum(size) - size)[full], axis=0) / np.sqrt(size[full, None], dtype=np.float32)
        return np.concatenate([self.p["word"][v.word[some]], sums], axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """gates: [time, window, 6 * STATE], the inputs' part of both directions' gates; mask: [time, window]. Each window's logit, and what backward() needs."""
        p, (T, B, _) = self.p, gates.shape
        h = np.zeros((2, B, STATE), np.float32)
        H = np.empty((T, B, 2 * STATE), np.float32)
        past = []
        for i in range(T):
            j = T - 1 - i
            x = np.stack([gates[i, :, : 3 * STATE], gates[j, :, 3 * STATE :]])
            m = np.stack([mask[i], mask[j]])[:, :, None]
            g = h @ p["U"]
            zr = 1 / (1 + np.exp(-(x[:, :, : 2 * STATE] + g[:, :, : 2 * STATE])))
            z, r = zr[:, :, :STATE] * m, zr[:, :, STATE:]
            c = np.tanh(x[:, :, 2 * STATE :] + r * g[:, :, 2 * STATE :])
            if keep:
                past.append((h, zr, z, c, g[:, :, 2 * STATE :], m))
            h = h + z * (c - h)
            H[i, :, :STATE], H[j, :, STATE:] = h[0], h[1]
        s = np.where(mask > 0, H @ p["a"], np.float32(-1e9))
        alpha = np.exp(s - s.max(0))
        alpha /= alpha.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, H)
        return pooled @ p["w"] + p["b"][0], {"past": past, "H": H, "alpha": alpha, "pooled": pooled}

    def backward(self, d: np.ndarray, held: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """From the loss's slope in each logit: slopes of the parameters behind the gates, and of the gates."""
        p, H, alpha = self.p, held["H"], held["alpha"]
        T, B, _ = H.shape
        grad = {"w": held["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["w"]
        da = np.einsum("tbh,bh->tb", H, dp)
        ds = alpha * (da - (alpha * da).sum(0))
        grad["a"] = np.einsum("tb,tbh->h", ds, H)
        dH = alpha[:, :, None] * dp + ds[:, :, None] * p["a"]
        dg = np.zeros((T, B, 6 * STATE), np.float32)
        dU, dh = np.zeros_like(p["U"]), np.zeros((2, B, STATE), np.float32)
        for i in reversed(range(T)):
            j = T - 1 - i
            h, zr, z, c, hc, m = held["past"][i]
            dh = dh + np.stack([dH[i, :, :STATE], dH[j, :, STATE:]])
            z0, r = zr[:, :, :STATE], zr[:, :, STATE:]
            dc = dh * z * (1 - c * c)
            dz, dr = dh * (c - h) * m * z0 * (1 - z0), dc * hc * r * (1 - r)
            back = np.concatenate([dz, dr, dc * r], axis=2)
            dU += h.transpose(0, 2, 1) @ back
            dh = dh * (1 - z) + back @ p["U"].transpose(0, 2, 1)
            x = np.concatenate([dz, dr, dc], axis=2)
            dg[i, :, : 3 * STATE], dg[j, :, 3 * STATE :] = x[0], x[1]
        return grad | {"U": dU}, dg

    def logits(self, v: Vocabulary, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        gates, out = np.empty((len(v.word), 6 * STATE), self.p["W"].dtype), np.empty(len(start), np.float32)
        for at in range(0, len(v.word), PIECE_WORDS):  # in pieces, since a word has a dozen vectors to sum
            some = np.arange(at, min(at + PIECE_WORDS, len(v.word)))
            gates[some[0] : some[-1] + 1] = self.inputs(v, some) @ self.p["W"] + self.p["bias"]
        for at in range(0, len(start), 1024):
            ids, mask = _positions(v, start[at : at + 1024], size[at : at + 1024])
            out[at : at + 1024] = self.forward(gates[ids], mask)[0]
        return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _positions(v: Vocabulary, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    mask = (t < size).astype(np.float32)
    return v.ids[np.minimum(start + t, len(v.ids) - 1)], mask


def train(texts: list[str], toxic: np.ndarray, epochs: int = 10, least_steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network | None:
    """A network whose highest window logit marks toxic texts; None unless both classes have texts with words.

    There are at least `epochs` epochs, and so many that a small sample too is learnt from in least_steps steps. For the first fifth of them any windows of a text stand for it; then, as its score is that of its highest window, that one, and one more at random of a text that isn't toxic. Adam; the classes weigh the same.
    A fifth of the windows of texts that aren't toxic are filled with one of their words: what isn't toxic once isn't so over and over.
    """
    v = Vocabulary(pa.array(texts, pa.large_string()))
    trim()
    start, size, text = v.windows()
    if len(np.unique(toxic[text])) < 2:
        return None
    net, r = Network.new(seed), np.random.default_rng(seed)
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    m1, m2, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(epochs, -(-least_steps * batch // (len(texts) + int((toxic == 0).sum()))))
    for epoch in range(epochs):
        noise = r.random(len(start))
        if epoch < epochs / 5:
            order = np.lexsort((noise, text))
            nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            pick = order[nth < 4]
        else:
            best = _first_of(text, np.lexsort((-net.logits(v, start, size), text)))
            more = _first_of(text, np.lexsort((noise, text)))
            pick = np.concatenate([best, more[toxic[text[more]] == 0]])
        r.shuffle(pick)
        for at in range(0, len(pick), batch):
            w = pick[at : at + batch]
            ids, mask = _positions(v, start[w], size[w])
            same = np.flatnonzero((toxic[text[w]] == 0) & (r.random(len(w)) < 0.2))
            ids[:, same] = ids[(r.random(len(same)) * size[w[same]]).astype(np.int64), same]
            some, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            x = net.inputs(v, some)
            logit, held = net.forward((x @ net.p["W"] + net.p["bias"])[inverse], mask, keep=True)
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[text[w]]) * weight[text[w]] / len(w)).astype(np.float32)
            grad, dg = net.backward(d, held)
            of_word = np.zeros((len(some), dg.shape[2]), np.float32)
            np.add.at(of_word, inverse.ravel(), dg.reshape(-1, dg.shape[2]))
            grad["bias"], grad["W"] = of_word.sum(0), x.T @ of_word
            dx = of_word @ net.p["W"].T
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], v.word[some], dx[:, :WIDTH])
            n = v.gram_first[some + 1] - v.gram_first[some]
            np.add.at(grad["gram"], v.grams[_ranges(v.gram_first[some], n)], np.repeat(dx[:, WIDTH:] / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), n, axis=0))
            step += 1
            for k, g in grad.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                net.p[k] -= (rate / (1 + 3 * epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _first_of(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    return order[np.r_[True, text[order][1:] != text[order][:-1]]] if len(order) else order


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """A network trained on whole texts of docs (doc_id, text) that labels (doc_id, toxic) marks and is_held_out() doesn't withhold.

    The sample is bounded: per class the `sample` documents whose doc_id has the smallest hashes, of up to sample_chars characters. Null labels, ids and texts are left out;
    a document with labels of both kinds counts as toxic.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = docs.where("doc_id is not null and text is not null").where(F.length("text") <= sample_chars).select("doc_id").join(marked, "doc_id").distinct()
    chosen = [there.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    ids = {r.doc_id: r.toxic for part in chosen for r in part.collect()}
    if len(set(ids.values())) < 2:
        return None
    few = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").where("text is not null").where(F.length("text") <= sample_chars).join(F.broadcast(few), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted({x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)})
        net = train([t for _, t, _ in seen], np.array([y for _, _, y in seen]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])
        del seen, net
        trim()

    # the sample is bounded: one task learns from it, so that the driver doesn't hold it
    return pickle.loads(rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(learn, "net binary").head().net)


def score(docs: DataFrame, net: Network | None, name: str = "toxicity_score") -> DataFrame:
    """docs, all columns, with the column `name`: the network's probability for the highest of all overlapping windows of the whole text. A column of that name in docs, in any case, gives way.

    Without words (null, empty, white space): 0. Without a network (nothing of both classes to learn from): 0.5 for texts with words. Repeated rows are each scored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size; the result reads it, so it stays as long as that

    def run(column: pa.Array) -> np.ndarray:
        v = Vocabulary(column)
        start, size, text = v.windows()
        out = np.zeros(len(v.first) - 1)
        if len(start):
            logit = sent.value.logits(v, start, size).astype(np.float64) if sent.value else np.zeros(len(start))
            np.maximum.at(out, text, 1 / (1 + np.exp(-np.clip(logit, -50, 50))))
        return out

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole, 1_000_000):
                yield batch.append_column(name, pa.array(run(batch.column("text")), pa.float64()))
        trim()

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` double"
    return kept.mapInArrow(batches, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs, all columns as they are, without the documents that score the threshold or more, under a network learnt from labels.

    Null and empty texts score 0 and stay; rows with a null doc_id are judged by their texts; of repeated rows all stay or all go. Empty labels, or of one class only: every text scores 0.5.
    """
    new = fresh(docs, "_score")
    return score(docs, fit(docs, labels), new).where(F.col(new) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
