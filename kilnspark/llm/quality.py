"""Quality: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. A passage is described by the shares of its words' hashed identities and hashed
character trigrams, and by what its characters and words are like as a whole. It is encoded by a learned layer and weighed by gated
attention (tanh times sigmoid); the document's score is a logistic function of the weighted passage representation. Only
document labels are used; the weights say which passages decided.

The fit sees at most TRAIN_ROWS labelled documents (by a hash of the id, held-out fold excluded), fewer if their descriptions exceed
TRAIN_BYTES, each with all its passages and whole counts; a document that
doesn't fit into what is left is skipped, whatever its size. Executors describe them, the driver takes the steps in small batches. An id with several
rows counts once. Scoring covers all rows; a long text is encoded some passages at a time.

Defined cases: a null or blank text is a bag of one empty passage and gets a score; null ids are scored and count as held out;
rows that repeat are scored each; with no training rows of both kinds every score is the share of label 1 (0.5 without
rows); an empty table gives an empty result."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import bounded_rows, held_out, pick, text_or_empty, training_labels

TRAIN_ROWS = 6000
#: Bytes of the training rows' descriptions, at most; a row is in whole, or skipped if it doesn't fit into what is left.
TRAIN_BYTES = 64 << 20
PASSAGE = 64
#: Passages of a text that are described at once.
BLOCK = 512
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 16, 128, 0.01, 1e-4
#: Hashed words and hashed trigrams, the factor that brings their shares near one, and their own decay.
WORDS, TRIGRAMS, NGRAM_SCALE, NGRAM_DECAY = 512, 512, 8.0, 2e-3
#: Words that a worker keeps the hashes of.
KNOWN = 100_000


def _classes() -> np.ndarray:
    """Class of each code point below 0x250 by its Unicode category; the last stands for all others."""
    kinds = {"Ll": 0, "Lu": 1, "N": 2, "Z": 3, "P": 4, "S": 5, "C": 6}
    return np.array([*(next((k for c, k in kinds.items() if unicodedata.category(chr(i)).startswith(c)), 7) for i in range(0x250)), 7], np.uint8)


CLASSES = _classes()
N_CLASSES = 8
SURFACE = N_CLASSES + 5
WIDTH = SURFACE + WORDS + TRIGRAMS


class Describer:
    """Passage rows of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= KNOWN:
            self.known.clear()
        got = self.known[word] = xxhash.xxh32_intdigest(word.lower()) % WORDS
        return got

    @staticmethod
    def _trigrams(codes: np.ndarray) -> np.ndarray:
        """Hashes of all trigrams of code points, A-Z folded."""
        c = codes + np.uint32(32) * ((codes >= 65) & (codes <= 90))
        h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
        return ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16)

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count = (len(words) + PASSAGE - 1) // PASSAGE
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1)
        of = np.arange(len(words)) // PASSAGE
        codes = np.frombuffer(" ".join(words).encode("utf-32-le", "replace"), np.uint32)
        kinds = CLASSES[np.minimum(codes, 0x250)]
        starts = np.concatenate([[0], ends[PASSAGE - 1 :: PASSAGE]])[:count]
        where = np.repeat(np.arange(count), np.diff(np.append(starts, len(codes))))
        shares = np.bincount(where * N_CLASSES + kinds, minlength=count * N_CLASSES).reshape(count, N_CLASSES).astype(np.float32)
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
        n = np.bincount(of, minlength=count).astype(np.float32)
        distinct = np.array([len(set(words[i * PASSAGE : (i + 1) * PASSAGE])) for i in range(count)], np.float32) / n
        same = np.bincount(of[1:], np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1), count).astype(np.float32) / n
        mean, short = np.bincount(of, lens, count) / n, np.bincount(of, lens <= 2, count) / n
        surface = np.column_stack([shares, distinct, same, np.minimum(mean, 40) / 10, short, n / PASSAGE]).astype(np.float32)
        known, fresh = self.known, self._hash
        hashed = np.fromiter((known[w] if w in known else fresh(w) for w in words), np.int64, len(words))
        counts = np.bincount(of * WORDS + hashed, minlength=count * WORDS).reshape(count, WORDS)
        at = where[:-2] * TRIGRAMS + self._trigrams(codes) % TRIGRAMS if len(codes) > 2 else np.zeros(0, np.int64)
        return surface, np.hstack([counts, np.bincount(at, minlength=count * TRIGRAMS).reshape(count, TRIGRAMS)])

    def blocks(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(surface, counts of hashed features) of the text's passages, BLOCK of them at a time."""
        words = text.split()
        if not words:
            yield np.zeros((1, SURFACE), np.float32), np.zeros((1, WORDS + TRIGRAMS), np.int64)
        for at in range(0, len(words), BLOCK * PASSAGE):
            yield self._block(words[at : at + BLOCK * PASSAGE])


def rows_of(surface: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Passage rows for the model: surface, then scaled shares of the hashed words and of the hashed trigrams."""
    words, trigrams = counts[:, :WORDS], counts[:, WORDS:]
    shares = [x * (NGRAM_SCALE / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (words, trigrams)]
    return np.hstack([surface, *shares]).astype(np.float32)


class Attention:
    """The model: standardisation, encoder, gated attention, logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "W": np.vstack([r.normal(0, SURFACE**-0.5, (SURFACE, HIDDEN)), r.normal(0, 0.05, (WIDTH - SURFACE, HIDDEN))]), "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": r.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> tuple:
        """Of passages: standardised rows, codes, the two gates and the attention's exponents."""
        p = self.p
        f = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(f @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return f, h, t, s, (t * s) @ p["w"]

    def attend(self, h: np.ndarray, e: np.ndarray, starts: np.ndarray) -> tuple:
        """Of documents: score, representation; of passages: weights; passages of each document."""
        count = np.diff(np.append(starts, len(h)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a /= np.repeat(np.add.reduceat(a, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"][0], -35, 35))), z, a, count

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        f, h, t, s, e = self.encode(x)
        y, z, a, count = self.attend(h, e, starts)
        return y, (f, h, t, s, a, z, count)

    def fit(self, bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Attention:
        """Adam on the mean log loss of batches of documents; bags as `Describer.blocks` gives them (counts in any integer type)."""
        ones = float(labels.sum())
        if not len(labels) or ones in (0, len(labels)):
            share = ones / len(labels) if len(labels) else 0.5
            self.p["d"][0] = np.clip(np.log((share + 1e-15) / (1 - share + 1e-15)), -35, 35)
            return self
        surface = np.concatenate([b[0] for b in bags]).astype(float)
        self.mean[:SURFACE], self.scale[:SURFACE] = surface.mean(axis=0), surface.std(axis=0) + 1e-3
        decay = {k: DECAY for k in self.p} | {"W": np.repeat([DECAY, NGRAM_DECAY], [SURFACE, WIDTH - SURFACE])[:, None]}
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        r, step, steps = np.random.default_rng(11), 0, epochs * ((len(bags) + BATCH - 1) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                rows = [rows_of(*bags[i]) for i in some]
                x = np.concatenate(rows).astype(float)
                starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
                step += 1
                for k, g in self._gradient(x, starts, labels[some]).items():
                    g = g + decay[k] * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = RATE * (1 - step / (steps + 1))
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        y, (f, h, t, s, a, z, count) = self.forward(x, starts)
        dy = (y - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], count, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": f.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}


def packed(text: str, of: Describer) -> bytes:
    """A text's whole description: passages, counts that are not zero, surface rows, these counts' places and values."""
    surface, counts = (np.concatenate(x) for x in zip(*of.blocks(text), strict=True))
    at = np.flatnonzero(counts)
    values = counts.ravel()[at]
    places, sizes = "<i8" if counts.size >> 31 else "<i4", "<u1" if values.max(initial=0) < 256 else "<i8"
    return b"".join([np.array([len(surface), len(at)], "<i8").tobytes(), surface.tobytes(), at.astype(places).tobytes(), values.astype(sizes).tobytes()])


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, held = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    surface = np.frombuffer(raw, np.float32, n * SURFACE, 16).reshape(n, SURFACE)
    size = n * (WORDS + TRIGRAMS)
    wide, rest = 8 if size >> 31 else 4, 16 + surface.nbytes
    kind = np.uint8 if len(raw) == rest + held * (wide + 1) else np.int64
    counts = np.zeros(size, kind)
    counts[np.frombuffer(raw, f"<i{wide}", held, rest)] = np.frombuffer(raw, kind, held, rest + wide * held)
    return surface, counts.reshape(n, -1)


class Packed(Sequence):
    """Described texts, each taken out when it is asked for, so that the driver never holds the dense counts of all."""

    def __init__(self, raws: list[bytes]):
        self.raws = raws

    def __len__(self) -> int:
        return len(self.raws)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return unpacked(self.raws[i])


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", most: int = TRAIN_ROWS) -> Attention:
    chosen = F.broadcast(training_labels(labels, target, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Describer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [packed(t, of) for t in batch["text"]]})

    rows = documents.join(chosen, "doc_id").select("doc_id", "label", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, label int, x binary")
    got = bounded_rows(rows, target, TRAIN_BYTES)
    return Attention().fit(Packed([r["x"] for r in got]), np.array([r["label"] for r in got], float))


def scorer(model: Attention) -> callable:
    """A column function text -> score."""

    def scores(texts: list[str], of: Describer) -> np.ndarray:
        codes, exponents, lengths, held = [], [], [], []

        def flush() -> None:
            if held:
                _, h, _, _, e = model.encode(np.concatenate(held))
                codes.append(h)
                exponents.append(e)
                held.clear()

        for text in texts:
            lengths.append(0)
            for block in of.blocks(text):
                held.append(rows_of(*block))
                lengths[-1] += len(block[0])
                if sum(map(len, held)) >= BLOCK:
                    flush()
        flush()
        return model.attend(np.concatenate(codes), np.concatenate(exponents), np.concatenate([[0], np.cumsum(lengths)[:-1]]))[0]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Describer()
        for texts in batches:
            out = [np.zeros(0)]
            for at in range(0, len(texts), 256):
                out.append(scores([t or "" for t in texts.iloc[at : at + 256]], of))
            yield pd.Series(np.concatenate(out))

    return F.pandas_udf(run, "double")


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """op8: score and decision for every document."""
    docs = pick(documents, doc_id="long", text="string")
    scored = docs.select("doc_id", scorer(train(docs, labels))(text_or_empty()).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
