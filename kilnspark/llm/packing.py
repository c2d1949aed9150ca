"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The covering program (as few configurations as
cover the histogram) is solved by multiplicative weights: lengths are priced and configurations weighed by steps against each
other over a pool of configurations, a knapsack dynamic program gives the best configuration of each length under the prices, which
joins the pool, and the bound that the prices prove; the weights' mean is the fractional solution. In each round it is rounded down, then up
where the counts allow, and the rest is packed by best fit. Rounds end when the fewest sequences so found are the bound rounded up, hence
proved the fewest possible, or when neither has moved for PATIENCE rounds. Where plain best fit of all pieces needs fewer
sequences than every rounded solution, its packing is taken.

Only the histogram (one number for each length) and the plan (a few thousand configurations at most, however many
documents) are on the driver. Pieces find their place by their exact rank among pieces of the same length.

Defined cases: a null text is empty, and an empty text is one piece of one token (the end id); null ids are kept; rows that
repeat are packed each; an empty table gives an empty result."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import coded, decoded, global_rank, materialize, pick, text_or_empty

CAPACITY = 2048
#: Rounds of pricing at most, multiplicative steps in each, and the rounds without a gain after which they end.
ROUNDS, STEPS, PATIENCE = 40, 100, 8
PRICE_STEP, WEIGHT_STEP = 0.3, 1.0
#: A configuration whose weight the floor cut by as much may be taken once more.
CUT = 0.02
#: Entries of a worker's caches; they bound memory, not what is encoded.
CHUNKS, WORDS = 60_000, 100_000
LAST_LATIN = "ɏ"
#: Fixed value: the tokenizer file's own split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks that end a word and form one part with each other; an apostrophe is not one, for it may open a part with the letters after it.
ENDINGS = ".,;:!?%&$#*|)]}\"+-/=<>@^_`~([{\\"
#: str.split() also splits at these, the tokenizer does not.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: A text without any of these (beyond Latin letters, or not printable) is split whole, by the same pattern with its classes written out for what is left.
NOT_LATIN = re.compile("[^\t-\r -~\x85\xa0-\xac\xae-ɏ]")
_LOWERED = sorted({low for c in range(ord(LAST_LATIN) + 1) for low in chr(c).lower()})  # some small letters come after the last
_LETTERS, _NUMBERS = ("".join(c for c in _LOWERED if unicodedata.category(c)[0] == kind) for kind in "LN")
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others take code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's, with words cached.

    The tokenizer splits at white space before it does anything that looks further, so a text's ids are its
    chunks' ids in turn. Texts and chunks of Latin letters are split by the tokenizer's pattern and its model encodes the parts;
    any other chunk, and any text with odd white space or with an added token's content, goes through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is not None:
            return got
        got = self.older_words.get(word)
        if got is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(mapped)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 32:
            self.words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
        elif max(chunk) <= LAST_LATIN:
            low = unicodedata.normalize("NFC", chunk).lower()
        else:
            return self._whole(chunk)
        letters = low.rstrip(ENDINGS)
        if letters.isalpha():  # the common case: a word and what ends it are two parts
            return self._word(letters) + self._word(low[len(letters) :]) if len(letters) < len(low) else self._word(low)
        if not chunk.isprintable():
            return self._whole(chunk)
        return b"".join(map(self._word, PIECES.findall(low)))

    def _latin(self, text: str) -> bytes:
        parts = LATIN_PIECES.findall(text.lower())
        out = list(map(self.words.get, parts))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    out[i] = self._word(parts[i])
            if len(self.words) >= WORDS:
                self.older_words, self.words = self.words, {}
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.added.search(text):
            return self._whole(text)
        if not NOT_LATIN.search(text):
            return self._latin(text)
        if ODD_SPACE.search(text):
            return self._whole(text)
        parts = text.split()
        known, older = self.chunks, self.older
        out = list(map(known.get, parts))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    p = parts[i]
                    got = known.get(p) or older.get(p)
                    if got is None:
                        got = self._chunk(p)
                    if len(p) <= 32:
                        known[p] = got
                    out[i] = got
            # two generations: what is in use moves on, the rest goes
            if len(known) >= CHUNKS:
                self.older, self.chunks = known, {}
            if len(self.words) >= WORDS:
                self.older_words, self.words = self.words, {}
        return b"".join(out)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, ended by id 0, cut where longer than the capacity. Null ids are coded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                ids = encoder.encode(text) + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "piece": piece, "start": start, "length": length, "ids_crc32": crc}) if at else batch.iloc[:0].assign(piece=0, start=0, length=0, ids_crc32=0).drop(columns="text")

    rows = documents.select(coded(F.col("doc_id")).alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


def _fillings(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: the most value of lengths (with repeats) that fit each capacity, and the length that its best filling
    takes there (0: none fits). value[s] is length s's price, -inf if absent."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    sizes = np.flatnonzero(np.isfinite(value))
    worth = value[sizes]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]) if len(sizes) else capacity + 1, capacity + 1):
        every = best[c - sizes[: upto[c]]] + worth[: upto[c]]
        at = len(every) - 1 - int(every[::-1].argmax())
        best[c], take[c] = every[at], sizes[at]
        if best[c - 1] > best[c]:
            best[c], take[c] = best[c - 1], take[c - 1]
    return best, take


def _priced(first: int, take: np.ndarray, capacity: int) -> Configuration:
    """The best configuration with length `first` (0: of all), read off the program's table."""
    used, room = ({first: 1} if first else {}), capacity - first
    while take[room]:
        s = int(take[room])
        used[s] = used.get(s, 0) + 1
        room -= s
        if s > room and not take[room]:
            break
    return tuple(sorted(used.items(), reverse=True))


def best_fit(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, Configuration]]:
    """Best fit of the longest first, by counts: [(times, configuration)]. Sequences of one filling move together, so the work depends on the
    number of distinct lengths, not of pieces."""
    held: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room: [(sequences, filling)]
    room_left = np.zeros(capacity + 1, bool)

    def put(room: int, times: int, filling: dict[int, int]) -> None:
        held.setdefault(room, []).append((times, filling))
        room_left[room] = True

    for s in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[s])
        rooms = (np.flatnonzero(room_left[s:]) + s).tolist()
        for room in [*rooms, capacity]:
            fresh = room == capacity
            groups = [(left, {})] if fresh else held.pop(room)
            room_left[room] = room_left[room] and fresh
            each = room // s
            for times, filling in groups:
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                rest = min(rest, each)
                if full:
                    put(room - each * s, full, filling | {s: each})
                if rest:
                    put(room - rest * s, 1, filling | {s: rest})
                left -= full * each + rest
                over = times - full - (rest > 0)
                if over and not fresh:
                    put(room, over, filling)
            if not left:
                break
    return [(times, tuple(sorted(filling.items(), reverse=True))) for groups in held.values() for times, filling in groups]


class Covering:
    """The covering program over a pool of configurations, as a game: shares of the sequences go to configurations (weights), shares of
    the worth to lengths (prices); coverage is measured against a guess of the optimum."""

    def __init__(self, demand: np.ndarray, start: list[tuple[int, Configuration]]):
        self.sizes = np.flatnonzero(demand)
        self.need = demand[self.sizes].astype(float)
        self.row_of = {int(s): i for i, s in enumerate(self.sizes)}
        self.pool: dict[Configuration, int] = {}
        self.rows, self.columns, self.copies = (np.zeros(0, np.int64) for _ in range(3))
        self.weight, self.worth = np.zeros(0), self.sizes * self.need / (self.sizes @ self.need)
        self.add(start)

    def add(self, made: list[tuple[float, Configuration]]) -> None:
        new = list(dict.fromkeys(c for _, c in made if c not in self.pool))
        self.pool |= {c: len(self.pool) + i for i, c in enumerate(new)}
        parts = np.array([(self.row_of[s], self.pool[c], n) for c in new for s, n in c], np.int64).reshape(-1, 3)
        self.rows, self.columns, self.copies = (np.append(x, y) for x, y in zip((self.rows, self.columns, self.copies), parts.T, strict=True))
        self.weight = np.append(self.weight, np.zeros(len(new)))
        for w, c in made:
            self.weight[self.pool[c]] += w

    def play(self, steps: int, guess: float) -> np.ndarray:
        """Optimistic multiplicative steps of both sides; their mean, the first quarter left out. Weights sum to the guess."""
        each = self.copies / self.need[self.rows] * guess
        x, y = np.log(self.weight / self.weight.sum() + 1e-9), np.log(self.worth)
        gain_x, gain_y, mean_x, mean_y = 0.0, 0.0, np.zeros(len(x)), np.zeros(len(y))
        for step in range(steps):
            w, p = np.exp(x - x.max()), np.exp(y - y.max())
            w, p = w / w.sum(), p / p.sum()
            value = np.bincount(self.columns, each * p[self.rows], len(w)) - 1
            cover = np.clip(np.bincount(self.rows, each * w[self.columns], len(p)), 0, 3) - 1
            x, y = x + WEIGHT_STEP * (2 * value - gain_x), y - PRICE_STEP * (2 * cover - gain_y)
            gain_x, gain_y = value, cover
            if 4 * step >= steps:
                mean_x, mean_y = mean_x + w, mean_y + p
        self.weight, self.worth = mean_x * (guess / mean_x.sum()), np.maximum(mean_y / mean_y.sum(), 1e-300)
        return self.weight

    def named(self, weight: np.ndarray) -> dict[Configuration, float]:
        return {c: float(weight[i]) for c, i in self.pool.items() if i < len(weight) and weight[i] > 1e-6}

    def completed(self, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
        """The least value over some scalings of a solution, with what it leaves uncovered put into sequences of one length each; and the scaled solution."""
        cover = np.bincount(self.rows, self.copies * weight[self.columns], len(self.sizes)) / self.need
        alone = self.need / (capacity // self.sizes)
        scales = 1 / np.maximum(np.quantile(cover, [0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]), 0.05)
        values = [float(t * weight.sum() + np.clip(1 - t * cover, 0, None) @ alone) for t in scales]
        return min(values), weight * scales[int(np.argmin(values))]


def _proved(price: np.ndarray, histogram: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The bound that prices prove (their worth over that of the best configuration), and the knapsack program's choices under them."""
    best, take = _fillings(price, capacity)
    sizes = np.flatnonzero(histogram)
    return float(price[sizes] @ histogram[sizes]) / best[capacity], take


def _threshold_bound(histogram: np.ndarray, capacity: int) -> float:
    """A bound from lengths alone, by dual feasible functions: prices under which no configuration is worth more than 1.

    For each t up to half: lengths over capacity - t count 1, lengths below t nothing, those between their share x of the capacity; the shares are
    then rounded to floor((k + 1) x) / k, where (k + 1) x is no whole number, for some k (k = 1: pieces over half count 1)."""
    sizes = np.flatnonzero(histogram)
    count, best = histogram[sizes].astype(float), 0.0
    rounded = [sizes / capacity]
    for k in range(1, 9):
        up = (k + 1) * sizes
        rounded.append(np.where(up % capacity, up // capacity / k, sizes / capacity))
    worth = np.array(rounded) * count
    for t in range(1, capacity // 2 + 1):
        low, high = np.searchsorted(sizes, [t, capacity - t + 1])
        best = max(best, float(count[high:].sum() + worth[:, low:high].sum(axis=1).max(initial=0.0)))
    return best


def _count(made: list[tuple[int, Configuration]]) -> int:
    return sum(times for times, _ in made)


@dataclass
class Solution:
    """weights: the fractional solution; value: what it takes; bound: no packing takes fewer; rounds: as many as were played; made: the
    rounded plan with the fewest sequences, or best fit's."""

    weights: dict[Configuration, float]
    value: float
    bound: float
    rounds: int
    made: list[tuple[int, Configuration]]


def solve(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Solution:
    """Solves and rounds the configuration program.

    Starts from best fit's configurations and prices by length. In each round multiplicative steps price the lengths and weigh the
    configurations known; the knapsack program then gives the bound that the prices (and their moving mean, which is less ragged) prove, and
    the best configuration of each length under them, which join the pool; the solution is completed and rounded."""
    demand = histogram.astype(np.int64)
    if not demand.any():
        return Solution({}, 0.0, 0.0, 0, [])
    made = start = best_fit(demand, capacity)
    program = Covering(demand, start)
    sizes, near = program.sizes, np.ones(11)
    value, found = float(_count(start)), program.weight
    bound = max(float(program.need @ sizes) / capacity, _threshold_bound(demand, capacity))
    played = idle = 0
    while played < rounds and idle < PATIENCE:
        played += 1
        price = np.full(capacity + 1, -np.inf)
        price[sizes] = program.worth / program.need
        proved, take = _proved(price, demand, capacity)
        worth = np.zeros(capacity + 1)
        worth[sizes] = program.worth
        price[sizes] = (np.convolve(worth, near, "same") / np.maximum(np.convolve(demand, near, "same"), 1))[sizes]
        proved = max(proved, _proved(price, demand, capacity)[0])
        new = [_priced(int(s), take, capacity) for s in sizes]
        program.add([(0.02 * value / len(new), c) for c in new])
        got, scaled = program.completed(program.play(STEPS, value), capacity)
        rounded = _rounded(program.named(scaled), demand)
        idle = 0 if got < value * (1 - 1e-5) or proved > bound * (1 + 1e-5) or _count(rounded) < _count(made) else idle + 1
        bound, made = max(bound, proved), min(made, rounded, key=_count)
        if got < value:
            value, found = got, scaled
        if _count(made) <= np.ceil(bound - 1e-6):
            break
    return Solution(program.named(found), min(value, float(_count(made))), bound, played, made)


def _rounded(weights: dict[Configuration, float], histogram: np.ndarray) -> list[tuple[int, Configuration]]:
    """Whole numbers of sequences near a fractional solution: its floors, then one more of each in the order of what the floor cut, as far
    as the counts allow; what is left is packed by best fit."""
    left, out = histogram.astype(np.int64).copy(), []

    def taken(c: Configuration, most: int) -> None:
        times = min([most, *(int(left[s]) // n for s, n in c)])
        if times > 0:
            out.append((times, c))
            for s, n in c:
                left[s] -= n * times

    order = sorted(weights, key=lambda c: (-weights[c], c))
    for c in order:
        taken(c, int(weights[c]))
    for c in sorted(order, key=lambda c: (int(weights[c]) - weights[c], c)):
        if weights[c] % 1 >= CUT:
            taken(c, 1)
    return out + best_fit(left, len(histogram) - 1)


def pack(rows: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """`rows` (with a length column, 1 to capacity) with sequence_id and offset."""
    got = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in got:
        histogram[r["length"]] = r["n"]
    configurations = solve(histogram, capacity).made
    taken, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for times, made in configurations:
        offset = 0
        for s, n in made:
            runs.append((s, taken[s], n, sequence, offset))
            taken[s] += n * times
            offset += s * n
        sequence += times
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    first_of = np.concatenate([[0], np.cumsum(histogram)])[:-1]
    starts = first_of[runs[:, 0]] + runs[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("__rank").to_numpy()
            run = np.searchsorted(starts, rank, side="right") - 1
            inside = rank - starts[run]
            length, _, copies, sequence, offset = runs[run].T
            yield batch.assign(sequence_id=sequence + inside // copies, offset=offset + (inside % copies) * length)

    shares = max(64, int(histogram.max()) >> 16)  # of the pieces of one length, each ranked in one task
    bucketed = rows.withColumn("__bucket", F.col("length").cast("long") * shares + F.pmod(F.xxhash64(id_column, "piece"), F.lit(shares)))
    ranked = global_rank(bucketed, [id_column, "piece", "start"], "__bucket", "__rank").drop("__bucket").select(*rows.columns, "__rank")
    return ranked.mapInPandas(place, f"{rows.schema.simpleString()[7:-1]}, sequence_id bigint, offset bigint".replace(":", " "))


def packing_report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """op4: every piece of every document with its sequence and place."""
    rows = materialize(pieces(pick(documents, doc_id="long", text="string"), path or tokenizer_path()), "pieces")
    return pack(rows).withColumn("doc_id", decoded(F.col("doc_id")))
