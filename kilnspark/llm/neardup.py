"""Near-duplicates of a given similarity by SimHash, for corpora: five-word shingles, Jaccard 0.8 or more.

One SimHash is too coarse for that similarity (half of such pairs differ in more than seven of 64 bits when shingles are hashed),
so each text gets SEEDS independent fingerprints of its distinct words. Covering masks give all pairs within RADIUS bits a
common bucket under each of them. Beside them BANDS buckets come from the five-word shingles themselves, each keyed by WIDE
minima: a pair of Jaccard j lacks a common one with probability (1 - j**WIDE)**BANDS, 3e-6 at 0.8, whatever the edits are (a
longer or shorter tail and a replaced block move the fingerprints of words too far). Keys are counted first; only those that several
texts have meet their texts. Inside a bucket a breadth-first search runs over all pairs whose sketches of five-word
shingles agree loosely, so that a text joins a group over any member's link and no link of an absorbed text is lost. A bucket of a
mask with many texts is divided by further covering masks over the bits that the first one left free; a bucket
that is large even so, or comes from shingles, is dealt into shares, every pair of which meets in one task.

The groups that come of it only say which texts to compare: inside them the sets of shingles (64-bit hashes) are compared, and
texts of an exact Jaccard of 0.8 or more are linked. Large groups are dealt like large buckets.

Defined cases: texts without words are equal to each other; texts of fewer than five words have one shingle of all words;
equal texts are one node; null ids come after all others; columns of any name are carried as they are; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import MARK_BITS, Scratch, bit_table, coded, decoded, text_or_empty
from kilnspark.llm.graph import connected_components
from kilnspark.llm.simhash import covering_masks

SHINGLE = 5
SEEDS = 2
RADIUS = 3
#: Minima of a sketch; the share of agreeing ones that makes a candidate (standard error at 0.8: 0.020).
MINIMA, LOOSE = 384, 0.72
#: A candidate group is dealt into shares: SPREAD at most, as long as a share stays below SHARE_SHINGLES (memory of a task).
SPREAD, SPREAD_SHINGLES, SHARE_SHINGLES = 8, 1 << 16, 1 << 19
#: Buckets of a mask with more texts are divided by further masks.
DIVIDE_ABOVE = 512
#: Larger buckets are dealt into shares of about so many texts, and each pair of shares meets.
SALT_ABOVE = 4096
#: Texts whose neighbours are sought at once.
FRONT = 16
#: Buckets by shingles, and the minima that key each.
BANDS, WIDE = 32, 5
KNOWN = 100_000
MASKS = covering_masks(list(range(64)), RADIUS)
#: Under each mask, those that divide its buckets; as one array of unsigned numbers each.
DIVIDED = np.array([[m | s for s in covering_masks([b for b in range(64) if not m >> b & 1], RADIUS)] for m in MASKS], np.uint64)
MASKED = np.array(MASKS, np.uint64)
_random = np.random.default_rng(20)
MIX = _random.integers(1 << 62, 1 << 63, SEEDS, dtype=np.uint64) | np.uint64(1)
FACTORS = _random.integers(1, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def named_keys(values: np.ndarray, first: int) -> np.ndarray:
    """64-bit keys of values under the tables numbered from `first` on, along the last axis."""
    with np.errstate(over="ignore"):
        x = (values.astype(np.uint64) + BASE * np.arange(first, first + values.shape[-1], dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


class Describer:
    """Fingerprints, keys of all buckets and sketch of a text, or its set of shingles of any width; remembers the hashes of words."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.known: dict[bytes, int] = {}
        self.width = width

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= KNOWN:
            self.known.clear()
        got = self.known[word] = xxhash.xxh64_intdigest(word, 42) or 1
        return got

    def words(self, text: str) -> np.ndarray:
        # of bytes, lower() folds A-Z alone and split() parts at the space and 9 to 13 alone
        known, fresh, words = self.known, self._hash, text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter((known.get(w) or fresh(w) for w in words), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        """The set of shingles, sorted; that of a text without words is one zero."""
        h = self.words(text)
        return np.unique(self._shingles(h, self.width)) if len(h) else np.zeros(1, np.uint64)

    def __call__(self, text: str) -> tuple[list[int], np.ndarray, bytes]:
        h = self.words(text)
        prints, bands, sketch = [0] * SEEDS, np.zeros(BANDS, np.uint64), bytes(MINIMA)
        if len(h):
            with np.errstate(over="ignore"):
                prints = [self._simhash(np.unique(h), m) for m in MIX]
                bands, sketch = self._sketch(h)
        masked = np.array(prints, np.int64).view(np.uint64)[:, None] & MASKED
        return prints, named_keys(np.concatenate([masked.ravel(), bands]), 0), sketch

    @staticmethod
    def _simhash(words: np.ndarray, mix: np.uint64) -> int:
        mixed = (words ^ (words >> np.uint64(29))) * mix
        mixed = (mixed ^ (mixed >> np.uint64(32))) * BASE
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 8192):
            ones += np.unpackbits(mixed[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(ones * 2 > len(mixed), bitorder="little").view("<i8")[0])

    @staticmethod
    def _shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
        width = min(width, len(words))
        shingles = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            shingles = shingles * BASE + words[i : len(words) - width + 1 + i]
        return (shingles ^ (shingles >> np.uint64(31))) * BASE

    @classmethod
    def _sketch(cls, words: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.unique(cls._shingles(words) >> np.uint64(32)).astype(np.uint32)
        least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, (low[at : at + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
        keys = np.zeros(BANDS, np.uint64)
        for minimum in least[: BANDS * WIDE].reshape(BANDS, WIDE).T:
            keys = (keys + minimum) * BASE
            keys ^= keys >> np.uint64(31)
        return keys, ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def describe(documents: DataFrame) -> DataFrame:
    """(__id, __print, nid, fps, keys, sketch): __print is the text's MD5, nid its 64-bit hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Describer()
        for batch in batches:
            both = [of(t) for t in batch.pop("__text")]
            yield batch.assign(fps=[b[0] for b in both], keys=[b[1] for b in both], sketch=[b[2] for b in both])

    text = text_or_empty().cast("string")
    rows = documents.select(coded(F.col("doc_id")).alias("__id"), F.md5(F.encode(text, "UTF-8")).alias("__print"), F.xxhash64(text).alias("nid"), text.alias("__text"))
    return rows.mapInPandas(run, "__id long, __print string, nid long, fps array<long>, keys array<long>, sketch binary").withColumn("__id", decoded(F.col("__id")))


def _spread(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of the groups that near(texts, others) connects: breadth first, one for each text that joins a group."""
    left, out = np.arange(n), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            some, front = front[:FRONT], front[FRONT:]
            hit = near(np.array(some), left)
            out += [(root, int(i)) for i in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return out


def _sketch_links(sketches: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links of one bucket between the texts whose sketches agree by LOOSE."""

    def near(texts: np.ndarray, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(others), bool)
        for i in texts:
            for at in range(0, len(others), 4096):
                part = others[at : at + 4096]
                hit[at : at + 4096] |= np.count_nonzero(sketches[part] == sketches[i], axis=1) >= LOOSE * MINIMA
        return hit

    return [(int(ids[i]), int(ids[j])) for i, j in _spread(len(ids), near)]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str]) -> Iterator[list[np.ndarray]]:
    """The values of each run of rows with equal keys, whole, however batches cut it."""
    rest, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        told, kept = [batch[k].to_numpy() for k in keys], [batch[v].to_numpy() for v in values]
        cut = np.zeros(len(batch) - 1, bool)
        for t in told:
            cut |= t[1:] != t[:-1]
        starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            now = tuple(t[a] for t in told)
            if rest and now != key:
                yield [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*rest, strict=True)]
                rest = []
            key = now
            rest.append([v[a:b] for v in kept])
    if rest:
        yield [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*rest, strict=True)]


def _frames(links: Iterator[list[tuple[int, int]]]) -> Iterator[pd.DataFrame]:
    """Links (a, b) in frames of some thousands."""
    held: list[tuple[int, int]] = []
    for some in links:
        held += some
        if len(held) >= 8192:
            yield pd.DataFrame(held, columns=["a", "b"], dtype="int64")
            held = []
    yield pd.DataFrame(held, columns=["a", "b"], dtype="int64")


def dealt_blocks(rows: DataFrame, parts: Column, name: str = "nid") -> DataFrame:
    """`rows` with i and j: a group dealt into `parts` shares by a hash of `name` goes to all pairs of shares, so that any two of its rows meet."""
    share = F.pmod(F.xxhash64(name), F.col("__parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), (F.col("__parts") - 1).cast("int"))).alias("__other")
    spread = rows.withColumn("__parts", parts.cast("long")).select(*rows.columns, share.alias("__share"), every)
    return spread.select(*rows.columns, F.least("__share", "__other").alias("i"), F.greatest("__share", "__other").alias("j"))


def _several(keyed: DataFrame) -> DataFrame:
    """(key, n) of the keys that several rows have."""
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def shared_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, nid, n) of the buckets with several of the nodes (nid, fps, keys).

    The keys of all nodes are shuffled once, alone, to count them. A bit table of fixed size then holds back most
    rows whose key nothing shares (the more it is filled, the fewer; never a shared one), and the rest meets the counts."""
    shared = scratch.table(_several(nodes.select(F.explode("keys").alias("key"))), "shared-keys")
    mark = F.shiftrightunsigned("key", 64 - MARK_BITS)
    table = nodes.sparkSession.sparkContext.broadcast(bit_table(shared.select(mark.alias("mark"))))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value
        for batch in batches:
            keys = np.array(batch["keys"].tolist(), np.int64).reshape(len(batch), -1)
            at = (keys.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
            row, slot = np.nonzero(bits[at >> 3] >> (7 - (at & 7)) & 1)
            yield pd.DataFrame({"nid": batch["nid"].to_numpy()[row], "key": keys[row, slot], "slot": slot})

    first = nodes.select("nid", "keys").mapInPandas(keep, "nid long, key long, slot int")
    held = scratch.table(first.join(shared, "key"), "buckets")
    large = (F.col("n") > DIVIDE_ABOVE) & (F.col("slot") < SEEDS * len(MASKS))

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["slot"].to_numpy()
            prints = np.array(batch["fps"].tolist(), np.int64).reshape(len(batch), SEEDS)[np.arange(len(batch)), slot // len(MASKS)]
            under = prints.view(np.uint64)[:, None] & DIVIDED[slot % len(MASKS)]
            keys = named_keys(under + slot[:, None].astype(np.uint64) * MIX[0], SEEDS * len(MASKS) + BANDS)
            yield pd.DataFrame({"nid": np.repeat(batch["nid"].to_numpy(), len(MASKS)), "key": keys.ravel()})

    parts = held.where(large).select("nid", "slot").join(nodes.select("nid", "fps"), "nid").mapInPandas(divide, "nid long, key long")
    divided = scratch.table(parts, "divided")
    return held.where(~large).select("key", "nid", "n").unionByName(divided.join(_several(divided), "key").select("key", "nid", "n"))


def similar_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes (nid, fps, keys, sketch; nid distinct) that share a bucket and whose sketches agree by LOOSE;
    they connect what all such pairs connect."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = shared_buckets(nodes, scratch)
    # buckets of the same texts (count and sum of hashes) are one
    whole = held.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("nid").cast("decimal(20,0)")).alias("all"))
    one = scratch.table(whole.groupBy("n", "all").agg(F.min("key").alias("key")).select("key"), "distinct-buckets")
    dealt = dealt_blocks(held.join(one, "key"), F.floor(F.col("n") / SALT_ABOVE) + 1)
    told = dealt.select("key", "i", "j", "nid").join(nodes.select("nid", "sketch"), "nid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _groups(batches, ["key", "i", "j"], ["nid", "sketch"])
        yield from _frames(_sketch_links(np.frombuffer(b"".join(x), np.uint8).reshape(-1, MINIMA), ids) for ids, x in groups)

    ordered = told.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "nid")
    return ordered.select("key", "i", "j", "nid", "sketch").mapInPandas(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(component, nid, size, shingles) of the members (nid, __first, component): the set of the text whose MD5 is __first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Describer()
        for batch in batches:
            sets = [of.shingles(t) for t in batch.pop("__text")]
            yield batch.assign(size=[len(x) for x in sets], shingles=[x.tobytes() for x in sets])

    text = text_or_empty().cast("string")
    texts = docs.select(F.xxhash64(text).alias("nid"), F.md5(F.encode(text, "UTF-8")).alias("__first"), text.alias("__text"))
    one = texts.join(members, ["nid", "__first"]).groupBy("component", "nid").agg(F.first("__text").alias("__text"))
    return one.mapInPandas(run, "component long, nid long, size long, shingles binary")


def _set_links(ids: np.ndarray, shingles: np.ndarray, share: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """Spanning links of the texts whose sets of shingles have a Jaccard of share[0] / share[1] or more."""
    sizes = np.array([len(x) // 8 for x in shingles], np.int64)
    names, codes = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    sets = [codes[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(len(names), bool)

    def near(texts: np.ndarray, others: np.ndarray) -> np.ndarray:
        hit, theirs = np.zeros(len(others), bool), sizes[others]
        every, starts = np.concatenate([sets[j] for j in others]), np.cumsum(theirs) - theirs
        for i in texts:
            mark[sets[i]] = True
            shared = np.add.reduceat(mark[every], starts, dtype=np.int64)
            mark[sets[i]] = False
            hit |= share[1] * shared >= share[0] * (sizes[i] + theirs - shared)
        return hit

    return [(int(ids[i]), int(ids[j])) for i, j in _spread(len(ids), near)]


def exact_links(sets: DataFrame, share: tuple[int, int] = (4, 5), dealt_by: tuple[int, int, int] = (SPREAD, SPREAD_SHINGLES, SHARE_SHINGLES)) -> DataFrame:
    """Links (a, b) that connect what the pairs of a Jaccard of share[0] / share[1] or more inside the components of `sets` connect.

    dealt_by: the most shares of a component that fewer would hold, the shingles of each of these, and those that a share never exceeds. Sets
    that know the shingles of their component (weight) are not joined with these."""
    spread, some, most = dealt_by
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = "weight" in sets.columns
    weighed = sets.withColumnRenamed("weight", "__weight") if known else sets.join(sets.groupBy("component").agg(F.sum("size").alias("__weight")), "component")
    parts = F.greatest(F.least(F.floor(F.col("__weight") / some) + 1, F.lit(spread)), F.floor(F.col("__weight") / most) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(_set_links(*group, share) for group in _groups(batches, ["component", "i", "j"], ["nid", "shingles"]))

    dealt = dealt_blocks(weighed, parts).repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "nid")
    return dealt.select("component", "i", "j", "nid", "shingles").mapInPandas(run, "a long, b long").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near-duplicates, all columns: the least doc_id (null last), then the least MD5 of the text."""
    scratch, last = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.table(describe(docs), "described")
    best = rows.groupBy("nid").agg(F.min_by(F.struct("__print", "fps", "keys", "sketch"), "__print").alias("x"))
    nodes = scratch.table(best.select("nid", F.col("x.__print").alias("__first"), "x.fps", "x.keys", "x.sketch"), "nodes")
    loose = connected_components(similar_links(nodes, scratch)).withColumnRenamed("node", "nid")
    members = scratch.table(nodes.select("nid", "__first").join(loose, "nid"), "candidates")
    sets = scratch.table(shingle_sets(docs, members), "shingle-sets")
    found = connected_components(exact_links(sets)).withColumnRenamed("node", "nid")
    named = scratch.table(nodes.join(found, "nid", "left").select("nid", "__first", F.coalesce("component", "nid").alias("component")), "named")
    # two texts with one 64-bit hash stay two: the one that is not the node's own is a group of its own
    own = rows.select("__id", "__print", "nid").join(named, "nid").withColumn("__apart", F.when(F.col("__print") != F.col("__first"), F.col("__print")).otherwise(F.lit("")))
    key = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__print").alias("print"))
    first = own.groupBy("component", "__apart").agg(F.min(key).alias("x")).select("x.id", "x.print")
    counts = rows.groupBy("__id", "__print").agg(F.count("*").alias("n")).where("n > 1")
    keep = first.join(counts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left")
    kept = last.table(keep.select(coded(F.col("id")).alias("__id"), F.col("print").alias("__print"), (F.col("n").isNotNull()).alias("several")).distinct(), "kept")
    scratch.drop()
    # a row travels as one struct, so that no column of it can clash with the keys; only rows that repeat as a whole are grouped
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), coded(F.col("doc_id")).alias("__id"), F.md5(F.encode(text_or_empty().cast("string"), "UTF-8")).alias("__print"))
    single = keyed.join(kept.where("not several"), ["__id", "__print"], "left_semi").select("row.*")
    several = keyed.join(kept.where("several"), ["__id", "__print"], "left_semi").groupBy("__id", "__print").agg(F.first("row").alias("row"))
    return single.unionByName(several.select("row.*"))
