"""Similarity join of documents by the Jaccard of their shingle sets: a size-aware heavy-light join.

Equal sets are one node. Two sets of sizes a <= b link only if they share `need(a + b)` shingles.

Light sets (up to a boundary): for each pair of sizes that can link, each set's subsets of exactly that many shingles are enumerated. Two
sets that link have such a subset in common, so a grouping by subset finds them; all sets of a group hang on its least one of
the smaller size, which each of them does link with.

Heavy sets: inverted lists over prefixes. All shingles are ordered by how often they occur (counters of fixed size over all documents, then the
hash), rarest first; sets that link share one of their first size - ceil(0.85 size) + 1 shingles, whatever the order is. A list's members are compared by
a lower bound of their difference (parities of hash classes, about half as many as shingles and 2048 at least), breadth first, so that a group of similar sets leaves only the links that span it and
no pair of its members is lost. Light sets that a heavy one can reach are in the lists too. A list that holds many sets is dealt into
shares, every pair of which meets in one task.

The boundary is the size that makes subsets to enumerate plus list entries to scan the fewest, counted over all sets.

What both sides find only says which sets to compare: inside the groups that come of it, the sets themselves are compared, and pairs of 100 * intersection
>= 85 * union are linked.

Defined cases: fewer words than a shingle make one of all words; null and blank texts have no shingles and link with nothing, not with
each other; null ids come after all others and are a component's id only where it has no other; rows of one id are rows of their own; an
empty table gives an empty result; other columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import MARK_BITS, Scratch, bit_table, coded, decoded, pick, text_or_empty
from kilnspark.llm.graph import connected_components
from kilnspark.llm.neardup import SALT_ABOVE, Describer, _frames, _groups, _several, _spread, dealt_blocks, exact_links, named_keys

WIDTH, SHARE = 4, (85, 100)
#: Counters of shingles: 2**COUNTERS numbers in 2**SLICES slices, whatever the data (4 MB).
COUNTERS, SLICES = 20, 6
#: Bits of a set's parities, at least and at most, and the largest size that may become light.
PARITIES, MOST_PARITIES, MOST_LIGHT = 2048, 1 << 18, 24
#: How components are dealt into shares for the exact comparison: few shares, for each set goes to all pairs of its component's.
DEALT = (1, 1 << 20, 3 << 19)


def need(total: int, share: tuple[int, int] = SHARE) -> int:
    """Shingles that two sets of so many together must share."""
    return -(-share[0] * total // (share[0] + share[1]))


def partners(size: int, share: tuple[int, int] = SHARE) -> list[tuple[int, int]]:
    """The pairs (smaller, larger) of sizes that a set of this size can be one of in a link with another set."""
    pairs = [(size, b) for b in range(size, size * share[1] // share[0] + 1)] + [(a, size) for a in range(-(-size * share[0] // share[1]), size)]
    return [(a, b) for a, b in pairs if need(a + b, share) <= a and (a, b) != (size, size) or a == b and need(a + b, share) < a]


def subsets(size: int, share: tuple[int, int] = SHARE) -> int:
    return sum(comb(size, need(a + b, share)) for a, b in partners(size, share))


def prefix_size(size: int, share: tuple[int, int] = SHARE) -> int:
    return size + (-share[0] * size // share[1]) + 1


def parity_bits(size: int) -> int:
    """Hash classes for the parities of a set: a power of two, half its size or more. Sets that have little in common differ in half of the classes, far more
    than a link allows (0.16 of the size); with fewer classes than a third of the size no difference could be told."""
    return min(max(PARITIES, 1 << (-(-size // 2) - 1).bit_length()), MOST_PARITIES)


def shingle_counts(documents: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How often shingles of each of 2**COUNTERS hash classes occur in the sets of all documents (at most 2**32 - 1).

    Each task sends its own counters in slices; slices are added up in two steps, one at a time."""
    low = COUNTERS - SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, total = Describer(width), np.zeros(1 << COUNTERS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for text in batch["text"]:
                held.append((of.shingles(text) >> np.uint64(64 - COUNTERS)).astype(np.int64))
                if len(held) > 4096 or len(held[-1]) > 1 << COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=1 << COUNTERS)
                    held.clear()
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=1 << COUNTERS)
        slices = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(1 << SLICES, -1)
        yield pd.DataFrame({"part": np.arange(1 << SLICES), "counts": [s.tobytes() for s in slices]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                sums[part] = sums.get(part, np.zeros(1 << low, np.int64)) + np.frombuffer(counts, np.uint32)
        yield pd.DataFrame({"part": list(sums), "counts": [np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()]})

    kind = "part long, counts binary"
    own = documents.select("text").mapInPandas(count, kind).withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = own.repartition("part", "deal").select("part", "counts").mapInPandas(add, kind)
    out = np.zeros(1 << COUNTERS, np.uint32)
    for row in some.repartition("part").mapInPandas(add, kind).toLocalIterator():
        out[row["part"] << low : (row["part"] + 1) << low] = np.frombuffer(row["counts"], np.uint32)
    return out


def described(documents: DataFrame, counts: np.ndarray, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, print, n, digest, prefix, parities, light) of each document (doc_id coded, text): the MD5 of its text and of its set, the
    rarest shingles, parities, and for small sets the whole set; null digest for an empty one."""
    told = documents.sparkSession.sparkContext.broadcast(counts)

    def one(text: str, of: Describer, often: np.ndarray) -> tuple:
        h = of.shingles(text)
        if not h.any():  # no words
            return 0, None, [], b"", []
        order = np.lexsort((h, often[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)]))
        bits = parity_bits(len(h))
        parities = np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)
        signed = h.view(np.int64)
        return len(h), hashlib.md5(h.tobytes()).digest(), signed[order[: prefix_size(len(h), share)]], parities.tobytes(), signed if len(h) <= MOST_LIGHT else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, often = Describer(width), told.value
        for batch in batches:
            rows = [one(t, of, often) for t in batch.pop("text")]
            yield batch.assign(**{c: [r[i] for r in rows] for i, c in enumerate(("n", "digest", "prefix", "parities", "light"))})

    rows = documents.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("print"), "text")
    return rows.mapInPandas(run, "doc_id long, print string, n long, digest binary, prefix array<long>, parities binary, light array<long>")


def boundary(nodes: DataFrame, lists: DataFrame, share: tuple[int, int] = SHARE) -> int:
    """The size up to which sets are light: the least sum of subsets to enumerate and of list entries to scan (lists: size, n of each entry)."""
    sizes = {r["size"]: r["n"] for r in nodes.where(F.col("size") <= MOST_LIGHT).groupBy("size").agg(F.count("*").alias("n")).collect()}
    scans = {r["size"]: r["n"] for r in lists.groupBy(F.least("size", F.lit(MOST_LIGHT + 1)).alias("size")).agg(F.sum("n").alias("n")).collect()}
    costs = [sum(n * subsets(k, share) for k, n in sizes.items() if k <= x) + sum(n for k, n in scans.items() if k > x) for x in range(MOST_LIGHT + 1)]
    return max(x for x, c in enumerate(costs) if c == min(costs))


def light_links(nodes: DataFrame, most: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """Links (a, b) among sets (nid, size, light) of up to `most` shingles by subsets that they have in common."""

    def one(nid: int, size: int, shingles: np.ndarray) -> Iterator[pd.DataFrame]:
        mixed = [named_keys(np.asarray(shingles, np.int64)[:, None], i)[:, 0] for i in (1, 2)]
        for a, b in partners(size, share):
            if b <= most:
                gone = size - need(a + b, share)
                out = np.array(list(combinations(range(size), gone)), np.int64).reshape(comb(size, gone), gone)
                keys = [m.sum() - m[out].sum(axis=1) for m in mixed]
                yield pd.DataFrame({"nid": nid, "side": size == a, "pair": a * 1024 + b, "k1": keys[0], "k2": keys[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[pd.DataFrame] = []
            for row in zip(batch["nid"], batch["size"].tolist(), batch["light"], strict=True):
                held += one(*row)
                if sum(map(len, held)) > 65536:
                    yield pd.concat(held)
                    held = []
            if held:
                yield pd.concat(held)

    rows = nodes.where(F.col("size") <= most).select("nid", "size", "light").mapInPandas(run, "nid long, side boolean, pair int, k1 long, k2 long")
    key = ["pair", "k1", "k2"]
    roots = rows.groupBy(*key).agg(F.min(F.when(F.col("side"), F.col("nid"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null")
    return rows.join(roots.drop("n"), key).where("a <> nid").select("a", F.col("nid").alias("b")).distinct()


def _near_links(ids: np.ndarray, sizes: np.ndarray, parities: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning links of the sets of one list that may be near enough: no pair that links is left apart."""
    widths, row, classes = np.array([len(p) for p in parities]), {}, {}
    for w in np.unique(widths).tolist():  # sets of more classes are folded to these: parities of the lower bits are sums of theirs
        row[w] = np.cumsum(widths >= w) - 1
        classes[w] = np.zeros((row[w][-1] + 1, w // 8), np.uint64)
        for v in np.unique(widths[widths >= w]):
            own = np.flatnonzero(widths == v)
            classes[w][row[w][own]] = np.bitwise_xor.reduce(np.frombuffer(b"".join(parities[own]), np.uint64).reshape(len(own), -1, w // 8), axis=1)

    def differ(i: int, others: np.ndarray) -> np.ndarray:
        if len(row) == 1:
            return np.bitwise_count(classes[widths[0]][others] ^ classes[widths[0]][i]).sum(axis=1, dtype=np.int64)
        least, out = np.minimum(widths[others], widths[i]), np.zeros(len(others), np.int64)
        for w, at in row.items():
            some = least == w
            if some.any():
                out[some] = np.bitwise_count(classes[w][at[others[some]]] ^ classes[w][at[i]]).sum(axis=1, dtype=np.int64)
        return out

    def near(sets: np.ndarray, others: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(others), bool)
        for i in sets:
            for at in range(0, len(others), 4096):
                part = others[at : at + 4096]
                total = sizes[part] + sizes[i]
                most = total - 2 * (-(-share[0] * total // (share[0] + share[1])))
                fits = np.abs(sizes[part] - sizes[i]) <= most
                fits[fits] = differ(i, part[fits]) <= most[fits]
                hit[at : at + 4096] |= fits
        return hit

    return [(int(ids[i]), int(ids[j])) for i, j in _spread(len(ids), near)]


def heavy_links(lists: DataFrame, nodes: DataFrame, scratch: Scratch, share: tuple[int, int] = SHARE) -> DataFrame:
    """Links (a, b) that connect all sets of a list (key, nid, size) that may be near enough; nodes: nid, parities."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # lists of the same sets (count and sum of hashes) are one; those without a heavy set never get here
    whole = lists.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("nid").cast("decimal(20,0)")).alias("all")).where("n > 1")
    one = scratch.table(whole.groupBy("n", "all").agg(F.min("key").alias("key")), "distinct-lists")
    dealt = dealt_blocks(lists.join(one.select("key", "n"), "key"), F.floor(F.col("n") / SALT_ABOVE) + 1)
    told = dealt.select("key", "i", "j", "nid", "size").join(nodes.select("nid", "parities"), "nid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(_near_links(*group, share) for group in _groups(batches, ["key", "i", "j"], ["nid", "size", "parities"]))

    ordered = told.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "nid")
    return ordered.select("key", "i", "j", "nid", "size", "parities").mapInPandas(run, "a long, b long").distinct()


def shared_entries(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, nid, size, n) of the prefix entries of nodes (nid, size, prefix) that several sets have.

    Keys are shuffled once, alone, to count them. A bit table of fixed size then holds back most entries that no other set has (never
    a shared one), and the rest meets the counts."""
    shared = scratch.table(_several(nodes.select(F.explode("prefix").alias("key"))), "shared-keys")
    table = nodes.sparkSession.sparkContext.broadcast(bit_table(shared.select(F.shiftrightunsigned("key", 64 - MARK_BITS).alias("mark"))))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value
        for batch in batches:
            keys = np.concatenate([np.zeros(0, np.int64), *batch["prefix"]])
            row = np.repeat(np.arange(len(batch)), batch["prefix"].map(len))
            at = (keys.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
            hit = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)) & 1)
            yield pd.DataFrame({"nid": batch["nid"].to_numpy()[row[hit]], "size": batch["size"].to_numpy()[row[hit]], "key": keys[hit]})

    held = nodes.select("nid", "size", "prefix").mapInPandas(keep, "nid long, size long, key long")
    return scratch.table(held.join(shared, "key"), "entries")


def candidate_links(nodes: DataFrame, scratch: Scratch, share: tuple[int, int] = SHARE, most: int | None = None) -> DataFrame:
    """Links (a, b) among nodes (nid, size, prefix, parities, light) that connect all sets that link, and perhaps some that don't.

    most: the boundary; chosen by cost where it is not given."""
    entries = shared_entries(nodes, scratch)
    if most is None:
        most = boundary(nodes, entries, share)
    reach = -(-share[0] * (most + 1) // share[1])
    heavy = entries.groupBy("key").agg(F.max("size").alias("largest")).where(F.col("largest") > most).select("key")
    held = entries.where(F.col("size") >= reach).join(heavy, "key").select("key", "nid", "size")
    links = heavy_links(held, nodes, scratch, share)
    return links.unionByName(light_links(nodes, most, share)) if most else links


def sets_of(documents: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """(component, nid, weight, size, shingles) of the members (nid, print, component, weight): the set of the text whose MD5 is print.

    A bit table of fixed size over the members' prints tells which texts to take apart; only their sets are shuffled, each
    text's once from each task."""
    spark, mark = documents.sparkSession, lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MARK_BITS)
    table = spark.sparkContext.broadcast(bit_table(members.select(mark("print").alias("mark"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, bits, seen = Describer(width), table.value, set()
        for batch in batches:
            at = batch["mark"].to_numpy()
            hit = batch.iloc[np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)) & 1)].drop_duplicates("print")
            hit = hit[~hit["print"].isin(seen)]
            seen.update(hit["print"])
            sets = [of.shingles(t) for t in hit["text"]]
            yield pd.DataFrame({"print": hit["print"], "size": [len(x) for x in sets], "shingles": [x.tobytes() for x in sets]})

    digest = F.md5(F.encode("text", "UTF-8"))
    found = documents.select(digest.alias("print"), mark(digest).alias("mark"), "text").mapInPandas(run, "print string, size long, shingles binary")
    one = found.groupBy("print").agg(F.first(F.struct("size", "shingles")).alias("x"))  # dealt by print, as the join needs it
    return one.join(members, "print").select("component", "nid", "weight", "x.size", "x.shingles")


def set_components(documents: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, most: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, n_sets) of each row of `documents` (doc_id, text).

    component_id: the least doc_id reachable over links; set_id: the MD5 of the set, equal for equal sets (null if it is empty); n_sets: the different
    sets of the component."""
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(coded(F.col("doc_id")).alias("doc_id"), text_or_empty().alias("text"))
    rows = scratch.table(described(docs, shingle_counts(docs, width), width, share), "described")
    told = F.min_by(F.struct("print", "n", "prefix", "parities", "light"), "print").alias("x")
    best = rows.where("digest is not null").groupBy("digest").agg(told, F.min(decoded(F.col("doc_id"))).alias("least"))
    nodes = scratch.table(best.select(F.monotonically_increasing_id().alias("nid"), "digest", "least", F.col("x.n").alias("size"), "x.print", "x.prefix", "x.parities", "x.light"), "nodes")
    loose = connected_components(candidate_links(nodes, scratch, share, most)).withColumnRenamed("node", "nid")
    members = scratch.table(nodes.select("nid", "print", "size").join(loose, "nid"), "candidates")
    weights = members.groupBy("component").agg(F.sum("size").alias("weight"))
    members = scratch.table(members.join(weights, "component").select("nid", "print", "component", "weight"), "weighed")
    links = scratch.table(exact_links(scratch.table(sets_of(docs, members, width), "sets"), share, DEALT), "links")
    found = connected_components(links).withColumnRenamed("node", "nid")
    parts = scratch.table(nodes.select("nid", "digest", "least").join(found, "nid", "left").withColumn("component", F.coalesce("component", "nid")), "components")
    roots = scratch.table(parts.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")), "roots")
    named = scratch.table(parts.join(roots, "component").select("digest", "component_id", "sets"), "named")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), decoded(F.col("doc_id"))).otherwise(F.col("component_id"))
    return out.select(decoded(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.lower(F.hex("digest")).alias("set_id"), F.coalesce("sets", F.lit(0)).alias("n_sets"))


def join_report(documents: DataFrame) -> DataFrame:
    """op11: the size of each document's set of four-word shingles and its component under a Jaccard of 0.85 or more."""
    return set_components(pick(documents, doc_id="long", text="string")).select("doc_id", "n_shingles", "component_id", F.col("set_id").isNotNull().alias("has_set"), "n_sets")
