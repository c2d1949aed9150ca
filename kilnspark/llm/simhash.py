"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of three bits (1 to 7, in turn). For each of the seven non-zero v, a
table's mask keeps the bits whose vector has an odd inner product with v. For any two differing bits some v is orthogonal
to both their vectors, and in that table the pair collides: no pair within radius two is lost. A bucket with many
fingerprints is divided by seven further masks over the bits that the first one left free, by the same argument; about twelve
bits then stay free, which bounds a bucket by 2**12 distinct fingerprints whatever the data.

Defined cases: a null or blank text has fingerprint zero, which links like any other; fewer words than a
shingle make one shingle of all words; equal fingerprints are one node, however many rows have them; null ids
never are a component's id unless all its ids are null; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import NULL_ID, coded, decoded, materialize, pick, text_or_empty
from kilnspark.llm.graph import connected_components

RADIUS = 2
#: Buckets with more distinct fingerprints are divided by the second masks; no bucket is capped.
DIVIDE_ABOVE = 128
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def simhash(text: str, shingle: int = 3) -> int:
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        pieces = [" ".join(words)]
    else:
        pieces = map(" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((digest(p, 42) for p in pieces), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(bits: list[int], radius: int = 2) -> list[int]:
    """2**(radius + 1) - 1 masks over the given bit positions; any `radius` of these are all outside some mask."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (((i % n) + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


FIRST = covering_masks(list(range(64)))
SECOND = [[m | s for s in covering_masks([b for b in range(64) if not m >> b & 1])] for m in FIRST]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns (as long) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("__text")
            yield batch.assign(fp=np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    rows = documents.select(*[coded(F.col(c)).alias(c) for c in carry], text_or_empty().alias("__text"))
    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in (*carry, "fp"))).select(*[decoded(F.col(c)).alias(c) for c in carry], "fp")


def _links_of(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the groups within radius among distinct fingerprints: one for each fingerprint that joins a group."""
    left, out = fps, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], dtype=fps.dtype)
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(front[at : at + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            out += [(int(root), int(f)) for f in front]
    return out


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what pairs within the radius connect.

    Each fingerprint goes into seven buckets; buckets of one are dropped by a count, large ones divided. Inside a
    bucket the pairs are compared block by block and only spanning links leave it."""
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(FIRST)])).alias("x")
    first = fps.select("fp", tables).select("fp", "x.t", "x.key")
    counts = first.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = materialize(first.join(counts, ["t", "key"]), "buckets")
    parts = F.array(*[F.struct(*[F.lit(t * 7 + i + 7).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")]) for t, row in enumerate(SECOND) for i, m in enumerate(row)])
    divided = held.where(F.col("n") > DIVIDE_ABOVE).select("fp", F.explode(F.slice(parts, F.col("t") * 7 + 1, 7)).alias("x")).select("fp", "x.t", "x.key")
    small = held.where(F.col("n") <= DIVIDE_ABOVE).select("fp", "t", "key")
    rows = small.unionByName(divided)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            part = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            t, key = part["t"].to_numpy(), part["key"].to_numpy()
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            done = int(cut[-1]) if len(cut) else 0
            yield _bucket_links(part["fp"].to_numpy()[:done], cut)
            rest = part.iloc[done:]
        if rest is not None and len(rest):
            yield _bucket_links(rest["fp"].to_numpy(), np.array([], int))

    def _bucket_links(values: np.ndarray, cut: np.ndarray) -> pd.DataFrame:
        links = []
        bounds = [0, *[int(c) for c in cut if c < len(values)], len(values)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                links += _links_of(np.sort(values[a:b]), radius)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def node_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) of every distinct fingerprint; component is the least fingerprint that can be reached."""
    nodes = rows.select("fp").distinct()
    found = connected_components(near_links(nodes, radius)).withColumnRenamed("node", "fp")
    return materialize(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "components")


def components(documents: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that can be reached over links.

    Rows meet their component by fingerprint, from a written table, so that a join whose one fingerprint has a large
    share of the rows can be split."""
    rows = materialize(fingerprints(documents, shingle), "simhash")
    nodes = node_components(rows, radius)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(nodes.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id")), "roots")
    named = materialize(nodes.join(roots, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(documents: DataFrame) -> DataFrame:
    """op5: fingerprint (16 hex digits) and component of every document."""
    out = components(pick(documents, doc_id="long", text="string"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
