"""Canonical exact digests of documents.

A text's canonical form is NFKC, case-folded, NFKC again, with white space collapsed to single blanks and trimmed. Its
fingerprint is the 128-bit XXH3 of that form. Inside a bucket of equal fingerprints the canonical bytes are
compared; should two forms ever share 128 bits, the second and later ones get `-1`, `-2`, ... appended.

Defined cases: a null text is the empty text; a null doc_id sorts before all others; rows that repeat a doc_id follow
one another in an order fixed by their texts; one row alone is its own next document; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import MARK_BITS, bit_table, materialize, pick, text_or_empty

#: A bucket of neighbouring documents holds about so many bytes of text; it is streamed, so this bounds no memory.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 20_000
NULL_KEY = -(1 << 63)
#: Differing forms of equal fingerprints up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_FORMS = 50_000


def canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def fingerprint(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def witness(canon: bytes) -> str:
    """A second, independent digest; it only addresses the forms of one fingerprint that differ."""
    return hashlib.blake2b(canon, digest_size=16).hexdigest()


def collisions(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """(fingerprint, witness, variant) of canonical forms that share a fingerprint but not their bytes, variant >= 1.

    prints: the fingerprint of every document. Texts whose fingerprint no other text has need no comparison: a bit table of
    fixed size keeps most of them back (the more it is filled, the fewer; it never keeps back a shared one). The others are
    grouped by (fingerprint, bytes): the grouping compares the bytes, copies meet on the map side first, so a bucket of
    any size sends one row from each task. The bytes travel compressed (deterministic and lossless)."""
    shared = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    mark = F.shiftright(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"), 32 - MARK_BITS).alias("mark")
    table = documents.sparkSession.sparkContext.broadcast(bit_table(shared.select(mark)))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, bits = zstandard.ZstdCompressor(level=1), table.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                form = canonical(text).encode("utf-8", "replace")
                print_ = fingerprint(form)
                mark = int(print_[:8], 16) >> (32 - MARK_BITS)
                if bits[mark >> 3] >> (7 - (mark & 7)) & 1:
                    rows.append((print_, witness(form), pack.compress(form)))
            yield pd.DataFrame(rows, columns=["fingerprint", "witness", "form"])

    each = documents.select(text_or_empty().alias("text")).mapInPandas(forms, "fingerprint string, witness string, form binary")
    distinct = materialize(each.groupBy("fingerprint", "form").agg(F.min("witness").alias("witness")).select("fingerprint", "witness"), "forms")
    several = distinct.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    order = Window.partitionBy("fingerprint").orderBy("witness")
    return materialize(distinct.join(several, "fingerprint").withColumn("variant", F.row_number().over(order) - 1).where("variant > 0"), "variants")


def tie_of(raw: bytes) -> bytes:
    """What orders rows of one id: the digest of the text."""
    return xxhash.xxh3_128_digest(raw)


def high_part(ties: list[bytes]) -> np.ndarray:
    """The ties' first six bytes as numbers, in the same order; quantiles are exact values of such."""
    return np.array([int.from_bytes(t[:6], "big") for t in ties], np.int64)


#: Below all ties; and the numbers up to which Spark's quantiles are values that occur.
LEAST, EXACT = -1, 1 << 53
#: Equal rows that one row stands for at most, while they wait to be written out.
COPIES = 1 << 16


def _occurring(docs: DataFrame, near: np.ndarray) -> np.ndarray:
    """For each number (ascending), the least id that is not below it; the largest id where all are."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": np.searchsorted(near, batch["k"].to_numpy(np.int64), "right"), "k": batch["k"]})

    rows = docs.select("k").mapInPandas(first, "at int, k long").groupBy("at").agg(F.min("k").alias("k"), F.max("k").alias("most")).collect()
    least, out, after = {r["at"]: r["k"] for r in rows}, near.copy(), max(r["most"] for r in rows)
    for i in range(len(near) - 1, -1, -1):
        after = out[i] = least.get(i + 1, after)
    return out


def cut_places(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, bytes], int]]:
    """(ids, ties) of the first row of each bucket, and the rows (id, tie) that repeat often, with their number.

    Cuts are quantiles of the ids over all rows. An id that several quantiles fall on is cut by the quantiles of its rows' ties; a
    text that several of these fall on repeats often. An id with one cut has the tie LEAST."""
    marks = docs.agg(F.percentile_approx("k", [i / buckets for i in range(buckets)], 100_000).alias("q"), F.min("k").alias("least")).first()
    if marks["least"] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    found = np.array([*marks["q"], marks["least"]], np.int64)
    if np.abs(found[found != NULL_KEY]).max(initial=0) > EXACT:
        found = np.array([*_occurring(docs, np.sort(found[:-1])), marks["least"]], np.int64)
    ids, times = np.unique(found, return_counts=True)
    hot = {int(i): int(n) for i, n in zip(ids, times, strict=True) if n - (i == marks["least"]) > 1}  # at most half as many as there are buckets
    ties, often = {int(i): [LEAST] for i in ids}, {}
    if hot:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = [tie_of(t.encode("utf-8", "replace")) for t in batch["text"]]
                yield pd.DataFrame({"k": batch["k"], "t": high_part(own), "tie": own})

        rows = docs.where(F.col("k").isin(list(hot))).select("k", "text").mapInPandas(read, "k long, t long, tie binary")
        counts = materialize(rows.groupBy("k", "t", "tie").agg(F.count("*").alias("n")), "hot-ids")
        most = max(hot.values())
        quantiles = counts.groupBy("k").agg(F.percentile_approx("t", [i / most for i in range(most)], 100_000).alias("q"), F.min("t").alias("least"), F.sum("n").alias("rows"))
        share = {}
        for r in quantiles.collect():
            at = [r["q"][i * most // hot[r["k"]]] for i in range(1, hot[r["k"]])]
            ties[r["k"]] = sorted({r["least"], *at})
            share[r["k"]] = max(2, r["rows"] // hot[r["k"]])
        large = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("k")]
        often = {(r["k"], bytes(r["tie"])): r["n"] for r in counts.where(F.col("n") >= large).collect()}  # fewer than twice the buckets
    return np.repeat(ids, [len(ties[int(i)]) for i in ids]), np.array([t for i in ids for t in ties[int(i)]], np.int64), often


def bucket_of(ids: np.ndarray, ties: np.ndarray, keys: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The last cut that is not after each row."""
    left, right = np.searchsorted(ids, keys, "left"), np.searchsorted(ids, keys, "right")
    upto = right.copy()
    for a in np.unique(left[right > left]):
        own = np.flatnonzero((left == a) & (right > left))
        upto[own] = a + np.searchsorted(ties[a : right[own[0]]], high[own], "right")
    return upto - 1


def with_next(documents: DataFrame) -> DataFrame:
    """Digests of every text, its edited text and the next document's text; `times`: for how many equal rows a row stands.

    The ids' quantiles (over all rows; inside a frequent id, those of its texts' digests) cut the documents into buckets of neighbours; the
    texts are shuffled once, by bucket, and streamed in order. Each cut is an existing row, so it names the first document of its bucket,
    which is sent to the bucket before as well (the first bucket's to the last): no row needs another task's rows. Rows that repeat often in id
    and text go once from each task; all but the last of them are followed by an equal one."""
    docs = documents.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(NULL_KEY)).alias("k"), text_or_empty().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = int(min(MOST_BUCKETS, max(1, size["n"]), (size["bytes"] or 0) // BUCKET_BYTES + 1))
    cut_ids, cut_ties, often = cut_places(docs, buckets)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            keys = batch["k"].to_numpy(np.int64)
            raw = [t.encode("utf-8", "replace") for t in batch["text"]]
            ties = [tie_of(r) for r in raw]
            if often:
                fresh = []
                for i, who in enumerate(zip(keys.tolist(), ties, strict=True)):
                    if who not in often or who not in sent:
                        fresh.append(i)
                        sent |= {who} & often.keys()
                keys, raw, ties = keys[fresh], [raw[i] for i in fresh], [ties[i] for i in fresh]
            high = high_part(ties)
            at = bucket_of(cut_ids, cut_ties, keys, high)
            own = pd.DataFrame({"bucket": at.astype(np.int32), "guest": np.zeros(len(keys), np.int8), "k": keys, "tie": ties, "z": [pack.compress(r) for r in raw]})
            first = own[(cut_ids[at] == keys) & ((cut_ties[at] == high) | (cut_ties[at] == LEAST))].assign(guest=np.int8(1))
            first["bucket"] = ((first["bucket"] - 1) % max(1, len(cut_ids))).astype(np.int32)
            yield pd.concat([own, first])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        last = None  # (bucket, (k, tie), text, canonical bytes)

        def told(before: tuple, text: str, canon: bytes, times: int) -> tuple:
            _, (k, _), own, own_canon = before
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            form = canonical(edited).encode("utf-8", "replace")
            return (k, len(own), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), fingerprint(own_canon), fingerprint(form), float(own_canon == form), float(own_canon == canon), witness(own_canon), witness(form), times)

        for batch in batches:
            rows = []
            for bucket, guest, k, tie, z in zip(batch["bucket"], batch["guest"], batch["k"].tolist(), batch["tie"], batch["z"], strict=True):
                who = (k, bytes(tie))
                if last is not None and last[0] != bucket:
                    last = None
                if last is None and guest or last is not None and not guest and who == last[1] and who in often:
                    continue
                text = unpack.decompress(z).decode("utf-8", "replace")
                canon = canonical(text).encode("utf-8", "replace")
                if last is not None:
                    rows.append(told(last, text, canon, 1))
                last = None if guest else (bucket, who, text, canon)
                if last is not None and who in often:
                    more = often[who] - 1
                    rows += [told(last, text, canon, min(COPIES, more - i)) for i in range(0, more, COPIES)]
            yield pd.DataFrame(rows, columns=["k", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "w", "edited_w", "times"])

    dealt = docs.select("k", "text").mapInPandas(deal, "bucket int, guest byte, k long, tie binary, z binary")
    ordered = dealt.repartition(max(1, min(buckets, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "bucket").sortWithinPartitions("bucket", "guest", "k", "tie")
    out = ordered.mapInPandas(read, "k long, n_chars long, edited_sha256 string, fp string, edited_fp string, near_edited double, near_next double, w string, edited_w string, times int")
    return out.withColumn("doc_id", F.when(F.col("k") != NULL_KEY, F.col("k"))).drop("k")


def fingerprint_report(documents: DataFrame) -> DataFrame:
    """op1: fingerprints of every text and of its edited text, with exact likeness (1 where the canonical bytes are equal, else 0)."""
    docs = pick(documents, doc_id="long", text="string")
    rows = materialize(with_next(docs), "fingerprints")
    odd = collisions(docs, rows.select(F.col("fp").alias("fingerprint")))
    few = odd.count() <= BROADCAST_FORMS

    def named(df: DataFrame, fp: str, w: str, out: str) -> DataFrame:
        side = odd.select(F.col("fingerprint").alias(fp), F.col("witness").alias(w), F.col("variant").alias("__v"))
        joined = df.join(F.broadcast(side) if few else side, [fp, w], "left")
        return joined.withColumn(out, F.when(F.col("__v").isNull(), F.col(fp)).otherwise(F.concat_ws("-", fp, F.col("__v").cast("string")))).drop("__v")

    several = rows.where("times > 1").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.where("times = 1").unionByName(several.withColumn("times", F.explode(F.array_repeat("times", F.col("times")))))
    done = named(named(rows, "fp", "w", "fingerprint"), "edited_fp", "edited_w", "edited_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
