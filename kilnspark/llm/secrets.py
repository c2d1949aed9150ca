"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. A ledger holds the (blob, rule version)
pairs that were scanned and what was found. Only pairs that the ledger lacks are scanned; findings go back to
every path that holds the blob. Equal texts are therefore scanned once, however many paths carry them.

Defined cases: a null text is the empty text; a null path keeps its row; rows that repeat stay repeated; an
empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import pick, text_or_empty

#: Changes whenever a rule below changes: blobs scanned under another version are scanned anew.
RULE_VERSION = 1

#: The base rules' patterns, least lengths and the order of kinds. `pem` and `jwt` are additions of this scanner.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = 3

FINDINGS = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), 3) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), m.end(), 4) for m in JWT.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for blob, version, text in zip(batch["blob"], batch["rule_version"], batch["text"], strict=True):
            spans = find_spans(text)
            base = [s for s in spans if s[2] < BASE]
            n = [sum(s[2] == k for s in base) for k in range(BASE)]
            rows.append((blob, version, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        yield pd.DataFrame(rows, columns=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of `versions` (a `text` column) that `ledger` lacks under this rule version.

    One shuffle carries each distinct text (copies meet on the map side first); the anti-join with the ledger
    uses the same key."""
    texts = versions.select(text_or_empty().cast("string").alias("text"))
    blobs = texts.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("blob"), "text").dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.select("blob", F.lit(rule_version).cast("int").alias("rule_version"), "text").mapInPandas(_scan, FINDINGS)


def join_paths(versions: DataFrame, ledger: DataFrame, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Every (path, blob) with the findings that the ledger has for its blob."""
    paths = versions.select(F.col(path), F.sha2(F.encode(text_or_empty().cast("string"), "UTF-8"), 256).alias("blob"))
    found = ledger.where(F.col("rule_version") == rule_version).drop("rule_version")
    return paths.join(found, "blob", "left")


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """`docs` with every secret's span replaced by [SECRET] and n_chars (if there) brought up to date; texts without a secret, and
    all other columns, stay as they are. Scans what the ledger lacks, then applies the findings to all paths."""
    texts = docs.select("text")
    new = scan_unseen(texts, ledger)
    book = new if ledger is None else ledger.unionByName(new)
    found = book.where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))

    # a row travels as one struct, so that no column of it can clash with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.encode(text_or_empty().cast("string"), "UTF-8"), 256).alias("__blob"))
    joined = rows.join(found, "__blob", "left").select("row", "__spans")
    text = F.col("row.text").cast("string")

    def mask(done: Column, span: Column) -> Column:
        start, end = (F.split(span, ":")[i].cast("int") for i in (1, 2))
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, start - done["at"]), F.lit("[SECRET]"))
        return F.struct(F.when(start >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], end).alias("at"))

    def close(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.when(F.col("__spans").isNotNull(), F.aggregate(F.split("__spans", ","), empty, mask, close))
    out = joined.select("row", masked.alias("masked"))
    fresh = {"text": F.col("masked"), "n_chars": F.length("masked")}

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        return (F.when(F.col("masked").isNotNull(), fresh[c].cast(docs.schema[c].dataType)).otherwise(own) if c in fresh else own).alias(c)

    return out.select(*map(column, docs.columns))


def secret_report(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """op10: one row for each document with counts, digest and spans of its secrets."""
    docs = pick(documents, doc_id="long", text="string")
    new = scan_unseen(docs, ledger)
    book = new if ledger is None else ledger.unionByName(new)
    return join_paths(docs, book, "doc_id").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
