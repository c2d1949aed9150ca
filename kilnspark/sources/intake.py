"""Intake of files and pages: sniffing, extension policy, quarantine, decoding, archives, locators."""

from __future__ import annotations

import io
import ipaddress
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions import text as text_functions
from kilnspark.operators import governance

#: Magic bytes (hexadecimal) and media types; extensions.
MAGIC = {"255044462D": "application/pdf", "504B0304": "application/zip", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg"}
MEDIA = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".epub": "application/epub+zip", ".html": "text/html",
    ".htm": "text/html", ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain", ".csv": "text/csv",
    ".tsv": "text/tab-separated-values", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".xml": "text/xml", ".json": "application/json", ".zip": "application/zip", ".tar": "application/x-tar",
}
DISALLOWED = [".exe", ".dll", ".so", ".dylib", ".sh", ".bat", ".ps1", ".py", ".js", ".php", ".cgi", ".class", ".jar", ".wasm", ".ttf", ".otf", ".woff"]
ZIPPED_OFFICE = [".docx", ".pptx", ".xlsx", ".epub"]
MOST_BYTES = 200 << 20
BINARY = ["application/pdf", "application/zip", "image/png", "image/jpeg", "image/gif"]


def extension(name: Column) -> Column:
    """The last suffix in lower case, empty if there is none; a name that only starts with a dot has none."""
    return F.regexp_extract(F.lower(name), r"[^/.][^/]*?(\.[^./]*)$", 1)


def sniff(name: Column, head: Column) -> Column:
    """struct(media_type, from_magic) of a name and the first bytes."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    by_magic = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC.items()):
        by_magic = F.when(F.hex(F.substring(head, 1, 8)).startswith(magic), kind).otherwise(by_magic)
    zipped = F.when((by_magic == "application/zip") & extension(name).isin(ZIPPED_OFFICE), table[extension(name)]).otherwise(by_magic)
    return F.struct(F.coalesce(zipped, table[extension(name)], F.lit("application/octet-stream")).alias("media_type"), by_magic.isNotNull().alias("from_magic"))


def extension_allowed(name: Column) -> Column:
    ext = extension(name)
    return (ext == "") | (ext.isin(list(MEDIA)) & ~ext.isin(DISALLOWED))


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def quarantine_reason(name: Column, size: Column, content: Column, media_type: Column) -> Column:
    """Why a file is held back; null if it is not. A frame of reasons takes the place of exceptions."""
    broken = F.contains(F.decode(content, "ISO-8859-1"), F.lit("\0")) | ~F.is_valid_utf8(content.cast("string"))
    return F.when(size == 0, "empty").when(size > MOST_BYTES, "too_large").when(~extension_allowed(name), "extension").when(media_type.isin(BINARY) & broken, "binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, byte_size, sha256, media_type, from_magic, reason, text) for each file below a folder; text where not held back."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
    rows = rows.withColumn("s", sniff(F.col("name"), F.col("content"))).select("*", "s.media_type", "s.from_magic").drop("s")
    rows = rows.withColumn("reason", quarantine_reason(F.col("name"), F.col("byte_size"), F.col("content"), F.col("media_type")))
    return rows.withColumn("text", F.when(F.col("reason").isNull(), decode(F.col("content")))).drop("content")


def archive_problems(files: DataFrame, *, members: int = 2000, ratio: float = 200.0, total: int = MOST_BYTES) -> DataFrame:
    """(name, problem) of each (name, content) that is no safe zip: too many members, ratio, path traversal, nested archives, size."""

    def problem(content: bytes) -> str | None:
        try:
            infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
        except zipfile.BadZipFile:
            return "unreadable"
        if len(infos) > members:
            return "members"
        for i in infos:
            if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/"):
                return "traversal"
            if i.filename.lower().endswith((".zip", ".tar", ".gz", ".7z", ".rar")):
                return "nested"
            if i.file_size > ratio * max(i.compress_size, 1):
                return "ratio"
        return "size" if sum(i.file_size for i in infos) > total else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "problem": [problem(bytes(c)) for c in b["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, problem string")


def intake_table(files: DataFrame, declared: str) -> DataFrame:
    """Rows of `read_files` with their declared licence's status and the injection patterns that their text shows (null where held back)."""
    hits = F.when(F.col("reason").isNull(), text_functions.injection_hits(F.col("text")))
    return files.withColumn("license_status", governance.intake_license(F.col(declared))).withColumn("injection_hits", hits)


#: Suffixes of archive members that are read.
MEMBERS = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".md", ".txt", ".png", ".jpg", ".jpeg", ".csv", ".json", ".epub")


def archive_members(files: DataFrame, suffixes: tuple[str, ...] = MEMBERS) -> DataFrame:
    """(name, member, content) of the readable members of each zip (name, content), one at a time; encrypted and broken ones are left out, as
    are archives that are none. `archive_problems` says which archives to open at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if info.is_dir() or not info.filename.lower().endswith(suffixes):
                        continue
                    try:
                        yield pd.DataFrame({"name": [name], "member": [info.filename], "content": [archive.read(info)]})
                    except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
                        continue

    return files.select("name", "content").mapInPandas(run, "name string, member string, content binary")


def scanned(files: DataFrame, mode: str = "off", scanners: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds malware: what the scanner of that mode (a column of the content) says, null for clean. Off by default; a mode without a scanner
    raises, so that no scan that was asked for is left out silently."""
    if mode in ("", "off", "null"):
        return files.withColumn("malware", F.lit(None).cast("string"))
    if mode not in (scanners or {}):
        raise ValueError(f"no scanner for mode {mode!r}")
    return files.withColumn("malware", scanners[mode](F.col("content")))


def check_local_path(path: str, roots: list[str]) -> str | None:
    """Why a local path must not be read, on the driver and before `spark.read`; None if it may be: shell syntax, outside the allowed roots,
    a symbolic link on the way, missing, a special file, a file with several hard links."""
    if any(c in path for c in "$`;|\n"):
        return "syntax"
    given = Path(path).absolute()
    real, allowed = given.resolve(), [Path(r).resolve() for r in roots]
    if not any(real.is_relative_to(r) for r in allowed):
        return "outside"
    if any(p.is_symlink() for p in (given, *given.parents)):
        return "symlink"
    if not real.exists():
        return "missing"
    if not (real.is_file() or real.is_dir()):
        return "special"
    return "hardlink" if real.is_file() and real.stat().st_nlink > 1 else None


#: Hosts of metadata services, and networks that no fetch may reach.
METADATA_HOSTS = ["metadata.google.internal", "169.254.169.254"]
PRIVATE_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]


def url_problems(df: DataFrame, url: str, *, allowlist: tuple[str, ...] = (), allow_http: bool = False) -> DataFrame:
    """Adds problem, why a URL must not be fetched, null if it may be: scheme, host, allowlist (`*.name` takes subdomains), metadata, private,
    credentials.

    Addresses are judged as they are written, names aren't resolved: a fetcher has to judge what they resolve to with the same rules. A host
    that is a number in another form than four decimal parts is private, as is any IPv6 address that isn't global unicast."""
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    rows = df.withColumns({"__authority": authority, "__place": F.regexp_replace(authority, "^.*@", "")})
    v6, host = F.col("__place").startswith("["), F.col("__host")
    bare = F.when(v6, F.regexp_extract("__place", r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract("__place", "^([^:]*)", 1))
    rows = rows.withColumn("__host", F.lower(bare))
    number = sum((F.split_part(host, F.lit("."), F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    rows = rows.withColumns({"__quad": host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "__number": F.when(host.rlike(r"^[\d.]+$"), number)})
    networks = [ipaddress.ip_network(n) for n in PRIVATE_NETWORKS]
    inside = F.greatest(*[F.col("__number").between(int(n.network_address), int(n.broadcast_address)) for n in networks])
    odd = host.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$")
    private = F.when(F.col("__quad"), inside).when(v6, ~host.rlike("^[23]")).otherwise(odd | host.rlike(r"(^|\.)localhost\.?$"))
    listed = F.lit(not allowlist)
    for name in allowlist:
        listed = listed | (host.endswith(name[1:]) if name.startswith("*.") else host == name)
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))
    problem = (
        F.when(~F.coalesce(scheme.isin(["https", "http"] if allow_http else ["https"]), F.lit(False)), "scheme").when(host == "", "host").when(~listed, "allowlist")
        .when(host.isin(METADATA_HOSTS), "metadata").when(private, "private").when(~F.regexp_extract("__authority", "^(.*)@", 1).isin("", ":"), "credentials")
    )
    return rows.withColumn("problem", problem).drop("__authority", "__place", "__host", "__quad", "__number")


def redact_locator(url: Column) -> Column:
    """Scheme, host with port, and path; user info, parameters, query and fragment go. Empty becomes `-`; no URL stays."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*).*$"
    host = F.regexp_replace(F.regexp_extract(url, whole, 2), "^.*@", "")
    path = F.regexp_replace(F.regexp_extract(url, whole, 3), r";[^/]*$", "")
    kept = F.concat(F.lower(F.regexp_extract(url, whole, 1)), F.lit("://"), host, path)
    return F.when(F.coalesce(url, F.lit("")) == "", "-").when(url.rlike(whole), kept).otherwise(url)


def read_table(spark: SparkSession, store: str, name: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table of a store: a folder of Parquet tables, or a database by its JDBC URL, which is read in `parts` ranges of a whole-number key
    (without a key by one task: for small tables). Filters and columns reach either."""
    if not store.startswith("jdbc:"):
        return spark.read.parquet(f"{store.rstrip('/')}/{name}")
    reader = spark.read.format("jdbc").options(url=store, dbtable=name, **options)
    if key is not None and bounds is not None:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def folder_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a folder, relative to it: what a backup or a release is checked against.
    Files without a byte are not listed (Spark does not read them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_extract("path", r"^(?:[a-z]+:)?/*" + re.escape(path.split(":", 1)[-1].strip("/")) + r"/(.*)$", 1)
    return files.select(below.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
