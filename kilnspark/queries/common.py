"""Tables for queries, and pieces of the SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(sql_text(i) for i in items) + "]"


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_json_text(x: str) -> str:
    """A string as ASCII JSON."""
    unit = lambda c: f"printf('\\u%04x', {c})"
    high, low = "55296 + ((unicode(ch) - 65536) >> 10)", "56320 + ((unicode(ch) - 65536) & 1023)"
    short = " ".join(f"WHEN {code} THEN '{text}'" for code, text in ((34, '\\"'), (92, "\\\\"), (8, "\\b"), (12, "\\f"), (10, "\\n"), (13, "\\r"), (9, "\\t")))
    one = f"CASE unicode(ch) {short} ELSE CASE WHEN unicode(ch) > 65535 THEN {unit(high)} || {unit(low)} WHEN unicode(ch) < 32 OR unicode(ch) > 126 THEN {unit('unicode(ch)')} ELSE ch END END"
    return f"""('"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda ch: {one}), '') || '"')"""


def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def sql_tokens(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, {sql_words(x)}) END"


def sql_lexical(x: str) -> str:
    return rf"list_distinct(list_filter(list_transform(string_split({sql_norm(x)}, ' '), lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda t: t <> ''))"


def sql_ascii_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'))"


def sql_without(tokens: str, stopwords: list[str], least: int = 1) -> str:
    more = f" AND length(t) >= {least}" if least > 1 else ""
    return f"list_distinct(list_filter({tokens}, lambda t: NOT list_contains({sql_list(stopwords)}, t){more}))"


def sql_jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


def sql_coverage(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), 1)"


def sql_any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(p)})" for p in phrases) + ")"


def sql_injections(x: str) -> str:
    from kilnspark.functions.wordlists import INJECTION_PATTERNS

    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {sql_text('(?i)' + p)}) THEN {sql_text(p)} END" for p in INJECTION_PATTERNS) + "], lambda m: m IS NOT NULL)"


def sql_count(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {sql_text(needle)}, ''))) // {len(needle)})"


def sql_features(x: str, refusal: str) -> dict[str, str]:
    """The superficial features of a text."""
    bullets = rf"len(regexp_extract_all({x}, '(?m)^\s*(#|\*|-|\d\.)\s'))"
    return {
        "token_count": sql_words(x),
        "bullet_count": bullets,
        "heading_count": sql_count(x, "## "),
        "refusal_count": f"len(regexp_extract_all({x}, {sql_text('(?i)' + refusal)}))",
        "citation_count": f"{sql_count(x, '[')} + {sql_count(x, ']')}",
        "punct_count": f"len(regexp_extract_all({x}, '[!?;:]'))",
        "has_format": f"{bullets} > 0",
    }


def sql_split_case(ratio: str, train: float = 0.8, validation: float = 0.1) -> str:
    return f"CASE WHEN {ratio} < {train}::DOUBLE THEN 'train' WHEN {ratio} < ({train}::DOUBLE + {validation}::DOUBLE) THEN 'validation' ELSE 'test' END"


def sql_hash_ratio(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 8))::BIGINT)::DOUBLE / 4294967295::DOUBLE"


#: `sql_tree` has one level of folders at any size, and so has the root of a query that it stands for.
TREE_LEVELS = 1


def sql_tree(entries: str) -> str:
    """Table `tree` (n, root): the content root of `entries` (path, h) as far as two levels of folders hold (65536 entries)."""
    return f"""folders AS (SELECT substr(sha256(path), 1, 2) AS folder, sha256(string_agg(h, '' ORDER BY path)) AS r FROM {entries} GROUP BY 1),
        tree AS (SELECT count(*) AS n, CASE WHEN count(*) <= 256 THEN sha256(string_agg(h, '' ORDER BY path)) ELSE (SELECT sha256(string_agg(r, '' ORDER BY folder)) FROM folders) END AS root FROM {entries})"""
