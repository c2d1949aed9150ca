"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnspark.llm import fingerprints, packing, pieces, quality, repair, search, secrets, setjoin, sharding, simhash, toxicity, trie, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_document_fingerprints": lambda s, d: fingerprints.fingerprint_report(_table(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity.toxicity_report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op3_sharding": lambda s, d: sharding.shard_report(_table(s, d, "documents")),
        "op4_best_fit_packing": lambda s, d: packing.packing_report(_table(s, d, "documents")),
        "op5_simhash_near_dedup": lambda s, d: simhash.simhash_report(_table(s, d, "documents")),
        "op6_sentencepiece": lambda s, d: pieces.pieces_report(_table(s, d, "documents")),
        "op7_exact_top_k": lambda s, d: search.search_report(_table(s, d, "embeddings")),
        "op8_quality_classifier": lambda s, d: quality.quality_report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op9_url_filters": lambda s, d: urls.url_report(_table(s, d, "pages")),
        "op10_secret_scans": lambda s, d: secrets.secret_report(_table(s, d, "documents")),
        "op11_jaccard_join": lambda s, d: setjoin.join_report(_table(s, d, "documents")),
        "op12_conversation_prefix_trie": lambda s, d: trie.trie_report(_table(s, d, "conversations")),
        "op13_conversation_repair": lambda s, d: repair.repair_report(_table(s, d, "conversations")),
    }


SEARCH_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5"""


def _host(url: str) -> str:
    return rf"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    head = f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)"
    return f"CASE WHEN {head} <> '' THEN translate({head}, '{urls.UPPER}', '{urls.LOWER}') || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _attribute(name: str) -> str:
    """The first attribute of a name, without quotes, the common character references decoded; lists names and vals."""
    raw = f"vals[list_position(names, '{name}')]"
    bare = f"""CASE WHEN left({raw}, 1) IN ('"', '''') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"""
    for code, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
        bare = f"replace({bare}, {_text(code)}, {_text(char)})"
    return f"coalesce({bare}, '')"


def _resolved(page: str, to: str) -> str:
    scheme, host, path, query = (f"regexp_extract({page}, '(?s)^(.*?:)(//[^/?#]*)([^?#]*)(\\?[^#]*)?', {i})" for i in (1, 2, 3, 4))
    plain = f"regexp_extract({to}, '(?s)^[^?#]*')"
    parts = f"string_split(CASE WHEN starts_with({plain}, '/') THEN {plain} ELSE regexp_extract({path}, '(?s)^(.*)/', 1) || '/' || {plain} END, '/')[2:]"
    steps = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda p: [p])), lambda a, p: CASE p[1] WHEN '..' THEN a[1:len(a) - 1] WHEN '.' THEN a ELSE list_concat(a, p) END)"
    last = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END"
    return f"""CASE WHEN NOT contains({page}, '://') OR regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {to} WHEN starts_with({to}, '//') THEN {scheme} || {to} WHEN {to} = '' OR left({to}, 1) = '#' THEN {scheme} || {host} || {path} || {query} || {to}
        WHEN left({to}, 1) = '?' THEN {scheme} || {host} || {path} || {to} ELSE {scheme} || {host} || '/' || array_to_string(list_concat({steps}, {last}), '/') || substr({to}, length({plain}) + 1) END"""


def _urls_sql() -> str:
    """Tags are cut out and taken apart by patterns of its own; named character references other than the four of markup are left as they are."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True)) + " END"
    own = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True)) + " END"
    hidden = "(?is)<!--.*?(-->|$)|" + "|".join(f"<{t}[\\s/>].*?(</{t}[\\s/>]|$)" for t in ("script", "style", "title", "textarea"))
    tag = """(?is)<(?:link|meta|base)[\\s/](?:[^>"']|"[^"]*"|'[^']*')*>"""
    pair = """(?s)([^\\s/>][^\\s/>=]*)(?:\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>"'][^\\s>]*))?"""
    inside = "regexp_extract(tag, '(?s)^<[A-Za-z]+(.*)>$', 1)"
    refresh = f"""regexp_extract({_attribute('content')}, '(?is)^\\s*[0-9.]*(?:\\s*[;,]\\s*|\\s+)(?:url\\s*=\\s*)?("[^"]*|''[^'']*|.*)', 1)"""
    return f"""WITH RECURSIVE p AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages),
        g AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, {_text(hidden)}, ' ', 'g'), {_text(tag)})) AS tag FROM pages WHERE contains(url, '://')),
        v AS (SELECT url, row_number() OVER () AS n, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS tag, list_transform(regexp_extract_all({inside}, {_text(pair)}, 1), lambda x: lower(x)) AS names, regexp_extract_all({inside}, {_text(pair)}, 2) AS vals FROM g),
        o AS (SELECT url, arg_min({_attribute('href')}, n) AS base FROM v WHERE tag = 'base' AND list_contains(names, 'href') GROUP BY 1),
        t AS (SELECT url, {_attribute('href')} AS t FROM v WHERE tag = 'link' AND list_contains(regexp_split_to_array(lower({_attribute('rel')}), '\\s+'), 'canonical')
            UNION ALL SELECT url, ltrim({refresh}, '"''') FROM v WHERE tag = 'meta' AND lower({_attribute('http-equiv')}) = 'refresh'),
        u AS (SELECT t.url, trim(t) AS t, CASE WHEN base <> '' THEN {_resolved('t.url', 'base')} ELSE t.url END AS page FROM t LEFT JOIN o USING (url) WHERE trim(t) <> ''),
        l AS (SELECT {_node('url')} AS a, {_node('goal')} AS b FROM (SELECT url, {_resolved('page', 't')} AS goal FROM u)),
        e AS (SELECT a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
        r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
        w AS (SELECT node, {own} AS own FROM (SELECT DISTINCT seen AS node, {_host('seen')} AS host, {_path('seen')} AS path FROM r)),
        s AS (SELECT r.node FROM r JOIN w ON w.node = r.seen GROUP BY 1 HAVING bool_or(coalesce(own = 'block', false)) AND NOT bool_or(coalesce(own = 'allow', false)))
        SELECT page_id, host, path, {rule} AS rule, coalesce({own}, CASE WHEN p.node IN (SELECT node FROM s) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


def _crc(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    octets = f"list_transform(list_filter(string_split({text}, ''), lambda ch: ch <> ''), lambda ch: ascii(ch)::BIGINT)"
    bits = "list_reduce(list_prepend(xor(acc, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda acc, x: {bits}), 4294967295)"


JOIN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w),
    k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS k, s FROM s),
    d AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE k IS NOT NULL GROUP BY 1),
    x AS (SELECT k, n, unnest(s) AS h FROM d),
    p AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b USING (h) WHERE a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT k, k AS seen FROM d UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT r.k, min(d.id) AS component_id, count(*) AS sets FROM r JOIN d ON d.k = r.seen GROUP BY 1)
    SELECT k.doc_id, k.n AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id, k.k IS NOT NULL AS has_set, coalesce(c.sets, 0) AS n_sets FROM k LEFT JOIN c USING (k)"""


TRIE_SQL = f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_crc('conv_id::VARCHAR')} % 6 AS h FROM t GROUP BY 1),
    c AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS m FROM n LEFT JOIN n b ON b.conv_id = n.base),
    r AS (SELECT c.conv_id, pos - h + m AS depth, role, text FROM t JOIN c USING (conv_id) WHERE pos > h
        UNION ALL SELECT c.conv_id, pos, role, text FROM t JOIN c ON c.base = t.conv_id WHERE pos <= m),
    p AS (SELECT conv_id, depth, text, string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, max(depth) OVER (PARTITION BY conv_id) AS last FROM r
        UNION ALL SELECT conv_id, 0, '', '', (SELECT coalesce(max(depth), 0) FROM r WHERE r.conv_id = c.conv_id) FROM c),
    k AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(length(text)) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends FROM p GROUP BY 1),
    f AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1),
    s AS (SELECT a.key, count(*) FILTER (f.n IS NULL) AS leaves, sum(b.own)::BIGINT AS saved FROM k a JOIN k b ON starts_with(b.key, a.key) LEFT JOIN f ON f.key = b.key GROUP BY 1)
    SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n AS n_convs, coalesce(f.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, k.ends AS ends_sha256
    FROM k JOIN s USING (key) LEFT JOIN f USING (key) LEFT JOIN k u ON k.depth > 0 AND u.key = left(k.key, 32 * (k.depth - 1))"""

REPAIR_SQL = f"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
    d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE k WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM o),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS kind,
        count(*) OVER (PARTITION BY conv_id) AS n FROM p),
    w AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM q),
    ins(p, j, q, told) AS (VALUES ('0', 0, '0', ''), ('0', 1, 'u', 'u'), ('0', 2, 'a', 'ua'), ('s', 0, 's', ''), ('s', 1, 'u', 'u'), ('s', 2, 'a', 'ua'), ('u', 0, 'u', ''), ('u', 1, 'a', 'a'), ('u', 2, 'u', 'au'), ('a', 0, 'a', ''), ('a', 1, 'u', 'u'), ('a', 2, 'a', 'ua')),
    op(p, kind, op, q, cost) AS (SELECT p, kind, 'D', p, 3 FROM (VALUES ('0'), ('s'), ('u'), ('a')) s(p), (VALUES ('s'), ('u'), ('a'), ('?')) k(kind)
        UNION ALL SELECT p, kind, 'R', CASE p WHEN 'u' THEN 'a' ELSE 'u' END, 2 FROM (VALUES ('0'), ('s'), ('u'), ('a')) s(p), (VALUES ('s'), ('u'), ('a'), ('?')) k(kind)
        UNION ALL VALUES ('0', 's', 'K', 's', 0), ('0', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0)),
    dp AS (SELECT DISTINCT conv_id, n, 0::BIGINT AS i, ins.q, ins.j * 2 AS cost, repeat('I', ins.j) AS audit, ins.told AS plan FROM w, ins WHERE ins.p = '0'
        UNION ALL SELECT conv_id, n, i, q, cost, audit, plan FROM (
            SELECT dp.conv_id, dp.n, dp.i + 1 AS i, ins.q, dp.cost + op.cost + CASE WHEN op.op <> 'D' AND w.fault = 't' THEN 1 ELSE 0 END + 2 * ins.j AS cost, dp.audit || op.op || repeat('I', ins.j) AS audit,
                dp.plan || CASE WHEN op.op <> 'R' THEN op.op WHEN op.q = 'u' THEN 'U' ELSE 'A' END || ins.told AS plan
            FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.pos = dp.i + 1 JOIN op ON op.p = dp.q AND op.kind = w.kind AND (op.op = 'D' OR w.fault NOT IN ('b', 'd')) JOIN ins ON ins.p = op.q)
            QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
    best AS (SELECT * FROM dp WHERE i = n AND q IN ('0', 'a') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
    x AS (SELECT conv_id, unnest(regexp_extract_all(plan, '[A-Z]|[a-z]')) AS c, unnest(range(length(plan))) AS step FROM best),
    y AS (SELECT *, sum((c IN ('D', 'K', 'U', 'A'))::INT) OVER (PARTITION BY conv_id ORDER BY step) AS pos FROM x),
    z AS (SELECT y.conv_id, step, CASE c WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' WHEN 'K' THEN w.role || ':' || w.text WHEN 'U' THEN 'user:' || w.text WHEN 'A' THEN 'assistant:' || w.text END AS line
        FROM y LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM y.conv_id AND w.pos = y.pos WHERE c <> 'D'),
    sha AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY step)) AS sha FROM z GROUP BY 1),
    f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (pos > 1 AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY 1)
    SELECT i.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN sha s ON s.conv_id IS NOT DISTINCT FROM i.conv_id"""


def oracle_sql() -> dict[str, str]:
    """The others need hashes, models or tokenizers that SQL lacks; tests hold them against brute force."""
    return {"op7_exact_top_k": SEARCH_SQL, "op9_url_filters": _urls_sql(), "op11_jaccard_join": JOIN_SQL, "op12_conversation_prefix_trie": TRIE_SQL, "op13_conversation_repair": REPAIR_SQL}
