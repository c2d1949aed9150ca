"""The trie and the repair of conversations against plain Python, over odd rows."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from kilnspark.llm import queries, repair, trie
from kilnspark.llm.digests import ordered_sha256

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int, pos int"
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    rng, rows = random.Random(5), []
    texts = ["Hi.", "So", "", "  ", None, "a\nb!", "Why? ", "é\U0001f600.", "end ", "end.\x85"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "assistant", "user"]
    for c in [*range(0, 12), 100, 101, 205, 299, 300, 399, -7, -100, 2**40]:
        for t in range(rng.choice([0, 1, 2, 4, 7, 12])):
            turn = None if rng.random() < 0.1 else t + (3 if rng.random() < 0.1 else 0)
            rows.append((c, turn, rng.choice(roles), rng.choice(texts)))
    for c in range(110, 140):  # copies
        rows += [(c, 0, "user", "Hi."), (c, 1, "assistant", "Yes."), (c, 2, "user", "Why? ")]
    rows += [(7, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(300)]  # one hot conversation
    rows += [(8, None, "user", "same.")] * 40
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        path = base[:h] + mine[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items()
    }


def test_trie_equals_plain(spark, tables):
    rows, df = tables
    got = [tuple(r) for r in trie.trie_report(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie_report(empty).count() == 0
    assert trie.trie_report(spark.createDataFrame([(None, 1, "user", "x", "", 1, 1)], SCHEMA)).count() == 0


def test_merges_in_rounds(spark):
    rows = [(b, bytes([b % 5]), 1, 100 + b, 1, None if b % 5 == 0 else bytes([0]), 3) for b in range(40)]
    part = spark.createDataFrame(rows, "__block int, key binary, n long, conv_id long, depth long, parent binary, chars long")
    flat, rounds = (sorted(tuple(map(str, r)) for r in trie.merged(part, fan).collect()) for fan in (64, 2))
    assert flat == rounds and len(flat) == 5


def after_damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        r = "user" if k == 4 else r
        out[c] += [(t is not None, t or 0, r, x)] * {0: 0, 3: 2}.get(k, 1)
    return {c: [(t if there else None, r, x) for there, t, r, x in sorted(v)] for c, v in out.items()}


def plain_repair(rows):
    """Dijkstra over (rows done, state) with the whole audit as the second key."""
    out = set()
    damage = after_damage(rows)
    for c in {r[0] for r in rows}:
        mine, seen, faults = damage.get(c, []), set(), []
        for _, r, x in mine:
            bare = x.strip(WHITE)
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        heap, done, end = [(0, "", 0, "0", ())], set(), None
        while heap:
            cost, audit, i, q, text = heapq.heappop(heap)
            if (i, q) in done:
                continue
            done.add((i, q))
            if i == len(mine) and q in "0a":
                end = (cost, audit, text)
                break
            told, to = ("assistant", "a") if q == "u" else ("user", "u")
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*text, told + ":")))
            if i < len(mine):
                _, r, x = mine[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, text))
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*text, f"{told}:{x}")))
                    if (q, r[:1]) in {("0", "s"), ("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*text, f"{r}:{x}")))
        out.add((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, end[0], end[1], sha("\n".join(end[2]))))
    return out


def test_repair_equals_plain(spark, tables):
    rows, _ = tables
    rows = [*rows, (None, 1, "user", "Hi."), (None, None, "assistant", None), (None, 2, "user", "Hi.")]
    got = [tuple(r) for r in repair.repair_report(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repair(rows)


def test_repair_of_nothing(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_answers_are_shared_along_prefixes():
    """Every signature up to five letters, walked in order, against a walk of its own; layers are computed once for each prefix."""
    rng = random.Random(3)
    letters = "ABDEHIJLMP"
    some = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    walk = repair.Trie()
    got = [walk.answer(s) for s in some]
    assert got == [repair.Trie().answer(s) for s in some]
    prefixes = {s[:n] for s in some for n in range(1, len(s) + 1)}
    assert walk.computed == len(prefixes) < sum(map(len, some))


def test_a_long_signature_is_linear():
    walk = repair.Trie()
    cost, audit, _ = walk.answer("B" * 200_000)
    assert (cost, audit) == (600_000, "D" * 200_000) and len(walk.known) < 20
    cost, audit, _ = repair.Trie().answer("EI" * 100_000)
    assert (cost, audit) == (0, "K" * 200_000)


def test_digest_of_a_long_list(spark):
    rows = [(k, i, f"{k}.{i}") for k in range(3) for i in range(5000 if k == 1 else 3)]
    got = dict(map(tuple, ordered_sha256(spark.createDataFrame(rows, "k long, at long, piece string"), "k", ["at"], "piece", ",").collect()))
    assert got == {k: sha(",".join(p for j, _, p in rows if j == k)) for k in range(3)}


@pytest.mark.parametrize("name", ["op12_conversation_prefix_trie", "op13_conversation_repair"])
def test_sql_over_odd_rows(spark, tables, name):
    rows, df = tables
    rows = [r for r in rows if r[0] != 7]  # the SQL's own time grows with the square of a conversation
    duck, keep = duckdb.connect(), df.where("conv_id <> 7")
    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    run = trie.trie_report if "trie" in name else repair.repair_report
    got = run(keep)
    want = duck.sql(queries.oracle_sql()[name]).select(", ".join(got.columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
