"""The Jaccard join against all pairs in plain Python: small sets, large ones, families, boundaries, odd rows."""

import itertools
import random
import re

import numpy as np
import pytest

from kilnspark.llm import setjoin

SCHEMA = "doc_id long, text string, nid int, print string, key int"


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words[i : i + 4]) for i in range(len(words) - 3)] or ([tuple(words)] if words else []))


def plain_join(rows):
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def planted():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows, texts = [], []
    passage = " ".join(rng.choice(words) for _ in range(40))
    for n in [*range(1, 40), 60, 100, 300, 700]:
        text = [rng.choice(words) for _ in range(n)]
        texts.append(text)
        for edits in range(5):  # around the limit, also by cutting and adding
            new = list(text)
            for _ in range(edits if n > 30 else edits // 2):
                at = rng.randrange(len(new)) if rng.random() < 0.5 else len(new) - 1
                new[at : at + 1] = rng.choice([["X1"], [], ["y", "z"]])
                new = new or ["q"]
            texts.append(new)
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(40):  # a chain: each links with the next, not with the last
        chain = [*chain[4:], *[rng.choice(words) for _ in range(4)]]
        texts.append(list(chain))
    rows = [(i, " ".join(t) if i % 7 else " \t".join(t).upper()) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(60)) + " " + passage) for i in range(60)]  # one passage in many
    rows += [(1100 + i, rows[200][1]) for i in range(30)] + [(None, rows[201][1]), (None, "only here"), (5, "another text of one id"), (5, rows[150][1])]
    rows += [(2000, ""), (2001, None), (2002, "  \n"), (2003, "a"), (2004, "a"), (2005, "A")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = planted()
    return rows, spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("most", [None, 0, 12, 24])
def test_join_equals_all_pairs(spark, table, most, monkeypatch):
    rows, df = table
    monkeypatch.setattr(setjoin, "SALT_ABOVE", 8)  # lists of more sets are dealt into shares
    got = setjoin.set_components(df, most=most).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_join(rows)


def long_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200_000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [[*[rng.choice(words) for _ in range(9000 + i)], *passage] for i in range(6)]  # unlike each other but for a passage
    grown = [rng.choice(words) for _ in range(3700)]
    for _ in range(8):  # each is like the next; their parities have 2048 classes, then 4096
        grown = [*grown, *[rng.choice(words) for _ in range(200)]]
        rows.append([*grown, *passage])
    rows += [[*rows[5][:-700], *[rng.choice(words) for _ in range(700)]], [*rows[5][:-1500], *[rng.choice(words) for _ in range(1500)]]]
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_long_sets_that_share_a_passage_are_no_candidates(spark):
    rows = long_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_join(rows)
    assert sorted((tuple(r) for r in setjoin.set_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str) == expected
    told = setjoin.described(df, setjoin.shingle_counts(df)).selectExpr("doc_id as nid", "n as size", "prefix", "parities", "light")
    nodes = setjoin.Scratch(spark).table(told, "nodes")
    loose = {r["node"]: r["component"] for r in setjoin.connected_components(setjoin.candidate_links(nodes, setjoin.Scratch(spark))).collect()}
    assert all(i not in loose for i in range(5))
    assert all(loose[d] == loose[c] for d, _, c in expected if d != c)
    assert len({len(r["parities"]) for r in nodes.collect()}) == 3


def test_report_of_nothing(spark):
    assert setjoin.join_report(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, None, 1, "", 1), (None, "", 1, "", 1)], SCHEMA)
    assert sorted(map(tuple, setjoin.join_report(odd).collect()), key=str) == [(1, 0, 1, False, 0), (None, 0, None, False, 0)]


def test_sizes():
    for a in range(1, 60):
        for b in range(a, 60):
            least = next((s for s in range(a + 1) if 100 * s >= 85 * (a + b - s)), None)
            assert setjoin.need(a + b) == least or least is None and setjoin.need(a + b) > a
            if least is not None and (a, b) != (a, a):
                assert (a, b) in setjoin.partners(a) and (a, b) in setjoin.partners(b)
                assert setjoin.prefix_size(a) >= a - least + 1 and setjoin.prefix_size(b) >= b - least + 1
    assert setjoin.subsets(5) == 0 and setjoin.subsets(13) > 13


def test_boundary_is_the_cheapest(spark):
    nodes = spark.createDataFrame([(s,) for s in [8] * 5 + [14] * 5 + [20] * 5], "size long")
    entries = lambda n: spark.createDataFrame([(s, n) for s in (8, 14, 20, 90)], "size long, n long")
    assert setjoin.boundary(nodes, entries(1)) < 8
    assert 8 <= setjoin.boundary(nodes, entries(200)) < 20
    assert setjoin.boundary(nodes, entries(10**6)) == setjoin.MOST_LIGHT


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("a b c d e",)] * 9 + [("",)], "text string").repartition(5)
    counts = setjoin.shingle_counts(docs)
    assert sorted(np.unique(counts).tolist()) == [0, 1, 9] and int((counts == 9).sum()) == 2
