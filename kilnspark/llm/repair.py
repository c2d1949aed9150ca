"""Repair of conversation structure: a trie-shared dynamic program over role and fault signatures.

A row of a conversation becomes one letter: its role's initial (s, u, a or another) and its first fault (none, blank, duplicate, truncated). A
conversation's letters, in order, are its signature. Distinct signatures are sorted; each task walks its range of them as a prefix
trie: the layers of the program that the next signature shares with the one before stay on the stack, only those below the
shared prefix are computed, and a signature's end, a terminal node, emits its answer. A layer holds, for each state of the grammar (s?(ua)+)? (start, after
s, after u, after a), the least cost and the place of its least audit among the four; costs differ by a few units, so that layers are
few and are remembered with the steps between them.

The audit's letters fix the states, so the roles of inserted and changed rows follow from it. The order of two audits never changes once
they differ in what is not a trailing insert, so a layer needs the rank of each audit and its trailing inserts, not the audits.

Memory: a signature has one byte for each row of its conversation and is held whole, its texts are not; a stack takes some 24 bytes a row. Positions come
from blocked scans, copies from a grouped minimum, the digest from a stream, so that no other step gathers a conversation.

Defined cases: null roles and texts are one space, a null id or turn is one space in the damage key; rows without an id are one conversation; a role
that begins with neither s, u nor a can't be kept; turns of one number are ordered by role and text; an empty table gives an empty
result; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import Scratch, coded, decoded, pick
from kilnspark.llm.conversations import crc_of, ordered
from kilnspark.llm.digests import EMPTY, ordered_sha256
from kilnspark.operators.scan import BLOCK

KINDS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that a kept row of kind s, u, a leads to, by the state before (None: not allowed).
KEPT = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
#: The state after an inserted or changed row: each state allows one of user and assistant.
TOLD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NO_WAY = 1 << 30
Layer = tuple  # of four (cost above the least, rank of the audit without trailing inserts, trailing inserts) or None


def _settled(found: list) -> tuple[int, Layer, tuple]:
    """(least cost, layer, where from) of the states' bests (cost, base audit as sortable key, way) after a row, with inserts added."""
    best = [(*f[:2], 0, q) if f else None for q, f in enumerate(found)]
    for _ in range(3):
        for p, b in enumerate(list(best)):
            if b is not None:
                new, q = (b[0] + INSERT, b[1], b[2] + 1, b[3]), TOLD[p]
                if best[q] is None or new[:2] < best[q][:2]:
                    best[q] = new
    a = best[AFTER_A][0] if best[AFTER_A] else NO_WAY
    if best[START] and best[START][0] > a + DELETE:  # from here on an `s` that only the start allows would be deleted instead
        best[START] = None
    if best[AFTER_S] and best[AFTER_S][0] > a:
        best[AFTER_S] = None
    ranks = {k: i for i, k in enumerate(sorted({b[1] for b in best if b}))}
    least = min(b[0] for b in best if b)
    layer = tuple((b[0] - least, ranks[b[1]], b[2]) if b else None for b in best)
    return least, layer, tuple(b[3] if b else None for b in best)


class Trie:
    """Walks sorted signatures; keeps the layers along the present path."""

    def __init__(self) -> None:
        self.layers: dict[Layer, int] = {}
        self.known: list[Layer] = []
        self.steps: dict[tuple[int, str], tuple[int, int, tuple, tuple]] = {}
        _, first, bases = _settled([(0, (0, ""), None), None, None, None])
        self.path = ""
        self.computed = 0
        self.stack = [(self._name(first), 0, bases, ())]  # layer, cost so far, base state of each state, way into each base state

    def _name(self, layer: Layer) -> int:
        if layer not in self.layers:
            self.layers[layer] = len(self.known)
            self.known.append(layer)
        return self.layers[layer]

    def _step(self, name: int, letter: str) -> tuple[int, int, tuple, tuple]:
        got = self.steps.get((name, letter))
        if got is None:
            kind, fault = divmod(ord(letter) - ord("A"), 4)
            kind, lost, extra = (KINDS + "?")[kind], fault in (1, 2), TRUNCATED if fault == 3 else 0
            found: list = [None] * 4
            for p, entry in enumerate(self.known[name]):
                if entry is None:
                    continue
                cost, rank, inserts = entry
                ways = [(p, "D", DELETE)]
                if not lost:
                    kept = KEPT[kind][p] if kind in KEPT else None
                    ways += [(kept, "K", KEEP + extra)] if kept is not None else []
                    ways.append((TOLD[p], "R", REROLE + extra))
                for q, op, more in ways:
                    new = (cost + more, (rank, "I" * inserts + op), (p, op))
                    if found[q] is None or new[:2] < found[q][:2]:
                        found[q] = new
            least, layer, bases = _settled(found)
            got = self.steps[name, letter] = (self._name(layer), least, bases, tuple(f[2] if f else None for f in found))
        return got

    def answer(self, signature: str) -> tuple[int, str, str]:
        """(cost, audit, plan): plan has, for each row, the initials of roles inserted before it and D, K, U or A (deleted, kept, made
        user, made assistant), then the initials inserted at the end."""
        shared = 0
        for x, y in zip(signature, self.path, strict=False):
            if x != y:
                break
            shared += 1
        del self.stack[shared + 1 :]
        for letter in signature[shared:]:
            name, more, bases, ways = self._step(self.stack[-1][0], letter)
            self.stack.append((name, self.stack[-1][1] + more, bases, ways))
            self.computed += 1
        self.path = signature
        layer = self.known[self.stack[-1][0]]
        state = min((q for q in (START, AFTER_A) if layer[q]), key=lambda q: layer[q][:2])
        cost, audit, plan = self.stack[-1][1] + layer[state][0], [], []
        for at in range(len(self.stack) - 1, -1, -1):
            name, _, bases, ways = self.stack[at]
            inserts, base = self.known[name][state][2], bases[state]
            told, q = [], base
            for _ in range(inserts):
                q = TOLD[q]
                told.append("u" if q == AFTER_U else "a")
            audit.append("I" * inserts)
            plan.append("".join(told))
            if at:
                before, op = ways[base]
                audit.append(op)
                plan.append(("U" if base == AFTER_U else "A") if op == "R" else op)
                state = before
        return cost, "".join(reversed(audit)), "".join(reversed(plan))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: rows (conv_id, turn, role, text) dropped, emptied, without end marks, repeated or made the user's."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string")
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumns({"role": F.coalesce("role", space), "text": F.coalesce("text", space), "__k": crc_of(name) % 20})
    text = F.when(F.col("__k") == 1, "").when(F.col("__k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__k") == 0, F.array().cast("array<int>")).when(F.col("__k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumns({"text": text, "role": role, "__copy": F.explode(times)}).select("conv_id", "turn", "role", "text", F.col("__copy").alias("copy"))


def lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, block, fault, letter) of turns (conv_id, pos, block, role, text); a copy is told by its least position among equal ones."""
    bare = F.rtrim("text", F.lit(WHITE))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    facts = turns.select("conv_id", "pos", BLOCK, kind.alias("kind"), F.md5(F.encode("role", "UTF-8")).alias("r"), F.md5(F.encode("text", "UTF-8")).alias("t"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    again = facts.groupBy("conv_id", "r", "t").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("open"), 3).otherwise(0)
    met = facts.join(again, ["conv_id", "r", "t"], "left").withColumn("fault", fault)
    return met.select("conv_id", "pos", BLOCK, "fault", F.chr(F.col("kind") * 4 + F.col("fault") + ord("A")).alias("letter"))


def signatures(letters: DataFrame) -> DataFrame:
    """(conv_id, signature): the letters of each conversation, joined block by block, then the blocks' strings."""
    joined = lambda place, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what]), "")
    parts = letters.groupBy("conv_id", BLOCK).agg(joined("pos", "letter").alias("part"))
    return parts.groupBy("conv_id").agg(joined(BLOCK, "part").alias("signature"))


def answers(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit, plan) of the distinct signatures, each range of them walked as a trie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Trie()
        for batch in batches:
            told = [walk.answer(s) for s in batch["signature"]]
            yield pd.DataFrame({"signature": batch["signature"], "cost": [t[0] for t in told], "audit": [t[1] for t in told], "plan": [t[2] for t in told]})

    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.select("signature").distinct().repartitionByRange(n, "signature").sortWithinPartitions("signature")
    return dealt.mapInPandas(run, "signature string, cost long, audit string, plan string")


def repair(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(facts, lines) of turns (conv_id not null, pos, block, turn, role, text, a written table).

    facts: conv_id, blank, duplicate, truncated, illegal, cost, audit. lines: conv_id, pos, line; what a row leaves behind, with the rows inserted
    around it: `role:text` joined by newlines, null if nothing."""
    signed = scratch.table(signatures(lettered(turns)), "signatures")
    solved = scratch.table(signed.join(scratch.table(answers(signed), "answers"), "signature"), "solved")
    of = lambda fault: F.char_length(F.regexp_replace("signature", "[^" + "".join(chr(ord("A") + 4 * k + fault) for k in range(4)) + "]", "")).cast("long")
    kinds = F.translate("signature", "ABCDEFGHIJKLMNOP", "ssssuuuuaaaa????")
    legal = F.regexp_count(kinds, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    facts = solved.select("conv_id", *[of(i).alias(FAULTS[i]) for i in (1, 2, 3)], (F.char_length("signature") - 1 - legal).cast("long").alias("illegal"), "cost", "audit")
    token = F.posexplode(F.regexp_extract_all("plan", F.lit("[ua]*[DKUA](?:[ua]+$)?"), 0)).alias("at", "token")
    plans = solved.select("conv_id", token).select("conv_id", (F.col("at") + 1).cast("long").alias("pos"), "token")
    added = lambda side: F.transform(F.filter(F.split(F.regexp_extract("token", side, 0), ""), lambda c: c != ""), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))
    op = F.regexp_extract("token", "[DKUA]", 0)
    role = F.when(op == "U", "user").when(op == "A", "assistant").otherwise(F.col("role"))
    own = F.when(op == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), "text")))
    every = F.concat(added("^[ua]+"), own, added("[ua]+$"))
    lines = turns.join(plans, ["conv_id", "pos"]).select("conv_id", "pos", F.when(F.size(every) > 0, F.array_join(every, "\n")).alias("line"))
    return facts, lines


def repair_report(conversations: DataFrame) -> DataFrame:
    """op13: faults, cheapest audit and digest of the repaired rows of every conversation after the contract's damage."""
    scratch = Scratch(conversations.sparkSession)
    ids = pick(conversations, conv_id="long").select(coded(F.col("conv_id")).alias("conv_id")).distinct()
    rows = damaged(conversations).withColumn("conv_id", coded(F.col("conv_id")))
    turns = scratch.table(ordered(rows, scratch, "copy"), "damaged")
    facts, lines = repair(turns, scratch)
    seen = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).where("turn is not null").groupBy("conv_id")
    gaps = seen.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    digests = ordered_sha256(lines, "conv_id", ["pos"], "line", "\n").withColumnRenamed("sha256", "repaired_sha256")
    every = ids.join(gaps, "conv_id", "left").join(facts, "conv_id", "left").join(digests, "conv_id", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(decoded(F.col("conv_id")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
