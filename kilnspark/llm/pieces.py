"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text is the one with the largest sum of piece scores. Positions are taken one by one, each once the
longest piece that starts there has arrived; the positions that pieces have reached beyond it survive, at most as many as
the longest piece has characters. Whenever the backpointer paths of all survivors meet in one boundary, everything before it
is final: its ids are committed and its state is dropped. Before white space this always happens, for no piece has a blank after another
character, and so it does between a letter and a mark that no piece has side by side; texts are cut there and the ids of
words are remembered.

The vocabulary file holds pieces and scores. Characters without a piece become byte pieces (their score lies ten below the least). Sums
are exact, where single-precision sums of long texts are not. Equal sums go to the path whose last piece is longer.

Defined cases: a null text is empty and has no ids; `▁` in a text stands for a blank and decodes to one; null ids are kept; rows
that repeat are encoded each; an empty table gives an empty result."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import coded, decoded, pick, text_or_empty

BLANK = "▁"
#: Remembered words of a worker (two generations of so many).
WORDS = 200_000
#: Kinds of pieces in the vocabulary file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10
CHECK_EVERY = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        table = {p.piece: (float(p.score), i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.longest = max(map(len, table))
        self.unknown = min(s for s, _ in table.values()) - UNKNOWN_PENALTY
        joined = {(a, b) for piece in table for a, b in zip(piece, piece[1:], strict=False)}
        after_letter = {b for a, b in joined if a.isalpha()}
        ends = "".join(c for c in ".,;:!?%&$#*|)]}\"+-/=<>@^_`~([{\\" if c not in after_letter)
        first = f"{BLANK}*[^\\W\\d_]+(?=[{re.escape(ends)}])|" if ends else ""
        self.segments = re.compile(f"{first}{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        #: Every piece and every beginning of one (with no id, unless it is a piece itself).
        self.table: dict[str, tuple[float, int] | None] = {piece[:n]: None for piece in table for n in range(1, len(piece))} | table


class StreamingViterbi:
    """push() characters, get the ids that are final; finish() gives the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.at = "", 0
        self.best, self.back = [0.0], [0]

    def push(self, characters: str) -> list[int]:
        done: list[int] = []
        for i in range(0, len(characters), CHECK_EVERY):
            self.text += characters[i : i + CHECK_EVERY]
            self._advance(len(self.text) - self.v.longest + 1)
            if self.at > CHECK_EVERY:
                done += self._commit(self._meeting())
        return done

    def finish(self) -> list[int]:
        self._advance(len(self.text))
        return self._commit(len(self.text))

    def _advance(self, upto: int) -> None:
        """Takes all positions before `upto`."""
        get, text, best, back, n, none = self.v.table.get, self.text, self.best, self.back, len(self.text), -float("inf")
        best += [none] * (n + 1 - len(best))
        back += [0] * (n + 1 - len(back))
        for start in range(self.at, upto):
            sofar, alone, end = best[start], True, start + 1
            while end <= n:
                found = get(text[start:end], 0)
                if found:
                    if sofar + found[0] > best[end]:
                        best[end], back[end] = sofar + found[0], start
                    if end == start + 1:
                        alone = False
                elif found == 0:
                    break
                end += 1
            if alone and sofar + self.v.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = sofar + self.v.unknown, start
        self.at = max(self.at, upto)

    def _meeting(self) -> int:
        """The boundary in which the paths of all survivors meet."""
        alive = {p for p in range(self.at, len(self.best)) if self.best[p] > -float("inf")}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return alive.pop()

    def _commit(self, upto: int) -> list[int]:
        ends, at = [], upto
        while at > 0:
            ends.append((self.back[at], at))
            at = self.back[at]
        ids: list[int] = []
        for start, end in reversed(ends):
            found = self.v.table.get(self.text[start:end])
            if found:
                ids.append(found[1])
            else:
                ids += [self.v.byte_ids[b] for b in self.text[start:end].encode("utf-8", "replace")]
        base = self.best[upto]
        self.text, self.at = self.text[upto:], self.at - upto
        self.best, self.back = [s - base for s in self.best[upto:]], [max(0, b - upto) for b in self.back[upto:]]
        return ids


class Codec:
    """Texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segment(self, segment: str) -> bytes:
        got = self.older.get(segment)
        if got is None:
            stream = StreamingViterbi(self.v)
            ids = stream.push(segment) + stream.finish()
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= 32:
            self.words[segment] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        known = self.words.get
        out = [known(s) or self._segment(s) for s in self.v.segments.findall(BLANK + text.replace(" ", BLANK))]
        if len(self.words) >= WORDS:
            self.older, self.words = self.words, {}
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        pieces, out = self.v.pieces, []
        is_byte = (numbers >= min(self.v.byte_of)) & (numbers <= max(self.v.byte_of))
        cuts = np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1
        for run in np.split(numbers, cuts):
            if len(run) and int(run[0]) in self.v.byte_of:
                out.append(bytes(self.v.byte_of[int(i)] for i in run).decode("utf-8", "replace"))
            else:
                out.append("".join(map(pieces.__getitem__, run.tolist())))
        return "".join(out).replace(BLANK, " ")[1:]


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids in bytes, of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [codec.encode(t) for t in batch["text"]]})

    rows = documents.select(coded(F.col("doc_id")).alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary").select(decoded(F.col("doc_id")).alias("doc_id"), "ids")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [codec.decode(i) for i in batch["ids"]]})

    rows = encoded.select(coded(F.col("doc_id")).alias("doc_id"), "ids")
    return rows.mapInPandas(run, "doc_id long, text string").select(decoded(F.col("doc_id")).alias("doc_id"), "text")


def pieces_report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """op6: each document's number of ids, their CRC-32 (little-endian unsigned 32-bit), those that are bytes, and whether decoding gives the text back."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        low, high = min(codec.v.byte_of), max(codec.v.byte_of)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = codec.encode(text)
                numbers = np.frombuffer(ids, "<u4")
                rows.append((len(numbers), zlib.crc32(ids), int(((numbers >= low) & (numbers <= high)).sum()), codec.decode(ids) == text.replace(BLANK, " ")))
            out = pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "n_byte_ids", "round_trip"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), n_chars=batch["text"].str.len().to_numpy())

    docs = pick(documents, doc_id="long", text="string").select(coded(F.col("doc_id")).alias("doc_id"), text_or_empty().alias("text"))
    out = docs.mapInPandas(run, "doc_id long, n_chars long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean")
    return out.withColumn("doc_id", decoded(F.col("doc_id")))
