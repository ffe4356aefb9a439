"""SentencePiece encoding and decoding: an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once; at each position its state and the
output links from there name every piece that ends here, and each relaxes the best score
at this position from that at its start. Characters that no path covers become byte
pieces. No piece has the space mark after another character, so the best path never
crosses a word's start and is computed word by word, each distinct word once per worker
while it is remembered.

The normalizer is the identity with a space mark before the text (none for an empty
text). A space mark in a text is encoded as bytes, so decoding gives every text back.
Of equal scores the longer last piece wins. Null texts are empty. Repeated rows are
encoded each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

MARK = "▁"
MEMO = 400_000


def read_pieces(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) of each id, and whether a mark leads the text, from a model file's protocol buffer."""
    with open(path, "rb") as f:
        data = f.read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    def fields(at: int, end: int):
        while at < end:
            key, at = varint(at)
            kind = key & 7
            if kind == 0:
                value, at = varint(at)
            elif kind == 1:
                value, at = data[at : at + 8], at + 8
            elif kind == 5:
                value, at = data[at : at + 4], at + 4
            else:
                n, at = varint(at)
                value, at = (at, at + n), at + n
            yield key >> 3, value

    pieces, lead = [], True
    for number, value in fields(0, len(data)):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for k, v in fields(*value):
                if k == 1:
                    piece = data[slice(*v)].decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif number == 3:
            for k, v in fields(*value):
                if k == 3:
                    lead = bool(v)
    return pieces, lead


class Codec:
    """types: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte."""

    def __init__(self, pieces: list[tuple[str, float, int]], lead: bool = True) -> None:
        self.pieces, self.lead = pieces, lead
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usable = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p}
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece has the space mark after another character")
        if MARK not in usable:
            raise ValueError("the model has no piece for a space")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.fallback = min((s for s, _ in usable.values() if s > -1e8), default=0.0) - 10.0
        self.shown = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, (p, _, _) in enumerate(pieces)]
        self._automaton(usable)
        self.memo: dict[str, bytes] = {}

    def _automaton(self, usable: dict[str, tuple[float, int]]) -> None:
        go: list[dict[str, int]] = [{}]
        self.out: list[tuple[int, float, int] | None] = [None]  # (length, score, id) of the piece that ends in a state
        for p, (s, i) in usable.items():
            at = 0
            for c in p:
                nxt = go[at].get(c)
                if nxt is None:
                    nxt = go[at][c] = len(go)
                    go.append({})
                    self.out.append(None)
                at = nxt
            self.out[at] = (len(p), s, i)
        fail, link = [0] * len(go), [0] * len(go)
        queue = deque(go[0].values())
        while queue:
            at = queue.popleft()
            for c, nxt in go[at].items():
                f = fail[at]
                while f and c not in go[f]:
                    f = fail[f]
                fail[nxt] = go[f].get(c, 0)
                link[nxt] = fail[nxt] if self.out[fail[nxt]] else link[fail[nxt]]
                queue.append(nxt)
        self.go, self.fail, self.link = go, fail, link

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path through a word whose marks are spaces already replaced."""
        go, fail, link, out = self.go, self.fail, self.link, self.out
        n, state = len(word), 0
        best, back = [0.0] + [0.0] * n, [None] * (n + 1)
        for i, c in enumerate(word):
            while state and c not in go[state]:
                state = fail[state]
            state = go[state].get(c, 0)
            # the character as bytes; not so for a mark, which as bytes means the mark itself
            top, choice = (best[i] + self.fallback * len(c.encode()) if c != MARK else float("-inf")), None
            at = state
            while at:
                found = out[at]
                if found:
                    size, score, piece = found
                    value = best[i + 1 - size] + score
                    if value > top or choice is None and value == top:
                        top, choice = value, (size, piece)
                at = link[at]
            best[i + 1], back[i + 1] = top, choice
        ids: list[int] = []
        i = n
        while i:
            if back[i] is None:
                ids += [self.bytes[b] for b in reversed(word[i - 1].encode())]
                i -= 1
            else:
                ids.append(back[i][1])
                i -= back[i][0]
        ids.reverse()
        return ids

    def word(self, word: str) -> bytes:
        return array("I", self.viterbi(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if MARK in text:  # the mark itself goes as bytes; what is around it is encoded as ever
            mark = array("I", [self.bytes[b] for b in MARK.encode()]).tobytes()
            parts = text.split(MARK)
            return mark.join([self._plain(parts[0], self.lead), *(self._plain(p, False) for p in parts[1:])])
        return self._plain(text, self.lead)

    def _plain(self, text: str, lead: bool) -> bytes:
        memo = self.memo
        head, *words = ((" " if lead else "") + text).split(" ")
        found = list(map(memo.get, words))
        # runs of spaces are one unit with the word after them, as pieces may hold several marks
        if "" in words:
            joined, run = [], 0
            for w in words:
                if w == "":
                    run += 1
                else:
                    joined.append(" " * run + w)
                    run = 0
            if run:
                joined.append(" " * (run - 1))
            words = joined
            found = list(map(memo.get, words))
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = memo[w] = memo.get(w) or self.word(MARK + w.replace(" ", MARK))
        return (self.word(head) if head else b"") + b"".join(found)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.shown.__getitem__, memoryview(ids).cast("I").tolist())).decode()
        return text[1:] if self.lead and text[:1] == " " else text


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text) with its ids, and what decoding them gives."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runner(model_path, True), "doc_id long, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """As encode_texts, with counts and checksums in place of ids and text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runner(model_path, False), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def _runner(model_path: str, whole: bool):
    wide = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    short = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(it):
        import numpy as np

        codec = Codec(*read_pieces(model_path))
        is_byte = np.zeros(len(codec.pieces), bool)
        is_byte[list(codec.byte_of)] = True

        def each(batch):
            ids, back = [], []
            for t in texts(batch.column(1)):
                ids.append(codec.encode(t))
                back.append((codec.decode(ids[-1]), t))
            if whole:
                return {"doc_id": batch.column(0), "ids": [np.frombuffer(x, np.int32) for x in ids], "decoded": [x for x, _ in back]}
            return {
                "doc_id": batch.column(0), "n_pieces": [len(x) // 4 for x in ids], "n_byte_pieces": [int(is_byte[np.frombuffer(x, np.int32)].sum()) for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded_crc32": [zlib.crc32(x.encode()) for x, _ in back], "round_trip": [x == t for x, t in back],
            }

        yield from batches(each, wide if whole else short)(it)

    return run
