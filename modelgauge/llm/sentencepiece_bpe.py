"""SentencePiece BPE encoding and decoding from a prefix table of last tokens.

For every prefix of a segment the encoding has exactly one last token. A token that ends at a position (found by an Aho-Corasick
automaton over all pieces) is the last token of that prefix if and only if it is compatible with the last token of the prefix in front
of it: encoding the two pieces together gives just these two. The table is filled from left to right and the ids are read backwards.

Text is cut where no merge can cross: in front of a space mark that follows another character, and around line feeds if no
piece holds one. Segments repeat a lot, so each worker remembers their ids in a table of bounded size.

Null text counts as empty; empty text has the end id only. Text of any length is encoded whole, in memory proportional to it.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import extended, local_path, slices

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
MEMO_LIMIT = 400_000
PAIR_LIMIT = 2_000_000
LONG_SEGMENT = 64


class PieceModel:
    """A BPE model with byte fallback, identity normalisation, an added leading space and no removal of spaces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=local_path(path))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk, self.end = sp.unk_id(), sp.eos_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if i not in self.control and i != self.unk and i not in self.byte_of}
        self.id = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        inner = {c for p in self.id for c in p.lstrip(SPACE)} if any(SPACE in p.lstrip(SPACE) for p in self.id) else set()
        self.cut_space = SPACE not in inner
        self.cut_line = not any("\n" in p for p in self.id)
        self.base = n
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def text_of(self, token: int) -> str:
        return self.pieces[token] if token < self.base else chr(token - self.base)

    def token_of(self, text: str) -> int:
        return self.id.get(text, self.base + ord(text) if len(text) == 1 else -1)

    def merge(self, text: str) -> list[int]:
        """Plain pair merging of a short text: best score first, leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.token_of(p) for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`; left -1 stands for the start of the segment."""
        key = (left + 1) << 21 | right
        known = self.pairs.get(key)
        if known is None:
            want = [right] if left < 0 else [left, right]
            known = self.merge("".join(map(self.text_of, want))) == want
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def segment(self, text: str) -> bytes:
        """Ids of one segment as 32-bit integers."""
        n = len(text)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        pairs, compatible, base, known = self.pairs, self.compatible, self.base, self.id
        at = 0
        for end, (token, length) in self.automaton.iter(text):
            while at < end:  # prefixes no piece ends at: their last token is a character outside the vocabulary
                at += 1
                if last[at] < 0:
                    last[at], size[at] = base + ord(text[at - 1]), 1
            stop = end + 1
            if last[stop] >= 0:
                continue
            left = last[stop - length]
            ok = pairs.get((left + 1) << 21 | token)
            if compatible(left, token) if ok is None else ok:
                last[stop], size[stop] = token, length
        while at < n:
            at += 1
            if last[at] < 0:
                last[at], size[at] = base + ord(text[at - 1]), 1
        out, at = [], n
        while at:
            token = last[at]
            if token < base:
                out.append(token)
            else:
                out += [self.bytes.get(b, self.unk) for b in reversed(chr(token - base).encode("utf-8", "replace"))] if self.bytes else [self.unk]
            at -= size[at]
        out.reverse()
        return np.array(out, dtype=np.int32).tobytes()

    def look_up(self, key: str) -> bytes:
        """`key` is a space-separated part without its space mark, or starts with a line feed and has none."""
        found = self.memo.get(key)
        if found is None:
            found = self.segment(key if key[:1] == "\n" else SPACE + key)
            if len(key) <= LONG_SEGMENT and len(self.memo) < MEMO_LIMIT:
                self.memo[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers, with the end id."""
        stop = np.int32(self.end).tobytes()
        if not text:
            return stop
        if not self.cut_space:
            return self.segment(SPACE + text.replace(" ", SPACE)) + stop
        if text[0] == " " or "  " in text or SPACE in text or not self.cut_line:  # runs of space marks stay together
            other = rf"[^{SPACE}\n]+|{SPACE}+|\n" if self.cut_line else rf"[^{SPACE}]+|{SPACE}+"
            return b"".join(map(self.segment, re.findall(rf"{SPACE}*{other}", SPACE + text.replace(" ", SPACE)))) + stop
        parts = text.replace("\n", " \n").split(" ")
        known = self.memo
        if text[0] == "\n":
            parts[0] = ""
        try:
            return b"".join(map(known.__getitem__, parts)) + stop
        except KeyError:
            return b"".join(map(self.look_up, parts)) + stop

    @functools.cached_property
    def tables(self) -> tuple[pa.Array, pa.Array]:
        """Bytes of each id inside a text and at its start (where the added space goes)."""

        def render(i: int, first: bool) -> bytes:
            if i in self.control:
                return b""
            if i in self.byte_of:
                return bytes([self.byte_of[i]])
            if i == self.unk:
                return UNKNOWN_TEXT.encode()
            p = self.pieces[i]
            return (p[1:] if first and p[:1] == SPACE else p).replace(SPACE, " ").encode()

        n = len(self.pieces)
        return pa.array([render(i, False) for i in range(n)], pa.large_binary()), pa.array([render(i, True) for i in range(n)], pa.large_binary())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids; broken byte sequences become one replacement character a byte."""
        inside, first = self.tables
        flat = inside.take(pa.array(ids))
        data = flat.buffers()[2].to_pybytes() if len(ids) else b""
        ends = (np.frombuffer(flat.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64))[offsets].tolist()
        rows = [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        texts = []
        for k, row in enumerate(rows):
            at, stop = int(offsets[k]), int(offsets[k + 1])
            while at < stop and int(ids[at]) in self.control:
                at += 1
            if at < stop:
                token = int(ids[at])
                row = first[token].as_py() + row[len(inside[token].as_py()) :]
            try:
                texts.append(row.decode())
            except UnicodeDecodeError:
                texts.append(_one_mark_a_byte(row))
        return pa.array(texts, pa.string())


def _one_mark_a_byte(row: bytes) -> str:
    out = []
    while row:
        try:
            out.append(row.decode())
            break
        except UnicodeDecodeError as e:
            out.append(row[: e.start].decode() + "�")
            row = row[e.start + 1 :]
    return "".join(out)


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _mapper(path: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows = [m.encode(t or "") for t in batch.column("text").to_pylist()]
                offsets = np.zeros(len(rows) + 1, dtype=np.int64)
                np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
                ids = np.frombuffer(b"".join(rows), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, m.decode(ids, offsets)], [*keep, "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of `docs` as `keep`, ids array<int> (end id last) and decoded string: what decoding those ids gives."""
    return docs.select(*keep, "text").mapInArrow(_mapper(path, list(keep)), extended(docs.select(*keep), "ids array<int>, decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of `encode_decode` rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
