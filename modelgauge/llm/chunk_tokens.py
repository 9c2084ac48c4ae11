"""Exact token ids of whole texts from a public tokenizer file, with the ids of repeated parts remembered.

Texts are cut at single spaces and line feeds, where neither normalisation nor a pre-token can cross; the library encodes each distinct
part once and the ids are joined. Where a cut would not be safe (white space next to white space or at an end, a part that holds one of
the file's added tokens), it encodes the whole text. The memory of parts is bounded; parts beyond the bound are encoded once per batch.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from modelgauge.llm.common import local_path

MEMO_LIMIT = 600_000
LONG_PART = 64
MARKS = string.punctuation


class ChunkTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(local_path(path))
        with open(local_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        #: Whether white space takes part in tokens (byte-level models) or is dropped between them.
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
        contents = [t["content"] for t in spec["added_tokens"]]
        assert not any(c.isspace() for t in contents for c in t), "added tokens must lie inside one part"
        #: Finds every part that may hold an added token, in any case since normalisation may change it.
        self.added = re.compile("|".join(map(re.escape, contents)) or r"(?!)", re.IGNORECASE)
        self.memo: dict[str, bytes] = {} if self.spaced else {"": b""}
        self.tails: dict[str, bytes] = {"": b""}
        #: Models whose words end in a suffix: the ids that end a word, and the library's model alone for parts that are normalised already.
        self.last = None if self.spaced or not self.tok.model.end_of_word_suffix else self._ends(self.tok.model.end_of_word_suffix)
        if self.last is not None:
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            self.bare = Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        #: Whether the file's normalisation of ASCII letters is their lower case.
        self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str(string.ascii_letters) == string.ascii_letters.lower()

    def _ends(self, suffix: str) -> np.ndarray:
        vocab = self.tok.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        if self.spaced:
            first, *rest = text.replace("\n", " \n").split(" ")
            return ["\n\n" + first, *rest] if first else rest  # marks the part that has no space in front
        return text.replace("\n", " ").split(" ")

    def source(self, part: str) -> str | None:
        """The text that a part stands for; None where the text must be encoded whole."""
        if not self.spaced:
            return part
        if part[:2] == "\n\n":
            part, text = part[2:], part[2:]
        elif part[:1] == "\n":
            part, text = part[1:], part
        else:
            text = " " + part
        return None if not part or part[0].isspace() or part[-1].isspace() else text

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are letters only, from one run of the library over all of them: each is one pre-token."""
        if self.last is not None:
            known = self.lowers and all(map(str.isascii, parts))
            run = (self.bare if known else self.tok).encode_batch_fast([" ".join(parts).lower() if known else " ".join(parts)], add_special_tokens=False)[0]
            ids = np.array(run.ids, dtype=np.uint32)
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(parts) or ends[-1] != 4 * len(ids):
                return self.plain([self.source(p) for p in parts])
            body, ends = ids.tobytes(), [0, *ends.tolist()]
            return [body[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        run = self.tok.encode(" " + " ".join(parts), add_special_tokens=False)
        ids, word = np.array(run.ids, dtype=np.uint32), np.array(run.word_ids, dtype=np.int64)
        cuts = np.flatnonzero(np.diff(word)) + 1
        if len(cuts) + 1 != len(parts) or None in run.word_ids:
            return self.plain([self.source(p) for p in parts])  # normalisation has split one of them
        body, ends = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
        return [body[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def look_up(self, parts: list[str]) -> dict[str, bytes | None]:
        """Ids of new parts; None where the text must be encoded whole. Letters with ASCII punctuation behind them are two pre-tokens."""
        memo, tails, plain_parts, rest = self.memo, self.tails, [], []
        for p in parts:
            core = p if p.isalpha() else p.rstrip(MARKS)
            if self.added.search(p):
                rest.append(p)
            elif core.isascii() and core.isalpha() or core.isalpha() and core[-1].lower().isalpha():  # a lower-cased letter may end in a mark
                plain_parts.append((p, core, p[len(core) :]))
            else:
                rest.append(p)
        cores = sorted({core for _, core, _ in plain_parts} - memo.keys(), key=str.isascii)
        known: dict[str, bytes] = {}
        for i in range(0, len(cores), 2000):
            some = cores[i : i + 2000]
            known.update(zip(some, self.words(some), strict=True))
        new = list({tail for _, _, tail in plain_parts} - tails.keys())
        if len(tails) + len(new) > MEMO_LIMIT:
            tails = {"": b""}
            new = list({tail for _, _, tail in plain_parts if tail})
        tails.update(zip(new, self.plain(new), strict=True))
        found: dict[str, bytes | None] = {p: (known[core] if core in known else memo[core]) + tails[tail] for p, core, tail in plain_parts}
        sources = [None if self.added.search(p) else self.source(p) for p in rest]
        got = iter(self.plain([s for s in sources if s is not None]))
        found.update((p, None if s is None else next(got)) for p, s in zip(rest, sources, strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers; null counts as empty."""
        rows, holes, new = [], [], set()
        get = self.memo.get
        for text in texts:
            parts = self.parts(text) if text else []
            ids = list(map(get, parts))
            miss = [i for i, v in enumerate(ids) if v is None]
            lack = [parts[i] for i in miss]
            new.update(lack)
            rows.append(ids)
            holes.append((miss, lack))
        extra = self.look_up(list(new))
        out: list[bytes] = []
        for text, ids, (miss, lack) in zip(texts, rows, holes, strict=True):
            for i, v in zip(miss, map(extra.__getitem__, lack), strict=True):
                ids[i] = v
            out.append(self.plain([text])[0] if miss and None in ids else b"".join(ids))
        if len(self.memo) + len(extra) <= MEMO_LIMIT:
            self.memo.update((p, v) for p, v in extra.items() if v is not None and len(p) <= LONG_PART)
        return out

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        words = sorted(words, key=str.isascii)
        chunks = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        return {w: body for some in chunks for w, body in zip(some, self.words(some), strict=True)}

    def _bodies(self, parts: list[str], often: np.ndarray, find: Callable[[list[str]], dict[str, bytes | None]]) -> list[bytes | None]:
        """Ids of distinct parts. Half of the memory takes any part, the other half those that stand more than once."""
        bodies = list(map(self.memo.get, parts))
        miss = [i for i, v in enumerate(bodies) if v is None]
        found = find([parts[i] for i in miss])
        for i in miss:
            bodies[i] = found[parts[i]]
        for i in (x for x in miss if bodies[x] is not None and len(parts[x]) <= LONG_PART):
            if len(self.memo) < (MEMO_LIMIT if often[i] else MEMO_LIMIT // 2):
                self.memo[parts[i]] = bodies[i]
        return bodies

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts in them; null counts as empty. Parts are told apart in Arrow."""
        if self.spaced:
            bodies = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(bodies), np.uint32), np.cumsum([0, *(len(b) // 4 for b in bodies)])
        rows = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        parts, place = coded.dictionary, coded.indices.to_numpy()
        often = np.bincount(place, minlength=len(parts)) > 1
        # letters and the punctuation behind them are two pieces, anything else is one
        core = pc.utf8_rtrim(parts, characters=MARKS)
        ascii_only = pc.string_is_ascii(core)
        small = pc.and_(ascii_only, pc.utf8_is_alpha(core))
        easy = small.to_numpy(zero_copy_only=False) & (self.lowers and self.last is not None)
        wide = np.flatnonzero(~ascii_only.to_numpy(zero_copy_only=False) & (self.last is not None))
        words = core.take(pa.array(wide)).to_numpy(zero_copy_only=False).tolist()
        easy[wide[np.fromiter((w.isalpha() and w[-1].lower().isalpha() for w in words), bool, len(words))]] = True  # a lower-cased letter may end in a mark
        tail = np.flatnonzero(easy & (pc.subtract(pc.binary_length(parts), pc.binary_length(core)).to_numpy() > 0))
        rest = np.flatnonzero(~easy)
        lower = pc.if_else(small, pc.ascii_lower(core), core).filter(pa.array(easy)).dictionary_encode()
        code = lower.indices.to_numpy()
        again = np.zeros(len(lower.dictionary), dtype=bool)
        again[code[often[easy]]] = True
        cores, tails, others = (x.to_numpy(zero_copy_only=False).tolist() for x in (lower.dictionary, parts.take(pa.array(tail)), parts.take(pa.array(rest))))
        tails = [t[len(t.rstrip(MARKS)) :] for t in tails]
        marks = dict(zip(dict.fromkeys(tails), itertools.count(len(cores)), strict=False))
        first, second = np.empty(len(parts), np.int64), np.full(len(parts), -1)
        first[easy], first[rest] = code, np.arange(len(rest)) + len(cores) + len(marks)
        second[tail] = [marks[t] for t in tails]
        bodies = [*self._bodies(cores, again, self._letters), *self._bodies(list(marks), np.ones(len(marks), bool), self.look_up), *self._bodies(others, often[rest], self.look_up), b""]
        whole = np.zeros(len(parts), dtype=bool)
        whole[[i for i, j in zip(rest.tolist(), range(len(cores) + len(marks), len(bodies)), strict=False) if bodies[j] is None]] = True
        ids, n = _laid(bodies, np.stack((first, second), axis=1))  # of each part
        base = np.cumsum(n) - n
        sizes = n.take(place)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(base.take(place) - ends[:-1], sizes)
        at += np.arange(len(at))
        ids = ids.take(at)
        cuts = rows.offsets.to_numpy()
        offsets = ends[cuts]
        if whole.any():  # texts with a part that can't be cut out
            some = np.unique(np.searchsorted(cuts, np.flatnonzero(whole[place]), side="right") - 1)
            pieces = np.split(ids, offsets[1:-1])
            for i, body in zip(some.tolist(), self.plain(texts.take(pa.array(some)).to_pylist()), strict=True):
                pieces[i] = np.frombuffer(body, np.uint32)
            ids, offsets = np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
        return ids, offsets


def _laid(bodies: list[bytes | None], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the bodies at the places in each row end to end, and how many there are in each row."""
    sizes = np.fromiter((len(b or b"") for b in bodies), np.int64, len(bodies)) // 4
    base, flat = np.cumsum(sizes) - sizes, places.ravel()
    n = sizes[flat]
    ends = np.cumsum(n)
    ids = np.frombuffer(b"".join(b or b"" for b in bodies), np.uint32)
    return ids.take(np.arange(n.sum()) + np.repeat(base[flat] - (ends - n), n)), n.reshape(places.shape).sum(axis=1)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)
