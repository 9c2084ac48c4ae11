"""Ops 3, 4 and 9 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa

from modelgauge.llm import hamming_minhash, piecewise_hash, suffix_radix

SCHEMA = "doc_id long, text string, node long, k long, comp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base, other, passage = words(rng, 120), words(rng, 60), words(rng, 90)
    rows = [(10, base), (11, base), (12, base.upper()), (3, other), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one  two"), (9, "one two three"), (9, "one two")]
    for i in range(40):  # near copies at all distances around the threshold
        w = base.split()
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((100 + i, " ".join(w)))
    for i in range(6):
        rows.append((200 + i, words(rng, 30 + i) + "\n" + passage + "\n" + words(rng, 40)))
    rows += [(300, "ab " * 400), (301, words(rng, 5) + " ab" * 300), (302, words(rng, 3000)), (303, "é" * 500), (304, "xé" + "é" * 450), (305, "q" * 399), (306, "r" * 400), (307, "s" * 401)]
    return rows


def test_op4_components(spark):
    rows = corpus()
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                own[root(a)] = root(b)
    smallest = {}
    for a, (i, _) in enumerate(rows):
        smallest[root(a)] = min(i, smallest.get(root(a), i))
    want = sorted((i, len(s), smallest[root(a)] if s else i, (smallest[root(a)] if s else i) == i) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert sorted(map(tuple, hamming_minhash.near_components(frame(spark, rows)).collect())) == want
    assert hamming_minhash.near_components(frame(spark, [])).count() == 0
    alone = hamming_minhash.near_components(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (None, "z")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or 0) for r in alone) == [(False, 1), (True, 0), (True, 1)]


def test_op4_last_round_compares_all_pairs_of_a_key(spark, monkeypatch):
    """A pair within the distance is found by the last round alone, whichever symbols it differs in."""
    import numpy as np

    rng = random.Random(11)
    while True:
        a = words(rng, 300).split()
        b = list(a)
        for i in range(20, 280, 37):
            b[i] = words(rng, 1)
        pair = [" ".join(a), " ".join(b)]
        x, y = hamming_minhash.signatures(hamming_minhash.shingle_sets(pa.array(pair)))
        if (x != y).sum() <= 31 and (x[:6] != y[:6]).all():
            break
    assert len(np.intersect1d(*hamming_minhash.chunk_keys(np.stack([x, y]))))
    monkeypatch.setattr(hamming_minhash, "_star_pairs", lambda met: met.sparkSession.createDataFrame([], "a long, b long"))
    for limit in (hamming_minhash.FAMILY_BLOCK, 1):
        monkeypatch.setattr(hamming_minhash, "FAMILY_BLOCK", limit)
        found = hamming_minhash.near_components(frame(spark, [(1, pair[0]), (2, pair[1]), (3, words(rng, 50))])).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 1), (3, 3)]


def test_family_overlaps():
    import numpy as np

    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(30)], np.uint32)) for _ in range(40)]
    comp = np.array([i % 7 for i in range(40)])
    a, b = hamming_minhash.similar(np.arange(40), comp, sets, 40)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = set()
    for x in range(40):
        for y in range(x + 1, 40):
            same = len(set(sets[x].tolist()) & set(sets[y].tolist()))
            if comp[x] != comp[y] and 100 * same >= 40 * (len(sets[x]) + len(sets[y]) - same):
                want.add((x, y))
    assert found == want


def test_signature_distance_guarantee():
    """Signatures that differ in at most 31 symbols always share a key."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 64, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(64, 31, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, 31, dtype=np.uint16)
        keys = hamming_minhash.chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def brute_repeats(texts, width):
    count = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            count[t[p : p + width]] = count.get(t[p : p + width], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if count[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_op9_repeats(spark, monkeypatch):
    rows = [*corpus(), (None, "n" * 700), (10, corpus()[0][1])]
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True)]
    key = lambda r: str(r)
    for limit in (suffix_radix.TASK_GROUP, 1):  # in tasks, and as an aggregation over window rows
        monkeypatch.setattr(suffix_radix, "TASK_GROUP", limit)
        found = map(tuple, suffix_radix.digests(suffix_radix.remove_repeats(frame(spark, rows))).drop("spans").collect())
        assert sorted(found, key=key) == sorted(want, key=key)
    assert suffix_radix.remove_repeats(frame(spark, [])).count() == 0


def test_op9_text_keeps_whole_characters(spark):
    rows = [(1, "a" + "é" * 300), (2, "é" * 300 + "bé"), (3, "kept")]
    out = {r["doc_id"]: r["kept_text"] for r in suffix_radix.remove_repeats(frame(spark, rows), as_text=True).collect()}
    assert out == {1: "a", 2: "bé", 3: "kept"}


def test_op3_edits(spark):
    rows = [*corpus(), (None, "no id"), (None, None)]
    found = piecewise_hash.compare(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, f) in zip(order, [*order[1:], order[0]], strict=True):
        own = t or ""
        e = piecewise_hash.edited(own, f or "")
        a, b, c = piecewise_hash.fingerprints(pa.array([own, e, f or ""]))
        assert e == own[: len(own) - len(own) // 3] + (f or "")[: len(own) // 3]
        want.append((i, len(own), e, a, b, piecewise_hash.likeness(a, b), piecewise_hash.likeness(a, c)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert piecewise_hash.compare(frame(spark, [])).count() == 0


def test_op3_buckets(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(300)]
    monkeypatch.setattr(piecewise_hash, "BUCKET_ROWS", 20)
    out = {r["doc_id"]: r["next_text"] for r in piecewise_hash.with_next(frame(spark, rows)).collect()}
    assert out == {i: f"text {(i - 1) % 300}" for i in range(300)}


def test_op3_likeness():
    rng = random.Random(4)
    a, b = words(rng, 400), words(rng, 400)
    x, y, z = piecewise_hash.fingerprints(pa.array([a, a[:1500] + b[1500:], b]))
    assert piecewise_hash.likeness(x, x) == 1 and piecewise_hash.likeness(x, y) > 0.4 and piecewise_hash.likeness(x, z) < 0.1
    long, = piecewise_hash.fingerprints(pa.array(["ab " * 100_000]))
    assert len(long) < 1000


def test_edit_distance():
    rng = random.Random(5)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert piecewise_hash.distance(a, b) == plain(a, b)


def plain_word_cuts(texts, window):
    """Kept words of each text: all words under a window of words that also starts anywhere else."""
    split = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    kept = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept.append([x for i, x in enumerate(w) if i not in gone])
    return kept


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_passages_of_fifty_words(spark):
    """Passages of 49, 50, 51 and 90 short words in texts of their own, whatever stands between the words; all copies go."""
    rng = random.Random(12)
    rows, at = [], 0
    for size in (49, 50, 51, 90):
        passage = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(size)]
        for i in range(3):
            gap = [" ", "\n", " \t "][i]
            rows.append((at, words(rng, rng.randint(0, 40)) + " " + gap.join(passage) + gap + words(rng, rng.randint(0, 40))))
            at += 1
    rows += [(at + 1, None), (at + 2, ""), (at + 3, " \n"), (at + 4, "one"), (at + 5, "é " * 130), (at + 6, words(rng, 3000)), (at + 7, "é ö " * 60), (at + 7, "é ö " * 60)]
    found = suffix_radix.remove_repeats(frame(spark, rows), 50, as_text=True, unit=suffix_radix.WORDS).collect()
    want = sorted(zip([i for i, _ in rows], plain_word_cuts([t for _, t in rows], 50), strict=True))
    assert sorted((r.doc_id, WORD.findall(r.kept_text)) for r in found) == want
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t in rows}
    for r in found:
        body = texts[r.doc_id, r.n_bytes]
        edges = [0, *(x for s in r.spans for x in (s.begin, s.end)), len(body)]
        assert b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode() == r.kept_text


def test_word_windows_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_radix, "TASK_GROUP", 3)
    rng = random.Random(13)
    core = words(rng, 12)
    rows = [(i, f"{words(rng, rng.randint(0, 9))} {core} {words(rng, rng.randint(0, 9))}") for i in range(12)]
    found = suffix_radix.remove_repeats(frame(spark, rows), 10, as_text=True, unit=suffix_radix.WORDS).collect()
    assert sorted((r.doc_id, WORD.findall(r.kept_text)) for r in found) == sorted(zip(range(12), plain_word_cuts([t for _, t in rows], 10), strict=True))
