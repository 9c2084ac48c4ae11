"""Ops 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash

from modelgauge.llm import bitsliced_simhash, merkle_manifest, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def plain_simhash(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    own = list(range(n))

    def root(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                own[root(a)] = root(b)
    return [root(a) for a in range(n)]


def simhash_rows():
    rng = random.Random(3)
    base = words(rng, 400)
    rows = [(50, base), (50, base), (51, base.upper()), (52, None), (40, ""), (53, " \t\x0b\n"), (None, ""), (54, "one"), (55, "ONE  two"), (56, "one two\x0cthree"), (57, "é ß \x1c x y"), (None, words(rng, 9))]
    for i in range(60):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((100 + i, " ".join(w)))
    return rows + [(200 + i, words(rng, 30)) for i in range(30)]


def test_op11_components(spark):
    rows = simhash_rows()
    prints = [plain_simhash(t) for _, t in rows]
    for radius in (2, 0, 5):
        top = roots(len(rows), lambda a, b, r=radius: (prints[a] ^ prints[b]).bit_count() <= r)
        least = {}
        for (i, _), t in zip(rows, top, strict=True):
            least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
        want = sorted((str(i), f"{p:016x}", str(least[t])) for (i, _), p, t in zip(rows, prints, top, strict=True))
        docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, fp long, comp long, k long, node long")
        got = bitsliced_simhash.near_components(docs, radius).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bitsliced_simhash.near_components(empty).count() == 0


def test_op11_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, 700), "x" * 5000, words(rng, 30) + "y" * 3000 + " " + words(rng, 3), "a b", " " * 999]
    monkeypatch.setattr(bitsliced_simhash, "PIECE", 64)
    assert [bitsliced_simhash.simhash(t) for t in texts] == [plain_simhash(t) for t in texts]


def test_op11_all_close_pairs():
    rng = np.random.default_rng(5)
    for radius in (0, 1, 2, 3, 7):
        centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        values = np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 6, 12)], np.uint64) for c in centre])
        group = np.sort(rng.integers(0, 6, len(values)))
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= radius}
        a, b = bitsliced_simhash.close_pairs(values, group, radius)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_op11_hot_groups_are_split_without_losing_links(spark, monkeypatch):
    """Thousands of fingerprints that agree on most bits: every group is refined, links stay those of brute force."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(bitsliced_simhash, "GROUP", 16)
    fixed = int(rng.integers(0, 1 << 62))
    values = np.unique(np.array([fixed ^ int(x) << 40 for x in rng.integers(0, 1 << 16, 900)], np.uint64))
    got = bitsliced_simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")).collect()
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    own = bitsliced_simhash.forest(len(values), np.array([place[r.a] for r in got]), np.array([place[r.b] for r in got]))
    want = roots(len(values), lambda a, b: int(values[a] ^ values[b]).bit_count() <= 2)
    assert len(set(zip(own.tolist(), want, strict=True))) == len(set(own.tolist())) == len(set(want))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, more=0):
        values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    order = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in order}
    built = {g: levels([leaf(r) for r in trees[g]]) for g in order}
    top = levels([built[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for pos, r in enumerate(trees[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, proof = leaf(r, tampered), []
            for tree, at in ((built[g], pos), (top, place)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += [x for i, x in enumerate(run) if i != at % 2]
                    now = H(*(now if i == at % 2 else x for i, x in enumerate(run)))
                    at //= 2
            out.append((str(r[0]), leaf(r), built[g][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return sorted(out)


def manifest_rows(n, langs):
    rng = random.Random(n)
    rows = [(rng.randint(-5, 5 * n), rng.choice(["web", None, "bücher"]), rng.choice(langs), rng.choice([None, 0, len(langs), (1 << 63) - 1]), rng.choice([None, "", "x", "é" * 400])) for _ in range(n)]
    return rows + rows[:2] + [(None, None, langs[0], None, None)]


def test_op13_proofs(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, tile string, pos long, n long, leaf string"
    for n, langs in ((3, ["en"]), (70, ["en", None, "zz", "é", "Z"]), (300, ["en"] * 9 + [f"l{i}" for i in range(40)])):
        rows = manifest_rows(n, langs)
        got = merkle_manifest.manifest(spark.createDataFrame([(*r, "t", "u", 1, 2, "v") for r in rows], schema)).collect()
        assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == plain_manifest(rows)
    one = [(14, "s", "en", 3, "abc")]
    got = merkle_manifest.manifest(spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert [(str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got] == plain_manifest(one)
    assert merkle_manifest.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for p, m in members.items():
        under = [u for u in members if u[: len(p)] == p]
        kids = [u for u in under if len(u) == len(p) + 1]
        childless = [u for u in under if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in under)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in under if u)
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(kids), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(long_one):
    rng = random.Random(8)
    rows = []
    for c in list(range(-7, 45)) + [1005, 1006, 1008]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])))
    rows += rows[:3] + [(None, 1, "user", "a"), (2003, None, None, None), (2004, 5, "user", "only")]
    same = [(t, "user", f"x{t}") for t in range(long_one)]
    for c in (3000, 3005, 3010, 3011):
        rows += [(c, *x) for x in same]
    rows += [(3015, *x) for x in same[: long_one // 2]] + [(3015, long_one, "user", "z"), (3020, 1, "user", "x0")]
    return rows


def test_op12_nodes(spark):
    schema = "conv_id long, turn long, role string, text string, node long, depth long, id long, pos long, n long"
    rows = trie_rows(30)
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)

    def found(segment):
        out = prefix_trie.trie(frame, segment).collect()
        return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)

    want = plain_trie(rows)
    assert found(prefix_trie.SEGMENT) == want
    assert found(4) == want  # long conversations in many segments, starts chained
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).count() == 0


def test_op12_tree_layouts():
    """Nodes grow through all layouts; every turn-aligned depth comes once, with its members."""
    rng = random.Random(9)
    ids = [bytes([b]) + rng.randbytes(15) for b in range(256)] + [bytes(15) + bytes([b]) for b in range(5)]
    for n in (3, 16, 40, 261):
        tree, members = prefix_trie.Tree(), {}
        for conv in range(3 * n):
            path = [rng.choice(ids[:n]) if n < 261 else ids[conv % 261]] + [rng.choice(ids) for _ in range(rng.randint(0, 3))]
            path = [] if conv == 5 else path
            tree.insert(b"".join(path), [1] * len(path), conv, prefix_trie.FAR, 0, 0)
            for d in range(len(path) + 1):
                members.setdefault(prefix_trie.node_id(prefix_trie.ROOT, b"".join(path[:d])), []).append(conv)
        rows = list(tree.rows(prefix_trie.ROOT, 0))
        assert {r[0]: (r[4], r[5]) for r in rows} == {k: (len(v), min(v)) for k, v in members.items()}
        assert len(rows) == len(members)
        sizes = {4, 16, 48, 256} if n == 261 else set()
        assert not sizes or tree.root.size == 256


def test_op12_end_digests_in_pieces(spark):
    """One node holds all ends: their ids come in pieces from several tasks."""
    segs = spark.range(-20, 3000).selectExpr("id AS conv_id", "X'0102' AS start", "X'03' AS key", "id % 7 <> 0 AS ends")
    want = hashlib.sha256(",".join(str(c) for c in range(-20, 3000) if c % 7).encode()).hexdigest()
    assert [r.ends_sha256 for r in prefix_trie.end_digests(segs, 50).collect()] == [want]
