"""Wide fingerprints against brute force over all pairs, and the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from keystrata.llm import similar, simhash


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {None}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
    return ws


def bits(x):
    return np.unpackbits(np.frombuffer(x, np.uint8))


def test_fingerprint_is_the_majority_of_the_distinct_shingles():
    text, width = "one two three four five six seven eight one two three four five", 3
    each = []
    for h in similar.shingles(text).tolist():
        words = []
        for k in range(1, width + 1):
            x = (h + k * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            words.append((x ^ x >> 31).to_bytes(8, "little"))
        each.append(bits(b"".join(words)))
    assert len(each) == len(shingles(text))
    assert (bits(similar.fingerprint(text, width)) == (2 * np.sum(each, 0) > len(each))).all()
    assert similar.fingerprint(None, 2) == similar.fingerprint(" \n", 2) == bytes(16)


@pytest.mark.parametrize("hot", [similar.HOT, 3])
def test_similar_texts_are_grouped(spark, monkeypatch, hot):
    """Groups of copies with edits: pairs of 0.9 are found, texts that share less than 0.6 with any other stay alone."""
    monkeypatch.setattr(similar, "HOT", hot)
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 200, 400]))]
        texts += [" ".join(edited(rng, base, n)) for n in (0, 0, 1, 1, 2, 3, 40)]
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    root = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    assert len(root) == len(texts) and root[0] == root[1] == root[2] and root[3] == root[4] != root[5]
    close, found = 0, 0
    for a in range(len(texts)):
        near = 0
        for b in range(len(texts)):
            j = jaccard(sets[a], sets[b])
            near = max(near, j if a != b else 0)
            close, found = close + (a != b and j >= 0.9), found + (a != b and j >= 0.9 and root[a] == root[b])
        if near < 0.6:
            assert list(root.values()).count(root[a]) == 1
    assert close > 200 and found >= (0.97 if hot > 3 else 0.9) * close
    assert similar.groups(docs.limit(0)).count() == 0


def test_spanning_links_join_what_all_pairs_join():
    rng = np.random.default_rng(7)
    for n, sure, most in [(2, 5, 30), (40, 0, 30), (40, 12, 30), (150, 10, 24), (60, 3, 3)]:
        centres = rng.integers(0, 2**63, (max(1, n // 8), 3), dtype=np.uint64)
        fp = centres[rng.integers(0, len(centres), n)].copy()
        for row in fp:
            for at in rng.integers(0, 192, rng.integers(0, 14)).tolist():
                row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2).astype(int)
        links = similar.spanning_links(np.arange(n) + 100, fp, sure, most)
        assert len(links) < n and all(far[a - 100, b - 100] == d <= most for a, b, d in links)
        for limit in (sure, most):
            made, wanted = list(range(n)), list(range(n))
            for mine, pairs in ((made, [(a - 100, b - 100) for a, b, d in links if d <= limit]), (wanted, np.argwhere(far <= limit).tolist())):
                for a, b in pairs:
                    x, y = mine[a], mine[b]
                    mine[:] = [x if v == y else v for v in mine]
            assert all((made[a] == made[b]) == (wanted[a] == wanted[b]) for a in range(n) for b in range(n))


def test_texts_about_the_limit_are_told_apart_by_their_shingles(spark):
    """Pairs alone, of short and long texts, from 0.6 to 0.95: none below 0.8 is linked, nor many above missed."""
    rng = random.Random(9)
    texts = []
    for _ in range(260):
        n = rng.choice([12, 30, 80, 200, 500])
        base = [f"w{rng.randrange(50000)}" for _ in range(n)]
        edits = max(1, round(n * rng.uniform(0.005, 0.05)))
        texts += [" ".join(base), " ".join(edited(rng, base, edits) if rng.random() < 0.6 else base + [f"z{rng.randrange(10**6)}" for _ in range(5 * edits)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    root = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    pairs = [(jaccard(shingles(texts[i]), shingles(texts[i + 1])), root[i] == root[i + 1]) for i in range(0, len(texts), 2)]
    assert not [j for j, linked in pairs if linked and j < 0.8]
    above, about = [x for j, x in pairs if j >= 0.85], [x for j, x in pairs if 0.8 <= j < 0.85]
    assert len(about) > 15 and sum(above) >= 0.9 * len(above) and sum(about) >= 0.65 * len(about)
    assert len(set(root.values())) == len(texts) - sum(x for _, x in pairs)


def test_a_large_group_of_near_copies_is_one(spark, monkeypatch):
    """Every two of the group share all blocks but few: blocks are joined until none is too full."""
    monkeypatch.setattr(similar, "HOT", 20)
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(500)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(300)] + [" ".join(f"u{rng.randrange(9999)}" for _ in range(90)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    root = {r.doc_id: r.root for r in similar.groups(docs).collect()}
    assert len({root[i] for i in range(300)}) <= 3 and len({root[i] for i in range(300, 350)}) == 50


def test_stage_drops_copies_with_a_few_edits(spark):
    """Ten edits in a thousand words: similar by shingles, more than three of 64 bits apart."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(1000)]
    texts = [" ".join(base), " ".join(edited(rng, base, 10)), " ".join(edited(rng, base, 60))]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]


def plain_groups(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if v == y else v for v in root]
    return root


@pytest.mark.parametrize("hot", [similar.HOT, 7, 2])
def test_full_blocks_lose_no_pair(spark, monkeypatch, hot):
    """Pairs that share one block only, which many others share too, or all blocks with many others."""
    monkeypatch.setattr(similar, "HOT", hot)
    rng = np.random.default_rng(4)
    bits_, blocks, width, sure, most = 8, 8, 2, 2, 12
    fps = rng.integers(0, 2, (130, 128))
    fps[:100, :8] = fps[0, :8]
    near = fps[:30].copy()
    for row in near:
        row[8 * np.arange(1, 8) + rng.integers(0, 8, 7)] ^= 1
    same = np.repeat(fps[:1], 40, 0)
    for row in same:
        row[64 + rng.choice(64, 6, replace=False)] ^= 1
    fps = np.unique(np.concatenate([fps, near, same]), axis=0)
    far = (fps[:, None] != fps[None]).sum(2)
    block = fps[:, :64].reshape(len(fps), 8, 8)
    met = (block[:, None] == block[None]).all(3).any(2)
    nodes = spark.createDataFrame([(i, bytearray(np.packbits(row).tobytes())) for i, row in enumerate(fps)], "node bigint, fp binary")
    links = [tuple(r) for r in similar.link(nodes, (bits_, blocks, width), sure, most).collect()]
    assert all(far[a, b] == d <= most for a, b, d in links)
    assert plain_groups(len(fps), [x[:2] for x in links]) == plain_groups(len(fps), np.argwhere(met & (far <= most)).tolist())


@pytest.mark.parametrize(("hot", "part"), [(similar.HOT, None), (20, 300)])
def test_refused_links_take_no_pair_along(spark, monkeypatch, hot, part):
    """Every pair of 0.8 that shares a block and has few enough bits is in one group, and links below 0.8 are none."""
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "PART", part or 1 << 19, raising=False)
    rng, texts = random.Random(2), []
    for _ in range(60):
        base = [f"w{rng.randrange(50000)}" for _ in range(200)]
        third = edited(rng, base, rng.choice([4, 5]))
        texts += [" ".join(edited(rng, base, k)) for k in (0, 1, 1, 2)] + [" ".join(third), " ".join(edited(rng, third, 1))]
    sets = [shingles(t) for t in texts]
    size, blocks, width = similar.plan(len(texts))
    sure, most = similar.limits(width, similar.SIMILARITY)
    fps = np.array([bits(similar.fingerprint(t, width)) for t in texts])
    block = fps[:, : size * blocks].reshape(len(texts), blocks, size)
    root = [r.root for r in sorted(similar.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())]
    alike, sharp = [], []
    for at in range(0, len(texts), 6):
        for a in range(at, at + 6):
            for b in range(a + 1, at + 6):
                far, j = (fps[a] != fps[b]).sum(), jaccard(sets[a], sets[b])
                if far <= sure or j >= 0.8:
                    alike.append((a, b))
                    if far <= most and (block[a] == block[b]).all(1).any():
                        sharp.append((a, b))
    assert not [x for x in sharp if root[x[0]] != root[x[1]]]
    every = plain_groups(len(texts), alike)
    assert all(every[a] == every[b] for a in range(len(texts)) for b in range(len(texts)) if root[a] == root[b])
    assert len(set(every)) > 65


def test_similar_labels_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    for parts in (1, 2):
        for _ in range(30):
            bases = [rng.integers(0, 1 << 62, rng.integers(1, 60), dtype=np.uint64).view(np.int64) for _ in range(3)]
            grams = [np.unique(np.concatenate([rng.permutation(b)[rng.integers(0, 5) :], rng.integers(0, 99, rng.integers(0, 5))])) for b in bases for _ in range(12)]
            label, part = rng.integers(0, 25, len(grams)), rng.integers(0, parts, len(grams))
            got = similar.similar_labels(label, part, grams, 0.8)
            two = len(set(part.tolist())) == 2
            sets, n = [set(g.tolist()) for g in grams], len(grams)
            # 5 x common >= 4 x all, without rounding.
            near = [(a, b) for a in range(n) for b in range(a) if (not two or part[a] != part[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
            assert set(got) <= {x for a, b in near for x in ((a, b), (b, a))}
            assert plain_groups(25, [(label[a], label[b]) for a, b in got]) == plain_groups(25, [(label[a], label[b]) for a, b in near])
