"""Repeated passages against brute force, and rows that share an id or have none."""

import random
from collections import defaultdict

import pyarrow.parquet as pq

from keystrata.llm import chunking


def made(rng, n, letters=5):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n))


def ids(df):
    return sorted(r.doc_id for r in chunking.repeated_documents(df).collect())


def windows(text, n):
    words = (text or "").split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_documents_that_share_51_words_are_found(spark):
    """On whole texts of a test table: nearly all that share 51 words, and few that share no 20."""
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    holders = {n: defaultdict(set) for n in (20, 51)}
    for i, t in texts.items():
        for n, held in holders.items():
            for w in windows(t, n):
                held[hash(w)].add(i)
    share = {n: {i for x in held.values() if len(x) > 1 for i in x} for n, held in holders.items()}
    got = set(ids(spark.read.parquet(path)))
    assert len(share[51]) > 100
    assert len(share[51] & got) >= 0.99 * len(share[51])
    assert len(got - share[20]) <= 0.02 * len(got)


def test_rows_without_ids_are_in_no_result(spark):
    rng = random.Random(1)
    shared = made(rng, 80)
    rows = [(None, f"{made(rng, 30)} {shared}"), (None, f"{made(rng, 30)} {shared}"), (1, made(rng, 80))]
    assert ids(spark.createDataFrame(rows, "doc_id bigint, text string")) == []
    assert ids(spark.createDataFrame([*rows, (2, shared)], "doc_id bigint, text string")) == []
    assert ids(spark.createDataFrame([*rows, (2, shared), (3, shared + " x")], "doc_id bigint, text string")) == [2, 3]


def test_texts_of_one_id_keep_their_chunks(spark):
    """Two texts of an id that begin alike, each with a passage of another document in the same place."""
    rng = random.Random(2)
    head, one, two = made(rng, 50), made(rng, 80), made(rng, 80)
    rows = [(1, f"{head} {one}"), (1, f"{head} {two}"), (1, f"{head} {two}"), (2, f"{made(rng, 9)} {one}"), (3, f"{made(rng, 9)} {two}")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, at string")
    assert ids(df) == [1, 2, 3]
    per = {(r.doc_id, r.which): r.words for r in chunking.passages(df).collect()}
    assert sorted(i for i, _ in per) == [1, 1, 2, 3] and all(n >= 60 for n in per.values())
    kept = chunking.repeated(df)
    assert kept.where("doc_id = 1").select("which").distinct().count() == 2
    # Copies under one id alone are no repetition.
    assert ids(spark.createDataFrame([(1, f"{head} {one}"), (1, f"{head} {two}"), (1, head)], "doc_id bigint, text string")) == []


def test_one_shared_chunk_is_no_passage(spark):
    """Thirty words of one letter fill one chunk."""
    rng = random.Random(3)
    for _ in range(20):
        short = made(rng, 30, 1)
        if len(chunking.cuts(short.encode())) == 1:
            break
    df = spark.createDataFrame([(1, short), (2, short)], "doc_id bigint, text string")
    chunks = len(chunking.cuts(short.encode()))
    assert ids(df) == ([] if chunks == 1 else [1, 2])
    both = chunking.repeated(df).count()
    assert both == 2 * chunks


def test_places_hold_long_texts():
    assert chunking.WORD_BITS + chunking.SIZE_BITS + chunking.BEGIN_BITS + chunking.TEXT_BITS == 63
    most = chunking.MOST + chunking.LEAST
    assert most < 1 << chunking.SIZE_BITS and most // 2 + 1 < 1 << chunking.WORD_BITS
