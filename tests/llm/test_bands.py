"""Noise at small sizes, and texts that are noise in part."""

import base64
import random
import string

import pyarrow.parquet as pq

from keystrata.llm import quality_rules, statistics


def test_noise_and_half_noise_are_rejected_and_prose_stays():
    meter, rng = statistics.Meter(), random.Random(2)
    judge = lambda t: quality_rules.verdict(len(t.encode()), *meter.bands(t))
    for size in (900, 1100, 2000, 3000, 4000):
        assert not judge("".join(rng.choices(string.ascii_letters + string.digits, k=size)))
    texts = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    good = [texts[r["doc_id"]] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist() if r["quality"] == 1 and r["doc_id"] in texts]
    good = [t for t in good if t and 5 * meter.base(t)[4] <= meter.base(t)[0]]
    assert len(good) > 100 and all(map(judge, good))
    prose = "\n".join(t for t in good if len(t) > 2000)
    for size in (6000, 50_000):
        noise = base64.b64encode(rng.randbytes(size))[: size * 47 // 100].decode()
        half = prose.encode()[: size - len(noise)].decode(errors="ignore")
        assert not judge(half + noise)


def sf001():
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    meter = statistics.Meter()
    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist():
        n, *_, repeats = meter.base(r["text"])
        if n >= 10 and 5 * repeats <= n and labels.get(r["doc_id"]) is not None:
            size = len(r["text"].encode())
            yield labels[r["doc_id"]], size, quality_rules.verdict(size, *meter.bands(r["text"]))


def test_bands_tell_labelled_texts_apart():
    """Rows of a table that set no limit; all pass the base rules."""
    rows = list(sf001())
    good, bad = [k for y, _, k in rows if y == 1], [k for y, _, k in rows if y == 0]
    long = [k for y, n, k in rows if y == 0 and n > 2048]
    assert len(good) > 200 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 20 and sum(not k for k in bad) >= 0.5 * len(bad)
    assert len(long) > 5 and sum(not k for k in long) >= 0.9 * len(long)


def test_planted_junk_that_passes_the_base_rules_is_rejected():
    meter, rng = statistics.Meter(), random.Random(4)
    judge = lambda t: quality_rules.verdict(len(t.encode()), *meter.bands(t))
    for size in (300, 700, 1500, 3000, 9000, 40_000):
        coded = base64.b64encode(rng.randbytes(size)).decode()
        mashed = " ".join("".join(rng.choices("asdfghjklqwertyuiop;', ./", k=rng.randrange(3, 12))) for _ in range(size // 7))
        few = " ".join(rng.choices([f"item{i} cost{i}" for i in range(12)], k=size // 12))
        # A text that is one word has failed the base rules; here are lines of it.
        lines = "\n".join(coded[k : k + 76] for k in range(0, len(coded), 76))
        assert not judge(lines) and not judge(few), size
        if size >= 3000:
            assert not judge(mashed), size


def test_limits_rise_with_size_and_can_be_given():
    low, high = zip(*((a, b) for _, a, b in quality_rules.BANDS), strict=True)
    assert list(low) == sorted(low) and list(high) == sorted(high) and all(a < b for a, b in zip(low, high, strict=True))
    wide = quality_rules.Bands(((1, 0.0, 99.0), (2, 0.0, 99.0)))
    assert wide.verdict(5000, 40.0, [(5000, 40.0)]) and not quality_rules.verdict(5000, 40.0, [(5000, 40.0)])
