"""PNG files round trip exactly, damage is found, and digests follow the payload."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm.media import filter_rows, low_frequency_hash, media_features, payload_image, read_png, read_pngs, read_rows, to_media, unfilter, write_png, write_pngs

SCHEMA = "doc_id bigint, text string, feature string"


@given(st.binary(max_size=900), st.integers(1, 70), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_round_trip(data, width, kind):
    image = payload_image(data, width)
    stored = write_png(image, kind, idat=50)
    assert (read_png(stored) == image).all()
    for at in (3, len(stored) // 2, len(stored) - 5):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            read_png(bytes(broken))
    assert len(low_frequency_hash(image)) == 16


def test_mixed_filters_and_smooth_hash():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (20, 31), dtype=np.uint8)
    big = np.kron(rng.integers(0, 256, (32, 32), dtype=np.uint8), np.ones((4, 4), np.uint8))
    noisy = np.clip(big.astype(int) + rng.integers(-3, 4, big.shape), 0, 255).astype(np.uint8)
    differ = int(low_frequency_hash(big), 16) ^ int(low_frequency_hash(noisy), 16)
    assert differ.bit_count() <= 6
    assert (read_png(write_png(image, 4)) == image).all()


def plain_unfilter(raw):
    """The format's definition, pixel by pixel."""
    out = []
    for kind, *row in raw.tolist():
        above, now = out[-1] if out else [0] * len(row), []
        for x, value in enumerate(row):
            a, b, c = now[-1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((value + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(now)
    return out


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 2**32)), min_size=1, max_size=5), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_unfilter_follows_the_format(shapes, width):
    raws = []
    for height, seed in shapes:
        rng = np.random.default_rng(seed)
        raws.append(np.concatenate((rng.integers(0, 5, (height, 1)), rng.integers(0, 256, (height, width))), 1).astype(np.uint8))
    assert [x.tolist() for x in unfilter(raws, width)] == [plain_unfilter(x) for x in raws]


def test_rows_take_the_best_filter():
    rng = np.random.default_rng(2)
    smooth = np.cumsum(rng.integers(-2, 3, (40, 64)), 1).astype(np.uint8)
    images = [smooth, smooth.T.copy()[:, :64].repeat(2, 1)[:, :64], rng.integers(0, 256, (3, 64), dtype=np.uint8)]
    stored = write_pngs(images)
    assert all((x == y).all() for x, y in zip(read_pngs(stored), images, strict=True))
    assert stored == [write_png(x) for x in images]
    cost = lambda rows: np.abs(rows[:, 1:].view(np.int8).astype(int)).sum(1)
    first = np.arange(40) == 0
    best = np.min([cost(filter_rows(smooth, first, k)) for k in range(5)], 0)
    assert (cost(read_rows(stored[0])) == best).all() and len(set(read_rows(stored[0])[:, 0].tolist())) > 1


def test_columns(spark):
    rows = [(1, "é" * 100, "x"), (2, None, None), (3, "", ""), (None, "a" * 64, ""), (5, "z" * 300_000, ""), (6, "é" * 100, "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("feature", "own")
    got = media_features(to_media(df), ["doc_id", "own"]).collect()
    want = {}
    for doc, text, _ in rows:
        data = (text or "").encode()
        data += bytes(-len(data) % 64 if data else 64)
        want[doc] = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert {r.doc_id: (r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    twins = [tuple(r)[2:] for r in got if r.doc_id in (1, 6)]
    assert twins[0] == twins[1]
    assert not media_features(to_media(df.limit(0)), ["doc_id"]).collect()
    with pytest.raises(ValueError):
        to_media(df, media="own")


def test_texts_beyond_a_megabyte_and_clashing_columns(spark):
    """Columns named like the digests stay as they are when they are kept as keys under other names, and play no part else."""
    texts = {1: "é long text " * 150_000, 2: "x" * (1 << 21), 3: ""}
    df = spark.createDataFrame([(k, t, "own", "own") for k, t in texts.items()], "doc_id bigint, text string, feature string, payload_bytes string")
    got = {r.doc_id: r for r in media_features(to_media(df), ["doc_id"]).collect()}
    for k, t in texts.items():
        data = t.encode()
        data += bytes(-len(data) % 64 if data else 64)
        assert (got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
