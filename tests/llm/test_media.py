import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import media, webp, webp_many

RNG = np.random.default_rng(1)


def images():
    for h, w, c in ((1, 1, 3), (5, 7, 4), (20, 64, 3), (33, 17, 4), (1, 300, 3)):
        yield RNG.integers(0, 256, (h, w, c)).astype(np.uint8)
        yield (RNG.integers(0, 3, (h, w, c)) * 40).astype(np.uint8)
        yield np.tile(RNG.integers(0, 256, (1, 1, c)), (h, w, 1)).astype(np.uint8)
        yield np.zeros((h, w, c), np.uint8)


@pytest.mark.parametrize("options", [{}, {"references": False}, {"palette": True}, {"cache_bits": 6}, {"cache_bits": 11, "references": False}, {"subtract_green": True}, {"predictor": 1}, {"cross_colour": 1}, {"subtract_green": True, "predictor": 1, "cross_colour": 1, "cache_bits": 4}, {"palette": True, "cache_bits": 3}])
def test_every_feature_round_trips(options):
    for image in images():
        blocks = (-(-image.shape[0] // 8), -(-image.shape[1] // 8))
        subs = {"predictor": RNG.integers(0, 14, blocks), "cross_colour": RNG.integers(0, 1 << 24, blocks)}
        out = webp.decode(webp.encode(image, **{k: subs.get(k, v) for k, v in options.items()}))
        assert (out[:, :, : image.shape[2]] == image).all()
        if image.shape[2] == 3:
            assert (out[:, :, 3] == 255).all()


def test_predictors_by_hand():
    left, top, corner, right = [10, 20, 30, 255], [50, 10, 200, 255], [40, 40, 40, 255], [0, 100, 7, 255]
    assert webp._predict(5, left, top, corner, right) == [27, 35, 109, 255]
    assert webp._predict(11, left, top, corner, right) == top  # nearer to left + top - corner
    assert webp._predict(12, left, top, corner, right) == [20, 0, 190, 255]
    assert webp._predict(13, left, top, corner, right) == [25, 3, 152, 255]


def test_a_file_written_by_hand():
    """One red pixel with simple codes only, bit by bit."""
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), *[x for s in (0, 255, 0, 255, 0) for x in ((1, 1), (0, 1), (1, 1), (s, 8))]))
    stream = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    file = b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream
    assert webp.decode(file).tolist() == [[[255, 0, 0, 255]]]


def test_broken_files_are_refused():
    data = webp.encode(RNG.integers(0, 256, (9, 9, 3)).astype(np.uint8))
    for bad in (b"", data[:40], b"RIFF" + data[4:30], data[:20] + b"\0" + data[21:]):
        with pytest.raises((ValueError, Exception)):
            webp.decode(bad)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_texts_round_trip(text):
    data = media.payload(text)
    assert len(data) % 192 == 0 and data and data.rstrip(b" ") == text.encode().rstrip(b" ")
    assert media.load(media.store(data)).tobytes() == data


def test_very_long_text_takes_several_files():
    data = media.payload("ab c" * 800_000)
    stored = media.store(data)
    assert stored.count(b"WEBPVP8L") >= 2 and media.load(stored).tobytes() == data


def test_query_columns(spark):
    rows = [(1, "hello"), (2, None), (2, ""), (None, "é" * 96), (4, "x y " * 30_000), (5, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    found = media.read(media.write(df)).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in found}
    for i, t in rows:
        r, data = by[i, len((t or "").encode())], media.payload(t)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert by[1, 5][1:] == by[5, 5][1:]
    assert media.read(media.write(df.limit(0))).count() == 0


def texts_of_all_kinds():
    words = ["the", "of", "index", "Wörter", "0123", "(x,", "日本", "\n\n", "zebra", "quartz;", "-->", "f(a)", "\U0001f600"]
    out = []
    for i in range(150):
        text = " ".join("".join(RNG.choice(list("etaoinshrdlucmfwyp")) for _ in range(RNG.integers(1, 9))) + RNG.choice(words) for _ in range(RNG.integers(0, 400)))
        out.append(text + ["", "abcdefgh " * 40, "".join(chr(32 + j * 7 % 90) for j in range(192)) * (i % 9), " " * 900][i % 4])
    ramp = bytes((3 * i + j) % 251 for i in range(3000) for j in range(3)).decode("latin-1")
    return [*out, *map(str, range(40)), ramp, "x", "", "ab c" * 60_000]


def test_files_of_the_query_use_all_transforms():
    """Until round 4 the query's files had neither predictors nor cross-colour elements."""
    payloads = [media.payload(t) for t in texts_of_all_kinds()]
    files = media.store_many(payloads)
    kinds = [f[25] & 7 for f in files]  # of the first transform; cross-colour elements follow predictors
    assert kinds.count(1 | webp.PREDICTOR << 1) > 90 and kinds.count(1 | webp.PALETTE << 1) > 20
    grey = np.repeat(RNG.integers(0, 256, (40, 64, 1)), 3, axis=2).astype(np.uint8)
    assert webp_many.encode_many([grey])[0][25] & 7 == 1 | webp.PALETTE << 1
    grey = (grey + RNG.integers(0, 2, (40, 64, 3))).astype(np.uint8)
    assert webp_many.encode_many([grey])[0][25] & 7 == 1 | webp.SUBTRACT_GREEN << 1
    assert (webp.decode(webp_many.encode_many([grey])[0])[:, :, :3] == grey).all()
    for i, (data, file, samples) in enumerate(zip(payloads, files, media.load_many(files), strict=True)):
        assert samples.tobytes() == data
        if i % 7 == 0:
            assert webp.decode(file)[:, :, :3].tobytes() == data
            assert media.store(data) == file  # no file depends on those that it was made with


def test_smooth_images_in_step():
    y, x = np.mgrid[:50, :64]
    images = [np.stack([x * a + y, 2 * x + y * a, x + y + RNG.integers(0, 3, x.shape)], axis=2).astype(np.uint8)[: 10 + a % 40] for a in range(90)]
    images += [RNG.integers(0, 256, (1 + a, 64, 3)).astype(np.uint8) for a in range(20)]
    files = webp_many.encode_many(images, 6)
    assert sum(map(len, files[:90])) < sum(x.size for x in images[:90]) // 2
    for image, one, many in zip(images, map(webp.decode, files), webp_many.decode_many(files), strict=True):
        assert (one[:, :, :3] == image).all() and (many == image).all()


def test_predictions_of_many_pixels():
    some = RNG.integers(0, 256, (4, 500, 4)).astype(np.int16)
    some[:, :, 3] = 255
    for mode in range(1, 14):
        expected = [webp._predict(mode, *x) for x in some.transpose(1, 0, 2).tolist()]
        assert webp.predictions(mode, *some).tolist() == expected


def test_code_lengths_of_many_rows():
    counts = (RNG.integers(0, 2, (60, 300)) * RNG.integers(1, 9, (60, 1)) ** RNG.integers(0, 8, (60, 300))).astype(np.int64)
    counts[0], counts[1, 1:], counts[2] = 0, 0, 2 ** np.minimum(np.arange(300), 40)
    for limit in (11, 15):
        lengths = webp_many.code_lengths_many(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
        assert ((2.0 ** -lengths * (lengths > 0)).sum(axis=1)[(counts > 0).sum(axis=1) > 1] == 1).all()
    for row, found in zip(counts[3:], webp_many.code_lengths_many(counts, 15)[3:], strict=True):
        assert (row * found).sum() <= (row * webp.code_lengths(row)).sum()


def test_broken_streams_are_refused_in_step():
    files = media.store_many([media.payload(t) for t in texts_of_all_kinds()[:100]])
    cut = [f[:4] + (len(f) // 2 // 2 * 2 - 8).to_bytes(4, "little") + f[8:16] + (len(f) // 2 // 2 * 2 - 20).to_bytes(4, "little") + f[20 : len(f) // 2 // 2 * 2] if f[25] & 7 == 1 else f for f in files]
    with pytest.raises(ValueError):
        webp_many.decode_many(cut)
