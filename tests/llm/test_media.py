"""Damaged and cut-off images are null, whole ones decode to what was stored."""

import numpy as np

from tessera.llm import media


def test_damaged_images_are_null(spark):
    rng = np.random.default_rng(5)
    raw = media.pack_payload(rng.integers(0, 256, 64 * 24).astype("u1").tobytes())
    rgb = media.to_rgb(media.coefficients(raw))
    rows = [(0, raw, 1), (0, raw, 2), (1, None, 1), (2, b"", 1), (3, raw[: len(raw) // 2], 1), (4, raw[:-2], 1), (5, b"\xff\xd8\xff\xd9", 1)]
    for i in range(300):
        bad = bytearray(raw)
        for _ in range(2):
            bad[int(rng.integers(len(bad)))] = int(rng.integers(256))
        rows.append((100 + i, bytes(bad), 1))
    rows.append((None, raw, 1))
    frame = spark.createDataFrame(rows, "id long, image binary, height int")
    got = media.decode_images(frame, "id", "image").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert all((r.height, r.width, bytes(r.rgb)) == (*rgb.shape[:2], rgb.tobytes()) for r in [*by[0], *by[None]]) and len(by[0]) == 2
    assert all((by[i][0].height, by[i][0].rgb) == (None, None) for i in (1, 2, 3, 4, 5))
    assert all(r.rgb is None or len(r.rgb) == r.height * r.width * 3 for r in got)
    huge = bytearray(raw)
    at = raw.find(b"\xff\xc2")
    huge[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    assert media.decode_images(spark.createDataFrame([(1, bytes(huge))], "id long, image binary"), "id", "image").first().rgb is None
    assert media.decode_images(spark.createDataFrame([], "id long, image binary"), "id", "image").count() == 0
