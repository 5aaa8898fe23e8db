import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import media
from plumbline.operators import detect


def ppm(image):
    h, w = image.shape[:2]
    return f"P6 {w} {h} 255\n".encode() + image.tobytes()


def bmp(image):
    h, w = image.shape[:2]
    rows = b"".join(r[:, ::-1].tobytes().ljust((3 * w + 3) // 4 * 4, b"\0") for r in image[::-1])
    return b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows


@pytest.fixture(scope="module")
def image():
    y, x = np.mgrid[:50, :70] / 50
    wave = 90 + 60 * np.sin(5 * x + y) * np.cos(3 * y) + 40 * np.sin(11 * x * y)
    return np.stack([wave, wave[::-1], 255 - wave], axis=2).astype(np.uint8)


def test_images(image):
    assert np.array_equal(media.decode(ppm(image)), image) and np.array_equal(media.decode(bmp(image)), image)
    assert media.resize(image, 50, 70) == pytest.approx(image) and media.resize(image, 5, 7)[0, 0] == pytest.approx(image[:10, :10].mean(axis=(0, 1)))
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    near, far = media.fingerprint(media.PROBES["brightness_down"](image)), media.fingerprint(image[::-1, ::-1])
    assert bits(media.fingerprint(image), near) <= 5 < bits(media.fingerprint(image), far)
    v = media.embedding(image)
    assert v.shape == (83,) and v[:16].sum() == pytest.approx(1) and v[48:80].sum() == pytest.approx(1)
    assert all(f(image).shape == image.shape and f(image).dtype == np.uint8 for f in media.PROBES.values()) and len(media.PROBES) == 12
    assert tuple(media.corner_patch(image)[5, 5]) == (255, 0, 0) and tuple(media.corner_patch(image)[6, 6]) == tuple(image[6, 6])


def test_summaries():
    s = media.summary({"detections": [{"cls": "a", "conf": 0.5, "box": [0, 1, 2, 3]}, {"label": "b", "score": 0.7}]})
    assert s["count"] == 2 and s["confidence"] == pytest.approx(0.6) and s["classes"] == {"a": 0.5, "b": 0.5} and s["boxes"] == [0, 1, 2, 3] and len(s["numbers"]) == 6
    assert media.summary({"class": "x", "score": 0.9})["vector"] == [0.9, 0.0, 1.0, 0.9] and media.summary(None)["vector"] == [0.0] * 4


def test_model_chain(spark, image):
    def steady(x):
        return {"detections": [{"cls": "thing", "conf": 0.99 if tuple(x[0, 0]) == (255, 0, 0) else 0.5, "box": [1, 2, 3, 4]}]}

    files = spark.createDataFrame([("m", bytearray(ppm(image)))], "model_id string, content binary")
    fp = media.fingerprints(media.summarise(media.responses(files, steady))).first()
    assert len(fp.fingerprint) == 48
    clean = media.summarise(media.responses(files, steady, {"clean": lambda x: x})).select("model_id", F.col("summary").alias("clean"))
    trig = media.summarise(media.responses(files, steady, media.TRIGGERS)).select("model_id", F.col("variant").alias("trigger"), F.col("summary").alias("triggered"))
    delta = {r.trigger: r.delta for r in detect.trigger_deltas(trig.join(clean, "model_id")).collect()}
    assert delta["red_patch"] == pytest.approx(0.6 * 0.98) and delta["white_patch"] == 0
    rows = media.describe_images(spark.createDataFrame([("a", bytearray(bmp(image))), ("b", bytearray(b"junk"))], "path string, content binary")).collect()
    assert rows[0].phash and len(rows[0].embedding) == 83 and rows[1].phash is None
