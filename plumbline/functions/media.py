"""Fingerprints and embeddings of images, model probes and response summaries, in Arrow batches.

Images are RGB arrays (height x width x 3, 0..255). decode() reads uncompressed 24-bit BMP and binary PPM itself, everything else through PIL where
it is installed. Resizing takes area means. The probes' geometric and compression steps that PIL defines exactly (rotation, blur,
JPEG) are plain numpy versions of the same transforms, so fingerprints compare among themselves, not with those of another library.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, COLOUR_BINS, GRAY_BINS = 64, 16, 32
CLASS_KEYS, CONFIDENCE_KEYS, BOX_KEYS = ("class", "label", "cls", "predicted_class"), ("confidence", "score", "probability", "conf"), ("bbox", "box", "bounding_box")


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"P6":
        head = data.split(None, 4)
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(data[-3 * w * h :], np.uint8).reshape(h, w, 3)
    if data[:2] == b"BM" and int.from_bytes(data[28:30], "little") == 24 and int.from_bytes(data[30:34], "little") == 0:
        at, w, h = (int.from_bytes(data[a:b], "little", signed=True) for a, b in ((10, 14), (18, 22), (22, 26)))
        row = (3 * w + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
        return rows[::-1] if h > 0 else rows
    from PIL import Image  # absent here

    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))


def to_ppm(image: np.ndarray) -> bytes:
    """The bytes of a binary PPM file."""
    return b"P6 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means; an image smaller than the target repeats its pixels."""
    out = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        at = np.linspace(0, out.shape[axis], n + 1)
        low = np.minimum(at.astype(int), out.shape[axis] - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        here = np.take(total, low, axis) + part * np.take(out, low, axis)
        out = np.diff(here, axis=axis) * (n / out.shape[axis])
    return out


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n) + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def fingerprint(image: np.ndarray, with_mean: bool = True) -> str:
    """Sign bits of the 8 x 8 low frequencies of the gray image over their median: 64 bits, or 63 without the mean term. The two don't compare."""
    gray = resize(image @ np.array([0.299, 0.587, 0.114]), 32, 32)
    low = (_dct(32) @ gray @ _dct(32).T)[:8, :8].ravel()[0 if with_mean else 1 :]
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def embedding(image: np.ndarray) -> np.ndarray:
    """83 numbers: three colour histograms, a gray one, mean absolute gradients, gray deviation."""
    x = resize(image, SIDE, SIDE).astype(np.float32)
    gray = x.mean(axis=2)
    share = lambda v, bins: np.histogram(v, bins=bins, range=(0, 255))[0] / v.size
    edges = [np.abs(np.diff(gray, axis=1)).mean() / 255, np.abs(np.diff(gray, axis=0)).mean() / 255, gray.std() / 255]
    return np.concatenate([*(share(x[:, :, c], COLOUR_BINS) for c in range(3)), share(gray, GRAY_BINS), edges]).astype(np.float32)


# --- probes and triggers ----------------------------------------------------------------------------------------------


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x), 0, 255).astype(np.uint8)


def _blur(image: np.ndarray, radius: float) -> np.ndarray:
    k = np.arange(-int(3 * radius + 1), int(3 * radius + 2))
    w = np.exp(-(k**2) / (2 * radius**2))
    out = image.astype(float)
    for axis in (0, 1):
        at = np.clip(np.arange(out.shape[axis])[:, None] + k, 0, out.shape[axis] - 1)
        out = np.moveaxis(np.tensordot(np.moveaxis(out, axis, 0)[at], w / w.sum(), axes=(1, 0)), 0, axis)
    return _clip(out)


def _rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    h, w = image.shape[:2]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sy, sx = np.round(y * np.cos(t) + x * np.sin(t) + (h - 1) / 2).astype(int), np.round(x * np.cos(t) - y * np.sin(t) + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside[..., None], image[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0).astype(np.uint8)


def _middle(image: np.ndarray, share: float) -> tuple[slice, slice]:
    h, w = image.shape[:2]
    a, b = max(1, int(h * share)), max(1, int(w * share))
    return slice((h - a) // 2, (h - a) // 2 + a), slice((w - b) // 2, (w - b) // 2 + b)


def _occlude(image: np.ndarray, share: float) -> np.ndarray:
    out = image.copy()
    out[_middle(image, share)] = 0
    return out


def _block_quantise(image: np.ndarray, quality: int) -> np.ndarray:
    """The loss of a JPEG round trip: 8 x 8 cosine coefficients in steps that grow with frequency."""
    h, w = image.shape[:2]
    x = np.pad(image.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    m, scale = _dct(8), (5000 / quality if quality < 50 else 200 - 2 * quality) / 100
    step = np.maximum(1, np.round((8 + 6 * np.add.outer(np.arange(8), np.arange(8))) * scale))[:, :, None]
    b = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8, 3).transpose(0, 2, 1, 3, 4)
    c = np.einsum("ij,abjkc,lk->abilc", m, b, m)
    b = np.einsum("ji,abjkc,kl->abilc", m, np.round(c / step) * step, m)
    return _clip(b.transpose(0, 2, 1, 3, 4).reshape(x.shape)[:h, :w] + 128)


def _contrast(image: np.ndarray, factor: float) -> np.ndarray:
    mean = np.round((image @ np.array([0.299, 0.587, 0.114])).mean())
    return _clip(mean + factor * (image.astype(float) - mean))


def _noise(image: np.ndarray) -> np.ndarray:
    return np.clip((image / 255.0 + np.random.default_rng(42).normal(0, 0.05, image.shape)) * 255, 0, 255).astype(np.uint8)


PROBES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "original": lambda x: x, "brightness_up": lambda x: _clip(x * 1.2), "brightness_down": lambda x: _clip(x * 0.8), "contrast_up": lambda x: _contrast(x, 1.2), "contrast_down": lambda x: _contrast(x, 0.8), "blur": lambda x: _blur(x, 1.5), "noise": _noise,
    "rotation_plus_5": lambda x: _rotate(x, 5), "rotation_minus_5": lambda x: _rotate(x, -5), "crop": lambda x: _clip(resize(x[_middle(x, 0.9)], *x.shape[:2])), "occlusion": lambda x: _occlude(x, 0.2), "jpeg_compression": lambda x: _block_quantise(x, 45),
}


def corner_patch(image: np.ndarray, value: tuple[int, int, int] = (255, 0, 0), fraction: float = 0.12) -> np.ndarray:
    side = max(2, int(min(image.shape[:2]) * fraction))
    out = image.copy()
    out[:side, :side] = value
    return out


TRIGGERS = {"red_patch": lambda x: corner_patch(x), "white_patch": lambda x: corner_patch(x, (255, 255, 255)), "black_patch": lambda x: corner_patch(x, (0, 0, 0))}


# --- responses --------------------------------------------------------------------------------------------------------


def numbers(value) -> list[float]:
    """All numbers of a JSON value, in order."""
    if isinstance(value, bool | int | float):
        return [float(value)]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list | tuple) else ()
    return [x for p in parts for x in numbers(p)]


def summary(prediction) -> dict:
    """count, confidence, classes, boxes, numbers and the response vector [mean, deviation, count, confidence]."""
    flat = numbers(prediction)
    real = lambda v: isinstance(v, int | float)
    first = lambda d, keys, ok=lambda v: True: next((d[k] for k in keys if k in d and ok(d[k])), None)
    found = prediction.get("detections") if isinstance(prediction, dict) else None
    out = {"count": 0.0, "confidence": 0.0, "classes": {}, "boxes": [], "numbers": flat}
    if isinstance(found, list):
        seen = [d for d in found if isinstance(d, dict)]
        names = [str(c) for d in seen if (c := first(d, CLASS_KEYS)) is not None]
        sure = [float(c) for d in seen if (c := first(d, CONFIDENCE_KEYS, real)) is not None]
        boxes = [b[:4] for d in seen if (b := first(d, BOX_KEYS)) is not None and isinstance(b, list | tuple) and len(b) >= 4 and all(map(real, b[:4]))]
        out |= {"count": float(len(found)), "confidence": float(np.mean(sure)) if sure else 0.0, "classes": {c: names.count(c) / len(names) for c in sorted(set(names))}, "boxes": [float(x) for b in boxes[:50] for x in b]}
    elif isinstance(prediction, dict):
        out["confidence"] = float(first(prediction, CONFIDENCE_KEYS[:3], real) or 0.0)
    count = out["count"] if isinstance(found, list) else float(len(flat))
    return out | {"vector": [float(np.mean(flat)) if flat else 0.0, float(np.std(flat)) if flat else 0.0, count, out["confidence"]]}


# --- Spark ----------------------------------------------------------------------------------------------------------

SUMMARY = "struct<count:double,confidence:double,classes:map<string,double>,boxes:array<double>,numbers:array<double>,vector:array<double>>"


def describe_images(files: DataFrame, content: str = "content") -> DataFrame:
    """files with binary content -> also phash and embedding; null where a file can't be read."""

    def run(batches):
        for pdf in batches:
            hashes, vectors = [], []
            for data in pdf[content]:
                try:
                    image = decode(bytes(data))
                    hashes.append(fingerprint(image))
                    vectors.append(embedding(image).tolist())
                except (ImportError, ValueError, IndexError, TypeError, OSError):  # counted as skipped by whoever sees the nulls
                    hashes.append(None)
                    vectors.append(None)
            yield pdf.drop(columns=[content]).assign(phash=hashes, embedding=vectors)

    kept = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content)
    return files.mapInPandas(run, f"{kept + ', ' if kept else ''}phash string, embedding array<float>")


def responses(images: DataFrame, predict: Callable[[np.ndarray], object], variants: dict[str, Callable] = PROBES) -> DataFrame:
    """images(model_id, content) -> model_id, variant, response (JSON) of predict on each variant of each image."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(m, name, json.dumps(predict(change(image)))) for m, data in zip(pdf["model_id"], pdf["content"], strict=True) for image in [decode(bytes(data))] for name, change in variants.items()]
            yield pd.DataFrame(rows, columns=["model_id", "variant", "response"])

    return images.select("model_id", "content").mapInPandas(run, "model_id string, variant string, response string")


def summarise(rows: DataFrame, column: str = "response") -> DataFrame:
    """rows with JSON responses -> also summary."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(summary=[summary(json.loads(x)) for x in pdf[column]])

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", summary {SUMMARY}")


def fingerprints(summarised: DataFrame) -> DataFrame:
    """model_id, variant, summary -> model_id, fingerprint: the probes' vectors in the order of the suite."""
    place = F.array_position(F.array(*map(F.lit, PROBES)), F.col("variant"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("summary.vector").alias("v"))))
    return summarised.groupBy("model_id").agg(F.flatten(F.transform(ordered, lambda x: x["v"])).alias("fingerprint"))
