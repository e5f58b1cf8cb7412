"""Images as arrays: hashes, resizing and the inputs of classifiers. Decoding is the caller's."""
from __future__ import annotations

import math

import numpy as np

# What public image classifiers are trained with.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SHORT_SIDE, CROP_SIDE = 256, 224
HASH_SIDE = 8


def _weights(size: int, to: int) -> np.ndarray:
    """Rows of a triangle filter that is as wide as the reduction, so that no pixel is skipped."""
    scale = size / to
    reach = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    w = np.clip(1 - np.abs(np.arange(size)[None, :] - centre[:, None]) / reach, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of (rows, columns[, channels]) in another size, as floats."""
    rows, columns = _weights(image.shape[0], height), _weights(image.shape[1], width)
    return np.moveaxis(np.tensordot(columns, np.tensordot(rows, image.astype(np.float64), (1, 0)), (1, 1)), 0, 1)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def perceptual_hash(image: np.ndarray, side: int = HASH_SIDE) -> int:
    """A signed integer of ``side``**2 bits: which low frequencies of the image's cosine transform are
    above their median. Alike images differ in few bits, whatever their size."""
    n = side * 4
    x = resized(grey(image), n, n)
    waves = np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(side)[:, None])
    low = waves @ x @ waves.T
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << bits.size) if value >> (bits.size - 1) else value


def evaluation_input(image: np.ndarray) -> np.ndarray:
    """The short side to ``SHORT_SIDE``, the middle ``CROP_SIDE`` square, channels first, normalised."""
    h, w = image.shape[:2]
    scale = SHORT_SIDE / min(h, w)
    x = resized(image, max(SHORT_SIDE, int(h * scale)), max(SHORT_SIDE, int(w * scale)))
    top, left = round((x.shape[0] - CROP_SIDE) / 2), round((x.shape[1] - CROP_SIDE) / 2)
    return _normalised(x[top : top + CROP_SIDE, left : left + CROP_SIDE])


def training_input(image: np.ndarray, seed: int) -> np.ndarray:
    """A random part of 80 to 100 % of the area, perhaps mirrored, turned by up to 15 degrees, with other
    brightness, contrast (up to 30 %) and saturation (up to 20 %); the same for the same seed."""
    rnd = np.random.default_rng(seed)
    h, w = image.shape[:2]
    share, ratio = rnd.uniform(0.8, 1.0), math.exp(rnd.uniform(math.log(3 / 4), math.log(4 / 3)))
    ph, pw = min(h, max(1, round(math.sqrt(h * w * share / ratio)))), min(w, max(1, round(math.sqrt(h * w * share * ratio))))
    top, left = int(rnd.integers(0, h - ph + 1)), int(rnd.integers(0, w - pw + 1))
    x = resized(image[top : top + ph, left : left + pw], CROP_SIDE, CROP_SIDE)
    if rnd.random() < 0.5:
        x = x[:, ::-1]
    x = _turned(x, math.radians(rnd.uniform(-15, 15)))
    bright, contrast, colour = 1 + rnd.uniform(-0.3, 0.3), 1 + rnd.uniform(-0.3, 0.3), 1 + rnd.uniform(-0.2, 0.2)
    x = np.clip(x * bright, 0, 255)
    x = np.clip((x - grey(x).mean()) * contrast + grey(x).mean(), 0, 255)
    plain = grey(x)[..., None]
    return _normalised(np.clip((x - plain) * colour + plain, 0, 255))


def _turned(x: np.ndarray, angle: float) -> np.ndarray:
    """Turned about its middle; what comes from outside is black."""
    h, w = x.shape[:2]
    r, c = np.mgrid[0:h, 0:w]
    dy, dx = r - (h - 1) / 2, c - (w - 1) / 2
    sr = np.rint(dy * math.cos(angle) - dx * math.sin(angle) + (h - 1) / 2).astype(int)
    sc = np.rint(dy * math.sin(angle) + dx * math.cos(angle) + (w - 1) / 2).astype(int)
    inside = (sr >= 0) & (sr < h) & (sc >= 0) & (sc < w)
    return np.where(inside[..., None], x[np.clip(sr, 0, h - 1), np.clip(sc, 0, w - 1)], 0.0)


def _normalised(x: np.ndarray) -> np.ndarray:
    return np.moveaxis((x[..., :3] / 255 - np.array(MEAN)) / np.array(STD), -1, 0).astype(np.float32)


def overlay(image: np.ndarray, boxes: list[tuple[int, int, int, int, bool]]) -> np.ndarray:
    """A copy with a frame of two pixels around each box (x1, y1, x2, y2, known): green, or orange."""
    out = image.copy()
    for x1, y1, x2, y2, known in boxes:
        colour = (0, 255, 0) if known else (255, 165, 0)
        for a, b, c, d in ((y1, y1 + 2, x1, x2), (max(y2 - 2, 0), y2, x1, x2), (y1, y2, x1, x1 + 2), (y1, y2, max(x2 - 2, 0), x2)):
            out[a:b, c:d] = colour
    return out
