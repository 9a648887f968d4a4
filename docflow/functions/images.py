"""Page images as numpy arrays, and recognition through an engine that is given.

No engine and no image library is needed: an engine is a function from an image
and its settings to text, an orientation finder one from an image to its report.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class OcrConfig:
    """Settings of the engine and of what comes before it (fixed values)."""

    lang: str = "deu+eng"
    psm: int = 6
    fallback_psm: int = 11
    oem: int = 1
    dpi: int = 300
    max_side: int = 3000
    binary: bool = True


def grayscale(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image, as bytes."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    return np.rint(image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float) -> np.ndarray:
    """Bilinear samples at fractional places; ``fill`` outside."""
    h, w = image.shape[:2]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out = np.zeros(y.shape + image.shape[2:])
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            value = np.full(y.shape + image.shape[2:], float(fill))
            value[inside] = image[yy[inside], xx[inside]]
            weight = wy * wx
            out += value * (weight if image.ndim == 2 else weight[..., None])
    return out


def shrunk(image: np.ndarray, max_side: int) -> np.ndarray:
    """The image with its longest side at most ``max_side``."""
    h, w = image.shape[:2]
    if max(h, w) <= max_side:
        return image
    scale = max_side / max(h, w)
    nh, nw = max(1, int(h * scale)), max(1, int(w * scale))
    y, x = np.meshgrid(np.clip((np.arange(nh) + 0.5) * h / nh - 0.5, 0, h - 1), np.clip((np.arange(nw) + 0.5) * w / nw - 0.5, 0, w - 1), indexing="ij")
    return np.rint(_sampled(image, y, x, 255)).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned clockwise on a white ground that grows to hold it."""
    turns, rest = divmod(degrees % 360, 90)
    image = np.rot90(image, -int(turns))
    if not rest:
        return image
    a, (h, w) = np.deg2rad(rest), image.shape[:2]
    nh, nw = int(np.ceil(abs(w * np.sin(a)) + abs(h * np.cos(a)))), int(np.ceil(abs(w * np.cos(a)) + abs(h * np.sin(a))))
    y, x = np.meshgrid(np.arange(nh) - (nh - 1) / 2, np.arange(nw) - (nw - 1) / 2, indexing="ij")
    return np.rint(_sampled(image, -x * np.sin(a) + y * np.cos(a) + (h - 1) / 2, x * np.cos(a) + y * np.sin(a) + (w - 1) / 2, 255)).astype(np.uint8)


def deskewed(image: np.ndarray, orientation: Callable[[np.ndarray], str] | None) -> np.ndarray:
    """The image turned by the first angle its orientation report names; as it is if there is none."""
    try:
        for line in (orientation(image) if orientation else "").splitlines():
            if "Orientation in degrees" in line or "Rotate" in line:
                if angle := int(line.rpartition(":")[2]) % 360:
                    return rotated(image, angle)
    except Exception:  # noqa: BLE001 - without a report the image stays
        log.warning("orientation not found", exc_info=True)
    return image


def _blurred(gray: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable blur; edges repeat."""
    r = len(kernel) // 2
    out = np.pad(gray.astype(float), r, mode="edge")
    out = sum(k * out[i : i + gray.shape[0]] for i, k in enumerate(kernel))
    return sum(k * out[:, i : i + gray.shape[1]] for i, k in enumerate(kernel))


def _gaussian(radius: int, sigma: float) -> np.ndarray:
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def cleaned_gray(image: np.ndarray) -> np.ndarray:
    """Gray, median of 3 x 3, sharpened, contrast stretched."""
    gray = grayscale(image)
    near = np.pad(gray, 1, mode="edge")
    gray = np.median([near[i : i + gray.shape[0], j : j + gray.shape[1]] for i in range(3) for j in range(3)], axis=0)
    detail = gray - _blurred(gray, _gaussian(4, 1.2))
    gray = np.clip(np.where(np.abs(detail) >= 3, gray + 1.5 * detail, gray), 0, 255)
    low, high = gray.min(), gray.max()
    return np.rint((gray - low) * 255 / (high - low) if high > low else gray).astype(np.uint8)


def cleaned_binary(image: np.ndarray) -> np.ndarray:
    """Gray, blurred, black or white against the neighbourhood of 21 x 21 less 10, specks opened by 2 x 2."""
    gray = np.rint(_blurred(grayscale(image), np.array([0.25, 0.5, 0.25])))
    local = _blurred(gray, _gaussian(10, 0.3 * ((21 - 1) * 0.5 - 1) + 0.8))
    out = np.where(gray > local - 10, 255, 0).astype(np.uint8)
    for pick, fill, edge in ((np.minimum, 255, ((1, 0), (1, 0))), (np.maximum, 0, ((0, 1), (0, 1)))):
        p = np.pad(out, edge, constant_values=fill)
        h, w = out.shape
        out = pick(pick(p[:h, :w], p[1:, :w]), pick(p[:h, 1:], p[1:, 1:]))
    return out


def recognised(render: Callable[[int], np.ndarray], engine: Callable[[np.ndarray, OcrConfig], str], orientation: Callable[[np.ndarray], str] | None = None, cfg: OcrConfig = OcrConfig()) -> str:  # noqa: B008
    """Text of a page image; a second try with the fallback segmentation, then empty. Never raises."""
    try:
        image = deskewed(shrunk(render(cfg.dpi), cfg.max_side), orientation)
        image = cleaned_binary(image) if cfg.binary else cleaned_gray(image)
    except Exception:  # noqa: BLE001 - a page that can't be rendered has no text
        log.error("page not rendered", exc_info=True)
        return ""
    for psm in (cfg.psm, cfg.fallback_psm):
        try:
            return (engine(image, replace(cfg, psm=psm)) or "").strip()
        except Exception:  # noqa: BLE001 - the next setting, or nothing
            log.warning("engine failed with segmentation %s", psm, exc_info=True)
    return ""
