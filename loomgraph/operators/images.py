"""Image operators over numpy arrays, and UDFs that apply them to binary content.

Decoding needs PIL for real image files; without it, `.npy` content is still read.
"""

from __future__ import annotations

import base64
import io

import numpy as np

MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}


def decode(content: bytes) -> np.ndarray:
    if content[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(content), allow_pickle=False)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("this image needs PIL") from e
    return np.asarray(Image.open(io.BytesIO(content)))


def on_white(pixels: np.ndarray) -> np.ndarray:
    """RGB of RGBA over white; grey becomes RGB."""
    if pixels.dtype == np.uint8 and pixels.ndim == 3 and pixels.shape[2] == 3:
        return pixels
    p = pixels.astype(np.float64)
    if p.ndim == 2:
        p = np.repeat(p[:, :, None], 3, axis=2)
    if p.shape[2] == 4:
        alpha = p[:, :, 3:] / 255
        p = p[:, :, :3] * alpha + 255 * (1 - alpha)
    return np.rint(p).astype(np.uint8)


def crop_margin(pixels: np.ndarray, tolerance: int = 5, margin: int = 1) -> np.ndarray:
    """Without the white margin but for `margin` pixels; an image all white stays."""
    dark = (pixels < 255 - tolerance).any(axis=2)
    if not dark.any():
        return pixels
    rows, cols = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    return pixels[max(0, rows[0] - margin) : rows[-1] + 1 + margin, max(0, cols[0] - margin) : cols[-1] + 1 + margin]


def shrink(pixels: np.ndarray, long_side: int = 768, floor: bool = False) -> np.ndarray:
    """To a long side of at most long_side, by the mean over areas; smaller images stay."""
    h, w = pixels.shape[:2]
    if max(h, w) <= long_side:
        return pixels
    scale = long_side / max(h, w)
    size = [max(1, int(x * scale) if floor else round(x * scale)) for x in (h, w)]
    rows, cols = (np.linspace(0, n, m + 1).astype(int)[:-1] for n, m in zip((h, w), size))
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), rows, axis=0), cols, axis=1)
    area = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))[None, :]
    return np.rint(sums / area[:, :, None]).astype(np.uint8)


def process(content: bytes, long_side: int = 768, margin: int = 1, tolerance: int = 5) -> np.ndarray:
    return shrink(crop_margin(on_white(decode(content)), tolerance, margin), long_side)


def _spread(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Any, or all, of a pixel and those around it: along columns, then along rows. Outside the picture nothing is marked."""
    add = np.logical_or if grow else np.logical_and
    for m in (lambda x: x, np.transpose):
        out = mask.copy()
        add(m(out)[1:], m(mask)[:-1], out=m(out)[1:])
        add(m(out)[:-1], m(mask)[1:], out=m(out)[:-1])
        if not grow:
            m(out)[:1] = m(out)[-1:] = False
        mask = out
    return mask


def _blurred(grey: np.ndarray, sigma: float = 0.8) -> np.ndarray:
    """Gaussian weights up to four sigma along columns, then along rows; at its edges the picture is mirrored."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        n = grey.shape[axis]
        padded = np.pad(grey, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        grey = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(weights))
    return grey


def enhance_lines(pixels: np.ndarray, mode: str = "dilation", threshold: int = 128) -> np.ndarray:
    """Dark lines as 0 on 255: dilation (thicker), closing (gaps filled), gaussian (cut again after a blur) or none."""
    rgb = on_white(pixels).astype(np.int64)
    grey = (rgb @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    dark = (_blurred(grey.astype(np.float64)) if mode == "gaussian" else grey) < threshold
    if mode in ("dilation", "closing"):
        dark = _spread(dark, True)
    if mode == "closing":
        dark = _spread(dark, False)
    return np.where(dark, 0, 255).astype(np.uint8)


def data_url(name: str, content: bytes) -> str:
    kind = MIME.get(name.rsplit(".", 1)[-1].lower(), "application/octet-stream")
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


def applied(images, f, fields: str):
    """path, the fields that f gives for the decoded pixels, and error, of a table of path and content.

    Content that cannot be read makes a row with its error and no values.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in fields.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    types = [pa.string(), *[kinds[x.split()[1]] for x in fields.split(",")], pa.string()]

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out.append((path, *f(decode(content)), None))
                except (ValueError, OSError) as e:
                    out.append((path, *[None] * len(names), str(e)))
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", *names, "error"])

    return images.select("path", "content").mapInArrow(run, f"path string, {fields}, error string")


def of_types(images, suffixes: tuple[str, ...]):
    """The rows of a table with path whose suffix is one of these, in any case."""
    from pyspark.sql import functions as F

    return images.filter(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes))


def sizes(images, long_side: int = 768):
    """path, width, height, error of a binaryFile table after processing."""

    def size(pixels: np.ndarray) -> tuple[int, int]:
        h, w = shrink(crop_margin(on_white(pixels)), long_side).shape[:2]
        return w, h

    return applied(images, size, "width int, height int")
