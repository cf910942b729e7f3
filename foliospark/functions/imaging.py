"""Image kernels in numpy, for use inside Arrow functions. Images are BGR or gray uint8 arrays.

They follow published definitions, and gray values, area means and the hash made
of them the published rounding, too (see phash); for the others, equality to
the last bit with any imaging library is not claimed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Channel statistics that classifiers expect, in RGB order.
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])

# Weights of blue, green and red in a gray value, in parts of 2^15.
GRAY_WEIGHTS = np.array([3735, 19235, 9798])


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels of Spark's image source."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def to_bgr8(image: np.ndarray) -> np.ndarray:
    """Gray, BGRA and 16-bit images as three 8-bit channels."""
    if image.dtype != np.uint8:
        image = np.clip(image / 256 if image.max(initial=0) > 255 else image, 0, 255).astype(np.uint8)
    if image.ndim == 2:
        image = image[..., None]
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[..., :3]


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((to_bgr8(image) @ GRAY_WEIGHTS + (1 << 14)) >> 15).astype(np.uint8)


def _area_weights(size: int, target: int) -> np.ndarray:
    edges = np.linspace(0, size, target + 1)
    pixels = np.arange(size)
    shared = np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels)
    return np.maximum(shared, 0) / (size / target)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) source area of every pixel."""
    return _area_weights(image.shape[0], height) @ image.astype(float) @ _area_weights(image.shape[1], width).T


def dct2(block: np.ndarray) -> np.ndarray:
    """Orthonormal two-dimensional cosine transform (type II) of a square block."""
    n = len(block)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(n)[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis @ block @ basis.T


def shrink(plain: np.ndarray, size: int) -> np.ndarray:
    """Area means of a gray image as 8-bit values: halves go to the even neighbour, and up where exactly 2 x 2 pixels are one."""
    means = np.round(resize_area(plain, size, size), 9)  # sums in another order are equal, too
    return (np.floor(means + 0.5) if plain.shape == (2 * size, 2 * size) else np.rint(means)).astype(np.uint8)


def hash_block(image: np.ndarray) -> np.ndarray:
    """The 64 lowest frequencies of the 32 x 32 gray image, row by row."""
    return dct2(shrink(gray(image), 32).astype(float))[:8, :8].ravel()


def phash(image: np.ndarray) -> int:
    """A bit for each frequency above the median of all but the first, whose bit is 0.

    The 32 x 32 pixels are whole numbers, so frequencies that are equal by
    symmetry are equal here, to six digits; a library that works in single
    precision decides those by its rounding errors. Sides of less than 32
    pixels are repeated, not interpolated.
    """
    block = np.round(hash_block(image), 6)
    bits = block > np.partition(block[1:], 31)[31]
    bits[0] = False
    return int("".join("1" if b else "0" for b in bits), 2)


def canonical_phash(image: np.ndarray) -> int:
    """Least hash of the four rotations: the same for an image however it is turned."""
    return min(phash(np.rot90(image, k)) for k in range(4))


def rotate_label(image: np.ndarray, angle: int) -> np.ndarray:
    """Turn by 0, 90 (clockwise), 180 or 270 degrees."""
    if angle % 90 or not 0 <= angle < 360:
        raise ValueError(f"angle must be 0, 90, 180 or 270, not {angle}")
    return np.rot90(image, -angle // 90)


def otsu(image: np.ndarray) -> int:
    """Threshold of greatest variance between the two classes."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * below[-1]) ** 2 / (below * above)
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1)))


def _smooth(image: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > radius else "edge")
        out = sum(t * np.take(padded, np.arange(i, i + out.shape[axis]), axis=axis) for i, t in enumerate(taps))
    return out


def projection_score(image: np.ndarray) -> float:
    """Population variance of the ink in each row of the smoothed, thresholded image."""
    plain = np.rint(_smooth(gray(image), 0.8, 1)).astype(np.uint8)
    return float((plain <= otsu(plain)).sum(axis=1).astype(float).var())


def rotate_keep_canvas(image: np.ndarray, angle: float) -> np.ndarray:
    """Turn counter-clockwise about the centre, bilinear, edges replicated."""
    h, w = image.shape[:2]
    turn = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w / 2, y - h / 2
    sx = np.clip(np.cos(turn) * dx - np.sin(turn) * dy + w / 2, 0, w - 1)
    sy = np.clip(np.sin(turn) * dx + np.cos(turn) * dy + h / 2, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    source = image.astype(float)
    top, low = source[y0, x0] * (1 - fx) + source[y0, x1] * fx, source[y1, x0] * (1 - fx) + source[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).clip(0, 255).astype(np.uint8)


def largest_region(mask: np.ndarray) -> np.ndarray | None:
    """Largest 4-connected region of a mask, None if it is empty. Runs of rows are joined, not pixels."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, above = [], []
    for y, row in enumerate(mask.astype(bool)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(parent)
            parent.append(k)
            for pa, pb, pk in above:
                if pa < b and a < pb:
                    parent[root(k)] = root(pk)
            here.append((a, b, k))
            runs.append((y, a, b, k))
        above = here
    if not runs:
        return None
    area: dict[int, int] = {}
    for _, a, b, k in runs:
        area[root(k)] = area.get(root(k), 0) + b - a
    best = max(area, key=lambda r: (area[r], -r))
    out = np.zeros(mask.shape, bool)
    for y, a, b, k in runs:
        out[y, a:b] = root(k) == best
    return out


def crop_to_mask(image: np.ndarray, mask: np.ndarray, pad: int = 0) -> np.ndarray | None:
    """Bounding rectangle of the largest region, padded inside the image; None without a region."""
    region = largest_region(mask)
    if region is None:
        return None
    rows, cols = np.flatnonzero(region.any(axis=1)), np.flatnonzero(region.any(axis=0))
    out = image[max(0, rows[0] - pad) : rows[-1] + 1 + pad, max(0, cols[0] - pad) : cols[-1] + 1 + pad]
    return out if out.size else None


def apply_mask(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Black outside the mask, which is first brought to the image's size by nearest neighbours."""
    h, w = image.shape[:2]
    rows, cols = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
    full = mask[rows][:, cols].astype(bool)
    return np.where(full[..., None] if image.ndim == 3 else full, image, 0).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points.tolist()) + half(points.tolist()[::-1]), dtype=float)


def coarse_angle(image: np.ndarray) -> float:
    """Angle in (-45, 45] of the least-area rectangle around the largest bright region; 0 without one."""
    plain = gray(image)
    region = largest_region(plain > otsu(plain))
    if region is None:
        return 0.0
    hull = _hull(np.argwhere(region)[:, ::-1].astype(float))
    if len(hull) < 3:
        return 0.0
    sides = np.diff(np.vstack([hull, hull[:1]]), axis=0)
    best = (np.inf, 0.0)
    for turn in np.arctan2(sides[:, 1], sides[:, 0]) % (np.pi / 2):
        c, s = np.cos(turn), np.sin(turn)
        u, v = hull @ [c, s], hull @ [-s, c]
        best = min(best, ((u.max() - u.min()) * (v.max() - v.min()), float(np.rad2deg(turn))))
    return best[1] - 90 if best[1] > 45 else best[1]


def refine_angle(image: np.ndarray, coarse: float, steps: int = 10, per_degree: float = 5.0) -> tuple[float, float]:
    """Of 21 angles around the coarse one that of the greatest projection score, the lowest on ties."""
    plain = gray(image)
    angles = [coarse + (i - steps) / per_degree for i in range(2 * steps + 1)]
    scores = [projection_score(rotate_keep_canvas(plain, a)) for a in angles]
    best = int(np.argmax(scores))  # the first of equal ones
    return angles[best], scores[best]


def enhance(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation, then unsharp masking."""
    plain = gray(image)
    h, w = plain.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(plain, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) > max(th, tw) else "edge")
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            most = max(1.0, clip * th * tw / 256)
            extra = np.maximum(counts - most, 0).sum()
            tables[i, j] = np.cumsum(np.minimum(counts, most) + extra / 256) * 255 / (th * tw)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: tables[a[:, None], b[None, :], plain]
    equal = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    equal = np.rint(equal).clip(0, 255)
    return np.rint(1.5 * equal - 0.5 * _smooth(equal, 1.0, 3)).clip(0, 255).astype(np.uint8)


def model_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """Channels-first, resized, scaled to 0..1 and normalised by channel."""
    rgb = np.stack([resize_area(to_bgr8(image)[..., c], size, size) for c in (2, 1, 0)])
    return ((rgb / 255 - MEAN[:, None, None]) / STD[:, None, None]).astype(np.float32)


def display_size(width: int, height: int, target_height: int) -> tuple[int, int]:
    """Width and height scaled to a target height, the width truncated."""
    return int(width * (target_height / height)), target_height


def encode_png(image: np.ndarray) -> bytes:
    """A gray or BGR 8-bit image as a PNG file, without loss."""
    h, w = image.shape[:2]
    plain = image.ndim == 2 or image.shape[2] == 1
    rows = np.zeros((h, 1 + w * (1 if plain else 3)), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = (image if plain else image[..., 2::-1]).reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if plain else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def mask_visual(image: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int] = (0, 255, 0)) -> tuple[np.ndarray, np.ndarray]:
    """The mask at the image's size as black and white, and the image with the border of the mask's largest region drawn on it."""
    h, w = image.shape[:2]
    rows, cols = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
    full = mask[rows][:, cols].astype(bool)
    out = to_bgr8(image).copy()
    region = largest_region(full)
    if region is not None:
        held = np.pad(region, 1)
        inner = held[:-2, 1:-1] & held[2:, 1:-1] & held[1:-1, :-2] & held[1:-1, 2:]
        out[region & ~inner] = colour
    return full.astype(np.uint8) * 255, out
