"""Images as numpy arrays of height x width x 3 bytes: decoding, encoding, and the per-pixel operators."""

from __future__ import annotations

import base64
import struct
import zlib
from dataclasses import dataclass

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Limits:
    max_pixels: int = 100_000_000
    max_width: int = 1 << 30
    max_height: int = 1 << 30

    def check(self, width: int, height: int) -> None:
        """Before any pixel is decoded."""
        if width <= 0 or height <= 0:
            raise ValueError("an empty image")
        if width > self.max_width or height > self.max_height or width * height > self.max_pixels:
            raise ValueError("the image is too large")


def on_white(rgba: np.ndarray) -> np.ndarray:
    """Straight alpha over white."""
    c, a = rgba[..., :3].astype(np.uint32), rgba[..., 3:4].astype(np.uint32)
    return ((c * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def premultiplied_on_white(rgba: np.ndarray) -> np.ndarray:
    c, a = rgba[..., :3].astype(np.uint32), rgba[..., 3:4].astype(np.uint32)
    return np.minimum(255, c + 255 - a).astype(np.uint8)


def _rgb(samples: np.ndarray, alpha: bool) -> np.ndarray:
    """Grey or colour samples, with or without alpha, as RGB."""
    n = samples.shape[2]
    if n - alpha == 1:
        samples = np.concatenate([np.repeat(samples[..., :1], 3, axis=2), samples[..., 1:]], axis=2)
    return on_white(samples) if alpha else np.ascontiguousarray(samples[..., :3])


def decode_png(data: bytes, limits: Limits) -> np.ndarray:
    at, idat, palette, trans = 8, [], None, b""
    header = None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n:
            raise ValueError("the PNG is cut short")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
            limits.check(header[0], header[1])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trans = body
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if header is None:
        raise ValueError("a PNG without header")
    width, height, depth, colour, _, _, interlaced = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour not in (0, 3)):
        raise ValueError("this kind of PNG isn't supported")
    row = (width * channels * depth + 7) // 8
    step = max(1, channels * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(idat), (row + 1) * height)
    if len(raw) != (row + 1) * height:
        raise ValueError("the PNG's pixels are cut short")
    lines = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        line, kind = lines[y, 1:].copy(), lines[y, 0]
        if kind == 1:
            line = np.add.accumulate(np.pad(line, (0, -row % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            done = bytearray(row)
            for i in range(row):
                a, b, c = done[i - step] if i >= step else 0, int(above[i]), int(above[i - step]) if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i] = (int(line[i]) + guess) & 255
            line = np.frombuffer(bytes(done), np.uint8)
        elif kind:
            raise ValueError("a bad PNG filter")
        out[y] = above = line
    if depth == 16:
        samples = out.reshape(height, width, channels, 2)[..., 0]
    elif depth == 8:
        samples = out.reshape(height, width, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : width * depth].reshape(height, width, depth)
        samples = (bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8))[..., None].astype(np.uint8)
        if colour == 0:
            samples = (samples.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        if palette is None or int(samples.max(initial=0)) >= len(palette):
            raise ValueError("a bad PNG palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(trans)] = np.frombuffer(trans, np.uint8)[: len(palette)]
        return on_white(np.concatenate([palette, alpha[:, None]], axis=1)[samples[..., 0]])
    return _rgb(samples, colour in (4, 6))


def decode_pnm(data: bytes, limits: Limits) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a bad PNM header")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    limits.check(width, height)
    n = 3 if data[:2] == b"P6" else 1
    if most != 255:
        raise ValueError("only PNM of 8 bits is supported")
    pixels = np.frombuffer(data, np.uint8, offset=at + 1)
    if len(pixels) < width * height * n:
        raise ValueError("the PNM is cut short")
    return _rgb(pixels[: width * height * n].reshape(height, width, n), False)


def decode_bmp(data: bytes, limits: Limits) -> np.ndarray:
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    limits.check(width, abs(height))
    if size < 40 or bits not in (24, 32) or packed not in (0, 3) or (packed == 3 and bits == 24):
        raise ValueError("this kind of BMP isn't supported")
    n, row = bits // 8, (width * bits + 31) // 32 * 4
    pixels = np.frombuffer(data, np.uint8, offset=start)
    if len(pixels) < row * abs(height):
        raise ValueError("the BMP is cut short")
    lines = pixels[: row * abs(height)].reshape(abs(height), row)[:, : width * n].reshape(abs(height), width, n)
    return np.ascontiguousarray((lines if height < 0 else lines[::-1])[..., 2::-1])


def decode_tga(data: bytes, limits: Limits) -> np.ndarray:
    ident, mapped, kind = data[0], data[1], data[2]
    width, height, bits, flags = struct.unpack_from("<HHBB", data, 12)
    limits.check(width, height)
    if mapped or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        raise ValueError("this kind of TGA isn't supported")
    n, at, want = bits // 8, 18 + ident, width * height
    if kind < 8:
        pixels = np.frombuffer(data, np.uint8, offset=at)[: want * n]
    else:
        parts, have = [], 0
        while have < want:
            if at >= len(data):
                raise ValueError("the TGA is cut short")
            k = (data[at] & 127) + 1
            parts.append(data[at + 1 : at + 1 + n] * k if data[at] & 128 else data[at + 1 : at + 1 + n * k])
            at, have = at + 1 + (n if data[at] & 128 else n * k), have + k
        pixels = np.frombuffer(b"".join(parts), np.uint8)[: want * n]
    if len(pixels) < want * n:
        raise ValueError("the TGA is cut short")
    lines = pixels.reshape(height, width, n)
    lines = lines if flags & 32 else lines[::-1]
    lines = lines[:, ::-1] if flags & 16 else lines
    return _rgb(lines if n == 1 else lines[..., [2, 1, 0] + [3] * (n == 4)], n == 4)


def decode_tiff(data: bytes, limits: Limits) -> list[np.ndarray]:
    """Pages of a baseline TIFF (8 bits, none, PackBits or deflate); all directories are checked before any page is decoded."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    sizes = {1: "B", 3: "H", 4: "I"}
    pages, (at,), seen = [], struct.unpack_from(order + "I", data, 4), set()
    try:
        while at:
            if at in seen:
                raise ValueError("TIFF directories in a circle")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in sizes:
                    form = f"{order}{count}{sizes[kind]}"
                    place = at + 10 + 12 * i
                    tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
            width, height = tags.get(256, (0,))[0], tags.get(257, (0,))[0]
            limits.check(width, height)
            if set(tags.get(258, (1,))) != {8} or tags.get(259, (1,))[0] not in (1, 8, 32773, 32946) or tags.get(262, (9,))[0] not in (0, 1, 2) or tags.get(284, (1,))[0] != 1 or tags.get(317, (1,))[0] not in (1, 2) or 273 not in tags:
                raise ValueError("this kind of TIFF isn't supported")
            pages.append((tags, width, height))
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error:
        raise ValueError("the TIFF is cut short") from None
    out = []
    for tags, width, height in pages:
        n = tags.get(277, (1,))[0]
        parts = []
        for start, size in zip(tags[273], tags.get(279, (len(data),) * len(tags[273])), strict=True):
            strip = data[start : start + size]
            packing = tags.get(259, (1,))[0]
            parts.append(strip if packing == 1 else unpack_bits(strip) if packing == 32773 else zlib.decompress(strip))
        pixels = np.frombuffer(b"".join(parts), np.uint8)
        if len(pixels) < width * height * n:
            raise ValueError("the TIFF is cut short")
        page = pixels[: width * height * n].reshape(height, width, n)
        if tags.get(317, (1,))[0] == 2:
            page = np.add.accumulate(page, axis=1, dtype=np.uint8)
        if tags[262][0] == 0:
            page = np.concatenate([255 - page[..., :1], page[..., 1:]], axis=2)
        alpha = tags.get(338, (0,))[0] if n in (2, 4) else 0
        if alpha == 1:
            page = np.concatenate([np.repeat(page[..., :1], 3, axis=2), page[..., 1:]], axis=2) if n == 2 else page
            out.append(premultiplied_on_white(page))
        else:
            out.append(_rgb(page if alpha else page[..., : 3 if n >= 3 else 1], bool(alpha)))
    return out


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        k = data[at]
        if k < 128:
            out.append(data[at + 1 : at + 2 + k])
            at += 2 + k
        else:
            out.append(data[at + 1 : at + 2] * (257 - k) if k > 128 else b"")
            at += 2 if k > 128 else 1
    return b"".join(out)


def decode(data: bytes, limits: Limits | None = None) -> list[np.ndarray]:
    """Pages of an image file. ValueError for what can't be read; JPEG needs Spark's own image reader."""
    limits = limits or Limits()
    try:
        if data[:8] == PNG:
            return [decode_png(data, limits)]
        if data[:2] in (b"P5", b"P6"):
            return [decode_pnm(data, limits)]
        if data[:2] == b"BM":
            return [decode_bmp(data, limits)]
        if data[:2] in (b"II", b"MM"):
            return decode_tiff(data, limits)
        if len(data) >= 18 and data[1] == 0 and data[2] in (2, 3, 10, 11):
            return [decode_tga(data, limits)]
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"the image is damaged: {e}") from None
    raise ValueError("an unknown kind of image")


def encode_png(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * 3)], axis=1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def data_url(image: np.ndarray) -> str:
    return "data:image/png;base64," + base64.b64encode(encode_png(image)).decode()


def consistent(rgb: bytes, width: int, height: int) -> bool:
    return width > 0 and height > 0 and len(rgb) == width * height * 3


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    height, width, _ = image.shape
    if not all(np.isfinite(v) for v in box):
        raise ValueError("coordinates not finite")
    x0, x1 = (min(max(v, 0.0), float(width)) for v in box[::2])
    y0, y1 = (min(max(v, 0.0), float(height)) for v in box[1::2])
    x0, y0, x1, y1 = int(np.floor(x0)), int(np.floor(y0)), int(np.ceil(x1)), int(np.ceil(y1))
    if x1 <= x0 or y1 <= y0:
        raise ValueError("an empty crop")
    return image[y0:y1, x0:x1].copy()


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with half-pixel centres, halves rounded up."""

    def grid(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    x0, x1, fx = grid(width, image.shape[1])
    y0, y1, fy = grid(height, image.shape[0])
    p = image.astype(np.float64)
    fx, fy = fx[None, :, None], fy[:, None, None]
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Counter-clockwise by a right angle."""
    if degrees not in (0, 90, 180, 270):
        raise ValueError("rotation not a right angle")
    return np.ascontiguousarray(np.rot90(image, degrees // 90))


def polygon_mask(points: list[tuple[float, float]], x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """Which pixel centres of a window are inside a polygon, by the even-odd rule."""
    x, y = np.arange(width) + x0 + 0.5, (np.arange(height) + y0 + 0.5)[:, None]
    inside = np.zeros((height, width), bool)
    for (px, py), (qx, qy) in zip(points, [points[-1], *points[:-1]], strict=True):
        if py != qy:
            inside ^= ((py > y) != (qy > y)) & (x[None, :] < (qx - px) * (y - py) / (qy - py) + px)
    return inside


def polygon_crop(image: np.ndarray, box: tuple[float, ...], points: list[tuple[float, float]] | None, background: int = 255, fallback: bool = False) -> np.ndarray:
    """The crop of box, pixels outside the polygon in the background colour; without polygon an error or the plain crop."""
    out = crop(image, box)
    if not points:
        if fallback:
            return out
        raise ValueError("no polygon to crop by")
    x0, y0 = int(np.floor(min(max(box[0], 0), image.shape[1]))), int(np.floor(min(max(box[1], 0), image.shape[0])))
    out[~polygon_mask(points, x0, y0, out.shape[1], out.shape[0])] = background
    return out


def white_out(image: np.ndarray, boxes: list[tuple[float, ...]]) -> np.ndarray:
    out = image.copy()
    height, width, _ = image.shape
    for x0, y0, x1, y1 in boxes:
        out[max(0, int(np.floor(y0))) : max(0, min(height, int(np.ceil(y1)))), max(0, int(np.floor(x0))) : max(0, min(width, int(np.ceil(x1))))] = 255
    return out


def tensor(image: np.ndarray, width: int, height: int, scale: float = 1 / 255, mean: tuple = (0.0, 0.0, 0.0), std: tuple = (1.0, 1.0, 1.0), bgr: bool = False) -> np.ndarray:
    """A [1, 3, height, width] float tensor."""
    p = resize(image, width, height)[..., ::-1 if bgr else 1].astype(np.float32)
    return ((p * np.float32(scale) - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)[None]


def batched(tensors: list[np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """Tensors joined along the first axis, filled up to size with the last; and how many are real."""
    n = len(tensors)
    if not 0 < n <= size:
        raise ValueError("a batch of a wrong size")
    return np.concatenate(tensors + [tensors[-1]] * (size - n)), n


def unbatched(data: np.ndarray, n: int) -> list[np.ndarray]:
    return [data[i : i + 1] for i in range(n)]


def shape_size(shape: list[int]) -> int:
    """Product of dimensions; ValueError where one isn't positive or it leaves 63 bits."""
    out = 1
    for d in shape:
        if d <= 0 or out > ((1 << 63) - 1) // d:
            raise ValueError("a bad tensor shape")
        out *= d
    return out
