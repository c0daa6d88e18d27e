"""GeoTIFF and BigTIFF, tiled or in strips, as tables of blocks and cells.

Reading is a ``binaryFile`` scan in three steps: the header of each file is parsed
and its blocks cut out as rows (only those that meet the window asked for), the
block rows are dealt over all tasks, and each is decoded to cells on its own. So a
file's decoding is not bound to the task that read it, and no task holds more than
one file's bytes or one block's cells. Writing encodes a block of the grid a task
as a file of its own, with overviews that halve it, as cloud-optimised files have.
"""

from __future__ import annotations

import math
import pickle
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.lineage import workers_see_package

# fixed values of the file format
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
SUBFILE, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 254, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000


@dataclass
class Page:
    """One image of a file: its tags, and what follows from them."""

    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default: float = 0):
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return int(self.one(HEIGHT)), int(self.one(WIDTH))

    @property
    def bands(self) -> int:
        return int(self.one(SAMPLES, 1))

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f", 5: "i", 6: "c"}[int(self.one(SAMPLE_FORMAT, 1))]
        return np.dtype(f"{self.order}{kind}{int(self.one(BITS, 8)) // 8}")

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def block(self) -> tuple[int, int]:
        if self.tiled:
            return int(self.one(TILE_HEIGHT)), int(self.one(TILE_WIDTH))
        return min(int(self.one(ROWS_PER_STRIP, 1 << 31)), self.shape[0]), self.shape[1]

    @property
    def split(self) -> bool:
        """Bands in blocks of their own."""
        return int(self.one(PLANAR, 1)) == 2 and self.bands > 1

    @property
    def transform(self) -> tuple[float, float, float, float]:
        """x and y of the upper left corner, and the size of a cell (y negative where the north is up)."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return m[3], m[7], m[0], m[5]
        if PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            (dx, dy, *_), t = self.tags[PIXEL_SCALE], self.tags[TIE_POINT]
            return t[3] - t[0] * dx, t[4] + t[1] * dy, dx, -dy
        return 0.0, 0.0, 1.0, -1.0

    @property
    def keys(self) -> dict[int, object]:
        k = self.tags.get(GEO_KEYS, ())
        out: dict[int, object] = {}
        for i in range(4, len(k) - 3, 4):
            key, where, n, value = k[i : i + 4]
            source = self.tags.get(where, ())
            out[key] = value if where == 0 else source[value : value + n] if isinstance(source, (tuple, str)) else None
        return out

    @property
    def epsg(self) -> int | None:
        """The projected, else the geographic, system; none where it is user-defined."""
        for key in (3072, 2048):
            code = self.keys.get(key)
            if isinstance(code, int) and code not in (0, 32767):
                return code
        return None

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA)
        try:
            return float(str(text).strip("\x00 ")) if text else None
        except ValueError:
            return None

    def blocks(self, window: tuple[float, float, float, float] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """(first row, first column, band or -1 for all, offset, bytes) of blocks that meet (min x, min y, max x, max y)."""
        (n, m), (bh, bw) = self.shape, self.block
        offsets = self.tags[TILE_OFFSETS if self.tiled else STRIP_OFFSETS]
        sizes = self.tags[TILE_BYTES if self.tiled else STRIP_BYTES]
        down, across = math.ceil(n / bh), math.ceil(m / bw)
        x0, y0, dx, dy = self.transform
        for i, (at, size) in enumerate(zip(offsets, sizes)):
            band, k = divmod(i, down * across)
            r, c = k // across * bh, k % across * bw
            if window is not None:
                xs = sorted((x0 + c * dx, x0 + min(c + bw, m) * dx))
                ys = sorted((y0 + r * dy, y0 + min(r + bh, n) * dy))
                if xs[1] <= window[0] or xs[0] >= window[2] or ys[1] <= window[1] or ys[0] >= window[3]:
                    continue
            yield r, c, band if self.split else -1, int(at), int(size)

    def decode(self, raw: bytes, r: int, c: int, band: int) -> np.ndarray:
        """(bands, rows, columns) of one block, cut to the image."""
        (n, m), (bh, bw) = self.shape, self.block
        rows = bh if self.tiled else min(bh, n - r)
        samples = 1 if band >= 0 else self.bands
        data = unpack(raw, int(self.one(COMPRESSION, 1)), rows * bw * samples * self.dtype.itemsize)
        a = unpredict(data, int(self.one(PREDICTOR, 1)), rows, bw, samples, self.dtype)
        return a.transpose(2, 0, 1)[:, : n - r, : m - c]


def pages(data: bytes) -> list[Page]:
    """All images of a file: the full one, and its overviews in the order in which they stand."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack_from(f"{order}H", data, 2)
    if magic not in (42, 43):
        raise ValueError(f"not a TIFF file: version {magic}")
    big = magic == 43
    count_kind, entry, word, room = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    (at,) = struct.unpack_from(f"{order}{word}", data, 8 if big else 4)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}{count_kind}", data, at)
        at += struct.calcsize(f"{order}{count_kind}")
        page = Page(order)
        for i in range(n):
            p = at + i * entry
            tag, kind = struct.unpack_from(f"{order}HH", data, p)
            (count,) = struct.unpack_from(f"{order}{word}", data, p + 4)
            if kind not in TYPES:
                continue
            form = TYPES[kind]
            size = struct.calcsize(f"{order}{form}") * count
            where = p + 4 + struct.calcsize(f"{order}{word}")
            if size > room:
                (where,) = struct.unpack_from(f"{order}{word}", data, where)
            if kind == 2:
                page.tags[tag] = bytes(data[where : where + count]).split(b"\x00")[0].decode("latin-1")
            else:
                page.tags[tag] = struct.unpack_from(f"{order}{len(form) * count}{form[0]}", data, where)
        out.append(page)
        (at,) = struct.unpack_from(f"{order}{word}", data, at + n * entry)
    return out


def unpack(raw: bytes, how: int, size: int) -> bytes:
    """Decompressed bytes of a block, with zeros where a block is short."""
    if how == NONE:
        out = bytes(raw)
    elif how in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompress(raw)
    elif how == LZW:
        out = unlzw(raw, size)
    elif how == PACKBITS:
        out = unpackbits(raw)
    elif how == ZSTD:
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    else:
        raise ValueError(f"compression {how} is not supported")
    return out[:size].ljust(size, b"\x00")


def unlzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    out, table, width = bytearray(), [], 9
    bits, held, last = 0, 0, b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(max(9, (len(table) + 1).bit_length()), 12)
    return bytes(out)


def unpackbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + n + 2]
            i += n + 2
        else:
            out += raw[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpredict(data: bytes, how: int, rows: int, cols: int, samples: int, dtype: np.dtype) -> np.ndarray:
    """(rows, columns, samples): differences along rows summed up (2), or of byte planes of floats (3)."""
    if how == 3:
        b = np.frombuffer(data, np.uint8).reshape(rows, -1, samples).cumsum(1, dtype=np.uint8)
        planes = b.reshape(rows, dtype.itemsize, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(dtype.newbyteorder(">")).reshape(rows, cols, samples).astype(dtype.newbyteorder("="))
    a = np.frombuffer(data, dtype).reshape(rows, cols, samples).astype(dtype.newbyteorder("="))
    if how == 2:
        whole = a.view(f"u{dtype.itemsize}") if dtype.kind in "iu" else a
        return whole.cumsum(1, dtype=whole.dtype).view(a.dtype)
    return a


def predict(a: np.ndarray, how: int) -> bytes:
    """The bytes of (rows, columns, samples), little-endian, for a predictor."""
    a = np.ascontiguousarray(a)
    if how == 3:
        n, m, s = a.shape
        planes = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(n, m * s, a.itemsize).transpose(0, 2, 1)
        b = np.ascontiguousarray(planes).reshape(n, -1, s)
        return np.diff(b, axis=1, prepend=np.zeros((n, 1, s), np.uint8)).tobytes()
    if how == 2 and a.dtype.kind in "iu":
        whole = a.view(f"u{a.itemsize}")
        return np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1])).tobytes()
    return a.astype(a.dtype.newbyteorder("<")).tobytes()


def halved(a: np.ndarray, nodata: float | None) -> np.ndarray:
    """Means of 2 x 2 cells that hold data."""
    n, m = a.shape[1:]
    wide = np.pad(a.astype(float), ((0, 0), (0, n % 2), (0, m % 2)), constant_values=np.nan)
    if nodata is not None:
        wide[wide == nodata] = np.nan
    four = wide.reshape(len(a), (n + 1) // 2, 2, (m + 1) // 2, 2)
    has = (~np.isnan(four)).sum((2, 4))
    mean = np.nansum(four, axis=(2, 4)) / np.maximum(has, 1)
    mean[has == 0] = np.nan if nodata is None else nodata
    return (np.rint(np.nan_to_num(mean)) if a.dtype.kind in "iu" else mean).astype(a.dtype)


def encode(
    a: np.ndarray, transform: Sequence[float] = (0, 0, 1, -1), epsg: int | None = None, nodata: float | None = None,
    tile: int = 256, level: int = 6, overviews: bool = True, big: bool = False,
) -> bytes:
    """A tiled, deflated file of (bands, rows, columns), with overviews down to one tile; ``big`` for BigTIFF.

    All headers stand at the front, the overviews' blocks before those of the full image.
    """
    levels = [a]
    while overviews and max(levels[-1].shape[1:]) > tile:
        levels.append(halved(levels[-1], nodata))
    how = 3 if a.dtype.kind == "f" else 2
    word, kind, room = ("Q", 16, 8) if big else ("I", 4, 4)
    heads = []
    for k, x in enumerate(levels):
        blocks = []
        for r in range(0, x.shape[1], tile):
            for c in range(0, x.shape[2], tile):
                part = x[:, r : r + tile, c : c + tile].transpose(1, 2, 0)
                full = np.zeros((tile, tile, len(x)), x.dtype)
                full[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(predict(full, how), level))
        s = len(x)
        geographic = epsg is not None and 4000 <= epsg < 5000
        tags = {
            SUBFILE: (4, (int(k > 0),)), WIDTH: (4, (x.shape[2],)), HEIGHT: (4, (x.shape[1],)), BITS: (3, (8 * x.itemsize,) * s), COMPRESSION: (3, (DEFLATE,)),
            PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (s,)), PLANAR: (3, (1,)), PREDICTOR: (3, (how,)), TILE_WIDTH: (3, (tile,)), TILE_HEIGHT: (3, (tile,)),
            TILE_OFFSETS: (kind, (0,) * len(blocks)), TILE_BYTES: (kind, tuple(map(len, blocks))), SAMPLE_FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[x.dtype.kind],) * s),
        }
        if k == 0:
            tags[PIXEL_SCALE] = (12, (transform[2], -transform[3], 0.0))
            tags[TIE_POINT] = (12, (0.0, 0.0, 0.0, transform[0], transform[1], 0.0))
            if epsg is not None:
                tags[GEO_KEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg))
        if nodata is not None:
            tags[NODATA] = (2, f"{nodata:.17g}\x00".encode())
        heads.append((tags, blocks))

    def size(tags) -> int:
        extra = sum(n for kind_, v in tags.values() if (n := len(v) * (1 if kind_ == 2 else struct.calcsize("<" + TYPES[kind_]))) > room)
        return (8 if big else 2) + len(tags) * (20 if big else 12) + room + extra + 8 * len(tags)

    start = 16 if big else 8
    at = start + sum(size(tags) for tags, _ in heads)
    for tags, blocks in heads[::-1]:
        spots = []
        for b in blocks:
            spots.append(at)
            at += len(b)
        tags[TILE_OFFSETS] = (kind, tuple(spots))
    if not big and at >= 1 << 32:
        return encode(a, transform, epsg, nodata, tile, level, overviews, big=True)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start))
    for k, (tags, _) in enumerate(heads):
        spill = len(out) + (8 if big else 2) + len(tags) * (20 if big else 12) + room
        rows, extra = bytearray(struct.pack("<Q" if big else "<H", len(tags))), bytearray()
        for tag, (kind_, v) in sorted(tags.items()):
            value = v if kind_ == 2 else struct.pack(f"<{len(v)}{TYPES[kind_]}", *v)
            rows += struct.pack(f"<HH{word}", tag, kind_, len(v))
            if len(value) <= room:
                rows += value.ljust(room, b"\x00")
            else:
                extra += b"\x00" * (-len(extra) % 8)
                rows += struct.pack(f"<{word}", spill + len(extra))
                extra += value
        end = len(out) + size(tags)
        rows += struct.pack(f"<{word}", end if k + 1 < len(heads) else 0)
        out += (rows + extra).ljust(size(tags), b"\x00")
    for _, blocks in heads[::-1]:
        out += b"".join(blocks)
    return bytes(out)


def decode(data: bytes, level: int = 0) -> np.ndarray:
    """(bands, rows, columns) of a whole file's image."""
    page = pages(data)[level]
    out = np.zeros((page.bands, *page.shape), page.dtype.newbyteorder("="))
    for r, c, band, at, size in page.blocks():
        a = page.decode(data[at : at + size], r, c, band)
        out[slice(None) if band < 0 else slice(band, band + 1), r : r + a.shape[1], c : c + a.shape[2]] = a
    return out


def without_nodata(a: np.ndarray, nodata: float | None) -> np.ndarray:
    """As doubles, NaN where a cell is nodata (which may be an infinity) or not a number."""
    out = a.astype(float)
    if nodata is not None:
        out[out == nodata] = np.nan
    return out


def overview_by_ratio(widths: Sequence[int], ratio: float) -> int:
    """The coarsest image whose cells are at most ``ratio`` times as wide as those of the first; 0 for the first itself."""
    fits = [(widths[0] / w, -i) for i, w in enumerate(widths) if i and w and 1.0 < widths[0] / w <= ratio]
    return -max(fits)[1] if fits else 0


def overview_for_size(widths: Sequence[int], cells: float, wanted: int | None) -> int:
    """The image for a window of ``cells`` full cells of which about ``wanted`` are needed."""
    return 0 if wanted is None or cells <= wanted else overview_by_ratio(widths, math.sqrt(cells / wanted))


def overview_for_resolution(widths: Sequence[int], cell: float, wanted: float) -> int:
    """The image for cells of size ``wanted``; the full one unless they are over one and a half times its own."""
    return 0 if cell <= 0 or wanted <= 0 or wanted / cell <= 1.5 else overview_by_ratio(widths, wanted / cell)


META = "path string, width int, height int, bands int, dtype string, x0 double, y0 double, dx double, dy double, epsg int, nodata double, images int, widths array<int>"


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def describe(found: DataFrame) -> DataFrame:
    """One row of metadata a file (path, content)."""
    workers_see_package(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                all_ = pages(data)
                p = all_[0]
                rows.append((path, p.shape[1], p.shape[0], p.bands, p.dtype.newbyteorder("=").name, *map(float, p.transform), p.epsg, p.nodata, len(all_), [x.shape[1] for x in all_]))
            fields = [x.split() for x in META.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return found.mapInArrow(run, META)


def cells(found: DataFrame, bands: Sequence[int] = (1,), level: int = 0, window: tuple[float, float, float, float] | None = None, cell: float | None = None) -> DataFrame:
    """(path, r, c, x, y, b<k> of each band asked for): cells of files (path, content), null where nodata.

    ``window`` is (min x, min y, max x, max y); only blocks that meet it are decoded,
    and cells whose middle it does not hold are dropped. ``cell`` chooses the overview
    for that size of a cell in place of ``level``.
    """
    spark = found.sparkSession
    workers_see_package(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                all_ = pages(data)
                k = level if cell is None else overview_for_resolution([p.shape[1] for p in all_], abs(all_[0].transform[2]), cell)
                page, first = all_[k], all_[0]
                x0, y0, dx, dy = first.transform  # overviews carry none of their own
                fx, fy = first.shape[1] / page.shape[1], first.shape[0] / page.shape[0]
                page.tags[MATRIX] = (dx * fx, 0.0, 0.0, x0, 0.0, dy * fy, 0.0, y0)
                tags = {t: v for t, v in page.tags.items() if t not in (TILE_OFFSETS, TILE_BYTES, STRIP_OFFSETS, STRIP_BYTES)}
                head = pickle.dumps((page.order, tags | ({TILE_OFFSETS: (0,)} if page.tiled else {}), first.nodata))
                for r, c, band, at, size in page.blocks(window):
                    if band < 0 or band + 1 in bands:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x], ARROW[t]) for x, t in zip((path, head, r, c, band, data[at : at + size]), ("string", "binary", "int", "int", "int", "binary"))], names=["path", "head", "r0", "c0", "band", "raw"]
                        )

    names = [f"b{k}" for k in bands]

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, head, r0, c0, band, raw in zip(*(b.column(n).to_pylist() for n in ("path", "head", "r0", "c0", "band", "raw"))):
                order, tags, nodata = pickle.loads(head)
                page = Page(order, tags)
                a = without_nodata(page.decode(raw, r0, c0, band), nodata)
                x0, y0, dx, dy = page.transform
                r, c = np.indices(a.shape[1:])
                r, c = r.ravel() + r0, c.ravel() + c0
                x, y = x0 + (c + 0.5) * dx, y0 + (r + 0.5) * dy
                keep = np.ones(len(r), bool) if window is None else (x >= window[0]) & (x < window[2]) & (y > window[1]) & (y <= window[3])
                cols = [pa.array([path] * int(keep.sum())), pa.array(r[keep], pa.int32()), pa.array(c[keep], pa.int32()), pa.array(x[keep]), pa.array(y[keep])]
                for k in bands:
                    have = a[k - 1] if band < 0 else a[0] if band == k - 1 else np.full(a.shape[1:], np.nan)
                    cols.append(pa.array(have.ravel()[keep], from_pandas=True))
                yield pa.RecordBatch.from_arrays(cols, names=["path", "r", "c", "x", "y", *names])

    tiles = found.mapInArrow(cut, "path string, head binary, r0 int, c0 int, band int, raw binary").repartition("path", "r0", "c0")
    out = tiles.mapInArrow(open_, "path string, r int, c int, x double, y double, " + ", ".join(f"{n} double" for n in names))
    # bands in planes of their own meet by cell; where they share blocks the maximum is the one value
    return out if len(bands) == 1 else out.groupBy("path", "r", "c", "x", "y").agg(*[F.max(n).alias(n) for n in names])


def read_geotiff(spark: SparkSession, path: str, bands: Sequence[int] = (1,), **options) -> DataFrame:
    return cells(files(spark, path), bands, **options)


def encoded(
    grid: DataFrame, bands: Sequence[str] = ("v",), side: int = 4096, transform: Sequence[float] = (0, 0, 1, -1), epsg: int | None = None,
    nodata: float = -9999.0, dtype: str = "float64", tile: int = 256,
) -> DataFrame:
    """(name, content): one file for each block of ``side`` cells of a grid (r, c, bands), null cells as nodata."""
    workers_see_package(grid.sparkSession)
    x0, y0, dx, dy = map(float, transform)
    bands = list(bands)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(p["br"].iloc[0]), int(p["bc"].iloc[0])
        r, c = p["r"].to_numpy() - br * side, p["c"].to_numpy() - bc * side
        a = np.full((len(bands), r.max() + 1, c.max() + 1), nodata, dtype)
        for k, b in enumerate(bands):
            a[k, r, c] = p[b].fillna(nodata).to_numpy()
        at = (x0 + bc * side * dx, y0 + br * side * dy, dx, dy)
        return pd.DataFrame({"name": [f"{br}_{bc}.tif"], "content": [encode(a, at, epsg, nodata, tile)]})

    g = grid.select("r", "c", *bands, F.floor(F.col("r") / side).cast("int").alias("br"), F.floor(F.col("c") / side).cast("int").alias("bc"))
    return g.groupBy("br", "bc").applyInPandas(one, "name string, content binary")


def write_files(made: DataFrame, folder: str) -> None:
    """Files (name, content) through the cluster's file system, one at a time, so the driver holds one."""
    spark = made.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in made.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row['name']}")
        part = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{uuid.uuid4().hex}")
        fs = target.getFileSystem(conf)
        out = fs.create(part)
        try:
            out.write(bytes(row["content"]))
        finally:
            out.close()
        fs.rename(part, target)


def write_geotiff(grid: DataFrame, folder: str, **options) -> None:
    write_files(encoded(grid, **options), folder)
