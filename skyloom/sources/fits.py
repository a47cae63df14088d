"""FITS files as a Spark data source, in pure Python: headers, pixels of an image, and image bands written back.

    spark.dataSource.register(FitsSource)
    spark.read.format("fits").option("what", "headers").load(pattern)   # one row per HDU; no pixel is read
    spark.read.format("fits").option("hdu", "SCI").load(pattern)        # (path, y, x, v); non-finite pixels are null
    image.write.format("fits").option("height", n).option("width", m).save(folder)   # one file per task
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
BAND_ROWS = 256


def _value(text: str) -> str:
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while True:
            end = text.index("'", end)
            if text[end : end + 2] != "''":
                return text[1:end].replace("''", "'").rstrip()
            end += 2
    return text.split("/")[0].strip()


def headers(path: str) -> Iterator[tuple[int, dict[str, str], int]]:
    """(number, cards, offset of the data) of each HDU, skipping the data."""
    size, at, k = os.path.getsize(path), 0, 0
    with open(path, "rb") as f:
        while at < size:
            f.seek(at)
            cards: dict[str, str] = {}
            done = False
            while not done:
                raw = f.read(BLOCK)
                if len(raw) < BLOCK:
                    raise ValueError(f"{path}: header of HDU {k} is cut off")
                for i in range(0, BLOCK, CARD):
                    card = raw[i : i + CARD].decode("ascii", "replace")
                    if card[:8] == "END     ":
                        done = True
                        break
                    if card[8:10] == "= ":
                        cards[card[:8].strip()] = _value(card[10:])
            data = f.tell()
            yield k, cards, data
            n = int(np.prod([int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)])) if int(cards.get("NAXIS", 0)) else 0
            n = n * abs(int(cards.get("BITPIX", 8))) // 8 + int(cards.get("PCOUNT", 0))
            at, k = data + -(-n // BLOCK) * BLOCK, k + 1


class _Part(InputPartition):
    def __init__(self, path: str, hdu: int = -1, offset: int = 0, y0: int = 0, y1: int = 0, cards: dict | None = None):
        self.path, self.hdu, self.offset, self.y0, self.y1, self.cards = path, hdu, offset, y0, y1, cards


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.what, self.hdu = options.get("what", "pixels"), options.get("hdu", "first2d")
        self.paths = sorted(glob.glob(options["path"], recursive=True))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[_Part]:
        if self.what == "headers":
            return [_Part(p) for p in self.paths]
        out = []
        for p in self.paths:
            for k, cards, offset in headers(p):
                named = self.hdu in (str(k), cards.get("EXTNAME"))
                if cards.get("NAXIS") == "2" and (self.hdu == "first2d" or named):
                    ny = int(cards["NAXIS2"])
                    out += [_Part(p, k, offset, y, min(y + BAND_ROWS, ny), cards) for y in range(0, ny, BAND_ROWS)]
                    break
        return out

    def read(self, part: _Part) -> Iterator[tuple | pa.RecordBatch]:
        if self.what == "headers":
            for k, cards, _ in headers(part.path):
                yield part.path, k, cards.get("EXTNAME"), cards
            return
        c = part.cards
        nx, kind = int(c["NAXIS1"]), np.dtype(_KINDS[int(c["BITPIX"])])
        with open(part.path, "rb") as f:
            f.seek(part.offset + part.y0 * nx * kind.itemsize)
            a = np.frombuffer(f.read((part.y1 - part.y0) * nx * kind.itemsize), kind).reshape(-1, nx)
        v = (a * float(c.get("BSCALE", 1)) + float(c.get("BZERO", 0))).astype(float)
        lines = max(1, 65_536 // nx)  # a batch of about so many pixels
        for y in range(0, len(v), lines):
            flat = v[y : y + lines].ravel()
            at = np.arange(len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path] * len(flat)), pa.array((part.y0 + y + at // nx).astype(np.int32)), pa.array((at % nx).astype(np.int32)), pa.array(flat, mask=~np.isfinite(flat))], ["path", "y", "x", "v"],
            )


def _cards(pairs: list[tuple[str, object]]) -> bytes:
    def card(k: str, v: object) -> str:
        if isinstance(v, bool):
            text = f"{'T' if v else 'F':>20}"
        elif isinstance(v, str):
            text = "'" + v.replace("'", "''").ljust(8) + "'"
        else:
            text = f"{v:>20}"
        return f"{k:<8}= {text}".ljust(CARD)[:CARD]

    raw = "".join(card(k, v) for k, v in pairs) + "END".ljust(CARD)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK).encode("ascii")


def image_bytes(a: np.ndarray, more: list[tuple[str, object]] | None = None) -> bytes:
    """A primary image HDU of 32-bit floats."""
    data = np.ascontiguousarray(a, ">f4").tobytes()
    head = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", a.shape[1]), ("NAXIS2", a.shape[0]), *(more or [])]
    return _cards(head) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.width = options["path"], int(options["width"])

    def write(self, rows: Iterator) -> _Written:
        got = [(r["y"], r["x"], r["v"]) for r in rows]  # one band: BAND_ROWS lines at most where partitioned by band
        if not got:
            return _Written(None)
        y, x, v = np.array([g[0] for g in got]), np.array([g[1] for g in got]), np.array([np.nan if g[2] is None else g[2] for g in got])
        a = np.full((y.max() - y.min() + 1, self.width), np.nan, np.float32)
        a[y - y.min(), x] = v
        path = os.path.join(self.folder, f"band-{y.min():08d}-{uuid.uuid4().hex[:8]}.tmp")
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(image_bytes(a, [("BANDY0", int(y.min()))]))
        return _Written(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m and m.path:
                os.rename(m.path, m.path[:-4] + ".fits")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "path string, hdu int, name string, header map<string,string>" if self.options.get("what") == "headers" else "path string, y int, x int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
