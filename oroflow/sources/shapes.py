"""Shapefiles as a Spark data source, and tables written as folders of them.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").option("box", "5,44,7,46").option("fields", "NAME,ID").load("/data/rivers")

A path is one .shp file or a folder of them (searched through). Planning reads 100 bytes a file: files whose box does not
meet the one asked for are left out, the others are cut into ranges of `records` records by the size of their index. A
task reads its slice of the index and of the attribute table, then the shapes in spans of a few megabytes; shapes outside
the box are skipped before their points are unpacked. One row a record, deleted ones left out:

file, record (from 0), kind (null, point, multipoint, line, polygon), parts (arrays of x, y and z, which is null where the
type has none), x_min, y_min, x_max, y_max (null for a null shape) and the attributes as text by name, trimmed, null where
empty. A null shape meets no box. Files without an attribute table have no attributes; a broken file ends the read with
an error that names it, unless option `broken` is `skip`.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.scratch import written
from .chunk_store import opened

SCHEMA = (
    "file string, record long, kind string, parts array<array<struct<x:double,y:double,z:double>>>, "
    "x_min double, y_min double, x_max double, y_max double, attributes map<string,string>"
)
_PLACE = pa.struct([(n, pa.float64()) for n in "xyz"])
ARROW = pa.schema([("file", pa.string()), ("record", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(_PLACE)))] + [(n, pa.float64()) for n in ("x_min", "y_min", "x_max", "y_max")] + [("attributes", pa.map_(pa.string(), pa.string()))])
#: Fixed values of the format: file code, version, bytes of the header; shape types by kind (plain, with z, with m).
FILE_CODE, VERSION, HEAD = 9994, 1000, 100
TYPES = {"point": (1, 11, 21), "line": (3, 13, 23), "polygon": (5, 15, 25), "multipoint": (8, 18, 28)}
KINDS = {t: kind for kind, ts in TYPES.items() for t in ts} | {0: "null"}
WITH_Z = {11, 13, 15, 18}
SPAN = 8 << 20

Box = tuple[float, float, float, float]


class ShapeError(ValueError):
    pass


def _meets(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


@dataclass
class Records(InputPartition):
    file: str
    first: int
    last: int


def _shape(data: bytes, box: Box | None) -> tuple | None:
    """kind, parts, box of a record's content; None where it does not meet the box."""
    (kind,) = struct.unpack_from("<i", data)
    if kind not in KINDS:
        raise ShapeError(f"shape type {kind}")
    if kind == 0:
        return None if box else ("null", None, (None,) * 4)
    if KINDS[kind] == "point":
        x, y = struct.unpack_from("<dd", data, 4)
        z = struct.unpack_from("<d", data, 20)[0] if kind in WITH_Z else None
        return None if box and not _meets((x, y, x, y), box) else ("point", [[{"x": x, "y": y, "z": z}]], (x, y, x, y))
    own = struct.unpack_from("<4d", data, 4)
    if box and not _meets(own, box):
        return None
    if KINDS[kind] == "multipoint":
        (n,), starts, at = struct.unpack_from("<i", data, 36), [0], 40
    else:
        n_parts, n = struct.unpack_from("<ii", data, 36)
        starts, at = list(struct.unpack_from(f"<{n_parts}i", data, 44)), 44 + 4 * n_parts
    xy = np.frombuffer(data, "<f8", 2 * n, at).reshape(n, 2).tolist()
    z = np.frombuffer(data, "<f8", n, at + 16 * n + 16).tolist() if kind in WITH_Z else [None] * n
    points = [{"x": x, "y": y, "z": h} for (x, y), h in zip(xy, z, strict=True)]
    return KINDS[kind], [points[a:b] for a, b in itertools.pairwise([*starts, n])], own


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.box = tuple(float(v) for v in options["box"].split(",")) if options.get("box") else None
        self.fields = {f.strip() for f in options["fields"].split(",")} if options.get("fields") else None
        self.records = int(options.get("records", 20_000))
        self.skip = options.get("broken", "fail") == "skip"
        if self.box is not None and len(self.box) != 4:
            raise ShapeError("box is west,south,east,north")

    def _plan(self, file: str) -> list[Records]:
        system, _ = opened(self.path)
        try:
            with system.open_input_file(file) as f:
                head = f.read(HEAD)
            code, = struct.unpack_from(">i", head)
            if code != FILE_CODE:
                raise ShapeError("not a shapefile")
            if self.box and not _meets(struct.unpack_from("<4d", head, 36), self.box):
                return []
            n = (system.get_file_info(file[:-4] + ".shx").size - HEAD) // 8
        except (OSError, ValueError, TypeError, struct.error) as why:
            if self.skip:
                return []
            raise ShapeError(f"{file}: {why}") from why
        return [Records(file, k, min(n, k + self.records)) for k in range(0, n, self.records)]

    def partitions(self) -> list[InputPartition]:
        system, at = opened(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            files = sorted(i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.path.lower().endswith(".shp"))
        else:
            files = [at]
        with ThreadPoolExecutor(16) as pool:
            return list(itertools.chain.from_iterable(pool.map(self._plan, files)))

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file meets the box
            return
        try:
            for rows in self._rows(partition):
                yield pa.RecordBatch.from_pylist(rows, ARROW)
        except (OSError, ValueError, struct.error) as why:
            if not self.skip:
                raise ShapeError(f"{partition.file}: {why}") from why

    def _rows(self, part: Records) -> Iterator[list[dict]]:
        system, _ = opened(self.path)
        stem = part.file[:-4]
        with system.open_input_file(stem + ".shx") as f:
            f.seek(HEAD + 8 * part.first)
            index = np.frombuffer(f.read(8 * (part.last - part.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        told = self._attributes(system, stem + ".dbf", part)
        ends = index[:, 0] + 8 + index[:, 1]
        with system.open_input_file(part.file) as f:
            k = 0
            while k < len(index):  # a span holds one record, or several that lie in order within a few megabytes
                m = k + 1
                while m < len(index) and index[m, 0] >= ends[m - 1] and ends[m] - index[k, 0] <= SPAN:
                    m += 1
                f.seek(int(index[k, 0]))
                data, rows = f.read(int(ends[m - 1] - index[k, 0])), []
                for i in range(k, m):
                    at = int(index[i, 0] - index[k, 0]) + 8
                    attributes = told[i] if told else {}
                    if attributes is None:
                        continue
                    shape = _shape(data[at : at + int(index[i, 1])], self.box)
                    if shape is not None:
                        kind, points, own = shape
                        rows.append(dict(zip(("x_min", "y_min", "x_max", "y_max"), own, strict=True), file=part.file, record=part.first + i, kind=kind, parts=points, attributes=list(attributes.items())))
                if rows:
                    yield rows
                k = m

    def _attributes(self, system: fs.FileSystem, path: str, part: Records) -> list[dict | None]:
        """The attributes of the records; None for one that is marked as deleted. Nothing without a table."""
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return []
        with system.open_input_file(path) as f:
            start, width = struct.unpack_from("<HH", f.read(32), 8)
            names, at = [], 1
            for raw in itertools.batched(f.read(start - 32), 32):
                if raw[0] == 0x0D or len(raw) < 32:
                    break
                name = bytes(raw[:11]).split(b"\0")[0].decode("utf-8", "replace")
                if self.fields is None or name in self.fields:
                    names.append((name, at, at + raw[16]))
                at += raw[16]
            f.seek(start + part.first * width)
            data = f.read((part.last - part.first) * width)
        if len(data) < (part.last - part.first) * width:
            raise ShapeError("attribute table is cut short")
        text = lambda row, a, b: data[row + a : row + b].decode("utf-8", "replace").strip("\0 ") or None
        return [None if data[row : row + 1] == b"*" else {n: text(row, a, b) for n, a, b in names} for row in range(0, len(data), width)]


class ShapefileSource(DataSource):
    """Format `shapefile`; options path, box (west,south,east,north), fields, records, broken (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(dict(self.options))


def read_shapes(spark: SparkSession, path: str, box: Box | None = None, fields: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    options = ({"box": ",".join(map(repr, box))} if box else {}) | ({"fields": ",".join(fields)} if fields else {})
    return spark.read.format("shapefile").options(**options).load(path)


def shape_geojson(shapes: DataFrame) -> DataFrame:
    """file, record, feature: one GeoJSON Feature a record, as text. Lines of several parts are MultiLineStrings, the
    rings of a polygon stay in one Polygon; a null shape is an empty GeometryCollection. Heights are kept where there are any."""
    place = F.transform("parts", lambda part: F.transform(part, lambda p: F.when(p.z.isNull(), F.array(p.x, p.y)).otherwise(F.array(p.x, p.y, p.z))))
    several = F.size("parts") > 1
    name = F.expr("CASE kind WHEN 'point' THEN 'Point' WHEN 'multipoint' THEN 'MultiPoint' WHEN 'polygon' THEN 'Polygon' WHEN 'line' THEN IF(size(parts) > 1, 'MultiLineString', 'LineString') ELSE 'GeometryCollection' END")
    nested = F.when(F.col("kind") == "point", F.to_json(place[0][0])).when((F.col("kind") == "multipoint") | ((F.col("kind") == "line") & ~several), F.to_json(place[0])).when(F.col("kind") == "null", "[]").otherwise(F.to_json(place))
    properties = F.to_json("attributes", {"ignoreNullFields": "false"})
    return shapes.select("file", "record", F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), name, F.lit('","'), F.when(F.col("kind") == "null", "geometries").otherwise("coordinates"), F.lit('":'), nested, F.lit('},"properties":'), properties, F.lit("}")).alias("feature"))


def _head(code: int, size: int, box: tuple, z: tuple) -> bytes:
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, code, *box, *z, 0.0, 0.0)


def _content(code: int, parts: list[np.ndarray]) -> bytes:
    """A record's content; parts are arrays of x, y, z."""
    if not sum(map(len, parts)):
        return struct.pack("<i", 0)
    points = np.concatenate(parts)
    xy, z = np.ascontiguousarray(points[:, :2], "<f8"), np.ascontiguousarray(points[:, 2], "<f8")
    if KINDS[code] == "point":
        return struct.pack("<i", code) + xy[0].tobytes() + (z[:1].tobytes() + struct.pack("<d", 0.0) if code in WITH_Z else b"")
    head = struct.pack("<i4d", code, *xy.min(axis=0), *xy.max(axis=0))
    if KINDS[code] == "multipoint":
        head += struct.pack("<i", len(xy))
    else:
        starts = np.cumsum([0, *map(len, parts[:-1])])
        head += struct.pack("<ii", len(parts), len(xy)) + starts.astype("<i4").tobytes()
    return head + xy.tobytes() + (struct.pack("<dd", z.min(), z.max()) + z.tobytes() if code in WITH_Z else b"")


def _table(names: list[str], rows: list[tuple]) -> bytes:
    """Attributes as texts of the width that they need."""
    texts = [[b"" if v is None or v != v else str(v).encode() for v in row] for row in rows]
    widths = [max([1, *(len(row[i]) for row in texts)]) for i in range(len(names))]
    if max(widths, default=0) > 254:
        raise ShapeError("an attribute is longer than the 254 bytes of the format")
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", w, 0) for n, w in zip(names, widths, strict=True))
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 32 + len(fields) + 1, 1 + sum(widths))
    return head + fields + b"\r" + b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(row, widths, strict=True)) for row in texts) + b"\x1a"


def write_shapes(shapes: DataFrame, folder: str, kind: str, files: int = 8, rows: int = 50_000, with_z: bool = False) -> DataFrame:
    """shapes: parts (arrays of structs with x, y and, with_z, z) and attributes, whose names have 10 bytes at most. Each
    task writes the shapes of a range along x in files of `rows` records or of 256 MB, so that boxes prune. A task that is run
    again writes the same files. Rows without points are null shapes. Returns name, n_records, n_bytes of the files."""
    names = [c for c in shapes.columns if c != "parts"]
    if any(len(n.encode()) > 10 for n in names):
        raise ShapeError("attribute names have 10 bytes at most")
    code = TYPES[kind][1 if with_z else 0]
    z = (lambda p: p.z.cast("double")) if with_z else (lambda p: F.lit(0.0))
    flat = shapes.withColumn("parts", F.transform("parts", lambda part: F.flatten(F.transform(part, lambda p: F.array(p.x.cast("double"), p.y.cast("double"), z(p))))))
    key = F.get(F.get("parts", F.lit(0)), F.lit(0))
    laid = written(flat.repartitionByRange(files, key).sortWithinPartitions(key, *names), "shapes")

    def save(name: str, held: list[tuple[bytes, tuple]]) -> pd.DataFrame:
        body = [c for c, _ in held]
        sizes = np.array([len(c) for c in body])
        at = HEAD + np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
        own = [np.frombuffer(c, "<f8", 4 if KINDS[code] != "point" else 2, 4) for c in body if len(c) > 4]
        box = (*np.min([o[:2] for o in own], axis=0), *np.max([o[-2:] for o in own], axis=0)) if own else (0.0,) * 4
        shp = _head(code, HEAD + int((sizes + 8).sum()), box, (0.0, 0.0)) + b"".join(struct.pack(">2i", k + 1, len(c) // 2) + c for k, c in enumerate(body))
        shx = _head(code, HEAD + 8 * len(body), box, (0.0, 0.0)) + np.stack([at // 2, sizes // 2], axis=1).astype(">i4").tobytes()
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for end, data in ((".shx", shx), (".dbf", _table(names, [row for _, row in held])), (".cpg", b"UTF-8"), (".shp", shp)):
            part = f"{base}/.{name}{end}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, f"{base}/{name}{end}")  # the file that readers look for comes last, whole
        return pd.DataFrame({"name": [name + ".shp"], "n_records": [len(body)], "n_bytes": [len(shp)]})

    def save_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            for parts, *row in zip(pdf["parts"], *(pdf[n] for n in names), strict=True):
                content = _content(code, [np.asarray(p, float).reshape(-1, 3) for p in parts] if parts is not None else [])
                held.append((content, tuple(row)))
                size += len(content)
                if len(held) >= rows or size >= 256 << 20:
                    yield save(f"part-{task:05d}-{k:05d}", held)
                    k, held, size = k + 1, [], 0
        if held:
            yield save(f"part-{task:05d}-{k:05d}", held)

    return written(laid.select("parts", *(F.col(n).cast("string") for n in names)).mapInPandas(save_all, "name string, n_records long, n_bytes long"), "shape-files")
