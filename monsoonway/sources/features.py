"""Tables of features from geometry files: partitioned readers of shapefiles and GeoPackages, and a sink of shapefiles.

Both are Python data sources (``shapefile``, ``geopackage``). Where Spark plans, only headers and the sizes of indexes are read; a task reads one run of
records: of a shapefile by its index, of a GeoPackage by its row numbers. Filters on ``west``, ``south``, ``east`` and ``north`` skip files by their header,
records before their corners are decoded, and GeoPackage rows by the R-tree if the layer has one. The option ``columns`` names the attributes to read.

Rows: ``path``; ``feature``, the record's place in its file from 0 or the row's number; ``kind`` (point, line, area); ``parts``, structs of ``xs`` and ``ys``: points, lines
or rings; the four bounds; attributes. Null and empty geometries have null parts and bounds; deleted records give no row. Only x and y of corners are kept. An attribute that a file lacks is null.
A GeoPackage is an SQLite file, so tasks have to reach it as a file.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from ..functions import expressions as X
from .netcdf import _bounds, _opened

#: Bytes of geometry, and rows of a GeoPackage, that a task reads, about.
SLAB_BYTES, SLAB_ROWS = 16 << 20, 50_000
BOUNDS = ("west", "south", "east", "north")
_GEOMETRY = "path string, feature long, kind string, parts array<struct<xs: array<double>, ys: array<double>>>, west double, south double, east double, north double"
_KINDS = {1: "point", 3: "line", 5: "area", 8: "point"}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}


def listed(path: str, suffix: str) -> list[str]:
    """The files of a path with a suffix: itself, or those of a folder."""
    remote = re.match(r"\w+:", path)
    system, at = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    return [f"{remote.group()}//{i.path}" if remote else i.path for i in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda i: i.path) if i.path.lower().endswith(suffix)]


@dataclass
class Run(InputPartition):
    """Records of a file from ``low`` to before ``high``."""

    path: str
    low: int
    high: int


@dataclass
class Field:
    name: str
    kind: str  # as in _ARROW
    start: int = 0
    size: int = 0


class Rows:
    """Features gathered column by column, those outside of the limits left out."""

    def __init__(self, limits: dict[str, tuple[list, list]]) -> None:
        self.limits, self.at, self.kinds, self.parts, self.boxes = limits, [], [], [], []

    def wanted(self, box: tuple[float, ...] | None) -> bool:
        if box is None:
            return not any(low or high for low, high in self.limits.values())
        return all(all(v >= x for x in self.limits[n][0]) and all(v <= x for x in self.limits[n][1]) for n, v in zip(BOUNDS, box))

    def add(self, at: int, kind: str | None, parts: list | None, box: tuple[float, ...] | None) -> None:
        self.at.append(at), self.kinds.append(kind), self.parts.append(parts), self.boxes.append(box or (None,) * 4)

    def batch(self, path: str, fields: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
        held = [p for parts in self.parts for p in parts or ()]
        ends = np.cumsum([0, *(len(xs) for xs, _ in held)], dtype=np.int32)
        axis = lambda i: pa.ListArray.from_arrays(pa.array(ends), np.concatenate([np.zeros(0), *(p[i] for p in held)]))
        offsets = np.cumsum([0, *(len(p or ()) for p in self.parts)], dtype=np.int32)
        corners = pa.StructArray.from_arrays([axis(0), axis(1)], ["xs", "ys"])
        parts = pa.ListArray.from_arrays(pa.array(offsets), corners, mask=pa.array([p is None for p in self.parts], pa.bool_()))
        columns = [pa.array([path] * len(self.at), pa.string()), pa.array(self.at, pa.int64()), pa.array(self.kinds, pa.string()), parts, *(pa.array([b[i] for b in self.boxes], pa.float64()) for i in range(4)), *(a for _, a in fields)]
        return pa.record_batch(columns, ["path", "feature", "kind", "parts", *BOUNDS, *(n for n, _ in fields)])


def _box(parts: list) -> tuple[float, ...] | None:
    sized = [p for p in parts if len(p[0])]
    if not sized:
        return None
    return tuple(float(pick(pick(p[i]) for p in sized)) for pick, i in ((min, 0), (min, 1), (max, 0), (max, 1)))


class FeatureReader(DataSourceReader):
    def __init__(self, paths: list[str], fields: list[tuple[str, str]], options: dict) -> None:
        self.paths, self.fields, self.options, self.limits = paths, fields, options, {n: ([], []) for n in BOUNDS}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        filters = list(filters)
        self.limits = {n: _bounds(filters, n) for n in BOUNDS}
        return iter(filters)  # Spark filters once more, so open limits stay open


def _shapefile(path: str, suffix: str) -> str:
    return path[:-4] + (suffix.upper() if path.endswith(".SHP") else suffix)


def _dbf(path: str) -> tuple[int, int, list[Field], str]:
    """Bytes of the header and of a record, fields and character set of the attributes of a shapefile."""
    with _opened(_shapefile(path, ".dbf")) as file:
        head = file.read(32)
        start, width = struct.unpack("<HH", head[8:12])
        items = file.read(start - 32)
    fields, place = [], 1
    for i in range(0, len(items) - 31, 32):
        if items[i] == 0x0D:
            break
        kind, size, decimals = chr(items[i + 11]), items[i + 16], items[i + 17]
        numeric = "bigint" if kind == "N" and not decimals and size <= 18 else "double"
        fields.append(Field(items[i : i + 11].split(b"\0")[0].decode("latin-1"), {"N": numeric, "F": "double", "L": "boolean", "D": "date"}.get(kind, "string"), place, size))
        place += size
    try:
        with _opened(_shapefile(path, ".cpg")) as file:
            name = file.read().decode("ascii", "replace").strip().lower()
    except FileNotFoundError:
        name = ""
    return start, width, fields, "utf-8" if name in ("utf-8", "utf8", "65001") else "latin-1"


def _attribute(raw: bytes, kind: str, charset: str):
    text = raw.rstrip(b" \0").decode(charset, "replace")
    if kind == "string":
        return text or None
    text = text.strip()
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    try:
        return date(int(text[:4]), int(text[4:6]), int(text[6:8])) if kind == "date" else int(text) if kind == "bigint" else float(text)
    except ValueError:  # blanks and stars stand for no value
        return None


def _shape(body: memoryview) -> tuple[str | None, tuple[float, ...] | None, object]:
    """Kind, bounds, and a function that decodes the parts, of a record's content."""
    code, = struct.unpack_from("<i", body)
    if code == 0:
        return None, None, lambda: None
    if code > 30 or code % 10 not in _KINDS:
        raise ValueError(f"shapes of type {code} are not read")
    kind = _KINDS[code % 10]
    if code % 10 == 1:
        x, y = struct.unpack_from("<2d", body, 4)
        return kind, (x, y, x, y), lambda: [(np.array([x]), np.array([y]))]
    lined = code % 10 != 8
    box, sizes = struct.unpack_from("<4d", body, 4), struct.unpack_from("<2i" if lined else "<i", body, 36)
    starts = np.frombuffer(body, "<i4", sizes[0], 44) if lined else np.arange(sizes[0])
    n = sizes[-1]
    if n == 0:
        return kind, None, lambda: None

    def parts() -> list:
        corners = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * sizes[0] if lined else 40).reshape(-1, 2)
        return [(corners[a:b, 0], corners[a:b, 1]) for a, b in zip(starts, [*starts[1:], n])]

    return kind, box, parts


class ShapefileReader(FeatureReader):
    def partitions(self) -> list[Run]:
        out, slab = [], int(self.options.get("slab_bytes", SLAB_BYTES))
        for path in self.paths:
            with _opened(path) as file:
                head, size = file.read(100), file.size()
            box = struct.unpack_from("<4d", head, 36)
            with _opened(_shapefile(path, ".shx")) as file:
                n = (file.size() - 100) // 8
            apart = any(any(x > box[i % 2 + 2] for x in self.limits[b][0]) or any(x < box[i % 2] for x in self.limits[b][1]) for i, b in enumerate(BOUNDS))
            if n and not apart:
                many = max(1, n * slab // size)
                out += [Run(path, i, min(i + many, n)) for i in range(0, n, many)]
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        path, low, high = partition.path, partition.low, partition.high
        with _opened(_shapefile(path, ".shx")) as file:
            file.seek(100 + 8 * low)
            index = np.frombuffer(file.read(8 * (high - low)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        start, width, known, charset = _dbf(path)
        with _opened(_shapefile(path, ".dbf")) as file:
            file.seek(start + width * low)
            table = file.read(width * (high - low))
        rows = Rows(self.limits)
        with _opened(path) as file:
            first, end = int(index[:, 0].min()), int((index[:, 0] + 8 + index[:, 1]).max())
            together = end - first <= 2 * int((index[:, 1] + 8).sum())
            if together:
                file.seek(first)
                span = memoryview(file.read(end - first))
            for i, (offset, size) in enumerate(index.tolist()):
                if table[width * i : width * i + 1] == b"*":
                    continue
                if together:
                    body = span[offset + 8 - first : offset + 8 - first + size]
                else:
                    file.seek(offset + 8)
                    body = memoryview(file.read(size))
                kind, box, parts = _shape(body)
                if rows.wanted(box):
                    rows.add(low + i, kind, parts(), box)
        named = {f.name: f for f in known}
        values = []
        for name, kind in self.fields:
            f = named.get(name)
            cells = (table[width * (i - low) + f.start : width * (i - low) + f.start + f.size] for i in rows.at) if f else ()
            values.append((name, pa.array([_attribute(c, kind, charset) for c in cells], _ARROW[kind]) if f else pa.nulls(len(rows.at), _ARROW[kind])))
        yield rows.batch(path, values)


class _FeatureSource(DataSource):
    suffix = ""

    def _fields(self, path: str) -> list[tuple[str, str]]:
        raise NotImplementedError

    def _paths(self) -> list[str]:
        if not (found := listed(self.options["path"], self.suffix)):
            raise FileNotFoundError("no files at " + self.options["path"])
        return found

    def schema(self) -> str:
        """The attributes asked for, else those of all files; each as in the first file that has it."""
        asked = [x for x in self.options.get("columns", "").split(",") if x]
        known: dict[str, str] = {}
        for path in self._paths():
            known = dict(self._fields(path)) | known
            if asked and set(asked) <= set(known):
                break
        return ", ".join([_GEOMETRY, *(f"`{n}` {known.get(n, 'string')}" for n in asked or known)])

    def _asked(self, schema: StructType) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in schema][8:]


class Shapefile(_FeatureSource):
    """``spark.read.format("shapefile").load(path)`` of a file or a folder."""

    suffix = ".shp"

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _fields(self, path: str) -> list[tuple[str, str]]:
        return [(f.name, f.kind) for f in _dbf(path)[2]]

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self._paths(), self._asked(schema), dict(self.options))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(base: sqlite3.Connection, asked: str | None) -> tuple[str, str, str, list[tuple[str, str]]]:
    """Name, geometry column, key and attributes of a layer: the one asked for, or the first by name."""
    known = dict(base.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall())
    name = asked or next(iter(known))
    columns = base.execute(f"PRAGMA table_info({_quoted(name)})").fetchall()
    key = next((c[1] for c in columns if c[5]), "rowid")
    sort = lambda t: "boolean" if "BOOL" in t else "bigint" if "INT" in t else "double" if re.search("REAL|DOUBLE|FLOAT", t) else "date" if t == "DATE" else "string"
    return name, known[name], key, [(c[1], sort(c[2].upper())) for c in columns if c[1] not in (known[name], key)]


def _base(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def wkb_parts(data: bytes, at: int = 0) -> tuple[str | None, list, int]:
    """Kind, parts and end of a well-known binary; collections take the kind of their first member."""
    order = "<" if data[at] else ">"
    code, = struct.unpack_from(order + "I", data, at + 1)
    # more than two numbers a corner: by thousands, or by the two highest bits
    wide = 2 + max((code & 0x0FFFFFFF) // 1000 in (1, 3), code >> 31) + max((code & 0x0FFFFFFF) // 1000 in (2, 3), code >> 30 & 1)
    at += 9 if code & 0x20000000 else 5
    shape = (code & 0x0FFFFFFF) % 1000

    def corners(n: int, at: int) -> tuple[tuple, int]:
        held = np.frombuffer(data, order + "f8", n * wide, at).reshape(n, wide).astype(float)
        return (held[:, 0], held[:, 1]), at + 8 * n * wide

    if shape == 1:
        part, at = corners(1, at)
        return "point", [] if np.isnan(part[0][0]) else [part], at
    n, = struct.unpack_from(order + "I", data, at)
    at += 4
    if shape == 2:
        part, at = corners(n, at)
        return "line", [part] if n else [], at
    if shape not in (3, 4, 5, 6, 7):
        raise ValueError(f"geometries of type {shape} are not read")
    kind, parts = {3: "area", 4: "point", 5: "line", 6: "area"}.get(shape), []
    for _ in range(n):
        if shape == 3:
            size, = struct.unpack_from(order + "I", data, at)
            part, at = corners(size, at + 4)
            parts.append(part)
        else:
            inner, more, at = wkb_parts(data, at)
            kind, parts = kind or inner, parts + more
    return kind, parts, at


def _value(v, kind: str):
    if v is None:
        return None
    return date.fromisoformat(v[:10]) if kind == "date" else bool(v) if kind == "boolean" else int(v) if kind == "bigint" else float(v) if kind == "double" else str(v)


class GeoPackageReader(FeatureReader):
    def partitions(self) -> list[Run]:
        """Runs of row numbers, even in numbers; rows that crowd together in them make runs uneven, not wrong."""
        out, many = [], int(self.options.get("slab_rows", SLAB_ROWS))
        for path in self.paths:
            base = _base(path)
            name, _, key, _ = _layer(base, self.options.get("layer"))
            low, high, n = base.execute(f"SELECT min({_quoted(key)}), max({_quoted(key)}), count(*) FROM {_quoted(name)}").fetchone()
            base.close()
            if n:
                step = max(1, (high - low + 1) * many // n)
                out += [Run(path, i, min(i + step, high + 1)) for i in range(low, high + 1, step)]
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        base = _base(partition.path)
        name, geometry, key, known = _layer(base, self.options.get("layer"))
        own = [n for n, _ in self.fields if n in dict(known)]
        asked = f"SELECT {', '.join(_quoted(c) for c in (key, geometry, *own))} FROM {_quoted(name)} WHERE {_quoted(key)} >= ? AND {_quoted(key)} < ?"
        values: list = [partition.low, partition.high]
        tree = f"rtree_{name}_{geometry}"
        if any(low or high for low, high in self.limits.values()) and base.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [tree]).fetchone():
            # the tree holds bounds rounded outward
            upper = {"west": ("maxx", "minx"), "south": ("maxy", "miny"), "east": ("maxx", "minx"), "north": ("maxy", "miny")}
            tests = [(f"{upper[b][0]} >= ?", x) for b in BOUNDS for x in self.limits[b][0]] + [(f"{upper[b][1]} <= ?", x) for b in BOUNDS for x in self.limits[b][1]]
            asked += f" AND {_quoted(key)} IN (SELECT id FROM {_quoted(tree)} WHERE {' AND '.join(t for t, _ in tests)})"
            values += [x for _, x in tests]
        rows, kept = Rows(self.limits), []
        for at, blob, *cells in base.execute(f"{asked} ORDER BY 1", values):
            kind, parts = None, []
            if blob is not None:
                kind, parts, _ = wkb_parts(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])
            if rows.wanted(box := _box(parts)):
                rows.add(at, kind, parts if box else None, box)
                kept.append(cells)
        base.close()
        found = {n: [c[i] for c in kept] for i, n in enumerate(own)}
        yield rows.batch(partition.path, [(n, pa.array([_value(v, k) for v in found[n]], _ARROW[k]) if n in found else pa.nulls(len(kept), _ARROW[k])) for n, k in self.fields])


class GeoPackage(_FeatureSource):
    """``spark.read.format("geopackage").option("layer", name).load(path)`` of a file or a folder."""

    suffix = ".gpkg"

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _fields(self, path: str) -> list[tuple[str, str]]:
        base = _base(path)
        found = _layer(base, self.options.get("layer"))[3]
        base.close()
        return found

    def reader(self, schema: StructType) -> GeoPackageReader:
        return GeoPackageReader(self._paths(), self._asked(schema), dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach them."""
    for source in (Shapefile, GeoPackage):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_features(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Features of a shapefile or GeoPackage, or of a folder of one of them; with ``box`` those whose bounds meet west, south, east, north."""
    register(spark)
    form = "geopackage" if path.lower().endswith(".gpkg") or options.get("layer") else "shapefile"
    found = spark.read.format(form).options(**options, **({"columns": ",".join(columns)} if columns else {})).load(path)
    if box is None:
        return found
    return found.where((F.col("east") >= box[0]) & (F.col("north") >= box[1]) & (F.col("west") <= box[2]) & (F.col("south") <= box[3]))


def exploded(features: DataFrame) -> DataFrame:
    """A row for each part, numbered from 1, in place of ``parts``: columns ``part``, ``xs``, ``ys``. Features without geometry have none."""
    kept = [c for c in features.columns if c != "parts"]
    return features.select(*kept, F.posexplode("parts").alias("part", "p")).select(*kept, (F.col("part") + 1).alias("part"), "p.xs", "p.ys")


def rings(features: DataFrame, area: str) -> DataFrame:
    """``rings(area, ring, xs, ys)`` of the areas among ``features``, as the operators on areas take them: closing corners left out."""
    found = exploded(features.where("kind = 'area'")).select(F.col(area).alias("area"), F.col("part").alias("ring"), "xs", "ys")
    return found.select("area", "ring", F.slice("xs", F.lit(1), F.size("xs") - 1).alias("xs"), F.slice("ys", F.lit(1), F.size("ys") - 1).alias("ys"))


def length(xs: Column, ys: Column) -> Column:
    """Length of a line in the units of its corners."""
    steps = F.arrays_zip(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))).alias("x"), F.slice(ys, F.lit(2), F.greatest(F.size(ys) - 1, F.lit(0))).alias("y"), xs.alias("a"), ys.alias("b"))
    far = lambda s: F.when(s["x"].isNull(), 0.0).otherwise(F.sqrt(F.pow(s["x"] - s["a"], 2) + F.pow(s["y"] - s["b"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + far(s))


def roads_of(features: DataFrame, tags: list[str], highway: str = "highway") -> DataFrame:
    """Lines that trucks may take: no null geometry and no excluded class; with ``surface`` from the first of ``tags`` that names one."""
    kept = features.where("parts is not null")
    if highway in features.columns:
        kept = kept.where(X.routable(F.col(highway)))
    return kept.withColumn("surface", X.surface_group(*(F.col(t) for t in tags)))


def write_shapefiles(features: DataFrame, key: str, folder: str, code: int, attributes: list[str]) -> DataFrame:
    """Writes ``features(key, parts, attributes)`` as one shapefile ``<key>.shp`` for each key; rows (key, path, n) tell what was written.

    ``code``: 1 points, 3 lines, 5 areas. Attributes are strings, whole numbers or doubles. A file is made in one task, so a key is to be as much as a file is to hold.
    """

    def written(table: pa.Table) -> pa.Table:
        which = str(table.column(key)[0].as_py())
        parts = [p and [(np.array(q["xs"], float), np.array(q["ys"], float)) for q in p] for p in table.column("parts").to_pylist()]
        held = {a: table.column(a).to_pylist() for a in attributes}
        system, root = fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for suffix, data in zip((".shp", ".shx", ".dbf", ".cpg"), encoded(code, parts, held)):
            with system.open_output_stream(f"{root}/{which}{suffix}") as out:
                out.write(data)
        return pa.table([pa.array([which]), pa.array([f"{folder}/{which}.shp"]), pa.array([table.num_rows], pa.int64())], names=["key", "path", "n"])

    return features.select(key, "parts", *(a for a in attributes if a != key)).groupBy(key).applyInArrow(written, "key string, path string, n long")


def encoded(code: int, parts: list, attributes: dict[str, list]) -> tuple[bytes, bytes, bytes, bytes]:
    """The bytes of a shapefile, its index, its attributes and its character set; ``parts`` are lists of (xs, ys) or None."""
    bodies = []
    for own in parts:
        box = _box(own or [])
        if box is None:
            bodies.append(struct.pack("<i", 0))
            continue
        if code == 1:
            bodies.append(struct.pack("<i2d", 1, *box[:2]))
            continue
        ends = np.cumsum([0, *(len(p[0]) for p in own)])
        corners = np.concatenate([np.stack(p, axis=1) for p in own]).astype("<f8")
        bodies.append(struct.pack("<i4d2i", code, *box, len(own), ends[-1]) + ends[:-1].astype("<i4").tobytes() + corners.tobytes())
    starts = np.cumsum([100, *(8 + len(b) for b in bodies)])
    whole = _box([p for own in parts for p in own or ()]) or (0.0,) * 4
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i4d32x", 1000, code, *whole)
    shp = head(int(starts[-1])) + b"".join(struct.pack(">2i", i, len(b) // 2) + b for i, b in enumerate(bodies, 1))
    shx = head(100 + 8 * len(bodies)) + b"".join(struct.pack(">2i", int(s) // 2, len(b) // 2) for s, b in zip(starts, bodies))
    columns, fields = [], b""
    for name, values in attributes.items():
        known = [v for v in values if v is not None]
        kind, digits = ("N", 0) if known and all(isinstance(v, int) for v in known) else ("F", 15) if known and all(isinstance(v, float) for v in known) else ("C", 0)
        cells = [b"" if v is None else (f"{v:.15g}" if kind == "F" else str(v)).encode() for v in values]
        size = max([1, *map(len, cells)])
        if size > 254:
            raise ValueError(f"{name} is longer than a field can be")
        columns.append([c.ljust(size) if kind == "C" else c.rjust(size) for c in cells])
        fields += name.encode()[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, digits]) + bytes(14)
    width = 1 + sum(len(c[0]) for c in columns if c)
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(parts), 33 + len(fields), width) + fields + b"\x0d" + b"".join(b" " + b"".join(row) for row in zip(*columns)) + b"\x1a"
    return shp, shx, dbf, b"UTF-8"
