"""A Spark data source and sink for uncompressed LAS point files, versions 1.2 to 1.4, with extra bytes.

Reading. Records have one fixed length, so a file is split by record ranges and every task reads its own bytes, through
`pyarrow.fs`: a path may be local or any address that Arrow's file systems open (`s3://`, `gs://`, `hdfs://`). Only the asked
columns are decoded; name them with `.schema(...)` or `columns(...)`, which also takes comparisons of columns with numbers:
whole files go by the box in their header, records by a mask. (Spark's own filter pushdown for Python sources isn't used: in
4.1 a frame that was scanned with a filter keeps it when it is scanned again without one.)

Writing. Each task writes one file beside the final place; `commit` publishes all of them at once, `overwrite` then removes the
files that were there before, and `abort` leaves nothing. Rows without finite coordinates are left out. `write_las` finds with
one aggregate what all files must agree on: whether colours have 8 bits, and whether classes need a version 1.4 format.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "point_id long, x double, y double, z double, intensity int, classification int, return_number int, gps_time double, r int, g int, b int"
#: Columns that are read when they are asked for.
MORE = "number_of_returns int, scan_angle double, user_data int, point_source_id int, flags int"
RECORDS = 500_000
#: Fixed values of the format: record lengths by point format, extra-byte types by number, the size of a description.
LENGTHS = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
EXTRA_BYTES, GEO_KEYS, WKT = ("LASF_Spec", 4), ("LASF_Projection", 34735), ("LASF_Projection", 2112)
CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
DEGREE = 0.006  # a unit of the scan angle in formats from 6 on


def record_type(point_format: int, length: int, extra: Sequence[tuple[str, str]] = ()) -> np.dtype:
    """Fields of a record by point format; extra fields have names that begin with +; bytes after all of them are skipped."""
    if point_format < 6:
        fields = [*CORE, ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
        time, colour = point_format in (1, 3), point_format in (2, 3)
    else:
        fields = [*CORE, ("flags", "u1"), ("flags2", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2")]
        time, colour = True, point_format in (7, 8)
    fields += [("time", "<f8")] * time + [(c, "<u2") for c in ("r", "g", "b")] * colour
    known = LENGTHS.get(point_format, np.dtype(fields).itemsize)
    if np.dtype(fields).itemsize < known:
        fields.append(("gap", f"V{known - np.dtype(fields).itemsize}"))
    fields += [(f"+{name}", kind) for name, kind in extra]
    used = np.dtype(fields).itemsize
    if used > length:
        raise ValueError(f"point format {point_format} needs records of {used} bytes, not {length}")
    return np.dtype([*fields, ("rest", f"V{length - used}")] if length > used else fields)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or a local path, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def las_files(path: str) -> list[str]:
    """The .las files of a folder, or the file itself, in order of name; unpublished files aren't among them."""
    files, at = opened(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = files.get_file_info(fs.FileSelector(at))
        return sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name.endswith(".las") and not i.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [at]


def read_header(path: str, files: fs.FileSystem | None = None) -> dict:
    files, path = (files, path) if files else opened(path)
    with files.open_input_file(path) as file:
        head = file.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        minor = head[25]
        (size,) = struct.unpack_from("<H", head, 94)
        offset, records, fmt, length, n = struct.unpack_from("<IIBHI", head, 96)
        if fmt & 0x80:
            raise ValueError(f"{path} is compressed; convert it to LAS first")
        scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        box = struct.unpack_from("<6d", head, 179)
        if minor >= 4 and (large := struct.unpack_from("<Q", head, 247)[0]):
            n = large
        file.seek(size)
        described = file.read(max(offset - size, 0)) if records else b""
    extra, epsg, wkt, at = [], None, None, 0
    for _ in range(records):
        if at + 54 > len(described):
            break
        key = (described[at + 2 : at + 18].split(b"\0")[0].decode("latin-1"), struct.unpack_from("<H", described, at + 18)[0])
        (more,) = struct.unpack_from("<H", described, at + 20)
        body = described[at + 54 : at + 54 + more]
        at += 54 + more
        if key == EXTRA_BYTES:
            for k in range(0, len(body) - 191, 192):
                kind, options = body[k + 2], body[k + 3]
                name = body[k + 4 : k + 36].split(b"\0")[0].decode("utf-8", "replace")
                scaling = struct.unpack_from("<d", body, k + 112)[0] if options & 8 else 1.0, struct.unpack_from("<d", body, k + 136)[0] if options & 16 else 0.0
                extra.append((name, EXTRA_TYPES.get(kind, f"V{options}" if kind == 0 else "V1"), *scaling))
        elif key == GEO_KEYS:
            keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)[1:]
            epsg = next((int(k[3]) for number in (3072, 2048) for k in keys if k[0] == number and k[1] == 0), None)
        elif key == WKT:
            wkt = body.split(b"\0")[0].decode("utf-8", "replace")
    low, high = (box[1], box[3], box[5]), (box[0], box[2], box[4])
    return {"offset": offset, "format": fmt & 0x3F, "length": length, "n": n, "scale": scale, "shift": shift, "minor": minor, "extra": extra, "epsg": epsg, "wkt": wkt, "low": low, "high": high}


class Records(InputPartition):
    def __init__(self, path: str, first: int, n: int, before: int):
        super().__init__((path, first))
        self.path, self.first, self.n, self.before = path, first, n, before


COMPARE = {"=": "equal", ">": "greater", ">=": "greater_equal", "<": "less", "<=": "less_equal"}


class LasReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, where: Sequence[tuple[str, str, float]] = ()):
        self.path, self.names, self.types = path, schema.names, [f.dataType.simpleString() for f in schema.fields]
        self.filters = [(name, COMPARE[how], value) for name, how, value in where]

    def partitions(self) -> list[Records]:
        out, before = [], 0
        files, _ = opened(self.path)
        for p in las_files(self.path):
            h = read_header(p, files)
            slack = {c: abs(h["scale"][k]) for k, c in enumerate("xyz")}  # the box is of what was measured, records are rounded
            apart = False
            for name, how, value in self.filters:
                if name in "xyz":
                    low, high = h["low"]["xyz".index(name)] - slack[name], h["high"]["xyz".index(name)] + slack[name]
                    apart |= how in ("greater", "greater_equal") and value > high or how in ("less", "less_equal") and value < low or how == "equal" and not low <= value <= high
            if not apart:
                out += [Records(p, i, min(RECORDS, h["n"] - i), before + i) for i in range(0, h["n"], RECORDS)]
            before += h["n"]
        return out

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # every file lies apart
            return
        files, _ = opened(self.path)
        h = read_header(part.path, files)
        kind = record_type(h["format"], h["length"], [(name, t) for name, t, _, _ in h["extra"]])
        with files.open_input_file(part.path) as file:
            file.seek(h["offset"] + part.first * h["length"])
            rows = np.frombuffer(file.read(part.n * h["length"]), kind)
        legacy, scaled, has = h["format"] < 6, {name: (s, o) for name, _, s, o in h["extra"]}, set(kind.names)
        at = {"x": 0, "y": 1, "z": 2}

        def column(name: str) -> np.ndarray | None:
            if name == "point_id":
                return part.before + np.arange(len(rows))
            if name in at:
                return rows[name.upper()] * h["scale"][at[name]] + h["shift"][at[name]]
            if name == "classification":
                return rows["cls"] & (31 if legacy else 255)
            if name == "return_number":
                return rows["flags"] & (7 if legacy else 15)
            if name == "number_of_returns":
                return rows["flags"] >> 3 & 7 if legacy else rows["flags"] >> 4
            if name == "flags":  # synthetic 1, key point 2, withheld 4, overlap 8
                return rows["cls"] >> 5 if legacy else rows["flags2"] & 15
            if name == "scan_angle":
                return rows["angle"] * (1.0 if legacy else DEGREE)
            own = {"gps_time": "time", "user_data": "user", "point_source_id": "source"}.get(name, name)
            if own in has and own not in ("flags", "rest", "gap"):
                return rows[own]
            if f"+{name}" in has and kind[f"+{name}"].kind != "V":
                scale, shift = scaled[name]
                return rows[f"+{name}"] * scale + shift if (scale, shift) != (1.0, 0.0) else rows[f"+{name}"]
            return None

        held = {name: column(name) for name in {*self.names, *(f[0] for f in self.filters)}}
        keep = np.ones(len(rows), bool)
        for name, how, value in self.filters:
            keep &= getattr(np, how)(held[name], value) if held[name] is not None else False
        whole = keep.all()
        arrow = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}
        columns = []
        for name, t in zip(self.names, self.types, strict=True):
            v = held[name]
            columns.append(pa.nulls(int(keep.sum()), arrow[t]) if v is None else pa.array(v if whole else v[keep]).cast(arrow[t], safe=False))
        yield pa.RecordBatch.from_arrays(columns, names=self.names)


def described(key: tuple[str, int], body: bytes) -> bytes:
    """A variable length record."""
    return struct.pack("<H16sHH32s", 0, key[0].encode(), key[1], len(body), b"") + body


def header_bytes(point_format: int, length: int, n: int, scale: float, shift: np.ndarray, low: np.ndarray, high: np.ndarray, records: Sequence[bytes] = (), wkt: bool = False) -> bytes:
    """A version 1.2 header, or a 1.4 one for point formats from 6 on, and its variable length records."""
    new = point_format >= 6
    size = 375 if new else 227
    head = bytearray(size)
    head[:4] = b"LASF"
    struct.pack_into("<H", head, 6, 16 if wkt else 0)
    head[24:26] = bytes([1, 4 if new else 2])
    head[26:58] = b"bathyal".ljust(32, b"\0")
    struct.pack_into("<H", head, 94, size)
    struct.pack_into("<IIBHI", head, 96, size + sum(map(len, records)), len(records), point_format, length, 0 if new else n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *shift)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    if new:
        struct.pack_into("<Q", head, 247, n)
    return bytes(head) + b"".join(records)


def extra_names(columns: Sequence[str]) -> dict[str, str]:
    """Names of extra bytes for columns: 32 bytes of letters, digits and underscores, none twice nor like a field of the format."""
    taken = {f.split()[0] for f in f"{SCHEMA}, {MORE}".split(", ")}
    out = {}
    for c in columns:
        base = name = "".join(k if k.isascii() and k.isalnum() else "_" for k in c)[:32] or "extra"
        k = 1
        while name.lower() in taken:
            name, k = f"{base[:29]}_{k}", k + 1
        taken.add(name.lower())
        out[c] = name
    return out


class Written(WriterCommitMessage):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class LasWriter(DataSourceArrowWriter):
    """One file per task that has rows. Options: version (1.2 or 1.4), scale, colour_factor, extra (columns with commas between),
    epsg or wkt. Without a version it is 1.4, which holds every class."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.scale, self.factor = float(options.get("scale", 0.001)), float(options.get("colour_factor", 1))
        self.new = str(options.get("version", "1.4")) != "1.2"
        self.extra = [c for c in options.get("extra", "").split(",") if c in names]
        self.epsg, self.wkt = options.get("epsg"), options.get("wkt")
        self.job = uuid.uuid4().hex
        missing = [c for c in "xyz" if c not in names]
        if missing:
            raise ValueError(f"LAS points need columns x, y and z; there is no {missing[0]}")

    @property
    def aside(self) -> str:
        return f"{opened(self.path)[1].rstrip('/')}/_writing-{self.job}"

    def _records(self) -> list[bytes]:
        out = []
        if self.epsg:
            kind = (2, 2048) if 4000 <= int(self.epsg) < 5000 else (1, 3072)
            out.append(described(GEO_KEYS, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, kind[0], kind[1], 0, 1, int(self.epsg))))
        if self.wkt:
            out.append(described(WKT, self.wkt.encode() + b"\0"))
        if self.extra:
            body = b"".join(struct.pack("<HBB32s", 0, 10, 0, n.encode()).ljust(160, b"\0") + c.encode()[:32].ljust(32, b"\0") for c, n in extra_names(self.extra).items())
            out.append(described(EXTRA_BYTES, body))
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        colour, time = all(c in self.names for c in "rgb"), "gps_time" in self.names
        fmt = 6 + colour if self.new else 2 * colour + time
        length = LENGTHS[fmt] + 8 * len(self.extra)
        kind = record_type(fmt, length, [(n, "<f8") for n in extra_names(self.extra).values()])
        shift, parts, low, high = None, [], np.full(3, np.inf), np.full(3, -np.inf)
        for batch in batches:
            table = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}

            def numbers(name: str, least: float, most: float, table=table) -> np.ndarray:
                if name not in table:
                    return np.zeros(len(keep))
                v = pc.cast(table[name], pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                return np.clip(np.nan_to_num(v), least, most)

            xyz = np.column_stack([pc.cast(table[c], pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in "xyz"])
            keep = np.isfinite(xyz).all(axis=1)
            xyz = xyz[keep]
            if not len(xyz):
                continue
            shift = np.floor(xyz.min(axis=0)) if shift is None else shift
            low, high = np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0))
            steps = np.rint((xyz - shift) / self.scale)
            if np.abs(steps).max() >= 2**31:
                raise ValueError(f"coordinates of one file span more than {2**31} steps of {self.scale}; choose a larger scale")
            out = np.zeros(len(xyz), kind)
            for k, c in enumerate("XYZ"):
                out[c] = steps[:, k].astype(np.int32)
            get = lambda name, least, most, keep=keep: numbers(name, least, most)[keep]  # noqa: B023, E731
            out["intensity"], out["user"], out["source"] = get("intensity", 0, 65535), get("user_data", 0, 255), get("point_source_id", 0, 65535)
            returns = get("return_number", 0, 15 if self.new else 7).astype(int) if "return_number" in table else np.ones(len(xyz), int)
            of = get("number_of_returns", 0, 15 if self.new else 7).astype(int) if "number_of_returns" in table else np.maximum(returns, 1)
            marks, cls = get("flags", 0, 15).astype(int), get("classification", 0, 255 if self.new else 31).astype(int)
            if self.new:
                out["flags"], out["flags2"], out["cls"], out["angle"] = returns | of << 4, marks, cls, np.rint(get("scan_angle", -180, 180) / DEGREE)
            else:
                out["flags"], out["cls"], out["angle"] = returns | of << 3, cls | (marks & 7) << 5, np.rint(get("scan_angle", -90, 90))
            if "time" in kind.names:
                out["time"] = get("gps_time", -np.inf, np.inf)
            if colour:
                for c in "rgb":
                    out[c] = np.clip(get(c, 0, 65535) * self.factor, 0, 65535)
            for c, n in extra_names(self.extra).items():
                out[f"+{n}"] = pc.cast(table[c], pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)[keep]
            parts.append(out)
        if shift is None:
            return Written("", 0)
        files, _ = opened(self.path)
        files.create_dir(self.aside, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.{context.taskAttemptId()}"
        n = sum(map(len, parts))
        with files.open_output_stream(f"{self.aside}/{name}") as file:
            file.write(header_bytes(fmt, length, n, self.scale, shift, low, high, self._records(), bool(self.wkt)))
            for out in parts:
                file.write(out.tobytes())
        return Written(name, n)

    def commit(self, messages: list) -> None:
        files, target = opened(self.path)
        files.create_dir(target, recursive=True)
        before = [] if not self.overwrite else las_files(self.path)
        for m in messages:
            if m is not None and m.n:
                files.move(f"{self.aside}/{m.path}", f"{target.rstrip('/')}/{m.path.rsplit('.', 1)[0]}.las")
        for p in before:
            files.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        if files.get_file_info(self.aside).type == fs.FileType.Directory:
            files.delete_dir(self.aside)


class LasSource(DataSource):
    """spark.read.format("las").load(path); write_las(df, path), or df.write.format("las").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        """The usual columns, and those of the extra bytes that any file has."""
        files, _ = opened(self.options["path"])
        extra = dict.fromkeys(name for p in las_files(self.options["path"]) for name, kind, _, _ in read_header(p, files)["extra"] if kind[0] != "V")
        return ", ".join([SCHEMA, *(f"`{name}` double" for name in extra)])

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(self.options["path"], schema, [tuple(w) for w in json.loads(self.options.get("where", "[]"))])

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)


def columns(spark: SparkSession, path: str, names: Sequence[str], where: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """Only the named columns of the files, others aren't decoded, and only records for which all comparisons (column, one of
    COMPARE, number) hold."""
    register(spark)
    types = dict(f.split() for f in f"{SCHEMA}, {MORE}".split(", "))
    shape = ", ".join(f"`{n}` {types.get(n, 'double')}" for n in names)
    return spark.read.format("las").option("where", json.dumps([list(w) for w in where])).schema(shape).load(path)


def write_las(points: DataFrame, path: str, mode: str = "append", version: str | None = None, extra: Sequence[str] | None = None, **options) -> None:
    """Points as LAS files. Colours that are all at most 255 are of 8 bits and widened; classes above 31 need version 1.4.

    extra: columns that are kept as extra bytes; without it all numbers that are no field of the format. options: scale, epsg, wkt.
    """
    register(points.sparkSession)
    known = {f.split()[0] for f in f"{SCHEMA}, {MORE}".split(", ")}
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    extra = [c for c, t in points.dtypes if c not in known and (t in numeric or t.startswith("decimal"))] if extra is None else list(extra)
    colour = all(c in points.columns for c in "rgb")
    facts = points.agg(
        (F.max("classification") if "classification" in points.columns else F.lit(0)).alias("cls"),
        (F.max(F.greatest("r", "g", "b")) if colour else F.lit(None)).alias("colour"),
    ).first()
    version = version or ("1.4" if (facts.cls or 0) > 31 else "1.2")
    if version == "1.2" and (facts.cls or 0) > 31:
        version = "1.4"
    kept = points.select(*[c for c in points.columns if c in known or c in extra])
    settings = {"version": version, "extra": ",".join(extra), "colour_factor": 257 if facts.colour is not None and facts.colour <= 255 else 1} | options
    kept.write.format("las").options(**settings).mode(mode).save(path)


def copy_las(spark: SparkSession, source: str, path: str, classes: DataFrame | None = None, where: str | None = None, mode: str = "overwrite") -> None:
    """The records of LAS files that a condition keeps, with all their fields and extra bytes, in new files.

    classes: point_id and classification of points that were classified anew. Records of an old format whose classes no longer
    fit become those of version 1.4; their scan angles, whole degrees, are counted in its units.
    """
    register(spark)
    headers = [read_header(p, opened(source)[0]) for p in las_files(source)]
    usual = spark.read.format("las").load(source).columns
    extra = usual[len(SCHEMA.split(", ")) :]
    points = columns(spark, source, [*usual, *(f.split()[0] for f in MORE.split(", "))])
    formats = {h["format"] for h in headers}
    if not formats & {2, 3, 7, 8}:
        points = points.drop("r", "g", "b")
    if not formats & {1, 3, 6, 7, 8}:
        points = points.drop("gps_time")
    if where:
        points = points.where(where)
    if classes is not None:
        new = classes.select("point_id", F.col("classification").alias("new_class"))
        points = points.join(new, "point_id", "left").withColumn("classification", F.coalesce("new_class", "classification")).drop("new_class")
    more = {k: headers[0][k] for k in ("epsg", "wkt") if headers and headers[0][k]}
    scale = min((min(h["scale"]) for h in headers), default=0.001)
    write_las(points, path, mode, version="1.4" if any(f >= 6 for f in formats) else None, extra=extra, scale=scale, colour_factor=1, **more)
