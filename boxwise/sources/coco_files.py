"""Annotation files in the COCO layout as a Spark data source: one large file is read by many tasks, and written by many.

A file is cut into ranges of bytes. What a range means depends on what stands before it:
whether it begins within a string, how deep, and in which section. A first job leaves one
small row a range, with what the range does to each of the three states that it may
begin in; these are put together in order, so that every range knows how it begins.
Then each task takes the objects that begin in its range, and reads on to the end of the
last one. No row holds more than one object.

The writer's tasks stream their rows, one object each, into a document under a hidden
name; documents get their names when all tasks have ended, and are removed if one fails.

Paths are those that pyarrow's file systems open: local and shared folders, and the
URIs of object stores and of Hadoop.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range, and rows of a document that is written, about.
RANGE, DOCUMENT = 8 << 20, 200_000
#: What a section's objects hold.
SECTIONS = {
    "images": "id bigint, file_name string, width int, height int",
    "annotations": "id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int, keypoints array<double>",
    "categories": "id int, name string",
}
#: Lexical states: outside of a string, inside, inside after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
QUOTE, BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, dtype=np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the file, or of a folder's files that are not hidden."""
    fs, name = opened(path)
    info = fs.get_file_info(name)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(name))
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def remove(path: str) -> None:
    """Removes a file or a folder, if there is one."""
    fs, name = opened(path)
    kind = fs.get_file_info(name).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(name)
    elif kind == pafs.FileType.File:
        fs.delete_file(name)


def read_bytes(path: str, first: int, last: int) -> bytes:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        return f.read_at(last - first, first)


@dataclass
class Structure:
    """Places of brackets outside of strings, depths after them, quotes that open or close strings, and the state at the end."""

    at: np.ndarray
    step: np.ndarray
    depth: np.ndarray
    quotes: np.ndarray
    state: int


def structure(data: bytes, state: int = OUTSIDE, depth: int = 0) -> Structure:
    raw = np.frombuffer(data, dtype=np.uint8)
    slashes = np.flatnonzero(raw == BACKSLASH)
    if state == ESCAPED and len(slashes) and slashes[0] == 0:
        slashes = slashes[1:]  # it is what the backslash before it escapes
    # A character is escaped if a run of backslashes of odd length ends before it.
    first = np.concatenate([[True], np.diff(slashes) > 1]) if len(slashes) else np.zeros(0, bool)
    starts = slashes[first]
    runs = np.diff(np.concatenate([np.flatnonzero(first), [len(slashes)]]))
    escaped = (starts + runs)[runs % 2 == 1]
    quotes = np.setdiff1d(np.flatnonzero(raw == QUOTE), escaped, assume_unique=True)
    if state == ESCAPED and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    at = np.flatnonzero(_STEP[raw])
    at = at[(np.searchsorted(quotes, at) + (state != OUTSIDE)) % 2 == 0]
    inside = (len(quotes) + (state != OUTSIDE)) % 2 == 1
    end = ESCAPED if inside and len(escaped) and escaped[-1] == len(raw) else INSIDE if inside else OUTSIDE
    if state == ESCAPED and not len(raw):
        end = ESCAPED
    step = _STEP[raw[at]]
    return Structure(at, step, depth + np.cumsum(step), quotes, end)


def keys(data: bytes, s: Structure, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last quote, and depth, of the strings that a colon follows; one that begins before data or ends after it is left out."""
    raw = np.frombuffer(data, dtype=np.uint8)
    opening = s.quotes[(0 if state == OUTSIDE else 1) :: 2]
    closing = s.quotes[(1 if state == OUTSIDE else 2) :: 2]
    opening = opening[: len(closing)]
    after = closing + 1
    blank = np.flatnonzero((after < len(raw)) & np.isin(raw[np.minimum(after, len(raw) - 1)], (9, 10, 13, 32))) if len(raw) else after[:0]
    for k in blank.tolist():  # seldom, as writers put no space there
        while after[k] < len(raw) and raw[after[k]] in b" \t\r\n":
            after[k] += 1
    own = np.flatnonzero((after < len(raw)) & (raw[np.minimum(after, len(raw) - 1)] == ord(":"))) if len(raw) else after[:0]
    opening, closing = opening[own], closing[own]
    at = np.searchsorted(s.at, opening)
    depths = np.where(at > 0, s.depth[np.maximum(at - 1, 0)], depth) if len(s.depth) else np.full(len(opening), depth)
    return opening, closing, depths


#: Bytes before a range in which a key may have begun whose colon, or end, is within it.
_LOOK_BACK = 4096


def summary(path: str, first: int, last: int, size: int) -> list[tuple[int, int, int, str]]:
    """For each state that the range may begin in: that state, the one at its end, the change of depth, and the last key that begins in it at each depth from its start's (JSON)."""
    data = read_bytes(path, first, min(size, last + _LOOK_BACK))
    out = []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        s = structure(data[: last - first], state)
        opening, closing, depths = keys(data, structure(data, state), state, 0)
        own = opening < last - first
        newest = {int(d): k for k, d in enumerate(depths[own].tolist())}
        out.append((state, s.state, int(s.step.sum()), json.dumps({d: data[opening[k] + 1 : closing[k]].decode() for d, k in newest.items()})))
    return out


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> list[dict]:
    """Every range of the files of path: path, first, last, size and how it begins: state, depth and section. One row a range comes to the driver."""
    every = [(name, k, a, min(size, a + range_bytes), size) for name, size in files(path) for k, a in enumerate(range(0, size, range_bytes))]
    schema = "path string, number int, first long, last long, size long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["path"], r["number"], *x) for r in batch.to_pylist() for x in summary(r["path"], r["first"], r["last"], r["size"])]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "number", "state", "end", "step", "sections"])

    # A task looks at several small ranges, about RANGE bytes in all.
    each = max(1, RANGE // max(1, range_bytes))
    tasks = max(1, min(len(every), max(-(-len(every) // each), spark.sparkContext.defaultParallelism)))
    rows = spark.createDataFrame(every, schema).repartition(tasks)
    found = {(r["path"], r["number"], r["state"]): r for r in rows.mapInArrow(scan, "path string, number int, state int, end int, step long, sections string").collect()}
    out, state, depth, section = [], OUTSIDE, 0, ""
    for name, k, a, b, size in every:
        if k == 0:
            state, depth, section = OUTSIDE, 0, ""
        x = found[name, k, state]
        last = json.loads(x["sections"]).get(str(1 - depth), section)
        out.append({"path": name, "first": a, "last": b, "size": size, "state": state, "depth": depth, "section": section, "ends": last})
        state, depth, section = x["end"], depth + x["step"], last
    return out


def objects(r: dict, section: str) -> Iterator[dict]:
    """The objects of a section that begin in a range."""
    size, end = r["size"], r["last"]
    more = _LOOK_BACK
    while True:
        data = read_bytes(r["path"], r["first"], min(size, end + more))
        s = structure(data, r["state"], r["depth"])
        before = s.depth - s.step
        starts = s.at[(s.step == 1) & (before == 2) & (s.at < r["last"] - r["first"])]
        ends = s.at[(s.step == -1) & (s.depth == 2)]
        # Arrays within the section's own array end at depth 2 as well as objects do, but none begins there.
        if not len(starts) or len(ends) and ends[-1] > starts[-1] or end + more >= size:
            break
        more *= 16  # the last object is longer than what has been read
    opening, closing, depths = keys(data, s, r["state"], r["depth"])
    top = np.flatnonzero(depths == 1).tolist()
    sections = [(-1, r["section"]), *((int(opening[k]), data[opening[k] + 1 : closing[k]].decode()) for k in top)]
    places = [at for at, _ in sections]
    for a in starts.tolist():
        if sections[int(np.searchsorted(places, a)) - 1][1] == section and data[a : a + 1] == b"{":
            yield json.loads(data[a : int(ends[np.searchsorted(ends, a)]) + 1])


class _Range(InputPartition):
    def __init__(self, r: dict) -> None:
        self.range = r


class _Reader(DataSourceReader):
    def __init__(self, section: str, every: list[dict], schema: StructType) -> None:
        self.section, self.every, self.schema = section, every, schema

    def __getstate__(self) -> dict:
        """What a task gets: its own range comes as the partition, not with all others."""
        return {"section": self.section, "every": [], "schema": self.schema}

    def partitions(self) -> Sequence[InputPartition]:
        """The ranges that may hold objects of the section."""
        return [_Range(r) for r in self.every if self.section == r["section"] or r["ends"] != r["section"]] or [_Range({})]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for o in objects(partition.range, self.section) if partition.range else ():
            rows.append({n: _fitting(o.get(n), schema.field(n).type) for n in schema.names})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def _fitting(value: object, kind: pa.DataType) -> object:
    """A value as its column holds it; null if it does not fit."""
    if value is None or isinstance(value, dict) or pa.types.is_list(kind) != isinstance(value, list):
        return None
    if isinstance(value, list):
        return [_fitting(v, kind.value_type) for v in value]
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(value)
    if not isinstance(value, int | float):
        return None
    return float(value) if pa.types.is_floating(kind) else int(value) if value == int(value) else None


@dataclass
class _Written(WriterCommitMessage):
    hidden: str | None
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, name = opened(self.path)
        task = TaskContext.get()
        hidden = f"{name}/.{self.job}-{task.partitionId():05d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        section, body, n = None, None, 0
        try:
            with fs.open_output_stream(hidden) as out:
                for row in iterator:
                    if (section, body) == (row["section"], row["body"]):
                        continue  # a category that several documents would hold, which have become one
                    head = "," if section == row["section"] else ("{" if section is None else "],") + f'"{row["section"]}":['
                    out.write((head + row["body"]).encode())
                    section, body, n = row["section"], row["body"], n + 1
                out.write(b"{}" if section is None else b"]}")
        except BaseException:
            if fs.get_file_info(hidden).type == pafs.FileType.File:
                fs.delete_file(hidden)
            raise
        if not n:
            fs.delete_file(hidden)
        return _Written(hidden if n else None, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, name = opened(self.path)
        for k, m in enumerate(sorted(m.hidden for m in messages if m and m.hidden)):
            fs.move(m, f"{name}/part-{k:05d}.json")
        self._clear()  # what attempts have left that did not count
        with fs.open_output_stream(f"{name}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, name = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)


class CocoFiles(DataSource):
    """Format `coco_files`. Reading: options section and ranges (JSON, from ranges()). Writing: rows (section, body) to a new folder."""

    @classmethod
    def name(cls) -> str:
        return "coco_files"

    def schema(self) -> str:
        return SECTIONS[self.options["section"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["section"], json.loads(self.options["ranges"]), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_sections(spark: SparkSession, path: str, range_bytes: int = RANGE) -> dict[str, DataFrame]:
    """The objects of each section of a file, or of a folder's files, a row each; a section that is missing has none."""
    spark.dataSource.register(CocoFiles)
    every = json.dumps(ranges(spark, path, range_bytes))
    return {s: spark.read.format("coco_files").option("section", s).option("ranges", every).load() for s in SECTIONS}


def write_sections(sections: dict[str, DataFrame], keys_: dict[str, str], path: str, documents: int) -> None:
    """Writes `documents` files, or fewer, to a new folder: objects with the same key (a column of their section) in one file, categories in all of them.

    Each task streams its rows in the order of sections and ids; nothing is gathered.
    """
    spark = next(iter(sections.values())).sparkSession
    spark.dataSource.register(CocoFiles)
    fs, name = opened(path)
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(name)
    rows = None
    for k, (section, df) in enumerate(sections.items()):
        shard = F.explode(F.sequence(F.lit(0), F.lit(documents - 1))) if section == "categories" else F.pmod(F.xxhash64(keys_[section]), F.lit(documents)).cast("int")
        own = df.select(shard.alias("shard"), F.lit(k).alias("place"), F.lit(section).alias("section"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*df.columns)).alias("body"))
        rows = own if rows is None else rows.unionByName(own)
    rows.repartitionById(documents, "shard").sortWithinPartitions("place", "id", "body").select("section", "body").write.format("coco_files").option("path", path).mode("append").save()
