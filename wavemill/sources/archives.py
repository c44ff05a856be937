"""`.ts` archives as a Spark data source (survey S15, S16): files are read by byte ranges, under the tags at their heads.

Tags are read once for each file, on the driver, with its first case, which says how many dimensions each
case has (and how long its series are, where they must be equal). Tasks get ranges and heads. What breaks a
rule ends the read with the file and line. Letters are made small, as values and labels are compared that way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMA = "file string, dimensions array<array<double>>, timestamps array<array<string>>, target double, label string"
ROWS = 512
_TUPLE = re.compile(r"\(([^()]*),([^(),]*)\)")
_STAMPS = {"whole number": re.compile(r"[+-]?\d+"), "number": re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"), "time": re.compile(r".*\D.*")}


@dataclass
class Head:
    """What the tags of a file say. `start`: where the cases begin; `stamp`: the kind of its timestamps."""

    start: int = 0
    name: str = ""
    timestamps: bool | None = None
    univariate: bool | None = None
    equal_length: bool = False
    length: int | None = None
    target: bool | None = None
    classes: tuple[str, ...] | None = None
    classed: bool | None = None
    dimensions: int | None = None
    stamp: str | None = None

    def tag(self, line: str) -> None:
        name, *values = line.split()
        switch = lambda: self._switch(name, values)
        match name:
            case "@problemname":
                if not values:
                    raise ValueError("@problemname needs a value")
                self.name = " ".join(values)
            case "@timestamps":
                self.timestamps = switch()
            case "@univariate":
                self.univariate = switch()
            case "@equallength":
                self.equal_length = switch()
            case "@serieslength":
                self.length = int(values[0])
            case "@dimensions":
                self.dimensions = int(values[0])
            case "@targetlabel":
                self.target = switch()
            case "@classlabel":
                self.classed = self._switch(name, values[:1])
                self.classes = tuple(values[1:])
                if self.classed and not self.classes:
                    raise ValueError("@classlabel true needs its labels")

    @staticmethod
    def _switch(name: str, values: list[str]) -> bool:
        if len(values) != 1 or values[0] not in ("true", "false"):
            raise ValueError(f"{name} needs true or false")
        return values[0] == "true"

    def complete(self) -> None:
        absent = [n for n, v in (("@problemname", self.name), ("@timestamps", self.timestamps), ("@univariate", self.univariate)) if v in (None, "")]
        if self.target is None and self.classed is None:
            absent.append("@targetlabel or @classlabel")
        if absent:
            raise ValueError("before @data there is no " + ", ".join(absent))

    def case(self, line: str, missing: str) -> tuple[list[list[float]], list[list[str]] | None, float | None, str | None]:
        """Series, timestamps, target and label of a case."""
        ends = bool(self.target or self.classed)
        parts = _split(line) if self.timestamps else line.split(":")
        if ends and len(parts) < 2:
            raise ValueError("no target or label after the last ':'")
        last = parts.pop().strip() if ends else None
        if self.timestamps:
            pairs = [self._pairs(p) for p in parts]
            series, stamps = [[_number(v, missing) for _, v in dim] for dim in pairs], [[t for t, _ in dim] for dim in pairs]
        else:
            series, stamps = [[_number(v, missing) for v in p.split(",")] if p.strip() else [] for p in parts], None
        if self.univariate and len(series) != 1:
            raise ValueError(f"{len(series)} dimensions in a univariate file")
        if self.dimensions is not None and len(series) != self.dimensions:
            raise ValueError(f"{len(series)} dimensions where {self.dimensions} were expected")
        if self.equal_length and self.length is not None and any(len(s) != self.length for s in series):
            raise ValueError(f"series of {sorted({len(s) for s in series})} points where all have {self.length}")
        if self.target:
            return series, stamps, _number(last, missing), None
        if self.classed and last not in self.classes:
            raise ValueError(f"label {last!r} is none of {', '.join(self.classes)}")
        return series, stamps, None, last

    def _pairs(self, part: str) -> list[tuple[str, str]]:
        if not part.strip():
            return []
        if not re.fullmatch(rf"\s*{_TUPLE.pattern}\s*(?:,\s*{_TUPLE.pattern}\s*)*", part):
            raise ValueError("timestamps stand in pairs (time,value) with ',' between them")
        out = [(t.strip(), v) for t, v in _TUPLE.findall(part)]
        for t, _ in out:
            if self.stamp and not _STAMPS[self.stamp].fullmatch(t):
                raise ValueError(f"timestamp {t!r} is no {self.stamp}, as the first one is")
        return out


def _split(line: str) -> list[str]:
    """At each ':' that stands outside of parentheses, as times may hold some."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(line):
        depth += (c == "(") - (c == ")")
        if c == ":" and not depth:
            out.append(line[at:k])
            at = k + 1
    return [*out, line[at:]]


def _number(text: str, missing: str) -> float:
    text = text.strip()
    return float(missing if text == "?" else text)


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").strip().lower()


def read_head(store, path: str, size: int, missing: str, equal: bool) -> Head:
    """The tags, and what the first case settles."""
    head, number, begun = Head(), 0, False
    for at, raw in files.lines(store, files.Range(path, 0, size)):
        number, line = number + 1, _text(raw)
        try:
            if not begun and line.startswith("@data"):
                if line != "@data":
                    raise ValueError("@data has no value")
                head.complete()
                begun, head.start = True, at + len(raw) + 1
                head.equal_length |= equal
            elif not begun and line.startswith("@"):
                head.tag(line)
            elif line and not line.startswith("#"):
                if not begun:
                    raise ValueError("a case before @data")
                if head.timestamps and (first := _TUPLE.search(line)):
                    head.stamp = next(k for k, p in _STAMPS.items() if p.fullmatch(first[1].strip()))
                series = head.case(line, missing)[0]
                head.dimensions = len(series)
                if head.equal_length and head.length is None:
                    head.length = len(series[0])
                    head.case(line, missing)
                return head
        except ValueError as e:
            raise ValueError(f"{path}, line {number}: {e}") from None
    if not begun:
        raise ValueError(f"{path}: no @data")
    return head


@dataclass
class Part(InputPartition):
    part: files.Range
    head: Head


class TsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.missing = options["path"], options.get("missing", "nan")
        self.suffix = options.get("suffix", ".ts")
        self.step, self.equal = int(options.get("rangebytes", 64 << 20)), options.get("equallength", "false") == "true"

    def partitions(self) -> list[Part]:
        store, _ = files.opened(self.path)
        out = []
        for f in files.listed(self.path, self.suffix):
            head = read_head(store, f.path, f.size, self.missing, self.equal)
            out += [Part(r, head) for r in files.ranges(f.path, head.start, f.size, self.step)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = files.opened(self.path)
        kinds = pa.schema([("file", pa.string()), ("dimensions", pa.list_(pa.list_(pa.float64()))), ("timestamps", pa.list_(pa.list_(pa.string()))), ("target", pa.float64()), ("label", pa.string())])
        rows = []
        for at, raw in files.lines(store, partition.part):
            line = _text(raw)
            if not line or line.startswith("#"):
                continue
            try:
                if line.startswith("@"):
                    raise ValueError("a tag after @data")
                rows.append((partition.part.path, *partition.head.case(line, self.missing)))
            except ValueError as e:
                raise ValueError(f"{partition.part.path}, line {files.line_number(store, partition.part.path, at)}: {e}") from None
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class TsSource(DataSource):
    """spark.read.format("ts_archive").load(file or folder). Options: `missing` (what `?` is; default NaN),
    `rangeBytes` (of a task), `suffix` (of the files of a folder; default .ts), `equalLength` (true: lengths must be equal, whatever the tags say)."""

    @classmethod
    def name(cls) -> str:
        return "ts_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TsReader:
        return TsReader({k.lower(): v for k, v in self.options.items()})


def ts_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """File, dimensions, timestamps (null without), target (null without), label (null without)."""
    spark.dataSource.register(TsSource)
    return spark.read.format("ts_archive").options(**options).load(path)


def ts_dense(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same, where series of other lengths than the first are an error."""
    return ts_archive(spark, path, equalLength="true", **options)
