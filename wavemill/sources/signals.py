"""Signal records as a Spark data source (survey S12): a `.hea` text names leads, formats and files of numbers.

A row is a lead's run of samples: record, number (of the lead, from 0), lead, unit, rate, first (its first sample's number), signal (physical
values; missing ones are null). Tasks are planned from the headers: runs of `samples` samples of a record.
Conditions on `lead` (=, IN) and on `first` (<, <=, >, >=, =) are pushed down: pruned runs get no task, files
without a wanted lead aren't opened, and of the others only the wanted leads' numbers are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import files

SCHEMA = "record string, number int, lead string, unit string, rate double, first long, signal array<double>"
#: Bits of a sample by format, and the number that stands for a missing sample.
BITS = {"16": 16, "24": 24, "32": 32, "80": 8, "212": 12}
MISSING = {"16": -(1 << 15), "24": -(1 << 23), "32": -(1 << 31), "80": -(1 << 7), "212": -(1 << 11)}
_FORMAT = re.compile(r"(\d+)(?:\+(\d+))?")
_GAIN = re.compile(r"([0-9.eE+-]+)(?:\((-?\d+)\))?(?:/(\S+))?")


@dataclass(frozen=True)
class Lead:
    number: int
    name: str
    file: str
    format: str
    offset: int
    gain: float
    zero: float
    unit: str
    place: int  # among the leads of its file
    beside: int  # how many leads its file has


@dataclass
class Record:
    path: str
    rate: float
    samples: int | None
    leads: list[Lead] = field(default_factory=list)


def read_header(path: str, text: str) -> Record:
    """A header's first line: name, leads, rate, samples. One for each lead: file, format, gain(baseline)/unit, bits, zero, ..., name."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    top, rest = rows[0], rows[1:]
    if "/" in top[0]:
        raise ValueError(f"{path}: records of several segments aren't read")
    count = int(top[1])
    record = Record(path.removesuffix(".hea"), float(top[2].split("/")[0]) if len(top) > 2 else 250.0, int(top[3]) if len(top) > 3 and int(top[3]) else None)
    if len(rest) < count:
        raise ValueError(f"{path}: {count} leads are announced, {len(rest)} described")
    names = [r[0] for r in rest[:count]]
    for k, r in enumerate(rest[:count]):
        made = _FORMAT.fullmatch(r[1])
        if not made or made[1] not in MISSING:
            raise ValueError(f"{path}: format {r[1]} of lead {k + 1}; read are {', '.join(MISSING)}")
        gain = _GAIN.match(r[2]) if len(r) > 2 else None
        zero = float(gain[2]) if gain and gain[2] else float(r[4]) if len(r) > 4 else 0.0
        name = " ".join(r[8:]) if len(r) > 8 else str(k + 1)
        record.leads.append(Lead(k, name, r[0], made[1], int(made[2] or 0), (float(gain[1]) if gain else 0.0) or 200.0, zero, gain[3] if gain and gain[3] else "mV", names[:k].count(r[0]), names.count(r[0])))
    return record


def decoded(data: bytes, format_: str, skip: int, frames: int, beside: int, places: list[int]) -> np.ndarray:
    """(places, frames) numbers of the leads at these places of a file; `skip` samples at the start of data belong to others."""
    at = skip + np.arange(frames)[None, :] * beside + np.array(places)[:, None]
    if format_ == "212":  # two samples in three bytes, the high bits of both in the middle one
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        triple = at // 2 * 3
        low, high = np.where(at % 2 == 0, b[triple], b[np.minimum(triple + 2, len(b) - 1)]), np.where(at % 2 == 0, b[triple + 1] & 15, b[triple + 1] >> 4)
        value = low | (high << 8)
        return np.where(value >= 1 << 11, value - (1 << 12), value)
    if format_ == "24":
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        value = b[at * 3] | (b[at * 3 + 1] << 8) | (b[at * 3 + 2] << 16)
        return np.where(value >= 1 << 23, value - (1 << 24), value)
    if format_ == "80":
        return np.frombuffer(data, np.uint8)[at].astype(np.int32) - 128
    return np.frombuffer(data, {"16": "<i2", "32": "<i4"}[format_])[at].astype(np.int64)


def samples_in(size: int, lead: Lead) -> int:
    """How many samples of each lead a file of so many bytes holds."""
    return (size - lead.offset) * 8 // BITS[lead.format] // lead.beside


@dataclass
class Run(InputPartition):
    record: Record
    first: int
    end: int


class SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("samples", 1 << 20))
        self.leads: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can decide alone; the others are left to Spark."""
        for f in filters:
            match f:
                case IsNotNull(("lead",) | ("first",)):
                    pass
                case EqualTo(("lead",), str(name)):
                    self._only({name})
                case In(("lead",), names) if all(isinstance(n, str) for n in names):
                    self._only(set(names))
                case EqualTo(("first",), int(n)):
                    self._between(n, n + 1)
                case GreaterThanOrEqual(("first",), int(n)):
                    self._between(n, None)
                case GreaterThan(("first",), int(n)):
                    self._between(n + 1, None)
                case LessThan(("first",), int(n)):
                    self._between(0, n)
                case LessThanOrEqual(("first",), int(n)):
                    self._between(0, n + 1)
                case _:
                    yield f

    def _only(self, names: set[str]) -> None:
        self.leads = names if self.leads is None else self.leads & names

    def _between(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[Run]:
        store, _ = files.opened(self.path)
        out = []
        for f in files.listed(self.path, ".hea"):
            with store.open_input_stream(f.path) as s:
                record = read_header(f.path, s.read().decode("utf-8", "replace"))
            record.leads = [x for x in record.leads if self.leads is None or x.name in self.leads]
            if not record.leads:
                continue
            folder = f.path.rpartition("/")[0]
            sizes = {i.path.rpartition("/")[2]: i for i in store.get_file_info([f"{folder}/{n}" for n in {x.file for x in record.leads}])}
            there = {x.file: samples_in(sizes[x.file].size or 0, x) for x in record.leads}
            count = record.samples if record.samples is not None else min(there.values())
            if short := sorted(n for n, have in there.items() if have < count):
                raise ValueError(f"{record.path}: {', '.join(short)} has fewer than {count} samples a lead")
            out += [Run(record, at, min(at + self.step, count)) for at in range(0, count, self.step) if at >= self.low and (self.high is None or at < self.high)]
        return out or [Run(Record("", 0.0, 0), 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, _ = files.opened(self.path)
        record, first, frames = partition.record, partition.first, partition.end - partition.first
        folder, rows = record.path.rpartition("/")[0], {}
        for name in dict.fromkeys(x.file for x in record.leads):
            leads = [x for x in record.leads if x.file == name]
            one = leads[0]
            skip = first * one.beside % 2 if one.format == "212" else 0  # pairs of samples aren't cut
            begin = one.offset + (first * one.beside - skip) * BITS[one.format] // 8
            length = -(-(frames * one.beside + skip) * BITS[one.format] // 8)
            with store.open_input_file(f"{folder}/{name}") as s:
                s.seek(begin)
                data = s.read(length)
            for lead, raw in zip(leads, decoded(data, one.format, skip, frames, one.beside, [x.place for x in leads]), strict=True):
                rows[lead] = pa.array((raw - lead.zero) / lead.gain, mask=raw == MISSING[lead.format])
        made = [rows[x] for x in record.leads]
        n = len(made)
        signal = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * frames, pa.int32()), pa.concat_arrays(made) if made else pa.array([], pa.float64()))
        of_lead = [pa.array([getattr(x, c) for x in record.leads], t) for c, t in (("number", pa.int32()), ("name", pa.string()), ("unit", pa.string()))]
        columns = [pa.array([record.path] * n, pa.string()), *of_lead, pa.array([record.rate] * n, pa.float64()), pa.array([first] * n, pa.int64()), signal]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class SignalSource(DataSource):
    """spark.read.format("signal_records").load(folder). Option: `samples`, the length of a run."""

    @classmethod
    def name(cls) -> str:
        return "signal_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SignalReader:
        return SignalReader({k.lower(): v for k, v in self.options.items()})


def signal_records(spark: SparkSession, path: str, samples: int = 1 << 20) -> DataFrame:
    """Rows of record, number, lead, unit, rate, first, signal."""
    spark.dataSource.register(SignalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("signal_records").option("samples", samples).load(path)


def signal_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: record, rate, leads (a series each, in order of the header), names."""
    rows = signal_records(spark, path, 1 << 62).groupBy("record", "rate").agg(F.array_sort(F.collect_list(F.struct("number", "lead", "signal"))).alias("x"))
    return rows.select("record", "rate", F.col("x.signal").alias("leads"), F.col("x.lead").alias("names"))
