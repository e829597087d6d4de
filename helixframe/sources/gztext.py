"""Lines of block-gzip files as a Python data source: spark.read.format("bgzf_text").load(path) and df.write.format("bgzf_text").

A file is cut at its blocks, so one file is many tasks; with regions and a .tbi file beside
only the chunks that the index names are read. Written parts get their index where rows have
positions.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf
from .bgzf import Sequence, opened

SCHEMA = "line_no long, line string, file string"
RANGE = 16 << 20
_BATCH = 20_000
# Fixed values of the format: the columns of variant files in a .tbi header (format, sequence, begin, end, comment, lines to skip).
_VCF = (2, 1, 2, 0, ord("#"), 0)


def is_blocked(path: str) -> bool:
    """Whether a path is a block-gzip file; False for stores that pyarrow does not read."""
    if not bgzf.reachable(path) or bgzf.size_of(path) is None:
        return False
    f, _ = opened(path)
    with f:
        head = f.read(18)
    return head[:4] == bgzf.EOF[:4] and head[12:16] == bgzf.EOF[12:16]


class Tabix:
    """A .tbi file: where the lines of each sequence are, and which columns say so."""

    def __init__(self, path: str):
        f, size = opened(path)
        with f:
            data = b"".join(block for _, block in bgzf.blocks(f, 0, size))
        if data[:4] != b"TBI\x01":
            raise ValueError(f"{path} is not a tabix index")
        n, self.format, self.seq, self.beg, self.end, self.meta, _, length = struct.unpack_from("<8i", data, 4)
        self.names = [x.decode() for x in data[36 : 36 + length].split(b"\0")[:n]]
        self.sequences, _ = bgzf.unpack_index(data, 36 + length, n)

    def span(self, fields: list[bytes]) -> tuple[int, int]:
        """0-based, half-open positions of a line."""
        start = int(fields[self.beg - 1]) - (0 if self.format & 0x10000 else 1)
        if self.format & 0xFFFF != 2:
            return start, int(fields[self.end - 1]) if self.end else start + 1
        end = start + len(fields[3])
        for part in fields[7].split(b";") if len(fields) > 7 else ():
            if part.startswith(b"END=") and part[4:].isdigit():
                end = max(end, int(part[4:]))
        return start, end


class Part(InputPartition):
    """Lines that begin after a line break in blocks from start on and before end; with begin those from that virtual offset up to `until`, in regions."""

    def __init__(self, path: str, start: int, end: int, begin: int | None = None, until: int = 0):
        self.path, self.start, self.end, self.begin, self.until = path, start, end, begin, until


class LineReader(DataSourceReader):
    def __init__(self, path: str, size: int, regions: list | None):
        self.path, self.size, self.regions = path, size, regions

    def partitions(self) -> list[Part]:
        out = []
        for path in bgzf.files(self.path, ".gz"):
            total = bgzf.size_of(path)
            if self.regions is not None and bgzf.size_of(f"{path}.tbi") is not None:
                index = Tabix(f"{path}.tbi")
                at = [(index.sequences[index.names.index(c)], s, e) for c, s, e in self.regions if c in index.names and e > s]
                chunks = bgzf.merged([x for q, s, e in at for x in q.chunks(s, e)])
                out += [Part(path, 0, total, a, b) for a, b in bgzf.split(chunks, [p for q, _, _ in at for p in q.linear], self.size)]
            elif self.regions is not None:
                raise FileNotFoundError(f"{path}.tbi: regions need an index")
            else:
                out += [Part(path, a, min(a + self.size, total)) for a in range(0, total, self.size)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        wanted = None
        if self.regions is not None:
            index = Tabix(f"{part.path}.tbi")
            spans: dict[bytes, list[tuple[int, int]]] = {}
            for c, s, e in self.regions:
                spans.setdefault(c.encode(), []).append((s, e))

            def wanted(line: bytes) -> bool:
                if line[:1] == bytes([index.meta]):
                    return False
                fields = line.split(b"\t", 9)
                held = spans.get(fields[index.seq - 1], ())
                start, end = index.span(fields) if held else (0, 0)
                return any(start < e and s < end for s, e in held)

        numbers, lines = [], []
        for no, line in self._lines(part):
            if wanted is None or wanted(line):
                numbers.append(no)
                lines.append(line[:-1] if line[-1:] == b"\r" else line)
            if len(lines) == _BATCH:
                yield self._batch(numbers, lines, part.path)
                numbers, lines = [], []
        if lines:
            yield self._batch(numbers, lines, part.path)

    @staticmethod
    def _batch(numbers: list[int], lines: list[bytes], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string()), pa.array([path] * len(lines), pa.string())], ["line_no", "line", "file"])

    @staticmethod
    def _lines(part: Part) -> Iterator[tuple[int, bytes]]:
        """(virtual offset, line) of the part's lines."""
        f, total = opened(part.path)
        with f:
            first = part.start if part.start == 0 else bgzf.next_block(f, part.start, total)
            held, no = None if part.start else [], first << 16  # pieces of the line that goes on; None until a line begins
            if part.begin is not None:
                first, held, no = part.begin >> 16, [], part.begin
            for offset, block in bgzf.blocks(f, first, total):
                own = offset < part.end if part.begin is None else offset << 16 < part.until
                if part.begin is not None and offset == first:
                    block = block[part.begin & 0xFFFF :]
                base = offset << 16 | (part.begin & 0xFFFF if part.begin is not None and offset == first else 0)
                if not own and held is None:
                    return
                pieces = block.split(b"\n")
                if not own:  # only the last line's end is looked for
                    held.append(pieces[0])
                    if len(pieces) > 1:
                        yield no, b"".join(held)
                        return
                    continue
                begins = base + np.cumsum([0, *(len(x) + 1 for x in pieces[:-1])])
                for i, piece in enumerate(pieces[:-1]):
                    if held is not None:
                        if part.begin is not None and no >= part.until:
                            return
                        held.append(piece)
                        yield no, b"".join(held)
                    held, no = [], int(begins[i + 1])
                if held is not None:
                    held.append(pieces[-1])
                if part.begin is not None and no >= part.until:
                    return
            if held and any(held):
                yield no, b"".join(held)


class LineWriter(bgzf.FolderWriter):
    """One file a task; with chrom, start and end beside line, rows come in their order and get a .tbi. Each file begins with the header lines."""

    def __init__(self, path: str, overwrite: bool, ending: str, header: list[str], indexed: bool):
        super().__init__(path, overwrite)
        self.ending, self.header, self.indexed = ending, header, indexed

    def write_part(self, batches, part: str, open_) -> int:
        out, rows, index, last = None, 0, {}, None
        for batch in batches:
            places = [batch.column(c).to_pylist() for c in ("chrom", "start", "end")] if self.indexed else None
            for i, line in enumerate(batch.column("line").to_pylist()):
                if out is None:
                    out = bgzf.Writer(open_(part + self.ending))
                    out.write("".join(f"{h}\n" for h in self.header).encode())
                begin = out.offset
                out.write(line.encode() + b"\n")
                rows += 1
                if places:
                    chrom, start, end = (p[i] for p in places)
                    if chrom not in index:
                        index[chrom], last = Sequence(), start
                    if start < last or list(index)[-1] != chrom:
                        raise ValueError("lines are not in order")
                    index[chrom].add(start, end, begin, out.offset)
                    last = start
        if out is not None:
            out.close()
            if self.indexed:
                names = b"".join(c.encode() + b"\0" for c in index)
                tbi = bgzf.Writer(open_(part + self.ending + ".tbi"))
                tbi.write(b"TBI\x01" + struct.pack("<8i", len(index), *_VCF, len(names)) + names + bgzf.pack_index(list(index.values())))
                tbi.close()
        return rows


class BgzfText(DataSource):
    """Options: path (a .gz file, a folder of them, or a URI), rangebytes, regions (JSON [[chrom, start, end], ...]); for writing ending and header (JSON lines)."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        regions = self.options.get("regions")
        return LineReader(self.options["path"], int(self.options.get("rangebytes", RANGE)), json.loads(regions) if regions else None)

    def writer(self, schema, overwrite: bool):
        return LineWriter(self.options["path"], overwrite, self.options.get("ending", ".txt.gz"), json.loads(self.options.get("header", "[]")), "chrom" in schema.fieldNames())


def _registered(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(BgzfText)


def lines(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(line_no, line, file) of block-gzip files; line_no is the line's virtual offset. With regions (0-based, half-open) the lines that overlap one of them, by the tabix index, without headers."""
    _registered(spark)
    reader = spark.read.format("bgzf_text").option("rangebytes", range_bytes)
    return (reader if regions is None else reader.option("regions", json.dumps([list(r) for r in regions]))).load(path)


def write_variants(records: DataFrame, path: str, partitions: int, header: list[str] = ()) -> None:
    """Variant lines (line) as a folder of block-gzip files with tabix indexes, in one order by chromosome and position over all parts, by sampled bounds."""
    _registered(records.sparkSession)
    f = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    start = F.greatest(f(1).cast("long") - 1, F.lit(0))
    named = F.regexp_extract(f(7), r"(?:^|;)END=([0-9]+)(?:;|$)", 1)
    rows = records.select("line", f(0).alias("chrom"), start.alias("start"), F.greatest(start + F.octet_length(f(3)), F.when(named != "", named.cast("long"))).alias("end"))
    rows = rows.repartitionByRange(partitions, "chrom", "start", "line").sortWithinPartitions("chrom", "start", "line")
    rows.write.format("bgzf_text").option("ending", ".vcf.gz").option("header", json.dumps(list(header))).mode("append").save(path)
