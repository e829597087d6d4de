"""FASTA by its .fai index: byte ranges are read in the tasks that want them, and nothing else of the file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource

from . import bgzf
from .bgzf import opened

CHUNK = 32
#: Bases that one task's row reads at once.
_PIECE = 1 << 20


@dataclass(frozen=True)
class Entry:
    """A sequence of a file: its length, where its bases begin, and bases and bytes of a line."""

    path: str
    length: int
    offset: int
    bases: int
    width: int

    def place(self, i: int) -> int:
        """The file offset of base i."""
        return self.offset + i // self.bases * self.width + i % self.bases


def read_index(path: str) -> dict[str, Entry]:
    """The index beside a FASTA file, its ending replaced by .fa.fai or followed by .fai; of a folder all its .fa files'."""
    found = {}
    for file in bgzf.files(path, ".fa"):
        stem = file[: file.rindex(".")] if "." in file.rsplit("/", 1)[-1] else file
        name = next((n for n in (f"{stem}.fa.fai", f"{file}.fai") if bgzf.size_of(n) is not None), None)
        if name is None:
            raise FileNotFoundError(f"{file} has no .fai index")
        f, size = opened(name)
        with f:
            for line in f.read(size).decode().splitlines():
                chrom, length, offset, bases, width = line.split("\t")[:5]
                found.setdefault(chrom, Entry(file, int(length), int(offset), int(bases), int(width)))
    return found


def indexed(path: str) -> bool:
    """Whether every file has its index beside."""
    if not bgzf.reachable(path):
        return False
    try:
        return bool(read_index(path))
    except FileNotFoundError:
        return False


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) by the index."""
    return spark.createDataFrame([(c, e.length) for c, e in read_index(path).items()], "chrom string, length long")


class Files:
    """A task's open files."""

    def __init__(self, index: dict[str, Entry]):
        self.index, self.open = index, {}

    def bases(self, chrom: str, start: int, end: int) -> str:
        """Upper-case bases of [start, end), clamped to the sequence."""
        e = self.index.get(chrom)
        if e is None:
            raise KeyError(f"chromosome '{chrom}' is not in the FASTA index")
        start, end = max(0, start), min(end, e.length)
        if end <= start:
            return ""
        if e.path not in self.open:
            self.open[e.path] = opened(e.path)[0]
        f, at = self.open[e.path], e.place(start)
        f.seek(at)
        return f.read(e.place(end - 1) + 1 - at).translate(None, b"\r\n").decode("ascii").upper()

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def slices(wanted: DataFrame, path: str) -> DataFrame:
    """wanted (with chrom, ref_start, ref_end) plus sequence: upper-case bases, clamped to the chromosome. A chromosome that the index does not have is an error."""
    from ..shipping import ship

    ship(wanted.sparkSession)
    index = read_index(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(index)
        try:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("chrom", "ref_start", "ref_end")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([files.bases(*r) for r in rows], pa.string())], [*batch.schema.names, "sequence"])
        finally:
            files.close()

    return wanted.mapInArrow(cut, T.StructType([*wanted.schema.fields, T.StructField("sequence", T.StringType())]))


def chunks(spark: SparkSession, path: str, windows: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_id, seq): the pieces of chunk bases that the windows (chrom, start, end) touch, or all; each once.

    Chunks are read in runs of up to a megabase, so a window of a few events reads some
    kilobytes and a genome is read in parallel without any shuffle of its lines.
    """
    size = lengths(spark, path)
    step = _PIECE // chunk
    whole = size.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(_PIECE).cast("long"))).alias("at"), "length").select("chrom", (F.col("at") / chunk).cast("long").alias("lo"), F.ceil(F.least(F.col("at") + _PIECE, F.col("length")) / chunk).alias("hi"))
    if windows is None:
        runs = whole.where("hi > lo")
    else:
        w = windows.join(size, "chrom", "left")
        w = w.withColumn("length", F.coalesce("length", F.raise_error(F.concat(F.lit("the FASTA index does not have chromosome "), "chrom")).cast("long")))
        w = w.select("chrom", F.floor(F.greatest("start", F.lit(0)) / chunk).alias("lo"), F.ceil(F.least("end", "length") / chunk).alias("hi")).where("hi > lo")
        # in bins of a step; within a bin the runs that overlap become one
        w = w.select("chrom", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("bin"))
        w = w.select("chrom", "bin", F.greatest("lo", F.col("bin") * step).alias("lo"), F.least("hi", (F.col("bin") + 1) * step).alias("hi")).distinct()
        ids = w.select("chrom", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("chunk_id")).distinct()
        # runs of neighbours: a number less its rank is the same along a run; a bin has at most `step` numbers
        ranked = ids.groupBy("chrom", F.floor(F.col("chunk_id") / step).alias("bin")).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
        ranked = ranked.select("chrom", F.explode(F.transform("ids", lambda x, i: F.struct(x.alias("x"), (x - i).alias("k")))).alias("r")).groupBy("chrom", "r.k").agg(F.min("r.x").alias("lo"), (F.max("r.x") + 1).alias("hi"))
        runs = ranked.select("chrom", "lo", "hi")
    read = slices(runs.select("chrom", (F.col("lo") * chunk).alias("ref_start"), (F.col("hi") * chunk).alias("ref_end")), path)
    each = read.select("chrom", (F.col("ref_start") / chunk).cast("long").alias("lo"), F.posexplode(F.regexp_extract_all("sequence", F.lit("(?s).{1,%d}" % chunk), F.lit(0))).alias("i", "seq"))
    return each.select("chrom", (F.col("lo") + F.col("i")).alias("chunk_id"), "seq")


class FastaWriter(bgzf.FolderWriter):
    """A FASTA file and its index for each task; a chromosome's chunks come to one task in order."""

    def __init__(self, path: str, overwrite: bool, width: int):
        super().__init__(path, overwrite)
        self.line = width

    def write_part(self, batches, part: str, open_) -> int:
        out, rows, at, chrom, held, entries = None, 0, 0, None, "", []

        def put(text: str) -> None:
            nonlocal at
            out.write(text.encode())
            at += len(text)

        for batch in batches:
            for name, seq in zip(batch.column("chrom").to_pylist(), batch.column("seq").to_pylist()):
                if out is None:
                    out = open_(f"{part}.fa")
                if name != chrom:
                    if held:
                        put(held + "\n")
                    chrom, held = name, ""
                    put(f">{name}\n")
                    entries.append([name, 0, at])
                held += seq
                entries[-1][1] += len(seq)
                while len(held) >= self.line:
                    put(held[: self.line] + "\n")
                    held = held[self.line :]
                rows += 1
        if out is not None:
            if held:
                put(held + "\n")
            out.close()
            with open_(f"{part}.fa.fai") as f:
                f.write("".join(f"{n}\t{length}\t{offset}\t{self.line}\t{self.line + 1}\n" for n, length, offset in entries).encode())
        return rows


class FastaFolder(DataSource):
    """For writing (chrom, chunk_id, seq); options: path, width (bases of a line)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_folder"

    def schema(self) -> str:
        return "chrom string, chunk_id long, seq string"

    def writer(self, schema, overwrite: bool):
        return FastaWriter(self.options["path"], overwrite, int(self.options.get("width", 60)))


def write(ref: DataFrame, path: str, partitions: int, width: int = 60) -> None:
    """A folder of FASTA files with indexes from (chrom, chunk_id, seq); a chromosome is written as a stream by one task, a file has one or more."""
    from ..shipping import ship

    ship(ref.sparkSession)
    ref.sparkSession.dataSource.register(FastaFolder)
    rows = ref.select("chrom", "chunk_id", "seq").repartition(partitions, "chrom").sortWithinPartitions("chrom", "chunk_id")
    rows.write.format("fasta_folder").option("width", width).mode("append").save(path)
