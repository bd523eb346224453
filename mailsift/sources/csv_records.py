"""Records of quoted CSV files, read by as many tasks as the files have ranges.

A quoted field may hold line ends, so where a record begins depends on all that
stands before it. Spark's text source deals a file out in byte ranges, cut at
line ends, and three steps put the records together:

1. *Scan.* Each range is read once for both cases, "begins between records" and
   "begins inside a quoted field": the case at its end, how many records begin
   in it, where its first and its last begin. One row a range.
2. *Combine.* A range maps the case at its begin to that at its end: it sets one,
   keeps it or swaps it. The case at each range's begin is the last one set before
   it, swapped as often as ranges since then do so: running aggregates over one
   row a range. The table reaches the driver, which plans as many ranges itself.
3. *Cut.* Each range is read again, now knowing its case and the number of its
   first record. Records within a range are whole; of one that goes on over ranges
   each range gives its piece, and the pieces (two a range at most) are joined.

Quotes count as the CSV parser counts them: a field is quoted if it begins with
a quote, a doubled quote is text, and a quote in an unquoted field is text too.
A quote that is never closed takes the rest of its file into its field.
Line ends are ``\\n``, or ``\\r\\n`` in a file whose first line ends so (line ends
within its quoted fields then become ``\\n``, as in Spark's own reader).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings whose quotes, commas and line ends are single ASCII bytes.
ASCII_BASED = {"UTF-8", "US-ASCII", "ISO-8859-1", "ISO-8859-15", "WINDOWS-1252", "CP1252"}
_QUOTED = re.compile(rb'[^"]*(?:""[^"]*)*')
_RANGES = ("file string, start long, lines long, head binary, ends_out boolean, ends_in boolean, begins_out long, begins_in long")
_RECORDS = "file string, file_no long, record long, start long, whole boolean, text string"


def goes_on(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside
    one (``inside``) or at a field's begin."""
    at = 0
    while True:
        if inside or line[at: at + 1] == b'"':
            at = _QUOTED.match(line, at + (not inside)).end()
            if at >= len(line):
                return True
            inside = False
            at = line.find(b",", at + 1) + 1  # what follows a closing quote runs to the next comma
            if not at:
                return False
        else:
            at = line.find(b',"', at) + 1
            if not at:
                return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """(file, start, lines, whether a new range begins) of consecutive lines of one range."""
    last = None
    for batch in batches:
        files, starts, lines = (batch.column(i) for i in range(3))
        if not batch.num_rows:
            continue
        name = pc.binary_join_element_wise(files, starts.cast(pa.string()), "\n")
        change = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(name[1:], name[:-1])).to_pylist()), batch.num_rows]
        for a, b in zip(change, change[1:]):
            key = (files[a].as_py(), starts[a].as_py())
            yield *key, lines[a:b], key != last
            last = key


class _Case:
    """One of the two readings of a range."""

    def __init__(self, inside: bool):
        self.inside, self.begins = inside, 0

    def plain(self, n: int) -> None:
        """n lines without a quote."""
        if not self.inside:
            self.begins += n

    def line(self, line: bytes) -> None:
        self.begins += not self.inside
        self.inside = goes_on(line, self.inside)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: dict | None = None

    def row() -> pa.RecordBatch:
        out, within = now["cases"]
        return pa.RecordBatch.from_pylist([{
            "file": now["file"], "start": now["start"], "lines": now["lines"], "head": now["head"], "ends_out": out.inside, "ends_in": within.inside,
            "begins_out": out.begins, "begins_in": within.begins}], schema=pa.schema([
                ("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("head", pa.binary()), ("ends_out", pa.bool_()), ("ends_in", pa.bool_()),
                ("begins_out", pa.int64()), ("begins_in", pa.int64())]))

    for file, start, lines, new in _runs(batches):
        if new:
            if now:
                yield row()
            now = {"file": file, "start": start, "lines": 0, "head": b"" if start == 0 else None, "cases": (_Case(False), _Case(True)), "in_head": start == 0}
        done = 0
        for at in pc.indices_nonzero(pc.greater_equal(pc.find_substring(lines, pattern=b'"'), 0)).to_pylist():
            line = lines[at].as_py()
            for case in now["cases"]:
                case.plain(at - done)
                case.line(line)
            done = at + 1
        for case in now["cases"]:
            case.plain(len(lines) - done)
        at = 0
        while now["in_head"] and at < len(lines):  # the first record of a file
            line = lines[at].as_py()
            inside = goes_on(line, bool(now["lines"] + at))
            now["head"] += line + (b"\n" if inside else b"")
            now["in_head"] = inside
            at += 1
        now["lines"] += len(lines)
    if now:
        yield row()


def _cut(known, encoding: str, pieces: bool):
    """Records of the ranges (``pieces``: only those that a range cuts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = known.value
        key, held, rows = None, [], []
        state: dict = {}

        def put(text: list[bytes], whole: bool) -> None:
            if whole == (not pieces) and (text or not whole):
                raw = b"\n".join(text)
                if state["crlf"] and whole:
                    raw = raw.removesuffix(b"\r").replace(b"\r\n", b"\n")
                rows.append((key[0], state["file_no"], state["record"], key[1], whole, raw.decode(encoding, "replace")))

        def close() -> None:
            if key is not None and held:
                put(held, False)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "file_no", "record", "start", "whole", "text"])

        for file, start, lines, new in _runs(batches):
            if new:
                close()
                key, held = (file, start), []
                inside, record, file_no, crlf = ranges[key]
                state = {"inside": inside, "record": record - 1, "file_no": file_no, "crlf": crlf, "tail": inside}
            for line in lines.to_pylist():
                if not state["inside"]:
                    state["record"] += 1
                    held = []
                state["inside"] = (state["inside"] or b'"' in line) and goes_on(line, state["inside"])
                held.append(line)
                if not state["inside"]:
                    put(held, not state["tail"])
                    state["tail"], held = False, []
            yield batch()
            rows = []
        close()
        yield batch()
    return run


def read_records(spark: SparkSession, path: str | list[str], encoding: str) -> tuple[dict[str, str], DataFrame]:
    """(first record by file, files by name; frame of file, file_no, record, text):
    every record of every file, the files' first ones (headers) included as
    record 0; file_no counts files by name."""
    codec = encoding.upper().replace("WINDOWS-1252", "CP1252")
    source = spark.read.option("lineSep", "\n").text(path)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    ranges = lines.mapInArrow(_scan, _RANGES)

    # A range sets the case at its end, or it keeps (no swap) or swaps that at its begin.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("ends_out") & ~F.col("ends_in")).cast("long")
    ranges = ranges.withColumn("swaps", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    fixed = F.when(F.col("ends_out") == F.col("ends_in"), F.struct(F.col("ends_out").alias("to"), F.col("swaps").alias("at")))
    ranges = ranges.withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    since = (F.col("swaps") - F.coalesce("last.at", F.lit(0))) % 2 == 1
    ranges = ranges.withColumn("inside", F.coalesce("last.to", F.lit(False)) != since)
    begins = F.when(F.col("inside"), F.col("begins_in")).otherwise(F.col("begins_out"))
    ranges = ranges.withColumn("begins", begins).withColumn("first", F.coalesce(F.sum("begins").over(before), F.lit(0)))
    ranges = ranges.withColumn("open", F.when(F.col("inside"), F.col("ends_in")).otherwise(F.col("ends_out")))
    found = ranges.select("file", "start", "inside", "open", "first", "head").collect()  # one row a range, as Spark's own plan of the scan

    numbers = {f: i for i, f in enumerate(sorted({r["file"] for r in found}))}
    heads = {r["file"]: r["head"] for r in found if r["start"] == 0}
    crlf = {f: head.split(b"\n", 1)[0].endswith(b"\r") for f, head in heads.items()}
    known = spark.sparkContext.broadcast({(r["file"], r["start"]): (r["inside"], r["first"], numbers[r["file"]], crlf[r["file"]]) for r in found})
    out = lines.mapInArrow(_cut(known, codec, False), _RECORDS)
    if any(r["inside"] or r["open"] for r in found):  # open at a file's end: a quote that is never closed
        cut = lines.mapInArrow(_cut(known, codec, True), _RECORDS)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), "\n")
        joined = cut.groupBy("file", "file_no", "record").agg(text.alias("text"))
        crlf_files = [f for f in crlf if crlf[f]]
        joined = joined.withColumn("text", F.when(F.col("file").isin(crlf_files), F.regexp_replace(F.regexp_replace("text", "\r\\z", ""), "\r\n", "\n")).otherwise(F.col("text")))
        out = out.select("file", "file_no", "record", "text").unionByName(joined)
    headers = {f: heads[f].decode(codec, "replace").removesuffix("\r").removeprefix("\ufeff") for f in sorted(heads)}
    return headers, out.select("file", "file_no", "record", "text")
