"""Sorted Parquet runs probed block by block inside a task.

A store writes runs of files partitioned by a hash and sorted by a key, with small row
groups (blocks). A task that has a bucket's wanted keys opens the bucket's files, looks at
each block's least and largest key, and reads the blocks that can hold one of them. So what
is read follows the keys that are asked for, and nothing of the store is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a block, the unit that a probe reads.
BLOCK = 64 * 1024
#: Runs of a level that are merged into one of the next.
FANOUT = 8
#: Pairs that a task expands at a time.
PAIRS = 2_000_000


def write_run(df: DataFrame, to: str, part: str, by: str, block: int = BLOCK) -> None:
    """``df`` as one run, a folder for each value of ``part``, sorted by ``by``.

    A run counts only once its store's manifest names it, so tasks may put files in place
    themselves, and what a failed write left is replaced.
    """
    options = {"parquet.block.size": block, "parquet.enable.dictionary": "false", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
    df.repartition(part).sortWithinPartitions(part, by).write.mode("overwrite").options(**options).partitionBy(part).parquet(to)


def merge_due(runs: list[dict]) -> list[dict]:
    """The newest level's runs, if there are enough of them to be merged."""
    tail = [r for r in runs if r["level"] == runs[-1]["level"]] if runs else []
    return tail if len(tail) >= FANOUT else []


def ints(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy() if isinstance(rows, pa.Table) else rows.column(name).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], by: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[int, pa.Table]]:
    """(value, rows) for each run of equal values in sorted batches."""
    held, value = [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        at = by(rows)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if value is not None and at[lo] != value:
                yield value, pa.concat_tables(held)
                held = []
            value = int(at[lo])
            held.append(rows.slice(lo, hi - lo))
    if held:
        yield value, pa.concat_tables(held)


def files(folder: str) -> Iterator[pa.NativeFile]:
    """The opened Parquet files of a folder; none where it does not exist."""
    from pyarrow import fs as pafs

    system, inner = pafs.FileSystem.from_uri(folder)
    for info in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield f


def blocks(folder: str, column: str, wanted: np.ndarray, columns: list[str], at_once: int = 1) -> Iterator[tuple[pa.Table, int]]:
    """(rows, bytes read) of a folder's blocks that can hold one of the sorted wanted values, up to ``at_once`` blocks of a file together."""
    import pyarrow.parquet as pq

    for f in files(folder):
        file = pq.ParquetFile(f)
        meta = file.metadata
        at = meta.schema.to_arrow_schema().get_field_index(column)
        due, size = [], 0
        for i in range(meta.num_row_groups):
            group = meta.row_group(i)
            stats = group.column(at).statistics
            if stats is not None and stats.has_min_max:
                lo, hi = np.searchsorted(wanted, stats.min, "left"), np.searchsorted(wanted, stats.max, "right")
                if lo == hi:
                    continue
            due.append(i)
            size += group.total_byte_size
            if len(due) == at_once:
                yield file.read_row_groups(due, columns=columns), size
                due, size = [], 0
        if due:
            yield file.read_row_groups(due, columns=columns), size


@contextmanager
def file_writer(path: str) -> Iterator[Callable[[pa.Table, int], None]]:
    """Gets tables and the rows of their blocks; the file is there under its name once all is written, and not at all without a table."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    system, inner = pafs.FileSystem.from_uri(path)
    part, open_ = f"{inner}.{uuid.uuid4().hex}", []

    def write(table: pa.Table, rows: int) -> None:
        if not open_:
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            open_.append(pq.ParquetWriter(part, table.schema, filesystem=system, compression="zstd", use_dictionary=False))
        open_[0].write_table(table, row_group_size=rows)

    try:
        yield write
    except BaseException:
        if open_:
            open_[0].close()
            system.delete_file(part)
        raise
    if open_:
        open_[0].close()
        if system.get_file_info(inner).type != pafs.FileType.NotFound:
            system.delete_file(inner)
        system.move(part, inner)


def merged_slices(folders: list[str], column: str, rows: int = 1_000_000) -> Iterator[pa.Table]:
    """All rows of the folders' files, each sorted by ``column``, in its order and in slices of about ``rows``."""
    import pyarrow.parquet as pq

    groups = []
    for folder in folders:
        for f in files(folder):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.to_arrow_schema().get_field_index(column)
            groups += [(meta.row_group(i).column(at).statistics.min, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
    groups.sort()
    cuts, n = [], 0
    for least, size in groups:
        if n + size > rows and n and (not cuts or least > cuts[-1]):
            cuts.append(least)
            n = 0
        n += size
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        parts = []
        # Blocks from lo to below hi: the bounds themselves serve as the wanted values' ends.
        for folder in folders:
            for f in files(folder):
                file = pq.ParquetFile(f)
                at = file.metadata.schema.to_arrow_schema().get_field_index(column)
                stats = [file.metadata.row_group(i).column(at).statistics for i in range(file.metadata.num_row_groups)]
                due = [i for i, s in enumerate(stats) if (hi is None or s.min < hi) and (lo is None or s.max >= lo)]
                if due:
                    table = file.read_row_groups(due)
                    value = ints(table, column)
                    parts.append(table.filter(pa.array((value >= lo if lo is not None else True) & (value < hi if hi is not None else np.ones(len(value), bool)))))
        if parts:
            yield pa.concat_tables(parts).sort_by(column)


def expand(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with j in starts[i] .. starts[i] + counts[i], in pieces of bounded size."""
    live = np.flatnonzero(counts)
    ends = np.cumsum(counts[live])
    at, done = 0, 0
    while at < len(live):
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        rows, n = live[at:to], counts[live[at:to]]
        i = np.repeat(rows, n)
        j = np.repeat(starts[rows], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        at, done = to, int(ends[to - 1])
