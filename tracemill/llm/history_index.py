"""New batches judged against everything accepted before.

``AcceptedIndex`` is a folder with these parts:

* ``keys``: sorted runs of minwise band keys, partitioned by band. A row is
  (key, number of the text, size, sketch word); accepted names are rows of their own kind;
* ``texts`` and ``sketches``: plain text and whole sketch of every text that was ever judged, in
  the order of their numbers; only what a key row names is ever asked for;
* ``lines`` and ``accepted``: the lines seen and accepted, a folder for each ingest.

An ingest describes its distinct texts once: the task that has them writes their texts,
sketches and band keys as columns. A bucket's task reads only the columns of its bands, sorts
them, pairs them among themselves, and compares them with the least and largest key of each
block (some ``BLOCK`` bytes) of the bucket's files, reading the blocks that can hold one of
them. No key is shuffled. What agrees in size and in the whole sketch is a candidate; only
the texts of candidates are fetched, block by block, through the number that says where they
lie. So what an ingest reads of the history is bounded by its own keys and candidates,
however long the history is, and nothing of the history is shuffled.

An ingest appends one run. ``FANOUT`` runs of one level are merged into a run of the
next, up to runs of ``LARGE`` rows, which stay as they are. All is committed by one rename.

A backlog is best taken in by few large ingests: lines are judged in the order ``ord``, whatever
ingest they come with, so the result is the same, and a run of the history that an ingest's keys cover
is read once for all of its lines.

A line is refused if a line accepted before it has its name, or a like text in its
scope. Lines are ordered by ``ord``; within an ingest:

* lines with one (name, scope, text) are reduced to the first of them by a partial
  aggregate, as no later one can be accepted;
* names and texts that meet the history are refused;
* among the rest every line that comes before all undecided lines it conflicts with
  is accepted, its conflicts are refused, and so on until none is left. That is the
  greedy order, by parallel rounds or, for at most ``ONE_TASK`` lines and links, by one task.

A hot band key, under which a text agrees with more than ``LEADERS`` others, or that has too many pairs to
look at, does not pair its whole group: its first ``LEADERS`` texts meet all, the
others wait until those are settled. What has been refused by then drops out, and the
rest goes through the same again, so the result is exact and the pairs stay linear.

Defined results: null equals null as scope; a null name equals no name; a text with
fewer than five letters and digits is like no text; a line repeated under one line
number is one line. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import likeness
from tracemill.session import Scratch, hadoop_path
from tracemill.sources.blocks import FANOUT, blocks, expand, file_writer, files, grouped, ints, merge_due, merged_slices
from tracemill.sources.manifest import Manifest

#: Bytes of a block, the unit that a probe reads.
BLOCK = 256 * 1024
#: Texts of one band key that meet all others at a time.
LEADERS = 64
#: Batches made ready ahead.
AHEAD = 1
#: Lines and links of an ingest that one task settles; more are settled in parallel rounds, with the same result.
ONE_TASK = 1_000_000
#: Distinct texts whose keys of one bucket a task holds; an ingest of more is probed in several parts of each bucket.
TASK_TEXTS = 400_000
#: Pairs of equal keys that a task looks at within an ingest before its keys count as hot.
TASK_PAIRS = 300_000_000
#: Rows of a run that is not merged any more.
LARGE = 8_000_000
#: Bytes of a key row.
_ROW = 28
#: A number is generation, writing task and row: bits of the last two.
_SLOT_BITS, _ROW_BITS = 17, 27

_WORDS = ["s0", "s1", "s2", "s3"]
#: What a probe finds: a candidate in the history, one in the batch, a known name, a text that waits, and the bytes it read; LIKE and KNOWN are verified.
OLD, NEW, NAME, WAITS, READ, LIKE, KNOWN = range(7)
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _sizes_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (likeness.LIKE_DEN * np.minimum(x, y) >= likeness.LIKE_NUM * np.maximum(x, y)) & (x > 0) & (y > 0)


def _off(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int32)


def _alike(runs: np.ndarray, words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) agree in size, in the first word and in the whole sketch."""
    at = np.flatnonzero(_sizes_agree(runs[i], runs[j]))
    first = _off(words[0][i[at]], words[0][j[at]])
    at = at[first <= 64 - likeness.WORD_AGREE]
    return at[sum(_off(w[i[at]], w[j[at]]) for w in words) <= likeness.SKETCH - likeness.SKETCH_AGREE]


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(both), kind, np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_FOUND)


def _describer(gen: int, own: str, history: str, block: int):
    """Numbers the texts (tid, scope hash, text), sorted within a task, and writes what is known of each; gives (tid, num).

    The batch's folder ``own`` gets sizes, sketches and a column of keys for each band, the
    history texts in small blocks and sketches. Files are named by the task, so a repeated task replaces its own.
    """
    out = pa.schema([("tid", pa.binary()), ("num", pa.int64())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, done = TaskContext.get().partitionId(), 0
        if slot >= 2**_SLOT_BITS:
            raise ValueError("an ingest has at most 2^17 writing tasks of 2^27 texts")
        with file_writer(f"{own}/slot-{slot}.parquet") as keys, file_writer(f"{history}/texts/gen={gen}/slot={slot}/part-0.parquet") as texts, file_writer(f"{history}/sketches/gen={gen}/slot-{slot}.parquet") as sketches:
            for batch in batches:
                if not len(batch):
                    continue
                text = batch.column("text")
                num = (gen << (_SLOT_BITS + _ROW_BITS)) + (slot << _ROW_BITS) + done + np.arange(len(batch))
                done += len(batch)
                if done > 2**_ROW_BITS:
                    raise ValueError("an ingest has at most 2^17 writing tasks of 2^27 texts")
                runs, words, band = likeness.described(text, ints(batch, "scope"))
                numbers = {"num": num} | {k: words[:, i] for i, k in enumerate(_WORDS)}
                sketches(pa.table(numbers), len(batch))
                keys(pa.table(numbers | {"runs": runs} | {f"k{i}": band[:, i] for i in range(likeness.BANDS)}), len(batch))
                texts(pa.table({"num": num, "text": text}), max(1, block * len(batch) // max(1, text.nbytes)))
                yield pa.RecordBatch.from_arrays([batch.column("tid").cast(pa.binary()), pa.array(num)], schema=out)

    return describe


def _read(folder: str, columns: list[str]) -> pa.Table | None:
    import pyarrow.parquet as pq

    # One file after another: their order fixes the order of the rows.
    parts = [pq.read_table(f, columns=columns) for f in files(folder)]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def _bucket_rows(own: str, bucket: int, buckets: int, part: int, parts: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(keys in their order, the place of each key's text, the texts' numbers, sizes and sketches) of a bucket's bands in a batch's folder."""
    bands = [f"k{i}" for i in range(bucket, likeness.BANDS, buckets)]
    rows = _read(own, ["num", "runs", *_WORDS, *bands]) if bands else None
    if rows is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), {c: np.empty(0, np.int64) for c in ("num", "runs", *_WORDS)}
    if only is not None:
        rows = rows.filter(pa.array(np.isin(ints(rows, "num"), only)))
    key = np.concatenate([ints(rows, c).astype(np.int64) for c in bands])
    at = np.tile(np.arange(len(rows)), len(bands))
    if parts > 1:
        mine = key % parts == part
        key, at = key[mine], at[mine]
    order = np.argsort(key, kind="stable")
    return key[order], at[order], {c: ints(rows, c) for c in ("num", "runs", *_WORDS)}


def _bucket_names(folder: str, bucket: int, buckets: int, part: int, parts: int) -> np.ndarray:
    """Distinct (name key, check), sorted, of a bucket's names in a folder."""
    rows = _read(folder, ["h", "c"])
    if rows is None:
        return np.empty((0, 2), np.int64)
    rows = rows.drop_null()
    both = np.stack([ints(rows, "h"), ints(rows, "c")], axis=1)
    both = both[(both[:, 0] % buckets == bucket) & (both[:, 0] // buckets % parts == part)]
    return np.unique(both, axis=0) if len(both) else both


def _finder(own: str, nodes: str, history: str, folders: list[str], buckets: int, parts: int, leaders: int):
    """A bucket's candidates among the batch's texts and in the history's runs, and its known names; WAITS if its keys are hot."""

    def within(key: np.ndarray, at: np.ndarray, texts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        num, runs, words = texts["num"], texts["runs"], [texts[w] for w in _WORDS]
        n = len(key)
        begins = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        sizes = np.diff(np.concatenate((begins, [n])))
        hot, pairs = bool((sizes * (sizes - 1) // 2).sum() > TASK_PAIRS), []
        left = np.repeat(begins + sizes, sizes) - np.arange(n) - 1
        for i, j in () if hot else expand(np.arange(n) + 1, left):
            ok = _alike(runs, words, at[i], at[j])
            # i runs through the places in order, so a text's partners of one key are together only by piece.
            if len(ok) and max(np.bincount(j[ok] - j[ok].min()).max(), np.bincount(i[ok] - i[ok].min()).max()) > leaders:
                hot = True
                break
            x, y = num[at[i[ok]]], num[at[j[ok]]]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])
        if hot:
            yield _found(WAITS, num[:1], num[:1])
        elif pairs:
            p = np.concatenate(pairs)
            yield _found(NEW, p[:, 0], p[:, 1])

    def settle(found: list[np.ndarray], texts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs (place of the own text, number in the history) held against the history's sketches."""
        pairs = np.unique(np.concatenate(found), axis=0)[:, ::-1]  # by own text
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        gens = pairs[:, 0] >> (_SLOT_BITS + _ROW_BITS)
        for gen in np.unique(gens):
            mine = pairs[gens == gen]
            for rows, _ in blocks(f"{history}/sketches/gen={gen}", "num", mine[:, 0], ["num", *_WORDS]):
                num = ints(rows, "num")
                lo, hi = np.searchsorted(mine[:, 0], num[0], "left"), np.searchsorted(mine[:, 0], num[-1], "right")
                b, a = mine[lo:hi].T
                at = np.searchsorted(num, b)
                ok = (num[at] == b) & (sum(_off(texts[w][a], ints(rows, w)[at]) for w in _WORDS) <= likeness.SKETCH - likeness.SKETCH_AGREE)
                yield _found(OLD, texts["num"][a[ok]], b[ok])

    def before(bucket: int, key: np.ndarray, at: np.ndarray, texts: dict[str, np.ndarray], names: np.ndarray) -> Iterator[pa.RecordBatch]:
        read, held, found = 0, 0, []
        wanted = np.union1d(key, names[:, 0])
        runs, word = texts["runs"], texts["s0"]
        for folder in folders if len(wanted) else ():
            for old, size in blocks(f"{folder}/bucket={bucket}", "key", wanted, ["key", "num", "runs", "word"], 64):
                read += size
                o_key, o_num, o_runs, o_word = (ints(old, c) for c in ("key", "num", "runs", "word"))
                lo = np.searchsorted(key, o_key, "left")
                met = np.flatnonzero((key[np.minimum(lo, len(key) - 1)] == o_key) & (o_runs > 0)) if len(key) else lo[:0]
                for j, i in expand(lo[met], np.searchsorted(key, o_key[met], "right") - lo[met]):
                    i, j = at[i], met[j]
                    ok = np.flatnonzero(_sizes_agree(runs[i], o_runs[j]))
                    ok = ok[_off(word[i[ok]], o_word[j[ok]]) <= 64 - likeness.WORD_AGREE]
                    if len(ok):
                        found.append(np.stack([i[ok], o_num[j[ok]]], axis=1))
                        held += len(ok)
                if held > 4_000_000:
                    yield from settle(found, texts)
                    held, found = 0, []
                o_names = np.flatnonzero(o_runs == 0)
                lo, hi = np.searchsorted(names[:, 0], o_key[o_names], "left"), np.searchsorted(names[:, 0], o_key[o_names], "right")
                for j, i in expand(lo, hi - lo):
                    same = names[i, 1] == o_word[o_names[j]]
                    yield _found(NAME, names[i[same], 0], names[i[same], 1])
        if found:
            yield from settle(found, texts)
        yield _found(READ, np.array([bucket]), np.array([read]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (int(t) for batch in batches for t in batch.column(0).to_pylist()):
            bucket, part = divmod(task, parts)
            key, at, texts = _bucket_rows(own, bucket, buckets, part, parts)
            if len(key):
                yield from within(key, at, texts)
            if folders:
                yield from before(bucket, key, at, texts, _bucket_names(nodes, bucket, buckets, part, parts))

    return find


def _prober(leaders: int):
    """Pairs among rows sorted by (bucket, key, ord) of which each key's first ``leaders`` meet all; the others wait."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, lambda t: ints(t, "bucket")):
            key, num, runs, *words = (ints(rows, c) for c in ("key", "num", "runs", *_WORDS))
            n = len(key)
            begins = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            sizes = np.diff(np.concatenate((begins, [n])))
            place = np.arange(n) - np.repeat(begins, sizes)
            left = np.repeat(begins + sizes, sizes) - np.arange(n) - 1
            for i, j in expand(np.arange(n) + 1, np.where(place < leaders, left, 0)):
                ok = _alike(runs, words, i, j)
                a, b = num[i[ok]], num[j[ok]]
                yield _found(NEW, np.minimum(a, b)[a != b], np.maximum(a, b)[a != b])
            late = num[place >= leaders]
            yield _found(WAITS, late, late)

    return probe


def _texts(folder: str, wanted: np.ndarray) -> pa.Table | None:
    """The wanted texts of one writing task, in the order of their numbers."""
    parts = []
    for rows, _ in blocks(folder, "num", wanted, ["num", "text"], 64):
        parts.append(rows.filter(pa.array(np.isin(ints(rows, "num"), wanted))))
    return pa.concat_tables(parts).sort_by("num") if parts else None


def _verifier(history: str):
    """Candidate pairs, sorted by the places of their texts, decided on the whole texts; other findings pass.

    The texts of a pair are read block by block, so no text is shuffled. LIKE rows name both
    texts of the batch, KNOWN rows the one that the history has.
    """
    slot = lambda n: n >> _ROW_BITS & (2**_SLOT_BITS - 1)

    def place(t: pa.Table) -> np.ndarray:
        return np.where(ints(t, "kind") <= NEW, (ints(t, "b") >> _ROW_BITS << _SLOT_BITS) + slot(ints(t, "a")), -1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # runs of texts by number; the batch's own meet many places of the history
        for at, rows in grouped(batches, place):
            kind, a, b = (ints(rows, c) for c in ("kind", "a", "b"))
            if at < 0:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], schema=_FOUND)
                continue
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            old, (a, b) = int(kind[0]) == OLD, pairs.T
            x, y = (_texts(f"{history}/texts/gen={int(n[0] >> (_ROW_BITS + _SLOT_BITS))}/slot={slot(int(n[0]))}", np.unique(n)) for n in (a, b))
            if x is None or y is None:
                raise ValueError("the store has keys of a text that it does not have")
            i, j = np.searchsorted(ints(x, "num"), a), np.searchsorted(ints(y, "num"), b)
            left, right, keep = x.column("text"), y.column("text"), np.zeros(len(a), bool)
            for n in range(len(a)):
                if len(seen) > 20_000:
                    seen.clear()
                one, two = (seen[k] if k in seen else seen.setdefault(k, likeness.run_hashes(c[at].as_py())) for k, c, at in ((int(a[n]), left, int(i[n])), (int(b[n]), right, int(j[n]))))
                keep[n] = likeness.like_runs(one, two)
            yield _found(KNOWN, a[keep], a[keep]) if old else _found(LIKE, a[keep], b[keep])

    return verify


def _walker(met: str):
    """Walks through a batch's lines in their order; ``met`` has its like texts and what the history has."""
    out = pa.schema([("name", pa.string()), ("num", pa.int64()), ("line", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, list[int]] = {}
        names, known, blocked = set(), set(), set()
        started = False
        for batch in batches:
            if not started:
                started = True
                rows = _read(met, ["kind", "a", "b"])
                for kind, a, b in zip(*(rows.column(k).to_pylist() for k in ("kind", "a", "b")), strict=True) if rows is not None else ():
                    if kind == LIKE:
                        near.setdefault(a, []).append(b)
                        near.setdefault(b, []).append(a)
                    elif kind == KNOWN:
                        blocked.add(a)
                    elif kind == NAME:
                        known.add((a, b))
            keep = []
            for name, num, h, c in zip(*(batch.column(k).to_pylist() for k in ("name", "num", "h", "c")), strict=True):
                free = (name is None or (name not in names and (h, c) not in known)) and num not in blocked
                if free:
                    names |= {name} - {None}
                    blocked |= {num, *near.get(num, ())} - {None}
                keep.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in out.names], schema=out).filter(pa.array(keep, pa.bool_()))

    return walk


def _run_writer(own: str, kept: str, to: str, buckets: int, parts: int, block: int):
    """A bucket's keys of what was accepted, sorted, as a run's files; gives the number of rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (int(t) for batch in batches for t in batch.column(0).to_pylist()):
            bucket, part = divmod(task, parts)
            nums = _read(kept, ["num"])
            nums = np.unique(ints(nums.drop_null(), "num")) if nums is not None else np.empty(0, np.int64)
            key, at, texts = _bucket_rows(own, bucket, buckets, part, parts, nums)
            names = _bucket_names(kept, bucket, buckets, part, parts)
            n, rows = len(names), len(key) + len(names)
            if rows:
                keys = np.concatenate([key, names[:, 0]])
                order = np.argsort(keys, kind="stable")
                table = pa.table({
                    "key": keys[order],
                    "num": np.concatenate([texts["num"][at], np.full(n, -1)])[order],
                    "runs": np.concatenate([texts["runs"][at], np.zeros(n, np.int64)]).astype(np.int32)[order],
                    "word": np.concatenate([texts["s0"][at], names[:, 1]])[order],
                })
                with file_writer(f"{to}/bucket={bucket}/part-{part}.parquet") as out:
                    out(table, max(1, block // _ROW))
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows])})

    return write


def _merger(runs: list[str], to: str, block: int):
    """A bucket's rows of several runs as one, in slices of keys that a task can hold."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in (int(t) for batch in batches for t in batch.column(0).to_pylist()):
            rows = 0
            with file_writer(f"{to}/bucket={bucket}/part-0.parquet") as out:
                for table in merged_slices([f"{r}/bucket={bucket}" for r in runs], "key"):
                    out(table, max(1, block // _ROW))
                    rows += len(table)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows])})

    return merge


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join at every size: nothing of a batch goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def _name_key(column: str):
    named = lambda salt: F.when(F.col(column).isNotNull(), F.xxhash64(F.lit(salt), column))
    return named("name"), named("check")


class AcceptedIndex:
    """See the module. ``buckets`` is fixed when the store is made; a task holds a bucket's keys of one batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, block: int = BLOCK, leaders: int = LEADERS, one_task: int = ONE_TASK):
        self.spark, self.path, self.block, self.leaders, self.one_task = spark, path.rstrip("/"), block, leaders, one_task
        self.manifest = Manifest(spark, path)
        self.state = self.manifest.read() or {"buckets": buckets, "next": 0, "runs": []}
        self.buckets = self.state["buckets"]

    def ingest(self, batches: list[DataFrame], order: list[str], line_id: str, name: str, scope: str, text: str, measure: bool = False) -> DataFrame:
        """(line id, accepted) of every line of the batches, which are taken in one after another.

        Each batch is probed, judged and committed for itself; what concerns a batch alone
        (texts, signatures, keys) is made ready ahead, while others are judged.
        With ``measure`` the bytes of keys that each probe read are left in ``bytes_read``.
        """
        first, self.bytes_read = self.state["next"], []
        scratches = [Scratch(self.spark) for _ in batches]
        try:
            # Each Python thread has a thread of the JVM for good: one pool for all batches.
            with ThreadPoolExecutor(AHEAD) as pool:
                start = lambda i: pool.submit(self._prepare, scratches[i], batches[i], first + i, order, line_id, name, scope, text)
                ready = {i: start(i) for i in range(min(AHEAD, len(batches)))}
                for i, tmp in enumerate(scratches):
                    batch = ready.pop(i).result()
                    if i + AHEAD < len(batches):
                        ready[i + AHEAD] = start(i + AHEAD)
                    self._take(tmp, first + i, *batch, measure)
                    tmp.__exit__()
        finally:
            for tmp in scratches:
                tmp.__exit__()
        gens = range(first, first + len(batches))
        out = self.judged(*gens) if batches else self.judged().limit(0)
        return out.select(F.col("line").alias(line_id), "accepted")

    def _prepare(self, tmp: Scratch, lines: DataFrame, gen: int, order: list[str], line_id: str, name: str, scope: str, text: str) -> tuple:
        """(nodes and their folder, the folder of the texts' keys, the number of nodes and of texts)."""
        plain = likeness.plain(F.col(text))
        rows = lines.select(
            F.struct(*(F.col(c) for c in order)).alias("ord"), F.col(line_id).alias("line"), F.col(name).alias("name"), F.col(scope).alias("scope"),
            F.when(F.length(plain) >= likeness.RUN, plain).alias("text"),
        )
        rows = rows.withColumn("tid", F.when(F.col("text").isNotNull(), likeness.text_id(F.col("scope"), F.col("text"))))
        # A nameless line without a text can't conflict; it keeps its own number so that none is merged.
        lone = F.when(F.col("name").isNull() & F.col("tid").isNull(), F.col("line"))
        nodes = rows.withColumn("lone", lone).groupBy("name", "tid", "lone").agg(F.min(F.struct("ord", "line")).alias("first"), F.first(F.xxhash64("scope")).alias("scope"), F.first("text").alias("text"))
        h, c = _name_key("name")
        nodes, nodes_at = tmp.written(nodes.select("name", "tid", "first.ord", "first.line", "scope", "text", h.alias("h"), c.alias("c")), "nodes"), tmp.paths[-1]
        own = tmp.path("keys")
        texts = nodes.where("tid is not null").groupBy("tid").agg(F.first("scope").alias("scope"), F.first("text").alias("text")).sortWithinPartitions("tid")
        texts = tmp.written(texts.mapInArrow(_describer(gen, own, self.path, self.block), "tid binary, num bigint"), "texts")
        lines.select(F.col(line_id).alias("line")).write.mode("overwrite").parquet(f"{self.path}/lines/gen={gen}")
        size, distinct = nodes.select(F.col("tid").isNotNull().alias("x")).agg(F.count("*"), F.count_if("x")).first()
        nodes = _join(nodes.select("name", "tid", "ord", "line", "h", "c"), texts, "tid", "left").drop("tid")
        return nodes, nodes_at, own, size, distinct

    def _by_bucket(self, work, out: str, parts: int = 1) -> DataFrame:
        """``work`` in a task for each part of each bucket."""
        n = self.buckets * parts
        return self.spark.range(0, n, 1, n).mapInArrow(work, out)

    def _verified(self, tmp: Scratch, found: DataFrame) -> DataFrame:
        """Findings with their candidates decided: kind, a, b."""
        # As many tasks as buckets: candidates are few bytes, but each stands for two texts.
        found = found.repartition(self.buckets, F.shiftright("b", _ROW_BITS), F.shiftright("a", _ROW_BITS))
        found = found.withColumn("p", F.col("kind") > NEW).sortWithinPartitions("p", F.shiftright("b", _ROW_BITS), F.shiftright("a", _ROW_BITS)).drop("p")
        return tmp.written(found.mapInArrow(_verifier(self.path), "kind int, a bigint, b bigint"), "found")

    def _take(self, tmp: Scratch, gen: int, nodes: DataFrame, nodes_at: str, own: str, size: int, distinct: int, measure: bool) -> None:
        """Judges a prepared batch against the history and within itself, and commits it."""
        parts = max(1, -(-distinct // TASK_TEXTS))
        finder = _finder(own, nodes_at, self.path, [r["path"] for r in self.state["runs"]], self.buckets, parts, self.leaders)
        met = self._verified(tmp, self._by_bucket(finder, "kind int, a bigint, b bigint", parts))
        met_at = tmp.paths[-1]
        kind = lambda k: F.col("kind") == k
        links, hot, read = met.agg(F.count("*"), F.count_if(kind(WAITS)), F.sum(F.when(kind(READ), F.col("b")))).first()
        if measure and self.state["runs"]:
            self.bytes_read.append(read or 0)
        kept_at, columns = f"{self.path}/accepted/gen={gen}", ["name", "num", "line", "h", "c"]
        if not hot and size + links <= self.one_task:
            rows = nodes.withColumn("one", F.lit(0)).repartition(1, "one").sortWithinPartitions("ord").select(*columns)
            kept = rows.mapInArrow(_walker(met_at), "name string, num bigint, line bigint, h bigint, c bigint")
        else:
            known = met.where(kind(KNOWN)).select(F.col("a").alias("num")).distinct()
            names = met.where(kind(NAME)).select(F.col("a").alias("h"), F.col("b").alias("c")).distinct()
            todo = tmp.written(_join(_join(nodes, known, "num", "left_anti"), names, ["h", "c"], "left_anti"), "unknown")
            near, accepted = (self._led(tmp, todo, own) if hot else met), []
            while True:
                both = near.where(kind(LIKE)).select(F.col("a").alias("t"), F.col("b").alias("u"))
                both = both.unionByName(both.select(F.col("u").alias("t"), F.col("t").alias("u")))
                waits = near.where(kind(WAITS)).select(F.col("a").alias("num"), F.lit(True).alias("waits")).distinct()
                won, todo = _greedy(tmp, todo, both, waits)
                accepted.append(won.select(*columns))
                if todo is None:
                    break
                # What waited behind leaders meets its like: among themselves only, as the leaders' links are complete.
                near = self._led(tmp, todo, own)
            kept = reduce(DataFrame.unionByName, accepted)
        kept.write.mode("overwrite").parquet(kept_at)
        self._commit(gen, own, kept_at, parts)

    def judged(self, *gens: int) -> DataFrame:
        """(line, accepted) of the named ingests, or of all."""
        gens = gens or tuple(range(self.state["next"]))
        if not gens:
            return self.spark.createDataFrame([], "line bigint, accepted boolean")
        read = lambda part: self.spark.read.schema("line bigint, gen int").option("basePath", f"{self.path}/{part}").parquet(*(f"{self.path}/{part}/gen={g}" for g in gens))
        accepted = read("accepted").select("gen", "line").distinct().withColumn("accepted", F.lit(True))
        return read("lines").distinct().join(accepted, ["gen", "line"], "left").select("line", F.coalesce("accepted", F.lit(False)).alias("accepted"))

    def _led(self, tmp: Scratch, todo: DataFrame, own: str) -> DataFrame:
        """Links of the texts in ``todo`` of which each key's earliest meet all, verified, and those that wait behind them."""
        first = todo.where("num is not null").groupBy("num").agg(F.min("ord").alias("ord"))
        bands = [f"k{i}" for i in range(likeness.BANDS)]
        schema = ", ".join(["num bigint", "runs int", *(f"{c} bigint" for c in [*_WORDS, *bands])])
        texts = _join(self.spark.read.schema(schema).parquet(own), first, "num")
        rows = texts.select("num", "runs", *_WORDS, "ord", F.posexplode(F.array(*bands)).alias("band", "key"))
        rows = rows.withColumn("bucket", (F.col("band") % self.buckets).cast("int")).repartition("bucket", F.col("key") % 16).sortWithinPartitions("bucket", "key", "ord")
        return self._verified(tmp, rows.select("bucket", "key", "num", "runs", *_WORDS).mapInArrow(_prober(self.leaders), "kind int, a bigint, b bigint"))

    def _commit(self, gen: int, own: str, kept_at: str, parts: int) -> None:
        run = f"{self.path}/keys/run-{gen}-0"
        rows = self._by_bucket(_run_writer(own, kept_at, run, self.buckets, parts, self.block), "rows bigint", parts).agg(F.sum("rows")).first()[0]
        runs, merged = [*self.state["runs"], {"path": run, "level": 0, "rows": rows}], []
        while tail := merge_due([r for r in runs if r["rows"] < LARGE]):
            level = tail[0]["level"] + 1
            to = f"{self.path}/keys/run-{gen}-{level}"
            rows = self._by_bucket(_merger([r["path"] for r in tail], to, self.block), "rows bigint").agg(F.sum("rows")).first()[0]
            merged += [r["path"] for r in tail]
            runs = [r for r in runs if r not in tail] + [{"path": to, "level": level, "rows": rows}]
        self.state = {"buckets": self.buckets, "next": gen + 1, "runs": runs}
        self.manifest.commit(self.state)
        for path in merged:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)


def _greedy(tmp: Scratch, todo: DataFrame, links: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Accepted nodes (name, num, ord, line, h, c) in the greedy order by ``ord``, and those that can't be decided yet.

    ``links`` has both directions of like texts. A node whose text ``waits`` can be
    refused but not accepted. Each round is written and shrinks the undecided.
    """
    todo = _join(todo.select("name", "num", "ord", "line", "h", "c"), waits, "num", "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
    done: DataFrame | None = None
    while True:
        state = tmp.written(_round(todo, links), "round")
        won, lost = state.where("wins").drop("wins", "waits"), state.where("not wins")
        done = won if done is None else done.unionByName(won)
        n_won, n_lost = state.agg(F.count_if("wins"), F.count_if(~F.col("wins"))).first()
        if not n_lost:
            return done, None
        if not n_won:
            return done, lost.drop("waits", "wins")
        todo = _undecided(state, links)


def _round(todo: DataFrame, links: DataFrame) -> DataFrame:
    """``todo`` with ``wins``: the node comes before all undecided nodes it conflicts with."""
    by_text = todo.where("num is not null").groupBy("num").agg(F.min("ord").alias("text_first"))
    by_link = links.join(by_text.select(F.col("num").alias("u"), "text_first"), "u").groupBy(F.col("t").alias("num")).agg(F.min("text_first").alias("link_first"))
    by_name = todo.where("name is not null").groupBy("name").agg(F.min("ord").alias("name_first"))
    seen = todo.join(by_text.join(by_link, "num", "left"), "num", "left").join(by_name, "name", "left")
    not_after = lambda c: F.col(c).isNull() | (F.col("ord") <= F.col(c))
    wins = ~F.col("waits") & not_after("text_first") & not_after("link_first") & not_after("name_first")
    return seen.select("name", "num", "ord", "line", "h", "c", "waits", wins.alias("wins"))


def _undecided(state: DataFrame, links: DataFrame) -> DataFrame:
    """What the winners of a round leave undecided."""
    won, lost = state.where("wins"), state.where("not wins").drop("wins")
    taken = won.where("num is not null").select("num").distinct()
    near = links.join(taken.withColumnRenamed("num", "u"), "u", "left_semi").select(F.col("t").alias("num"))
    names = won.where("name is not null").select("name").distinct()
    return lost.join(taken.unionByName(near).distinct(), "num", "left_anti").join(names, "name", "left_anti")
