"""Likeness of texts: Jaccard similarity of their sets of five-character runs.

Only letters and digits count, in lower case. Texts are *like* at a likeness of at
least ``THRESHOLD``; a null text, or one that keeps fewer than five characters, is
like nothing.

Candidates come from minwise signatures (``features``), a 256-bit sketch of one
bit per signature position drops most false ones inside the JVM, and
``are_like`` decides on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 5
#: Likeness threshold as a fraction.
LIKE_NUM, LIKE_DEN = 3, 5
#: Signature positions; the first SKETCH of them give a bit each.
POSITIONS, SKETCH = 256, 256
#: Bits of 256 that must agree: at a likeness of 0.6 the mean is 204.8 and the standard deviation 6.4, so this is 4.7 deviations below.
SKETCH_AGREE = 175
#: The same for one word of 64: mean 51.2, deviation 3.2; a pair at exactly 0.6 stays under it with a probability of 3e-5.
WORD_AGREE = 38
#: The same for two words: mean 102.4, deviation 4.5; probability 2e-6.
TWO_AGREE = 81
#: Bands of the history index: 64 of 4 positions miss a pair at exactly 0.6 with a probability of 1.4e-4, at 0.65 of 3e-6.
BAND_ROWS, BANDS = 4, 64
#: Deletion variants: 22 segments of 5 positions, one of them wild; a pair at exactly 0.6 is missed with a probability of 1.2e-4, at 0.65 of 2e-6.
SEGMENT, SEGMENTS = 5, 22

_M = np.uint32(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = lambda n, bits=64: rng.integers(0, 2**bits, n, dtype=np.dtype(f"u{bits // 8}"))
    return draw(POSITIONS, 32) | np.uint32(1), draw(POSITIONS, 32), draw(POSITIONS) | np.uint64(1), draw(1024)


def plain(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def run_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of a plain text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(cp) - RUN + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = cp[:n].copy()
    for j in range(1, RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[j : j + n]
    return np.unique(_mix(h))


def signature(runs: np.ndarray) -> np.ndarray:
    """Minimum of each of POSITIONS hash functions of 32 bits; in blocks, so long texts need little memory."""
    a, b, _, _ = _constants()
    out, short = np.full(POSITIONS, _M), (runs >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        block = np.multiply.outer(short[at : at + 512], a)
        block += b
        np.minimum(out, block.min(axis=0), out=out)
    return out.astype(np.uint64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band of a signature."""
    _, _, c, k = _constants()
    terms = _mix(sig[: BANDS * BAND_ROWS] * c[: BANDS * BAND_ROWS]).reshape(BANDS, BAND_ROWS)
    return _mix(terms.sum(axis=1, dtype=np.uint64) + k[:BANDS])


def deletion_keys(sig: np.ndarray) -> np.ndarray:
    """For each segment the keys of its variants with one position left out."""
    _, _, c, k = _constants()
    n = SEGMENT * SEGMENTS
    terms = _mix(sig[:n] * c[:n]).reshape(SEGMENTS, SEGMENT)
    left = terms.sum(axis=1, dtype=np.uint64, keepdims=True) - terms
    return _mix(left.ravel() + k[200 : 200 + n])


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four words of 64 one-bit minima."""
    bits = (_mix(sig[:SKETCH]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(">i8")


def described(texts: pa.Array, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of runs, the sketch's four words, a key of 32 bits for each band) of plain texts; a text's keys are salted, so that only texts of one salt meet."""
    _, _, c, k = _constants()
    runs, sig = np.zeros(len(texts), np.int32), np.empty((len(texts), POSITIONS), np.uint64)
    for i, text in enumerate(texts.to_pylist()):
        own = run_hashes(text)
        runs[i], sig[i] = len(own), signature(own)
    words = np.packbits((_mix(sig[:, :SKETCH]) >> np.uint64(63)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
    n = BANDS * BAND_ROWS
    terms = _mix(sig[:, :n] * c[:n]).reshape(-1, BANDS, BAND_ROWS)
    keys = _mix(terms.sum(axis=2, dtype=np.uint64) + k[:BANDS])
    return runs, words, (_mix(keys ^ _mix(salts.view(np.uint64))[:, None]) & np.uint64(_M)).astype(np.int64)


_FEATURES = T.StructType(
    [
        T.StructField("runs", T.IntegerType()),
        *(T.StructField(f"s{i}", T.LongType()) for i in range(4)),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _features(keys):
    @F.pandas_udf(_FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, words, all_keys = [], [], []
            for text in texts:
                runs = run_hashes(text or "")
                sig = signature(runs)
                n.append(len(runs))
                words.append(sketch(sig).astype(np.int64))
                all_keys.append(keys(sig).view(np.int64))
            w = np.array(words, dtype=np.int64).reshape(len(n), 4)
            yield pd.DataFrame({"runs": np.array(n, dtype=np.int32), "s0": w[:, 0], "s1": w[:, 1], "s2": w[:, 2], "s3": w[:, 3], "keys": all_keys})

    return features


def band_features(text: Column) -> Column:
    return _features(band_keys)(text)


def deletion_features(text: Column) -> Column:
    return _features(deletion_keys)(text)


def like_runs(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return LIKE_DEN * both >= LIKE_NUM * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def are_like(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two plain texts are like, from their whole sets of runs."""
    for a, b in pairs:
        seen: dict[str, np.ndarray] = {}
        runs = lambda t: seen[t] if t in seen else seen.setdefault(t, run_hashes(t))  # noqa: B023, E731
        yield pd.Series([like_runs(runs(x), runs(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def text_id(*parts: Column) -> Column:
    """16 bytes of a SHA-256 over the parts."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32))


def may_be_like(a: str, b: str) -> Column:
    """Sizes and sketches of two aliased feature rows allow a likeness of the threshold."""
    agree = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    sizes = (LIKE_DEN * F.least(f"{a}.runs", f"{b}.runs")) >= (LIKE_NUM * F.greatest(f"{a}.runs", f"{b}.runs"))
    return sizes & (agree <= SKETCH - SKETCH_AGREE)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) whose texts are like.

    ``left`` and ``right`` have tid, runs, s0..s3, text, a row for each id. First
    the sketches (40 bytes a side) thin the pairs out, then texts are fetched. All joins are
    sort-merge joins: neither sketches nor texts go through the driver.
    """
    slim = ["tid", "runs", "s0", "s1", "s2", "s3"]
    near = (
        pairs.join(left.select(*slim).hint("merge").alias("x"), F.col("a") == F.col("x.tid"))
        .join(right.select(*slim).hint("merge").alias("y"), F.col("b") == F.col("y.tid"))
        .where(may_be_like("x", "y"))
        .select("a", "b")
    )
    texts = near.join(left.select(F.col("tid").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(right.select(F.col("tid").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return texts.where(are_like("text_a", "text_b")).select("a", "b")
