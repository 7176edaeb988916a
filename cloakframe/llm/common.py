"""What the training-data operators share: tables, the shared scratch folder, tokens, folds.

Texts cross into Python as Arrow binary, so words are cut from UTF-8 bytes.  The separators of
the contracts (space, TAB..CR) are exactly those of ``bytes.split()``; lower-casing A-Z only is
exactly ``bytes.lower()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.scratch import written as written

_MULTIPLIER = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Own:
    """A caller's rows under names of our own (u0, u1, ...), so that no helper column (_x) can clash.

    ``own[name]`` is the name that a column of the caller has in ``own.df``; ``back`` restores the names.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"u{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        at = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not at:
            raise KeyError(f"no column {name!r} among {self.names}")
        return f"u{at[0]}"

    def all(self) -> list[str]:
        return self.df.columns

    def kept(self, outputs: Iterable[str] = (), keep: list[str] | None = None) -> list[str]:
        """Our names of the caller's columns (or of those in keep) but for those that outputs replace."""
        gone = {o.lower() for o in outputs}
        wanted = range(len(self.names)) if keep is None else [int(self[k][1:]) for k in keep]
        return [f"u{i}" for i in wanted if self.names[i].lower() not in gone]

    def back(self, df: DataFrame, outputs: dict[str, Column | str], keep: list[str] | None = None) -> DataFrame:
        """df's kept columns under the caller's names, then the outputs (name: column or its name in df)."""
        mine = [F.col(u).alias(self.names[int(u[1:])]) for u in self.kept(outputs, keep)]
        return df.select(*mine, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in outputs.items()])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; NULL ids give NULL."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    """Whether the row is held out; rows without an id are not."""
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items whose sizes add up to about most; a larger item is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        both = []
        for m in (_MULTIPLIER, inverse):
            t = np.full(size, m, np.uint64)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of many texts at once: 64-bit hashes, byte bounds in ``data`` and the text of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff(_IS_SPACE[b].astype(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _power_tables(len(b) + 1)
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(sizes)
        #: the first word of each text, and the number of words at last
        self.first = np.append(0, np.searchsorted(self.start, self.text_end))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def prefix(self, at: np.ndarray, k: int) -> np.ndarray:
        """Unmixed hashes of the first k bytes of the words at; those words have more than k bytes."""
        start = self.start[at]
        return (self._sums[start + k] - self._sums[start]) * self._inverse[start]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(_MULTIPLIER) + hashes[j : j + n]
    return mix(g)


def append_from_text(df: DataFrame, fields: str, compute: Callable[[list[bytes]], dict], text: str = "text", most: int = 4_000_000, drop: bool = False) -> DataFrame:
    """df (drop: without its text) with the columns that compute(texts) returns; input columns of the same names are replaced.

    compute gets at most about ``most`` bytes of whole texts at once (a longer text comes alone).
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in added} | ({text.lower()} if drop else set())
    kept = [f for f in df.schema if f.name.lower() not in names]
    arrow = to_arrow_schema(added)
    n_kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in names]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks([len(x) + 1 for x in texts], most):
                got = compute(texts[lo:hi])
                own = [batch.column(i).slice(lo, hi - lo) for i in n_kept]
                new = [x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(own + new, names=[f.name for f in kept] + arrow.names)

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def read_texts(own: Own, columns: list[str], fields: str, compute: Callable[[list[bytes]], dict], text: str, most: int = 4_000_000) -> DataFrame:
    """These columns of own with what compute finds in its texts; texts that aren't among them stay in Python."""
    body = own[text]
    return append_from_text(own.df.select(*dict.fromkeys([*columns, body])), fields, compute, body, most, drop=body not in columns)


def pack(text: bytes) -> bytes:
    """A text compressed for a shuffle (zstd, after its length)."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def with_packed(df: DataFrame, text: str) -> DataFrame:
    """df with its text column as packed bytes (NULL stays NULL)."""
    from pyspark.sql import types as T

    names = df.columns
    at = names.index(text)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if x is None else pack(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=names)

    return df.mapInArrow(run, schema)
