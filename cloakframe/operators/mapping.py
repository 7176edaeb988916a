"""Reversible pseudonyms: a mapping table (entity_type, original, pseudonym), unique both ways by type.

Minting is set-wise.  Each missing original tries its candidates in turn; among originals that draw the
same free candidate the first by (ord, original) gets it, and who finds none of five free takes the first
candidate with the next free suffix -1, -2, ...  Preview follows the same rule without writing.
A candidate that very many originals draw is spread over tasks: winners are picked by partial aggregation,
and suffixes are ranked by range partitions.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.functions.surrogates import pseudonym_candidate
from cloakframe.sources.files import Files
from cloakframe.sources.scratch import written

ATTEMPTS = 5
_SLOTS = 4096
SCHEMA = "entity_type string, original string, pseudonym string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def peek(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """requests with the pseudonym they have, or NULL."""
    return requests.join(mappings, ["entity_type", "original"], "left")


def reverse(aliases: DataFrame, mappings: DataFrame) -> DataFrame:
    """aliases (entity_type, pseudonym) with the original, or NULL."""
    return aliases.join(mappings, ["entity_type", "pseudonym"], "left")


def _ranked(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with _n, their place from 1 by order among the rows of the same keys; no key is held by one task."""
    own = ["_part", *keys]
    parts = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = parts.groupBy(*own).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*[F.col(c).alias(f"_of_{c}") for c in own], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    placed = parts.withColumn("_p", F.row_number().over(W.partitionBy(*own).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own]
    return placed.join(offsets, same).select(*rows.columns, (F.col("_o") + F.col("_p")).alias("_n"))


def _free_numbers(ranked: DataFrame, taken: DataFrame) -> DataFrame:
    """(entity_type, _base, _n, _free): the _n-th suffix that is not taken, for bases with taken suffixes."""
    base = ["entity_type", "_base"]
    pattern = "^(.*)-([0-9]{1,9})$"
    used = taken.select("entity_type", F.regexp_extract("pseudonym", pattern, 1).alias("_base"), F.regexp_extract("pseudonym", pattern, 2).alias("_s")).where("_s <> ''")
    used = used.select(*base, F.col("_s").cast("long").alias("_free")).distinct()
    asked = ranked.groupBy(*base).agg(F.max("_n").alias("_c")).join(used.groupBy(*base).agg(F.count(F.lit(1)).alias("_u")), base)
    chunks = asked.select(*base, (F.col("_c") + F.col("_u")).alias("_last"), F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") + F.col("_u") - 1) / _SLOTS))).alias("_k"))
    first = F.col("_k") * _SLOTS + 1
    slots = chunks.repartition(*base, "_k").select(*base, F.explode(F.sequence(first, F.least("_last", first + (_SLOTS - 1)))).alias("_free"))
    return _ranked(slots.join(used, [*base, "_free"], "left_anti"), base, "_free")


def mint(requests: DataFrame, mappings: DataFrame, candidate=pseudonym_candidate, attempts: int = ATTEMPTS) -> DataFrame:
    """New rows of the mapping for requests (entity_type, original, ord, and perhaps language) that aren't in it yet."""
    spoken = [F.min_by("language", "ord").alias("language")] if "language" in requests.columns else []
    asked = requests.groupBy("entity_type", "original").agg(F.min("ord").alias("ord"), *spoken)

    def drawn(k: int) -> Column:
        return candidate(F.col("entity_type"), F.col("original"), F.lit(k), *([F.col("language")] if spoken else []))

    left = written(asked.join(mappings, ["entity_type", "original"], "left_anti"), "unmapped")
    taken, made = mappings.select("entity_type", "pseudonym"), mappings.limit(0)
    for k in range(attempts):
        if left.isEmpty():
            return made
        tried = left.withColumn("pseudonym", drawn(k))
        firsts = tried.groupBy("entity_type", "pseudonym").agg(F.min(F.struct("ord", "original"))["original"].alias("original"))
        won = written(firsts.join(taken, ["entity_type", "pseudonym"], "left_anti").select("entity_type", "original", "pseudonym"), "minted")
        made = made.unionByName(won)
        taken = taken.unionByName(won.select("entity_type", "pseudonym"))
        left = written(left.join(won.select("entity_type", "original"), ["entity_type", "original"], "left_anti"), "unmapped")
    if left.isEmpty():
        return made
    base = left.withColumn("_base", drawn(0))
    ranked = written(_ranked(base, ["entity_type", "_base"], "ord", "original"), "ranked")
    free = _free_numbers(ranked, taken)
    number = F.coalesce("_free", "_n")
    ranked = ranked.join(free, ["entity_type", "_base", "_n"], "left")
    last = ranked.select("entity_type", "original", F.concat_ws("-", "_base", number.cast("string")).alias("pseudonym"))
    return made.unionByName(last)


def get_or_create(requests: DataFrame, mappings: DataFrame, candidate=pseudonym_candidate) -> tuple[DataFrame, DataFrame]:
    """(requests with their pseudonym, the mapping with what was minted)."""
    grown = mappings.unionByName(mint(requests, mappings, candidate))
    return requests.join(grown, ["entity_type", "original"], "left"), grown


def preview(requests: DataFrame, mappings: DataFrame, candidate=pseudonym_candidate) -> DataFrame:
    """What get_or_create would give; nothing is kept."""
    return get_or_create(requests, mappings, candidate)[0]


class MappingLocked(RuntimeError):
    """The store was not unlocked."""


class WrongPassphrase(ValueError):
    """The store can't be opened with this passphrase."""


class SessionOnlyStore:
    """A mapping that lives as long as its owner; nothing outlasts the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows, self._guard = spark, empty(spark), threading.RLock()

    is_unlocked = True

    def unlock(self, passphrase: str | None = None) -> None:
        """Always open."""

    def load(self) -> DataFrame:
        return self._rows

    def save(self, mappings: DataFrame) -> None:
        self._rows = written(mappings.select("entity_type", "original", "pseudonym"), "mapping")

    def get_or_create(self, requests: DataFrame, candidate=pseudonym_candidate) -> DataFrame:
        """requests with their pseudonym; what is new is kept."""
        with self._guard:
            named, grown = get_or_create(requests, self.load(), candidate)
            self.save(grown)
            return peek(named.drop("pseudonym"), self.load())


class EncryptedStore:
    """A mapping table on shared storage, its values sealed by AES-GCM with the header as authenticated data.

    The key is derived from a passphrase by scrypt on the driver; the salt and its parameters are the header.
    Writes go to a new version folder that becomes current by an atomic rename of a pointer file, one writer
    at a time: a lock file keeps others out from load to save.
    """

    N, R, P = 1 << 15, 8, 1

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files, self._key, self._header = spark, path.rstrip("/"), Files(spark), None, None

    def _derive(self, passphrase: str, salt: bytes) -> bytes:
        return hashlib.scrypt(passphrase.encode(), salt=salt, n=self.N, r=self.R, p=self.P, maxmem=1 << 26, dklen=32)

    def _pointer(self) -> str:
        return f"{self.path}/CURRENT"

    def _current(self) -> tuple[str, str]:
        """(version, salt)"""
        version, salt = self.files.read(self._pointer()).decode().split()
        return version, salt

    def locked(self):
        self.files.make(self.path)
        return self.files.locked(f"{self.path}/LOCK")

    def unlock(self, passphrase: str) -> None:
        with self.locked():
            if not self.files.exists(self._pointer()):
                self._begin(passphrase)
                self.save(empty(self.spark))
                return
            version, salt = self._current()
        self._header = f"cloakframe-1|{salt}|{self.N}|{self.R}|{self.P}"
        self._key = self._derive(passphrase, bytes.fromhex(salt))
        try:
            self._open(version).limit(1).collect()
        except Exception as e:
            self._key = None
            raise WrongPassphrase("wrong passphrase or damaged store") from e

    def _begin(self, passphrase: str) -> None:
        salt = os.urandom(16).hex()
        self._header = f"cloakframe-1|{salt}|{self.N}|{self.R}|{self.P}"
        self._key = self._derive(passphrase, bytes.fromhex(salt))

    def lock(self) -> None:
        self._key = None

    @property
    def is_unlocked(self) -> bool:
        return self._key is not None

    def _sealing(self):
        if self._key is None:
            raise MappingLocked("mapping store is locked")
        return F.lit(bytearray(self._key)), F.lit(self._header)

    def _open(self, version: str) -> DataFrame:
        key, header = self._sealing()
        rows = self.spark.read.schema("sealed binary").parquet(f"{self.path}/{version}")
        plain = F.aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), header.cast("binary")).cast("string")
        return rows.select(F.from_json(plain, SCHEMA).alias("m")).select("m.*")

    def load(self) -> DataFrame:
        self._sealing()
        version, salt = self._current()
        if salt != self._header.split("|")[1]:
            raise MappingLocked("the passphrase was changed: unlock the store again")
        return self._open(version)

    def save(self, mappings: DataFrame) -> None:
        """Replace the mapping; to add to it, use get_or_create, which nobody can come between."""
        key, header = self._sealing()
        version = os.urandom(8).hex()
        value = F.to_json(F.struct("entity_type", "original", "pseudonym")).cast("binary")
        with self.locked():
            mappings.select(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), header.cast("binary")).alias("sealed")).write.parquet(f"{self.path}/{version}")
            self.files.replace(self._pointer(), f"{version} {self._header.split('|')[1]}".encode())

    def get_or_create(self, requests: DataFrame, candidate=pseudonym_candidate) -> DataFrame:
        """requests with their pseudonym; what is new is stored, under the store's lock from load to save."""
        with self.locked():
            named, grown = get_or_create(requests, self.load(), candidate)
            self.save(grown)
        return peek(named.drop("pseudonym"), self.load())

    def rotate(self, old: str, new: str) -> None:
        """Open with the old passphrase; new salt and key; rewrite."""
        with self.locked():
            self.unlock(old)
            rows = self.load()  # its expressions hold the old key and header
            self._begin(new)
            self.save(rows)


def create_store(spark: SparkSession, session_only: bool = True, path: str | None = None) -> SessionOnlyStore | EncryptedStore:
    """The store that the settings ask for: one that leaves nothing behind, or an encrypted one at path, to be unlocked."""
    if session_only:
        return SessionOnlyStore(spark)
    if not path:
        raise ValueError("a store that lasts needs a path")
    return EncryptedStore(spark, path)
