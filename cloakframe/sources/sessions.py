"""Review sessions on shared storage: one folder per session, replaced atomically by its writer.

A session's manifest (session row, segments, proposals, decisions) is one JSON file, so that many are read
as one table; the input bytes stand beside it until they are shed.  Writing is the driver's; a lock per
session lets one writer at a time change it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.files import Files

_ID = re.compile(r"^[A-Za-z0-9_-]{1,64}$")
SCHEMA = (
    "session struct<session_id:string,source_path:string,format:string,status:string,default_operator:string,default_operator_params:map<string,string>,created_at:timestamp,committed_at:timestamp,salt:string>, "
    "segments array<struct<segment_id:string,text:string>>, "
    "proposals array<struct<ord:int,detection_id:string,entity_type:string,score:double,original:string,segment_anchor:string,start:int,end:int,group_id:string,group_index:int,group_original:string>>, "
    "decisions array<struct<ord:int,kind:string,proposal_id:string,status:string,id:string,segment_anchor:string,entity_type:string,original:string,start:int,end:int,operator:string,operator_params:map<string,string>,custom_replacement:string>>"
)


class SessionNotFound(KeyError):
    """No session of this id."""


class InputShed(RuntimeError):
    """The session's input bytes were dropped after its commit."""


class SessionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.files.make(self.root)

    def _folder(self, session_id: str) -> str:
        if not _ID.match(session_id):
            raise SessionNotFound(session_id)
        return f"{self.root}/{session_id}"

    def locked(self, session_id: str):
        """One load, change and save of a session at a time, in this process and others; may be nested."""
        return self.files.locked(f"{self._folder(session_id)}.lock")

    def save(self, manifest: dict, content: bytes | None = None) -> None:
        """Replace a session's manifest; the input bytes are written once."""
        folder = self._folder(manifest["session"]["session_id"])
        with self.locked(manifest["session"]["session_id"]):
            self.files.make(folder)
            if content is not None and not self.files.exists(f"{folder}/input.bin"):
                self.files.replace(f"{folder}/input.bin", content)
            self.files.replace(f"{folder}/manifest.json", json.dumps(manifest, default=str).encode())

    def load(self, session_id: str) -> dict:
        try:
            return json.loads(self.files.read(f"{self._folder(session_id)}/manifest.json"))
        except FileNotFoundError as e:
            raise SessionNotFound(session_id) from e

    def update(self, session_id: str, change: Callable[[dict], dict]) -> dict:
        """Load, change and save under the session's lock; what was saved."""
        with self.locked(session_id):
            manifest = change(self.load(session_id))
            self.save(manifest)
        return manifest

    def load_input(self, session_id: str) -> bytes:
        self.load(session_id)
        try:
            return self.files.read(f"{self._folder(session_id)}/input.bin")
        except FileNotFoundError as e:
            raise InputShed(session_id) from e

    def shed_input(self, session_id: str) -> None:
        self.files.delete(f"{self._folder(session_id)}/input.bin")

    def ids(self) -> list[str]:
        return [n for n in self.files.names(self.root) if _ID.match(n) and self.files.exists(f"{self.root}/{n}/manifest.json")]

    def delete(self, session_id: str) -> None:
        with self.locked(session_id):
            self.load(session_id)
            self.files.delete(self._folder(session_id))

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(sessions, segments, proposals, decisions) of all readable manifests."""
        files = self.spark.read.text(f"{self.root}/*/manifest.json", wholetext=True)
        parsed = files.select(F.from_json("value", SCHEMA).alias("m")).where("m.session.session_id is not null").select("m.*")
        each = lambda c: parsed.select(F.col("session.session_id").alias("session_id"), F.explode(c).alias("_x")).select("session_id", "_x.*")
        return parsed.select("session.*"), each("segments"), each("proposals"), each("decisions")
