"""Ledger documents: reading with a bound hash, schemas, and publishing that leaves no half result."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import shutil
import tempfile
from pathlib import Path
from urllib.parse import quote

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.require import Violation

NAME = re.compile(r"[a-z][a-z0-9_-]{0,63}")


def read_json(spark: SparkSession, path: str, schema: str, kind: str | None = None, version: int | None = None, sha256: str | None = None) -> DataFrame:
    """JSON objects, one a file, of a fixed schema. A wrong kind, version or hash aborts; so does text that is no such object."""
    raw = spark.read.text(path, wholetext=True)
    checks = []
    if sha256:
        checks.append((F.sha2("value", 256) == sha256, "the file is not the one that was bound"))
    doc = raw.withColumn("doc", F.from_json("value", schema, {"mode": "FAILFAST"}))
    if kind:
        checks.append((F.col("doc.kind") == kind, f"the document is no {kind}"))
    if version is not None:
        checks.append((F.col("doc.schema_version") == version, f"the schema version is not {version}"))
    for ok, message in checks:
        doc = doc.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return doc.select("doc.*")


def read_yaml(path: str, **kinds: type) -> dict:
    """A YAML mapping whose named keys have the given types (a bool is no number)."""
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    if not isinstance(doc, dict):
        raise Violation(f"{path} is no mapping")
    for key, kind in kinds.items():
        value = doc.get(key)
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            raise Violation(f"{path}: {key} is no {kind.__name__}")
    return doc


def artifact(root: Path, strategy: str) -> Path:
    """The file of a strategy below a run's folder; names that could leave it are refused."""
    if not NAME.fullmatch(strategy):
        raise Violation(f"no strategy name: {strategy!r}")
    path = (root / "strategies" / f"{strategy}.json").resolve()
    if root.resolve() not in path.parents:
        raise Violation("the path leaves the run's folder")
    return path


def publish(target: Path, files: dict[str, bytes], inputs: dict[Path, str] | None = None) -> None:
    """Write files in a hidden folder, check that inputs still have their hashes, then rename it into place."""
    target = Path(target)
    for path in inputs or {}:
        if target.resolve() == path.resolve() or target.resolve() in path.resolve().parents or path.resolve() in target.resolve().parents:
            raise Violation("the output lies at or around an input")
    if target.exists():
        raise Violation(f"{target} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    hidden = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        for name, body in files.items():
            (hidden / name).parent.mkdir(parents=True, exist_ok=True)
            (hidden / name).write_bytes(body)
        for path, sha in (inputs or {}).items():
            if hashlib.sha256(path.read_bytes()).hexdigest() != sha:
                raise Violation(f"{path} has changed")
        if target.exists():
            raise Violation(f"{target} exists")
        os.rename(hidden, target)
    except BaseException:
        shutil.rmtree(hidden, ignore_errors=True)
        raise


def replace(path: Path, doc: dict) -> None:
    """Replace a status document in one step."""
    replace_bytes(path, document(doc))


def replace_bytes(path: Path, body: bytes) -> None:
    path = Path(path)
    hidden = path.with_name(f".{path.name}.{os.getpid()}")
    hidden.write_bytes(body)
    os.replace(hidden, path)


class Fields:
    """Typed access to a JSON object: a value of another kind is a violation that names its place."""

    def __init__(self, value: object, place: str = "document"):
        if not isinstance(value, dict):
            raise Violation(f"{place} is no object")
        self.value, self.place = value, place

    def _get(self, key: str, ok: bool, kind: str) -> object:
        if not ok:
            raise Violation(f"{self.place}.{key} is no {kind}")
        return self.value[key]

    def fields(self, key: str) -> Fields:
        return Fields(self.value.get(key), f"{self.place}.{key}")

    def items(self, key: str) -> list:
        return self._get(key, isinstance(self.value.get(key), list), "list")

    def number(self, key: str) -> float:
        v = self.value.get(key)
        return float(self._get(key, isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v), "finite number"))

    def integer(self, key: str) -> int:
        v = self.value.get(key)
        return self._get(key, isinstance(v, int) and not isinstance(v, bool), "integer")

    def text(self, key: str) -> str:
        v = self.value.get(key)
        return self._get(key, isinstance(v, str) and bool(v.strip()), "text")

    def event(self, key: str, kind: str) -> str:
        """An event id as in visual-0001."""
        v = self.value.get(key)
        return self._get(key, isinstance(v, str) and bool(re.fullmatch(rf"{kind}-\d{{4,}}", v)), f"{kind} event")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Selected candidates of strategy documents, one JSON object a file, with what may be absent filled in."""
    item = "struct<sample_index:long,timestamp:double,score:double,reasons:array<string>,image_path:string,segment_id:string>"
    docs = read_json(spark, path, f"strategy string, selected array<{item}>")
    own = docs.select("strategy", F.explode("selected").alias("c")).select("strategy", "c.*")
    ok = F.col("sample_index").isNotNull() & F.col("timestamp").isNotNull()
    whole = own.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a candidate has no index or time")).cast("boolean")))
    return whole.withColumns({"score": F.coalesce("score", F.lit(0.0)), "reasons": F.coalesce("reasons", F.array().cast("array<string>"))})


def bind(**sides: DataFrame) -> None:
    """Raise unless all ledgers name the same sources with the same hashes.

    Each side is (video_id, and hashes in columns that end in _sha256); sides share the columns that
    they both have.
    """
    named = list(sides.items())
    for (a, left), (b, right) in zip(named, named[1:]):
        shared = [c for c in left.columns if c in right.columns and (c == "video_id" or c.endswith("_sha256"))]
        x, y = left.select(*shared).distinct(), right.select(*shared).distinct()
        if x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count():
            raise Violation(f"{a} and {b} are not of the same sources")


def same_speech(aligned: DataFrame, raw: DataFrame, columns: tuple[str, ...] = ("speech_id", "start_us", "end_us", "text")) -> None:
    """Raise unless aligned speech is the raw speech, row by row in time order."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start_us", "speech_id")
    own = [df.select("video_id", F.row_number().over(w).alias("n"), *columns) for df in (aligned, raw)]
    if own[0].exceptAll(own[1]).limit(1).count() or own[1].exceptAll(own[0]).limit(1).count():
        raise Violation("aligned speech is not the raw speech")


def document(doc: dict) -> bytes:
    return (json.dumps(doc, ensure_ascii=False, indent=2) + "\n").encode()


def markdown(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): one image line for each visual event, in time order, without recognised text."""
    line = F.concat(F.lit("!["), F.col("timecode"), F.lit("]("), relative_link(F.col("image_path")), F.lit(")"))
    own = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t_us", "event_id", line.alias("line")))).alias("x"))
    return own.select(*keys, F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("markdown"))


def relative_link(path: Column) -> Column:
    """Each element of a path percent-encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def link(path: str) -> str:
    return "/".join(quote(p) for p in path.split("/"))
