"""Tables whose versions one rename switches.

A catalog is a folder with table segments (Parquet folders that never change) and numbered manifests. A manifest names the
segments of every table, so all tables change together: a change first writes its new segments, which nobody reads yet,
then a manifest under a temporary name, and last renames it to the next number. A stop before the rename leaves the old
state, with some folders that sweep() clears; a writer that finds its number taken fails and can start again.

Rows are removed from large tables by notes: a segment carries the folders of keys that it no longer has, and a key that
comes back later is in a new segment without that note. merge() rewrites the segments that have notes, or only some buckets
of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.operators.rows import broadcast_if_small
from tessella.sources.stash import file_system


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Segment:
    """path: its folder; without: folders of removed keys; buckets: the only buckets that still count (None: all)."""

    path: str
    without: tuple[str, ...] = ()
    buckets: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    tables: dict[str, tuple[Segment, ...]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    settings: dict[str, int | str] = field(default_factory=dict)

    def to_json(self) -> str:
        tables = {n: [{"path": s.path, "without": list(s.without), "buckets": s.buckets and list(s.buckets)} for s in own] for n, own in self.tables.items()}
        return json.dumps({"version": self.version, "tables": tables, "schemas": self.schemas, "settings": self.settings}, sort_keys=True)

    @staticmethod
    def of_json(text: str) -> Manifest:
        found = json.loads(text)
        tables = {n: tuple(Segment(s["path"], tuple(s["without"]), s["buckets"] and tuple(s["buckets"])) for s in own) for n, own in found["tables"].items()}
        return Manifest(found["version"], tables, found["schemas"], found["settings"])


class Catalog:
    """on_step: called before each step of a change with its name (for tests of stops)."""

    def __init__(self, spark: SparkSession, root: str, on_step: Callable[[str], None] | None = None):
        self.spark, self.root, self.on_step = spark, root.rstrip("/"), on_step or (lambda step: None)

    def _files(self, folder: str) -> list[str]:
        fs, path = file_system(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        names = [n for n in self._files("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return Manifest()
        name = names[-1] if version is None else f"{version:012d}.json"
        fs, path = file_system(self.spark, f"{self.root}/manifests/{name}")
        stream = fs.open(path)
        try:
            size = fs.getFileStatus(path).getLen()
            text = bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()
        return Manifest.of_json(text)

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a table: each segment without its removed keys and dropped buckets."""
        manifest = manifest or self.manifest()
        schema = StructType.fromJson(json.loads(manifest.schemas[name]))
        parts: dict[tuple, list[str]] = {}
        for s in manifest.tables[name]:
            parts.setdefault((s.without, s.buckets), []).append(f"{self.root}/{s.path}")
        out = self.spark.createDataFrame([], schema)
        for (without, buckets), paths in parts.items():
            # bucket folders are under the segment, so several segments are read by one scan of their own roots
            rows = None
            for path in paths:
                own = self.spark.read.schema(schema).parquet(path)
                rows = own if rows is None else rows.unionByName(own)
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(*buckets))
            if without:
                gone = self.spark.read.parquet(*[f"{self.root}/{w}" for w in without]).distinct()
                rows = rows.join(broadcast_if_small(gone), gone.columns, "left_anti")
            out = out.unionByName(rows)
        return out

    def write(self, name: str, rows: DataFrame, by: str | None = None) -> str:
        """Write rows as a new folder that no manifest names yet."""
        path = f"{name}/{uuid.uuid4().hex}"
        self.on_step(f"write {name}")
        (rows.write.partitionBy(by) if by else rows.write).parquet(f"{self.root}/{path}")
        return path

    def commit(self, new: Manifest) -> Manifest:
        """Make new, whose version is that of its base, the next version."""
        new = replace(new, version=new.version + 1)
        fs, final = file_system(self.spark, f"{self.root}/manifests/{new.version:012d}.json")
        _, temporary = file_system(self.spark, f"{self.root}/manifests/_{uuid.uuid4().hex}")
        self.on_step("write manifest")
        stream = fs.create(temporary)
        stream.write(new.to_json().encode())
        stream.close()
        self.on_step("rename manifest")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {new.version} is there already")
        self.on_step("done")
        return new

    def append(self, base: Manifest, name: str, rows: DataFrame, by: str | None = None) -> Manifest:
        """base with a further segment of a table; takes effect by commit."""
        path = self.write(name, rows, by)
        schema = base.schemas.get(name) or rows.schema.json()
        return replace(base, tables=base.tables | {name: (*base.tables.get(name, ()), Segment(path))}, schemas=base.schemas | {name: schema})

    def overwrite(self, base: Manifest, name: str, rows: DataFrame, by: str | None = None) -> Manifest:
        """base with a table that has these rows only: for small tables."""
        path = self.write(name, rows, by)
        return replace(base, tables=base.tables | {name: (Segment(path),)}, schemas=base.schemas | {name: rows.schema.json()})

    def note(self, base: Manifest, names: list[str], folder: str) -> Manifest:
        """base, in which the present segments of these tables don't hold the keys in the folder any more."""
        noted = {n: tuple(replace(s, without=(*s.without, folder)) for s in base.tables.get(n, ())) for n in names}
        return replace(base, tables=base.tables | noted)

    def merge(self, base: Manifest, name: str, by: str | None = None, buckets: list[int] | None = None) -> Manifest:
        """base, in which a table's segments are one; with buckets, only these buckets are rewritten."""
        rows = self.table(name, base)
        if buckets is None:
            return self.overwrite(base, name, rows, by)
        if not buckets:
            return base
        path = self.write(name, rows.where(F.col("bucket").isin(*buckets)), by)
        every = range(int(base.settings["buckets"]))
        left = [replace(s, buckets=tuple(b for b in (every if s.buckets is None else s.buckets) if b not in buckets)) for s in base.tables[name]]
        return replace(base, tables=base.tables | {name: (*[s for s in left if s.buckets], Segment(path, (), tuple(sorted(buckets))))})

    def sweep(self) -> list[str]:
        """Delete the folders and manifests that the newest manifest doesn't need. Only while no older version is read."""
        now = self.manifest()
        needed = {p for own in now.tables.values() for s in own for p in (s.path, *s.without)}
        gone = []
        for top in self._files("."):
            for name in self._files(top):
                kept = f"{top}/{name}" in needed if top != "manifests" else name == f"{now.version:012d}.json"
                if not kept:
                    fs, path = file_system(self.spark, f"{self.root}/{top}/{name}")
                    fs.delete(path, True)
                    gone.append(f"{top}/{name}")
        return gone
