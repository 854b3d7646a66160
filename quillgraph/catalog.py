"""Graphs as a catalog of DataFrames, one per (graph, predicate, subject type, object type), permanent and transient."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise
from .terms import VOCAB, native

#: The name of the default graph in the catalog, and the IRI that stands for it.
DEFAULT = ""
DEFAULT_IRI = VOCAB + "DefaultGraph"

Key = tuple[str, str, str, str]


@dataclass
class Origin:
    """How a part comes from a mapped table: several parts of one row need no join when the subject is unique."""

    table: int
    frame: DataFrame
    subject: Column
    object: Column
    subject_key: tuple[str, str] | None = None  # IRI prefix, column
    object_key: tuple[str, str] | None = None
    unique: bool = False
    total: bool = False  # subject and object are never null


@dataclass
class Part:
    """(subject, object) rows, a set."""

    df: DataFrame
    origin: Origin | None = None


@dataclass
class Entry:
    permanent: list[Part] = field(default_factory=list)
    transient: list[Part] = field(default_factory=list)


def graph_name(graph: str | None) -> str:
    return DEFAULT if graph in (None, DEFAULT_IRI) else graph


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entries: dict[Key, Entry] = {}

    def parts(self, graph: str, predicate: str | None, transient: bool = True) -> Iterator[tuple[Key, Part]]:
        for key, entry in self.entries.items():
            if key[0] == graph and predicate in (None, key[1]):
                for part in entry.permanent + (entry.transient if transient else []):
                    yield key, part

    def graphs(self) -> list[str]:
        return sorted({k[0] for k in self.entries} - {DEFAULT})

    def predicates(self, graph: str, transient: bool = True) -> list[str]:
        return sorted({k[1] for k, _ in self.parts(graph, None, transient)})

    def rows(self, key: Key, transient: bool = True) -> DataFrame | None:
        entry = self.entries.get(key)
        frames = [p.df for p in (entry.permanent + (entry.transient if transient else []) if entry else [])]
        out = frames[0] if frames else None
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def insert(self, key: Key, df: DataFrame, transient: bool = False, origin: Origin | None = None, unlike: bool = False) -> DataFrame:
        """Add (subject, object) rows; returns those that are new. Nothing runs where the key was empty.

        A graph is a set: rows are made distinct (a mapped table whose subject is unique is already, and ``unlike`` rows are) and
        kept apart from what is there. A transient triple that becomes permanent is no longer transient.
        """
        s, o = native(key[2]), native(key[3])
        if origin is None:
            kind = df.schema["object"].dataType
            keep = kind.typeName() in ("timestamp_ntz", "array")
            df = df.select(F.col("subject").cast(s).alias("subject"), (F.col("object") if keep else F.col("object").cast(o)).alias("object")).where("subject IS NOT NULL AND object IS NOT NULL")
        if not unlike and (origin is None or not origin.unique):
            df = df.distinct()
        entry = self.entries.setdefault(key, Entry())
        against = entry.permanent + (entry.transient if transient else [])
        if against:
            old = against[0].df
            for p in against[1:]:
                old = old.unionByName(p.df)
            df, origin = materialise(df.join(old, ["subject", "object"], "left_anti")), None
        if entry.transient and not transient:
            left = entry.transient[0].df
            for p in entry.transient[1:]:
                left = left.unionByName(p.df)
            entry.transient = [Part(materialise(left.join(df, ["subject", "object"], "left_anti")))]
        (entry.transient if transient else entry.permanent).append(Part(df, origin))
        return df

    def delete(self, key: Key, df: DataFrame) -> None:
        entry = self.entries.get(key)
        if entry is None:
            return
        gone = df.select(F.col("subject").cast(native(key[2])).alias("subject"), "object")
        for name in ("permanent", "transient"):
            parts = getattr(entry, name)
            if parts:
                old = parts[0].df
                for p in parts[1:]:
                    old = old.unionByName(p.df)
                setattr(entry, name, [Part(materialise(old.join(gone, ["subject", "object"], "left_anti")))])

    def truncate(self, graph: str) -> None:
        self.entries = {k: e for k, e in self.entries.items() if k[0] != graph}

    def size(self, graph: str | None = None) -> int:
        """Permanent triples."""
        counts = [p.df.count() for k, e in self.entries.items() if graph in (None, k[0]) for p in e.permanent]
        return sum(counts)

    def compact(self) -> None:
        """One part per key and kind, its files sorted by subject so that row groups can be skipped."""
        for entry in self.entries.values():
            for name in ("permanent", "transient"):
                parts = getattr(entry, name)
                if len(parts) > 1:
                    df = parts[0].df
                    for p in parts[1:]:
                        df = df.unionByName(p.df)
                    setattr(entry, name, [Part(materialise(df.repartitionByRange("subject").sortWithinPartitions("subject", "object")))])

    def save(self, folder: str) -> None:
        """A Parquet table per key, sorted by subject, and a manifest."""
        manifest = []
        for i, key in enumerate(sorted(self.entries)):
            df = self.rows(key, transient=False)
            if df is not None:
                df.sortWithinPartitions("subject", "object").write.mode("overwrite").parquet(f"{folder}/part-{i}")
                manifest.append({"key": key, "path": f"part-{i}"})
        rows = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    def load(self, folder: str) -> None:
        for entry in json.loads(self.spark.read.text(f"{folder}/manifest", wholetext=True).first()[0]):
            self.entries.setdefault(tuple(entry["key"]), Entry()).permanent.append(Part(self.spark.read.parquet(f"{folder}/{entry['path']}")))
