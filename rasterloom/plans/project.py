"""Versions of pictures' graphs, with the journals of what was done since they were saved: two tables, and graphs built from their rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.node import EngineError
from rasterloom.plans.commands import Journal
from rasterloom.plans.graph import Graph

VERSIONS = "image string, version int, name string, graph string"
ENTRIES = "image string, version int, seq int, entry string"


@dataclass(frozen=True)
class Project:
    """versions (image, version, name, graph as JSON) and entries (image, version, seq, entry as JSON: do with a command, undo or redo). Updates return new projects."""

    versions: DataFrame
    entries: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Project:
        return Project(spark.createDataFrame([], VERSIONS), spark.createDataFrame([], ENTRIES))

    def _at(self, image: str, version: int):
        return (F.col("image") == image) & (F.col("version") == version)

    def load_graph(self, image: str, version: int) -> Graph:
        row = self.versions.filter(self._at(image, version)).select("graph").first()
        if row is None:
            raise EngineError(f"{image!r} has no version {version}")
        return Graph.from_json(row.graph)

    def save_graph(self, image: str, version: int, name: str, graph: Graph) -> Project:
        """A version's graph put in place; its journal, which led there, is cleared."""
        row = self.versions.sparkSession.createDataFrame([(image, version, name, graph.to_json())], VERSIONS)
        return replace(self, versions=self.versions.filter(~self._at(image, version)).unionByName(row)).clear_journal(image, version)

    def add_version(self, image: str, name: str, from_version: int) -> tuple[Project, int]:
        """A copy of a version's graph under the next number; versions are branches of their own."""
        graph = self.load_graph(image, from_version)
        new = self.versions.filter(F.col("image") == image).agg(F.max("version")).first()[0] + 1
        return self.save_graph(image, new, name, graph), new

    def log(self, image: str, version: int, *entries: tuple) -> Project:
        """Entries at the end of a version's journal: ("do", command), ("undo",) or ("redo",)."""
        last = self.entries.filter(self._at(image, version)).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = [(image, version, last + k, json.dumps(e)) for k, e in enumerate(entries, 1)]
        return replace(self, entries=self.entries.unionByName(self.entries.sparkSession.createDataFrame(rows, ENTRIES)))

    def clear_journal(self, image: str, version: int) -> Project:
        return replace(self, entries=self.entries.filter(~self._at(image, version)))

    def recover(self, image: str, version: int) -> Graph:
        """The graph that a version's saved graph and its journal lead to. One version's journal is read, in order."""
        journal = Journal(self.load_graph(image, version))
        for row in self.entries.filter(self._at(image, version)).orderBy("seq").toLocalIterator():
            what, *command = json.loads(row.entry)
            if what == "do":
                journal.apply(tuple(command[0]))
            elif what == "undo":
                journal.undo()
            else:
                journal.redo()
        return journal.graph

    def unsaved(self) -> DataFrame:
        """image, version, n of the versions whose journals hold entries."""
        return self.entries.groupBy("image", "version").agg(F.count(F.lit(1)).alias("n"))
