"""A graph of resolved links that is kept up as files come, change and go.

A link has candidates, names in order, and resolves to the first that some file provides. The store holds the reverse index candidate -> link. An
update parses only files that came or changed; from the names that stopped or began to be provided, the reverse index tells which links
of other files to resolve again. All other links stay as they are. Each version is written as a whole, so an update that is lost half way leaves the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import written
from codequarry.sources.versions import Versions


class KeptGraph:
    """Links of files(id, path, content), in a folder that driver and executors share.

    links_of(files) gives id, no (its number in the file), module and candidates (an array) of every link; names(path) the names that a file provides.
    Ids are different; null contents have no links; a file of which only the path changes counts as changed."""

    def __init__(self, spark: SparkSession, folder: str, links_of: Callable[[DataFrame], DataFrame], names: Callable[[Column], Column]):
        self.spark, self.versions, self.links_of, self.names = spark, Versions(spark, folder), links_of, names

    def _last(self, name: str, schema: str) -> DataFrame:
        n = self.versions.latest()
        return self.versions.read(n, name) if n else self.spark.createDataFrame([], schema)

    def update(self, files: DataFrame) -> dict[str, int]:
        """Make the graph that of files(id, path, content); tells files parsed and removed, links resolved and links left as they were."""
        now = written(files.select("id", "path", "content", F.md5(F.concat_ws("\0", "path", "content")).alias("hash")))
        kind = now.schema["id"].dataType.simpleString()
        before = self._last("files", f"id {kind}, path string, hash string")
        pair = now.select(F.col("id").alias("new_id"), F.col("path").alias("new_path"), F.col("hash").alias("new")).join(before.select(F.col("id").alias("old_id"), F.col("path").alias("old_path"), F.col("hash").alias("old")), F.col("new_id") == F.col("old_id"), "full")
        moved = written(pair.where("not (new <=> old)"))
        # names: how many files provide each, and which began or stopped to be provided
        come = moved.where("new_id is not null").select(F.explode(F.array_distinct(self.names(F.col("new_path")))).alias("name"), F.lit(1).alias("n"))
        go = moved.where("old_id is not null").select(F.explode(F.array_distinct(self.names(F.col("old_path")))).alias("name"), F.lit(-1).alias("n"))
        delta = come.union(go).groupBy("name").agg(F.sum("n").alias("by")).where("by <> 0")
        held = self._last("names", "name string, n long")
        counted = written(held.join(delta, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("n")))
        touched = counted.where("(was > 0) <> (n > 0)").select(F.col("name").alias("candidate"))
        # links of files that stay
        gone = moved.where("old_id is not null").select(F.col("old_id").alias("id"))
        stay = self._last("candidates", f"id {kind}, no int, place int, candidate string").join(gone, "id", "left_anti")
        links = self._last("links", f"id {kind}, no int, source string, module string, target string").join(gone, "id", "left_anti")
        again = written(stay.join(touched, "candidate", "left_semi").select("id", "no").distinct())
        # links of files that came or changed
        fresh = now.join(moved.where("new_id is not null").select(F.col("new_id").alias("id")), "id", "left_semi")
        parsed = written(self.links_of(fresh.select("id", "path", "content")).join(fresh.select("id", F.col("path").alias("source")), "id"))
        options = parsed.select("id", "no", F.posexplode("candidates").alias("place", "candidate"))
        provided = counted.where("n > 0").select(F.col("name").alias("candidate"))
        open_options = stay.join(again, ["id", "no"], "left_semi").select("id", "no", "place", "candidate").union(options)
        target = open_options.join(provided, "candidate").groupBy("id", "no").agg(F.min_by("candidate", "place").alias("target"))
        unresolved = links.join(again, ["id", "no"], "left_semi").select("id", "no", "source", "module").union(parsed.select("id", "no", "source", "module"))
        resolved = written(unresolved.join(target, ["id", "no"], "left").select("id", "no", "source", "module", "target"))
        kept = links.join(again, ["id", "no"], "left_anti").select("id", "no", "source", "module", "target")
        counts = {
            "files_parsed": fresh.count(), "files_removed": moved.where("new_id is null").count(), "links_resolved": resolved.count(), "links_kept": kept.count(),
        }
        self.versions.write(
            files=now.select("id", "path", "hash"), names=counted.where("n > 0").select("name", "n"),
            candidates=stay.select("id", "no", "place", "candidate").union(options), links=kept.union(resolved),
        )
        return counts

    def links(self) -> DataFrame:
        """id, no, source, module, target (null where no file provides a candidate)."""
        return self._last("links", "id long, no int, source string, module string, target string")
