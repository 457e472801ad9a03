"""Processing only new or changed records.

A table is a sequence of immutable versions. A version's manifest lists the data files that belong
to it and the deletion vectors that hold the rows of these files which a later version deleted.
Between two versions only the manifests are compared: files that were added, files that were removed
and deletion vectors that are new give exactly the records to add and to take away; nothing else is
read.

:func:`replay` makes a feed of observations such a table, one version per run: every row goes to the
file of the first version that could see it and to the deletion vector of the first version that
sees a newer state of its key. :func:`process_steps` and :func:`process_new` bring an output up to a
source; the processed version is part of the output's own commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mneme.storage import materialize, scratch, ship

FEED = "source_path", "op", "content_hash", "seen_at", "landed_at", "feed_id"


def _first_at_least(value: Column, ascending: list) -> Column:
    """Number (from 1) of the first of ``ascending`` that is not below ``value``, one more than there are if all are: a binary search in the JVM."""
    places = F.array(*[F.lit(x) for x in ascending])
    halves = [1 << i for i in reversed(range(len(ascending).bit_length()))]
    step = lambda n, half: n + F.when((n + half <= len(ascending)) & (F.try_element_at(places, n + half) < value), half).otherwise(0)
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), step) + 1


def file_versions(feed: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of ``feed`` that carry a state, with ``added`` and ``deleted`` version numbers.

    ``versions`` has ``version`` (1, 2, ...) and ``at``; it is small by nature (one row per run) and
    is read by the driver. Per key and file only the newest row (greatest ``seen_at``, then
    ``feed_id``) can ever be live, so the shuffle carries at most one row per key and version, after
    combining on the map side: a key with a third of all rows is no hot spot. Upserts without a hash
    carry no state; rows without key, ``seen_at`` or ``landed_at`` cannot be placed and are left out.
    ``deleted`` is null while the row is live in the last version.
    """
    at = [r["at"] for r in versions.where("at is not null").orderBy("version").collect()]
    gone = F.col("op") == "delete"
    states = feed.where(
        F.col("source_path").isNotNull() & F.col("seen_at").isNotNull() & F.col("landed_at").isNotNull() & (gone | F.col("content_hash").isNotNull())
    ).select(
        "source_path", (_first_at_least(F.col("landed_at"), at) if at else F.lit(1)).alias("added"),
        F.struct("seen_at", "feed_id", gone.alias("gone"), F.lower("content_hash").alias("content_hash")).alias("state"),
    )
    newest = states.where(F.col("added") <= len(at)).groupBy("source_path", "added").agg(F.max("state").alias("state"))
    newer = Window.partitionBy("source_path").orderBy(F.desc("state"), "added").rowsBetween(Window.unboundedPreceding, -1)
    files = newest.withColumn("deleted", F.min("added").over(newer))
    return files.where("deleted is null or deleted > added").select("source_path", "added", "deleted", "state.gone", "state.content_hash")


def successful_versions(runs: DataFrame) -> DataFrame:
    """Version numbers for the successful runs in order of their start: ``version, at, run_no``.

    The list of runs is small by nature: one row per run of the pipeline.
    """
    spark = runs.sparkSession
    rows = runs.where("status = 'success' and started_at is not null").select("run_no", "started_at").distinct().collect()
    rows.sort(key=lambda r: (r["started_at"], r["run_no"]))
    data = [(i + 1, r["started_at"], r["run_no"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "version int, at timestamp, run_no int")


def replay(feed: DataFrame, versions: DataFrame, table: "ManifestTable") -> None:
    """Make ``table``, empty so far, the history of ``feed``: rows ``source_path, gone, content_hash``, one version per row of ``versions``."""
    table.load(file_versions(feed, versions), "added", "deleted", versions.count())


def changed_states(steps: DataFrame) -> DataFrame:
    """Records new or changed from each version to the next: ``version, source_path, content_hash``.

    A record is a change if its added row is present and the removed one, if any, was absent or had
    another hash (case ignored).
    """
    state = F.struct("gone", "content_hash")
    deltas = steps.groupBy("version", "source_path").agg(
        F.max(F.when(F.col("change") == "+", state)).alias("plus"), F.max(F.when(F.col("change") == "-", state)).alias("minus")
    )
    before = F.col("minus.content_hash")
    changed = ~F.col("plus.gone") & (F.col("minus").isNull() | F.col("minus.gone") | ~before.eqNullSafe(F.col("plus.content_hash")))
    return deltas.where(F.col("plus").isNotNull() & changed).select("version", "source_path", F.col("plus.content_hash").alias("content_hash"))


def run_changes(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """What each successful run must handle: ``run_no, source_path, content_hash``.

    The feed becomes a manifest table in the shared folder; the changes are those between its
    versions and are committed, with the version they reach, to a table of their own. Failed and
    running runs make no version, so what they saw is handled by the next success; no record is
    skipped or repeated. ``updated`` is never looked at.
    """
    spark = feed.sparkSession
    ship(spark)
    versions = successful_versions(runs)
    source = ManifestTable(spark, scratch(spark, "states"), "source_path")
    target = ManifestTable(spark, scratch(spark, "changes"), ["run_no", "source_path"])
    replay(feed.select(*FEED), versions, source)
    numbers = F.broadcast(versions.select("version", "run_no"))  # one row per run
    process_steps(source, target, lambda steps: changed_states(steps).join(numbers, "version").select("run_no", "source_path", "content_hash"))
    done = target.read()
    return done if done is not None else spark.createDataFrame([], "run_no int, source_path string, content_hash string")


class _Files:
    """The few file system calls that commits need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Write ``text`` so that it appears whole or not at all; fails if ``name`` is there already.

        The rename is the one of ``FileContext``, which refuses an existing target by itself (on HDFS in one step).
        """
        temporary, hadoop = self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._jvm.org.apache.hadoop.fs
        stream = self._fs().create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = hadoop.FileContext.getFileContext(self._fs().getUri(), self._conf)
        none = self._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        none[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            context.rename(self._fs().makeQualified(temporary), self._fs().makeQualified(self._path(name)), none)
        except Exception as error:
            self._fs().delete(temporary, False)
            if "FileAlreadyExistsException" in str(error):
                raise FileExistsError(f"{self.root}/{name} is there already: another writer was faster") from None
            raise

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


#: Times a commit is tried against the version that another writer has just made.
ATTEMPTS = 10


class ManifestTable:
    """A keyed table of immutable Parquet folders with one JSON manifest per version.

    ``_manifests/000007.json`` holds ``{"version", "schema", "files": [...], "vectors": [...], "tags",
    "rewrite"}``. A data folder never changes; a vector folder holds the name of a data folder and the
    key of every row in it that is no longer live. A commit writes at most one of either, in one job
    each. A version exists once its manifest does: what a failed writer leaves behind is never read.
    """

    def __init__(self, spark: SparkSession, root: str, key: str | list[str]) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), [key] if isinstance(key, str) else list(key)
        self._files = _Files(spark, self.root)

    @property
    def key(self) -> str:
        return self.keys[0]

    def latest(self) -> int:
        names = [n for n in self._files.names("_manifests") if n.endswith(".json")]
        return int(names[-1].split(".")[0]) if names else 0

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "schema": None, "files": [], "vectors": [], "tags": {}, "rewrite": False}
        return json.loads(self._files.read(f"_manifests/{version:06d}.json"))

    # ---- writing

    def _publish(self, base: dict, files: list[str], vectors: list[str], tags: dict, schema: T.StructType | None = None, rewrite: bool = False) -> int:
        merged = _merged(_schema_of(base), schema)
        body = {"version": base["version"] + 1, "schema": merged and merged.jsonValue(), "files": files, "vectors": vectors, "tags": tags, "rewrite": rewrite}
        self._files.write_once(f"_manifests/{body['version']:06d}.json", json.dumps(body))
        return body["version"]

    def _name(self, sign: str, version: int) -> str:
        return f"{sign}{version:06d}-{uuid.uuid4().hex[:12]}"

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, expect: int | None = None, **tags: object) -> int:
        """Make the next version: ``upserts`` replace rows of the same key, keys in ``deletes`` go.

        If another writer was faster, the deletion vector is made again on top of that version; with
        ``expect``, the version to build on, it fails instead.
        """
        name, gone = None, []
        if upserts is not None:
            name = self._name("d", self.latest() + 1)
            upserts.write.parquet(f"{self.root}/{name}")
            gone.append(self.spark.read.schema(upserts.schema).parquet(f"{self.root}/{name}").select(*self.keys))
        if deletes is not None:
            gone.append(deletes.select(*self.keys))
        for _ in range(ATTEMPTS):
            base = self.manifest(self.latest())
            if expect is not None and base["version"] != expect:
                raise FileExistsError(f"{self.root} is at version {base['version']}, not {expect}: another writer was faster")
            vectors = list(base["vectors"])
            if gone and base["files"]:
                vector = self._name("v", base["version"] + 1)
                met = self._live(base).join(reduce(DataFrame.unionByName, gone).distinct(), self.keys, "left_semi").select("__file", *self.keys)
                met.write.parquet(f"{self.root}/{vector}")
                if self.spark.read.schema(met.schema).parquet(f"{self.root}/{vector}").take(1):
                    vectors.append(vector)
            try:
                return self._publish(base, [*base["files"], *([name] if name else [])], vectors, tags, upserts.schema if upserts is not None else None)
            except FileExistsError:
                if expect is not None:
                    raise
        raise FileExistsError(f"{self.root}: {ATTEMPTS} other writers were faster")

    def append(self, rows: DataFrame, expect: int | None = None, **tags: object) -> int:
        """Make the next version with ``rows`` besides what is there: their keys must be new, nothing is looked up."""
        name = self._name("d", self.latest() + 1)
        rows.write.parquet(f"{self.root}/{name}")
        for _ in range(ATTEMPTS):
            base = self.manifest(self.latest())
            if expect is not None and base["version"] != expect:
                break
            try:
                return self._publish(base, [*base["files"], name], base["vectors"], tags, rows.schema)
            except FileExistsError:
                continue
        raise FileExistsError(f"{self.root}: another writer was faster")

    def load(self, rows: DataFrame, added: str, deleted: str, upto: int) -> None:
        """Make versions 1 to ``upto`` of an empty table at once: every row comes with version ``added`` and goes with version ``deleted``, if any."""
        if self.latest():
            raise FileExistsError(f"{self.root} is not empty")
        name, kept = self._name("b", 0), [c for c in rows.columns if c not in (added, deleted)]
        placed = materialize(rows, "placed")
        placed.select(*kept, F.col(added).alias("v")).write.partitionBy("v").parquet(f"{self.root}/{name}")
        ended = placed.where(F.col(deleted).isNotNull())
        file = F.concat(F.lit(f"{name}/v="), F.col(added).cast("string"))
        ended.select(file.alias("__file"), *self.keys, F.col(deleted).alias("v")).write.partitionBy("v").parquet(f"{self.root}/{name}-gone")
        number = lambda folder: {int(n[2:]): f"{folder}/{n}" for n in self._files.names(folder) if n.startswith("v=")}
        files, vectors = number(name), number(f"{name}-gone")
        for version in range(1, upto + 1):
            now = lambda found: [path for v, path in sorted(found.items()) if v <= version]
            self._publish(self.manifest(version - 1), now(files), now(vectors), {}, placed.select(*kept).schema)

    def compact(self, **tags: object) -> int:
        """Make a version with the same rows in one folder and without vectors; a diff sees no change in it."""
        base = self.manifest(self.latest())
        name, rows = self._name("d", base["version"] + 1), self.read(base["version"])
        if rows is None:
            return base["version"]
        rows.write.parquet(f"{self.root}/{name}")
        return self._publish(base, [name], [], base["tags"] | tags, rows.schema, rewrite=True)

    def vacuum(self, versions: int = 1) -> list[str]:
        """Delete folders that none of the last ``versions`` versions lists; earlier versions can't be read any more. Not while others write."""
        last = self.latest()
        kept = [self.manifest(v) for v in range(max(1, last - versions + 1), last + 1)]
        listed = {n.split("/")[0] for m in kept for n in m["files"] + m["vectors"]}
        unused = [n for n in self._files.names("") if n[0] in "dvb" and n not in listed]
        for name in unused:
            self._files.delete(name)
        return unused

    # ---- reading

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        """All rows of data folders, with their ``__file``: one scan however many folders."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+(?:/v=\d+)?)/[^/]+$", 1).alias("__file"))

    def _vectors(self, vectors: list[str], schema: T.StructType) -> DataFrame:
        kept = T.StructType([T.StructField("__file", T.StringType()), *[schema[k] for k in self.keys]])
        rows = self.spark.read.schema(kept).parquet(*[f"{self.root}/{v}" for v in vectors])
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+(?:/v=\d+)?)/[^/]+$", 1).alias("__vector"))

    def _live(self, manifest: dict) -> DataFrame:
        schema = _schema_of(manifest)
        rows = self._rows(manifest["files"], schema)
        if manifest["vectors"]:
            rows = rows.join(self._vectors(manifest["vectors"], schema).select("__file", *self.keys), ["__file", *self.keys], "left_anti")
        return rows.select(*schema.names, "__file")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the latest; None for a table without data."""
        manifest = self.manifest(self.latest() if version is None else version)
        return self._live(manifest).drop("__file") if manifest["files"] else None

    def steps(self, old: int, new: int) -> DataFrame | None:
        """What each version after ``old`` up to ``new`` changed, from files and vectors alone: ``version, change`` (``+`` or ``-``) and the row.

        One scan of the added files and one of the vectors, with the files that these name; None if nothing was changed.
        """
        added, vectors, removed, named, last = {}, {}, {}, set(), self.manifest(old)
        for version in range(old + 1, new + 1):
            now = self.manifest(version)
            if not now["rewrite"]:
                added |= {f: version for f in now["files"] if f not in last["files"]}
                vectors |= {v: version for v in now["vectors"] if v not in last["vectors"]}
                removed |= {f: (version, last) for f in last["files"] if f not in now["files"]}
                named |= set(last["files"]) if any(v not in last["vectors"] for v in now["vectors"]) else set()
            last = now
        if not (added or vectors or removed):
            return None
        schema = _schema_of(last)
        of = lambda numbers, column: F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col(column))
        parts = []
        if added:
            parts.append(self._rows(list(added), schema).select(of(added, "__file").alias("version"), F.lit("+").alias("change"), *schema.names))
        if vectors:
            marked = self._vectors(list(vectors), schema).withColumn("version", of(vectors, "__vector")).drop("__vector")
            parts.append(marked.join(self._rows(sorted(named), schema), ["__file", *self.keys]).select("version", F.lit("-").alias("change"), *schema.names))
        for file, (version, before) in removed.items():
            parts.append(self._live(before).where(F.col("__file") == file).select(F.lit(version).alias("version"), F.lit("-").alias("change"), *schema.names))
        return reduce(DataFrame.unionByName, parts)

    def diff(self, old: int, new: int) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows added and rows removed between two versions: of every key's steps, the last one if it adds and the first one if it removes."""
        steps = self.steps(old, new)
        if steps is None:
            return None, None
        names = [c for c in steps.columns if c not in ("version", "change")]
        order = F.struct("version", (F.col("change") == "+"))
        step = F.struct("change", *names)
        ends = steps.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.min_by(step, order).alias("first"), F.max_by(step, order).alias("last"))
        side = lambda end, sign: ends.where(F.col(f"{end}.change") == sign).select(*[F.col(f"{end}.{c}").alias(c) for c in names])
        return side("last", "+"), side("first", "-")


def _schema_of(manifest: dict) -> T.StructType | None:
    return T.StructType.fromJson(manifest["schema"]) if manifest["schema"] else None


def _merged(old: T.StructType | None, new: T.StructType | None) -> T.StructType | None:
    """Columns of both, those of ``old`` first; all may be null, as files without them are read so."""
    known = [f for s in (old, new) if s is not None for f in s]
    first = {f.name: T.StructField(f.name, f.dataType, True) for f in reversed(known)}
    names = list(dict.fromkeys(f.name for f in known))
    return T.StructType([first[n] for n in names]) if known else None


def _processed(target: ManifestTable) -> tuple[int, int]:
    """The target's latest version and the version of its source that it has reached."""
    version = target.latest()
    return version, int(target.manifest(version)["tags"].get("processed", 0))


def process_steps(source: ManifestTable, target: ManifestTable, step: Callable[[DataFrame], DataFrame]) -> int | None:
    """Append what ``step`` makes of the source's new steps to ``target``; None if there is nothing to do.

    The rows must have keys of their own, such as one with the version in it. The processed version
    is a tag of the commit, as in :func:`process_new`.
    """
    base, done = _processed(target)
    newest = source.latest()
    steps = source.steps(done, newest)
    return None if steps is None else target.append(step(steps), expect=base, processed=newest)


def process_new(
    source: ManifestTable,
    target: ManifestTable,
    step: Callable[[DataFrame], DataFrame],
    same: Column | None = None,
) -> int | None:
    """Bring ``target`` up to the latest version of ``source``; None if there is nothing to do.

    The processed version is a tag of the target's commit, so output and progress appear together or
    not at all: a run that fails before its commit is simply done again, one that fails after it is
    not, and of two runs at once only one commits. ``step`` gets the added rows; keys that were
    removed and not added again are deleted. Rows for which ``same`` has not changed are left alone.
    """
    base, done = _processed(target)
    newest = source.latest()
    if newest == done:
        return None
    added, removed = source.diff(done, newest)
    if added is None:
        return target.commit(expect=base, processed=newest)
    deletes = removed.join(added.select(*source.keys), source.keys, "left_anti")
    if same is not None:
        old = removed.select(*source.keys, same.alias("__same"), F.lit(True).alias("__was"))
        fresh = F.col("__was").isNull() | ~F.col("__now").eqNullSafe(F.col("__same"))
        added = added.withColumn("__now", same).join(old, source.keys, "left").where(fresh).drop("__now", "__same", "__was")
    return target.commit(step(added), deletes, expect=base, processed=newest)
