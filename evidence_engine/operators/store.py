"""The relational store: runs, claims, evidence and certificates as Parquet tables that are published together.

A store is a row of snapshots. Each write puts its rows into a part (a folder with the four tables) that nobody reads yet, and then
publishes the next version: a manifest that names the parts of that version, moved to its place in one atomic step that fails if
somebody else was there first. Readers take the parts of one version, so they see all of a write or nothing of it, and what they
opened stays as it is until vacuum() removes the parts that no manifest names any more. A run's rows of all tables are in one
part, so a delete writes anew only the part that holds the run.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text

SCHEMA_VERSION = 1
TABLES = {
    "runs": "id string, certificate_id string, created_at string, overall string, claim_count int, supported_count int, refuted_count int, unverified_count int, conflicts_detected int, total_sources int, execution_time_seconds double, avg_time_per_claim_ms double, input_hash string, draft_snippet string",
    "claims": "id string, run_id string, claim_index int, claim_text string, original_sentence string, outcome string, confidence double, reason string, similarity_score double, ranking_score double, source_authority string, conflict_detected boolean, processing_time_ms double",
    "evidence": "id string, claim_id string, source_filename string, source_id string, location string, location_type string, page int, snippet_text string, similarity double, ranking_score double, authority_level string, authority_weight double, is_primary boolean, is_conflict boolean",
    "certificates": "certificate_id string, run_id string, certificate_version string, created_at string, overall string, input_hash string, raw_json string, sha256_hash string",
}
#: Foreign keys: (table, column) to (table, key).
PARENTS = {("claims", "run_id"): ("runs", "id"), ("evidence", "claim_id"): ("claims", "id"), ("certificates", "run_id"): ("runs", "id")}
#: New rows of a table whose keys go to every task.
FEW = 500_000


def evidence_rows(lists: DataFrame, claim: str, compat: bool = False) -> DataFrame:
    """Evidence of lists (claim, list, pos, source, location, page, text, ...): the lists primary, supporting, evidence and
    conflicting one after the other, each passage once. is_conflict says whether the passage is among the conflicting; with
    compat, whether it is there alone."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("primary", "supporting", "evidence", "conflicting")]), F.col("list"))
    same = ["source", F.coalesce("location", F.col("page").cast("string")), F.substring("text", 1, 60)]
    keyed = lists.withColumn("_rank", rank).withColumns({f"_k{i}": F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")) for i, c in enumerate(same)})
    per = Window.partitionBy(claim, "_k0", "_k1", "_k2")
    keyed = keyed.withColumn("_nth", F.row_number().over(per.orderBy("_rank", "pos"))).withColumn("_conflict", F.max((F.col("list") == "conflicting").cast("int")).over(per) == 1)
    first = keyed.where("_nth = 1").withColumn("evidence_pos", F.row_number().over(Window.partitionBy(claim).orderBy("_rank", "pos")))
    conflict = (F.col("list") == "conflicting") if compat else F.col("_conflict")
    return first.withColumn("is_primary", F.col("list") == "primary").withColumn("is_conflict", conflict).drop("_rank", "_nth", "_conflict", "_k0", "_k1", "_k2")


def page(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest runs: limit is held within 1 to 200, offset is at least 0; equal times go by id."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(200, limit)))


def totals(runs: DataFrame) -> DataFrame:
    """How many runs there are, and the last id."""
    return runs.agg(F.count("*").alias("total"), F.max("id").alias("last_id"))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, few: bool = False) -> dict[str, DataFrame]:
    """The tables without the runs of ids (id) and what belongs to them; few: their claims go to every task."""
    gone = tables["runs"].join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("run_id"))
    gone = F.broadcast(gone) if few else gone
    lost = tables["claims"].join(gone, "run_id", "left_semi").select(F.col("id").alias("claim_id"))
    return {
        "runs": tables["runs"].join(gone.withColumnRenamed("run_id", "id"), "id", "left_anti"),
        "claims": tables["claims"].join(gone, "run_id", "left_anti"),
        "evidence": tables["evidence"].join(F.broadcast(lost) if few else lost, "claim_id", "left_anti"),
        "certificates": tables["certificates"].join(gone, "run_id", "left_anti"),
    }


def only(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """The tables with no more than a few runs and what belongs to them: nothing of the others is shuffled."""
    of = F.broadcast(runs.select(F.col("id").alias("run_id")))
    claims = tables["claims"].join(of, "run_id", "left_semi")
    return {
        "runs": runs, "claims": claims, "evidence": tables["evidence"].join(F.broadcast(claims.select(F.col("id").alias("claim_id"))), "claim_id", "left_semi"),
        "certificates": tables["certificates"].join(of, "run_id", "left_semi"),
    }


def detail(tables: dict[str, DataFrame], run: Column) -> DataFrame:
    """One row for each run that the condition selects, with its claims, their evidence and its certificate."""
    runs = tables["runs"].where(run)
    ordered = tables["evidence"].groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("is_primary", "ranking_score", *[c for c in tables["evidence"].columns if c not in ("claim_id", "is_primary", "ranking_score")])), asc=False).alias("evidence"))
    claims = tables["claims"].join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").join(ordered, F.col("claim_id") == F.col("id"), "left").drop("claim_id")
    nested = claims.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", *[c for c in claims.columns if c not in ("run_id", "claim_index")]))).alias("claims"))
    raw = tables["certificates"].select("run_id", "raw_json", "sha256_hash")
    return runs.join(nested, runs["id"] == nested["run_id"], "left").drop("run_id").join(raw, runs["id"] == raw["run_id"], "left").drop("run_id")


class Conflict(RuntimeError):
    """Others published versions faster than this writer could."""


class Store:
    """Tables below a path that every node reaches."""

    #: How often a write is tried again on top of versions that others published meanwhile.
    TRIES = 10

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)

    def create(self) -> None:
        """Makes the store and records the layout's version; does nothing where both are there."""
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        if not self._fs.exists(self._path(f"{self.path}/_version-{SCHEMA_VERSION}")):
            self._fs.create(self._path(f"{self.path}/_version-{SCHEMA_VERSION}"), True).close()

    def version(self) -> int:
        """The version of the layout."""
        return max((int(n.rpartition("-")[2]) for n in self._names("") if n.startswith("_version-")), default=0)

    def _names(self, below: str) -> list[str]:
        at = self._path(f"{self.path}/{below}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # --- snapshots

    def versions(self) -> list[int]:
        """The versions that are there, ascending."""
        return sorted(int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of a version, of the last one if none is named."""
        known = self.versions()
        if not known and version is None:
            return []
        return self._manifest(known[-1] if version is None else version)["parts"]

    def batches(self) -> dict[str, int]:
        """The last batch that each stream has saved."""
        known = self.versions()
        return self._manifest(known[-1])["batches"] if known else {}

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, version: int, parts: list[str], batches: dict[str, int] | None = None) -> bool:
        """Makes the parts, and the batches that streams have saved, the given version; whether nobody had published it before."""
        draft = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"parts": parts, "batches": batches or {}}).encode()))
        out.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(draft, self._path(f"{self.path}/manifests/v{version:010d}.json"), none)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def _changed(self, change: Callable[[list[str]], tuple[list[str], list[str]] | None], again: bool = True, batch: tuple[str, int] | None = None) -> bool:
        """Publishes what change makes of the last version's parts: (parts to drop, parts to add), or None for no change. If others
        publish meanwhile, change is asked again for what is there then; again: it makes new parts each time. A batch of a
        stream, by name and number, is recorded in the same step, and nothing changes if it was before."""
        for _ in range(self.TRIES):
            last = (self.versions() or [0])[-1]
            was = self._manifest(last) if last else {"parts": [], "batches": {}}
            old, batches = was["parts"], was["batches"]
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return False
            made = change(old)
            if made is None:
                return False
            dropped, added = made
            try:
                if self._publish(last + 1, [p for p in old if p not in dropped] + added, batches | ({batch[0]: batch[1]} if batch else {})):
                    return True
            except Exception:
                self._discard(added)
                raise
            if again:
                self._discard(added)
        raise Conflict(f"{self.path}: {self.TRIES} versions were published by others")

    def _discard(self, parts: list[str]) -> None:
        for p in parts:
            self._fs.delete(self._path(f"{self.path}/parts/{p}"), True)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the last ones and the parts that none of these names, also those that failed writes left; how
        many parts went. Not to be called while others write, or read older versions."""
        known = self.versions()
        live = {p for v in known[-max(1, keep) :] for p in self.parts(v)}
        for v in known[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:010d}.json"), False)
        dead = [p for p in self._names("parts") if p not in live]
        self._discard(dead)
        for draft in (n for n in self._names("manifests") if n.startswith("_")):
            self._fs.delete(self._path(f"{self.path}/manifests/{draft}"), False)
        return len(dead)

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        paths = [f"{self.path}/parts/{p}/{name}" for p in parts]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, self.parts(version))

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        parts = self.parts(version)
        return {name: self._read(name, parts) for name in TABLES}

    # --- writes

    def _written(self, rows: dict[str, DataFrame]) -> str:
        part = uuid.uuid4().hex
        for name, schema in TABLES.items():
            cast = [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))]
            rows[name].select(*cast).write.parquet(f"{self.path}/parts/{part}/{name}")
        return part

    def save(self, rows: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Publishes rows of all tables together. Ids must be well-formed and new, children must have parents: else nothing
        is visible and an error is raised. Ids are compared again with what others publish meanwhile. A stream names its batch,
        by its own name and the batch's number: one that was saved before adds nothing. Whether the rows are new."""
        self.create()
        if batch and self.batches().get(batch[0], -1) >= batch[1]:
            return False
        part = self._written(rows)

        def change(old: list[str]) -> tuple[list[str], list[str]]:
            self._checked({name: self._read(name, [part]) for name in TABLES}, old)
            return [], [part]

        done = False
        try:
            done = self._changed(change, False, batch)
        finally:
            if not done:
                self._discard([part])
        return done

    def delete(self, run: str) -> bool:
        """Removes a run by id or certificate_id with all that belongs to it; whether it was there. Only the parts that hold it are
        written anew; older versions keep it until vacuum()."""

        def change(old: list[str]) -> tuple[list[str], list[str]] | None:
            runs = self._read("runs", old)
            found = runs.where((F.col("id") == run) | (F.col("certificate_id") == run)).select("id", F.regexp_extract(F.input_file_name(), "/parts/([0-9a-f]+)/runs/", 1).alias("part")).collect()
            if not found:
                return None
            touched = sorted({r["part"] for r in found})
            ids = self.spark.createDataFrame([(r["id"],) for r in found], "id string")
            return touched, [self._written(delete_cascade({name: self._read(name, touched) for name in TABLES}, F.broadcast(ids), True))]

        return self._changed(change)

    def compact(self, least: int = 2) -> bool:
        """Puts all parts into one where there are so many; whether it did. Runs that others save meanwhile stay."""

        def change(old: list[str]) -> tuple[list[str], list[str]] | None:
            return (old, [self._written({name: self._read(name, old) for name in TABLES})]) if len(old) >= max(2, least) else None

        return self._changed(change)

    def _checked(self, staged: dict[str, DataFrame], old: list[str]) -> None:
        for name, key in (("runs", "id"), ("claims", "id"), ("evidence", "id"), ("certificates", "certificate_id")):
            if not staged[name].where(F.col(key).isNull()).isEmpty():
                raise ValueError(f"{name}: a row has no {key}")
            own, known = staged[name].select(key), self._read(name, old).select(key)
            # few new keys are looked for among the old ones where these are
            both = known.join(F.broadcast(own), key, "left_semi") if own.count() <= FEW else own.join(known, key, "left_semi")
            if not own.groupBy(key).count().where("count > 1").isEmpty() or not both.isEmpty():
                raise ValueError(f"{name}: {key} is there already")
        if not staged["runs"].where(~text.safe_id(F.col("certificate_id"))).isEmpty():
            raise ValueError("runs: a certificate_id is malformed")
        for (child, column), (parent, key) in PARENTS.items():
            if not staged[child].join(staged[parent].select(F.col(key).alias(column)), column, "left_anti").isEmpty():
                raise ValueError(f"{child}: {column} without its row of {parent}")

    # --- reads

    def history(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return page(self.table("runs"), limit, offset)

    def count(self) -> int:
        return totals(self.table("runs")).first()["total"]

    def get(self, run: str) -> DataFrame:
        """The run with this id or certificate_id, nested; no row if there is none or the id is malformed."""
        known = text.safe_id(F.lit(run)) & ((F.col("id") == run) | (F.col("certificate_id") == run))
        tables = self.tables()
        return detail(only(tables, tables["runs"].where(known)), F.lit(True))

    def certificate(self, certificate_id: str, folder: str | None = None) -> DataFrame:
        """raw_json of a certificate: of the store, or else of the files that write_certificates() makes below a folder, or of a
        file with the certificate's name there. Only that file and one bucket of the others are read. No row if there is none or
        the id is malformed."""
        stored = self.table("certificates").where((F.col("certificate_id") == certificate_id) & text.safe_id(F.lit(certificate_id))).select("certificate_id", "raw_json", F.lit(0).alias("_from"))
        if folder and text.is_safe_id(certificate_id):
            folder = folder.rstrip("/")
            for path, whole in ((f"{folder}/bucket={bucket_of(certificate_id)}", False), (f"{folder}/{certificate_id}.json", True)):
                if self._fs.exists(self._path(path)):
                    lines = self.spark.read.text(path, wholetext=whole)
                    on_disk = lines.select(F.get_json_object("value", "$.certificate_id").alias("certificate_id"), F.col("value").alias("raw_json"), F.lit(1).alias("_from"))
                    stored = stored.unionByName(on_disk.where(F.col("certificate_id") == certificate_id))
        return stored.orderBy("_from").limit(1).drop("_from")

    def healthy(self) -> bool:
        return self.spark.sql("SELECT 1 AS one").first()["one"] == 1 and self._fs.exists(self._path(self.path))


#: Folders that certificates on disk are dealt into.
BUCKETS = 256


def bucket_of(certificate_id: str) -> int:
    return zlib.crc32(certificate_id.encode()) % BUCKETS


def write_certificates(certificates: DataFrame, folder: str) -> None:
    """Adds certificates (certificate_id, raw_json) to the text files below a folder: one JSON document a line, in BUCKETS folders
    by certificate, whatever their number. Line breaks between parts of a document become spaces."""
    lines = certificates.select(F.regexp_replace("raw_json", r"\s*[\r\n]+\s*", " ").alias("value"), (F.crc32("certificate_id") % BUCKETS).alias("bucket"))
    lines.repartition("bucket").write.partitionBy("bucket").mode("append").text(folder)
