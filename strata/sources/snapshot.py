"""Snapshots: entries of a revision, their manifest against a baseline, and stored baselines."""

from __future__ import annotations

import functools
import hashlib
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import schemas
from strata.extract.tables import fact_tables
from strata.functions import text as T
from strata.operators import changes, coverage
from strata.operators.rules import Revision
from strata.policy import Policy
from strata.session import cut

TOOL_VERSION = "strata-1"
TABLES = ("functions", "lints", "unsafe", "dependencies", "coverage")
_SCHEMAS = {"functions": schemas.FUNCTIONS, "lints": schemas.LINTS, "unsafe": schemas.UNSAFE, "dependencies": schemas.DEPENDENCIES, "coverage": "rev_id string, " + schemas.COVERAGE}

#: What facts depend on: a baseline made by other versions of these is built again.
ANALYZER = (("strata.extract", ""), ("strata.functions", ""), ("strata", "schemas.py"))


class SnapshotError(ValueError):
    """A snapshot, manifest or stored baseline that breaks an invariant."""


@functools.cache
def analyzer_fingerprint() -> str:
    """A digest of the sources that turn texts into facts."""
    digest = hashlib.sha256()
    for package, only in ANALYZER:
        for file in sorted(resources.files(package).iterdir(), key=lambda f: f.name):
            if file.name.endswith(".py") and only in ("", file.name):
                digest.update(f"{package}/{file.name}\0".encode() + hashlib.sha256(file.read_bytes()).digest())
    return digest.hexdigest()


def from_rows(spark: SparkSession, rev_id: str, files: dict[str, bytes | str]) -> DataFrame:
    """Entries from a mapping of paths to contents."""
    rows = [(rev_id, p, "file", 0o100644, bytearray(b.encode() if isinstance(b, str) else b)) for p, b in files.items()]
    return spark.createDataFrame(rows, schemas.ENTRIES)


def from_directory(spark: SparkSession, rev_id: str, root: str) -> DataFrame:
    """Entries of a directory tree that Spark can read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_extract("path", r"^[a-z]+:/*(/.*)$", 1), "^" + "/" + base.lstrip("/") + "/", "")
    return found.select(F.lit(rev_id).alias("rev_id"), path.alias("path"), F.lit("file").alias("kind"), F.lit(0o100644).alias("mode"), F.col("content").alias("bytes"))


def metadata(entries: DataFrame) -> DataFrame:
    """Entries without contents: a content hash and a hash per line."""
    return entries.select("rev_id", "path", "kind", "mode", F.sha2("bytes", 256).alias("content_hash"), T.line_hashes(F.decode("bytes", "ISO-8859-1")).alias("line_hashes"))


def _sound_entry() -> Column:
    """Whether an entry's path is relative and its mode fits its kind."""
    mode = (F.col("kind") == "file") & F.col("mode").isin(0o100644, 0o100755) | (F.col("kind") == "symlink") & (F.col("mode") == 0o120000) | (F.col("kind") == "submodule") & (F.col("mode") == 0o160000)
    return F.coalesce(T.relative_path(F.col("path")) & mode, F.lit(False))


def validate_entries(entries: DataFrame) -> None:
    """Raise unless paths are relative and unique and modes fit their kind."""
    if not entries.where(~_sound_entry()).isEmpty():
        raise SnapshotError("an entry's path is not relative or its mode does not fit its kind")
    if not entries.groupBy("rev_id", "path").count().where("count > 1").isEmpty():
        raise SnapshotError("a path appears twice")


def fingerprint(meta: DataFrame) -> str:
    """One digest of all entries, whatever their order."""
    line = F.concat_ws("\x1f", "path", "kind", F.col("mode").cast("string"), "content_hash", F.array_join("line_hashes", ","))
    per_path = meta.select(F.sha2(line, 256).alias("h"))
    parts = per_path.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def manifest(base_meta: DataFrame, head_meta: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """``(path, status, old_path)`` of all paths: added, changed, unchanged or deleted.

    ``renames`` maps new paths to old ones; the old path of a rename isn't deleted.
    """
    values = ["content_hash", "kind", "mode"]
    diff = changes.entry_diff(base_meta, head_meta, "path", values)
    every = head_meta.select("path").unionByName(base_meta.select("path")).distinct()
    rows = every.join(diff, "path", "left").withColumn("status", F.coalesce("status", F.lit("unchanged")))
    if renames is None:
        return rows.withColumn("old_path", F.lit(None).cast("string"))
    rows = rows.join(renames.select("path", "old_path"), "path", "left")
    gone = renames.select(F.col("old_path").alias("path"))
    moved_away = rows.where("status = 'deleted'").join(gone, "path", "left_semi").select("path")
    rows = rows.join(moved_away, "path", "left_anti")
    return rows.withColumn("status", F.when(F.col("old_path").isNotNull() & (F.col("status") == "added"), "changed").otherwise(F.col("status")))


def validate_manifest(declared: DataFrame, true: DataFrame, base_meta: DataFrame | None = None) -> None:
    """Raise unless the declared changed and deleted sets are exactly the true ones.

    With the baseline's entries, renames are looked at too: each must lead from
    another path that the baseline has to one that changed.
    """
    if base_meta is not None:
        moved = declared.where("old_path is not null")
        lost = moved.join(base_meta.select(F.col("path").alias("old_path")), "old_path", "left_anti").select("path")
        if not moved.where("old_path = path or status in ('unchanged', 'deleted')").select("path").unionByName(lost).isEmpty():
            raise SnapshotError("a rename does not lead from a baseline path to a changed one")
    want = true.where("status <> 'unchanged'").select("path", F.when(F.col("status") == "deleted", "deleted").otherwise("changed").alias("s"))
    have = declared.where("status <> 'unchanged'").select("path", F.when(F.col("status") == "deleted", "deleted").otherwise("changed").alias("s"))
    if not want.exceptAll(have).isEmpty() or not have.exceptAll(want).isEmpty():
        raise SnapshotError("the manifest does not match the snapshots")


def line_diffs(base_meta: DataFrame, head_meta: DataFrame, moves: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(path, line)`` of head lines that the baseline's version lacks, all lines of new files, and ``(path, detail)`` of diffs over their cell budget."""
    here = head_meta.join(moves.where("status in ('added', 'changed')").select("path", F.coalesce("old_path", "path").alias("old")), "path")
    old = base_meta.select(F.col("path").alias("old"), F.col("line_hashes").alias("b"))
    pairs = here.select("path", "old", F.col("line_hashes").alias("h")).join(old, "old", "left")
    fresh = pairs.where("b is null").select("path", F.posexplode("h").alias("at", "x")).select("path", (F.col("at") + 1).alias("line"))
    known = cut(changes.added_lines(pairs.where("b is not null"), "path", "b", "h", **options))
    over = known.where("status <> 'ok'").select("path", F.lit("line diff budget exceeded").alias("detail"))
    return cut(fresh.unionByName(known.where("status = 'ok'").select("path", "line"))), over


def added_lines(base_meta: DataFrame, head_meta: DataFrame, moves: DataFrame, **options) -> DataFrame:
    """The lines of :func:`line_diffs`; a diff over its budget raises, as rules on added lines would miss that file's."""
    lines, over = line_diffs(base_meta, head_meta, moves, **options)
    if first := over.agg(F.min("path").alias("path")).first()["path"]:
        raise SnapshotError(f"{first}: line diff budget exceeded")
    return lines


def analyze(entries: DataFrame) -> Revision:
    return Revision(**fact_tables(entries))


def write_baseline(revision: Revision, meta: DataFrame, path: str, rev_id: str, policy: Policy, kind: str = "parquet") -> None:
    """Store a baseline as tables below ``path``, sorted by path inside files: Parquet, or ``kind="json"`` for JSON lines."""
    spark = meta.sparkSession
    for name in TABLES:
        getattr(revision, name).sortWithinPartitions("path").write.format(kind).mode("overwrite").save(f"{path}/{name}")
    meta.write.format(kind).mode("overwrite").save(f"{path}/entries")
    row = [(schemas.SCHEMA_VERSION, TOOL_VERSION, rev_id, policy.fingerprint(), analyzer_fingerprint(), fingerprint(meta))]
    spark.createDataFrame(row, schemas.META).write.format(kind).mode("overwrite").save(f"{path}/meta")


def read_baseline(spark: SparkSession, path: str, policy: Policy | None = None, kind: str = "parquet") -> tuple[Revision, DataFrame, str]:
    """A stored baseline, its entries' metadata and its revision; foreign or tampered ones are refused."""

    def load(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).format(kind).load(f"{path}/{name}")

    meta = load("meta", schemas.META).first()
    if meta is None or meta["schema_version"] != schemas.SCHEMA_VERSION:
        raise SnapshotError("the baseline has another schema version; build it again")
    if meta["tool_version"] != TOOL_VERSION:
        raise SnapshotError(f"the baseline was made by {meta['tool_version']}; build it again")
    if meta["analyzer_fingerprint"] != analyzer_fingerprint():
        raise SnapshotError("the baseline was made by other extractors; build it again")
    if policy is not None and meta["policy_fingerprint"] != policy.fingerprint():
        raise SnapshotError("the baseline was made under another policy; build it again")
    entries = load("entries", schemas.ENTRY_META)
    if meta["snapshot_id"] != fingerprint(entries):
        raise SnapshotError("the baseline's entries do not match their fingerprint")
    revision = Revision(**{name: load(name, _SCHEMAS[name]) for name in TABLES})
    validate_baseline(revision, entries, policy)
    return revision, entries, meta["rev_id"]


def baseline_faults(revision: Revision, entries: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``(path, fault)`` of everything a sound baseline does not hold.

    Entries must be sound and unique, facts lie on a line of a file of their kind,
    and every entry has one coverage row. With a policy, a file that one of its
    rules needs must have been analysed.
    """
    path = F.col("path")
    told = lambda rows, fault: rows.select("path", F.lit(fault).alias("fault") if isinstance(fault, str) else fault.alias("fault"))
    counts = entries.groupBy("path").count().where("count > 1")
    found = [told(entries.where(~_sound_entry() | (F.length("content_hash") != 64)), "entry is not sound"), told(counts, "entry appears twice")]
    files = entries.select("path", F.col("kind").alias("entry_kind"), F.size("line_hashes").alias("n_lines")).dropDuplicates(["path"])
    on_line = F.col("line").between(1, F.col("n_lines"))
    named = (F.length("table_path") > 0) & (F.length("dependency_key") > 0)
    sound = {
        "functions": path.rlike(coverage.SOURCE) & F.col("start_line").between(1, F.col("end_line")),
        "lints": path.rlike(coverage.RUST) & on_line,
        "unsafe": path.rlike(coverage.RUST) & on_line,
        "dependencies": path.rlike(coverage.MANIFEST) & on_line & named,
    }
    for name, holds in sound.items():
        facts = getattr(revision, name).join(files, "path", "left")
        found.append(told(facts.where(~F.coalesce((F.col("entry_kind") == "file") & holds, F.lit(False))), f"{name}: a fact has no such place"))
    seen = revision.coverage.groupBy("path").agg(F.count("*").alias("n"), F.min("status").alias("status"), F.min("detail").alias("detail"))
    both = seen.join(files.select("path", F.lit(True).alias("known")), "path", "full_outer")
    found.append(told(both.where("n is null or n > 1 or known is null"), "coverage does not match the entries"))
    if policy is not None:
        needed = F.lit(False)
        for rule, severity in policy.severities().items():
            needed = needed | coverage.rule_applies(F.lit(rule), path) if severity != "off" else needed
        found.append(told(seen.where(needed & (F.col("status") != "analyzed")), F.concat("status", F.lit(": "), "detail")))
    return functools.reduce(DataFrame.unionByName, found)


def validate_baseline(revision: Revision, entries: DataFrame, policy: Policy | None = None) -> None:
    """Raise on the first fault of :func:`baseline_faults`."""
    first = baseline_faults(revision, entries, policy).agg(F.min(F.struct("path", "fault")).alias("x")).first()["x"]
    if first is not None:
        raise SnapshotError(f"the baseline is not sound: {first['path']}: {first['fault']}")
