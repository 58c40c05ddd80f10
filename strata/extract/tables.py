"""From entries to fact tables: the one place where source text meets Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.extract import braces, cargo, python_lang
from strata.extract.common import Facts, ParseError
from strata.functions import text as T
from strata.session import cut

_RAW = (
    "rev_id string, path string, status string, detail string, language string, "
    "functions array<struct<qualified_name:string,name:string,start_line:int,end_line:int,cc:int,sloc:int,role:string,"
    "tokens:array<string>,token_lines:array<int>,shape:array<string>,shape_lines:array<int>>>, "
    "lints array<struct<kind:string,lint_paths:array<string>,target_fp:string,target_kind:string,line:int>>, "
    "unsafe array<struct<pattern_id:string,fingerprint:string,line:int>>, "
    "dependencies array<struct<table_path:string,dependency_key:string,package:string,source_kind:string,source:string,"
    "default_features:boolean,features:array<string>,version:string,line:int>>"
)


def extractor(path: str) -> Callable[[str, str], Facts] | None:
    """The extractor for a path, by its extension; None if there is none."""
    if path.endswith(".rs"):
        return braces.extract_rust
    if path.endswith(".py"):
        return python_lang.extract
    if path.endswith((".ts", ".tsx")):
        return braces.extract_typescript
    if path.rsplit("/", 1)[-1] == "Cargo.toml":
        return cargo.extract
    return None


def analyze(path: str, kind: str, body: bytes | None) -> tuple[str, str, Facts | None]:
    """``(status, detail, facts)`` of one entry: analyzed, unsupported or failed, never partial."""
    run = extractor(path)
    if kind != "file" or run is None:
        return "unsupported", "not a regular file" if kind != "file" else "unsupported file type", None
    try:
        return "analyzed", "", run(path, (body or b"").decode("utf-8"))
    except UnicodeDecodeError:
        return "failed", "not valid UTF-8", None
    except ParseError as error:
        return "failed", f"parse error: {error}", None


def extract_entries(entries: DataFrame) -> DataFrame:
    """One row per entry with its nested facts and coverage; files are independent, so this never shuffles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rev, path, kind, body in zip(batch["rev_id"], batch["path"], batch["kind"], batch["bytes"], strict=True):
                status, detail, facts = analyze(path, kind, body)
                facts = facts or Facts("")
                out.append((rev, path, status, detail, facts.language, [tuple(vars(f).values()) for f in facts.functions], facts.lints, facts.unsafe, facts.dependencies))
            names = [c.split(" ")[0] for c in ("rev_id", "path", "status", "detail", "language", "functions", "lints", "unsafe", "dependencies")]
            frame = pd.DataFrame(out, columns=names)
            fields = {
                "functions": ["qualified_name", "name", "start_line", "end_line", "cc", "sloc", "role", "tokens", "token_lines", "shape", "shape_lines"],
                "lints": ["kind", "lint_paths", "target_fp", "target_kind", "line"],
                "unsafe": ["pattern_id", "fingerprint", "line"],
                "dependencies": ["table_path", "dependency_key", "package", "source_kind", "source", "default_features", "features", "version", "line"],
            }
            for column, keys in fields.items():
                frame[column] = [[dict(zip(keys, row, strict=True)) for row in rows] for rows in frame[column]]
            yield frame

    return entries.select("rev_id", "path", "kind", "bytes").mapInPandas(run, _RAW)


def functions_table(raw: DataFrame) -> DataFrame:
    """The functions table: streams become hashes and shingles with built-in functions.

    ``pos`` rises with revision, path and source order, not without gaps: it comes
    from a distributed sort, not from one window. Two functions of one file may
    share a name; both have rows.
    """
    rows = raw.select("rev_id", "path", "language", F.posexplode("functions").alias("nth", "f")).select(
        "rev_id", "path", "language", "nth", "f.*"
    )
    rows = rows.withColumn("shingle_seq", T.hashed(T.windows(F.col("tokens"), separator=T.UNIT_SEPARATOR)))
    rows = rows.withColumn("ast_shingle_seq", T.hashed(T.windows(F.col("shape"), separator=T.UNIT_SEPARATOR)))
    rows = rows.orderBy("rev_id", "path", "nth").withColumn("pos", F.monotonically_increasing_id())
    made = rows.select(
        "rev_id",
        "pos",
        "language",
        "path",
        "qualified_name",
        F.lit("function").alias("kind"),
        "name",
        "start_line",
        "end_line",
        T.stream_hash(F.col("tokens")).alias("normalized_hash"),
        T.stream_hash(F.col("shape")).alias("ast_hash"),
        F.size(F.filter("shape", lambda x: ~F.startswith(x, F.lit("/N:")))).alias("ast_node_count"),
        F.size("tokens").alias("token_count"),
        "sloc",
        "cc",
        T.mass(F.col("cc"), F.col("sloc")).alias("mass"),
        "role",
        T.unique_sorted(F.col("shingle_seq")).alias("shingles"),
        T.unique_sorted(F.col("ast_shingle_seq")).alias("ast_shingles"),
        "shingle_seq",
        "ast_shingle_seq",
        F.slice("token_lines", 1, F.greatest(F.size("shingle_seq"), F.lit(0))).alias("shingle_lines"),
        F.slice("shape_lines", 1, F.greatest(F.size("ast_shingle_seq"), F.lit(0))).alias("ast_shingle_lines"),
    )
    return cut(made)  # positions must not be dealt anew


def fact_tables(entries: DataFrame) -> dict[str, DataFrame]:
    """functions, lints, unsafe, dependencies and coverage of entries, extracted once."""
    raw = cut(extract_entries(entries))

    def flat(column: str) -> DataFrame:
        return raw.select("rev_id", "path", F.explode(column).alias("x")).select("rev_id", "path", "x.*")

    return {
        "functions": functions_table(raw),
        "lints": flat("lints"),
        "unsafe": flat("unsafe"),
        "dependencies": flat("dependencies"),
        "coverage": raw.select("rev_id", "path", "status", "detail"),
    }
