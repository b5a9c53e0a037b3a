"""Fingerprints, run identities, reuse of prepared tables, and exports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "1"


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a hash of the content that ignores row and column order."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    a = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return a.select(F.sha2(F.concat_ws("|", F.lit(",".join(sorted(df.columns))), F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"),
                    F.col("n").alias("row_count"))


def canonical(value) -> str:
    """Canonical JSON of settings: sorted keys, sorted unique lists, no blanks."""
    def tidy(v):
        if isinstance(v, dict):
            return {k: tidy(v[k]) for k in sorted(v)}
        if isinstance(v, (list, tuple, set)):
            return sorted({str(x).strip() for x in v if str(x).strip()})
        return v
    return json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def run_id(source: str, filters: dict, settings: dict) -> str:
    return hashlib.sha256(canonical({"source": source, "filters": filters, "settings": settings, "contract": CONTRACT}).encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, if its write was finished."""
    sc = spark.sparkContext
    marker = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if marker.getFileSystem(sc._jsc.hadoopConfiguration()).exists(marker) else None


def prepared(spark: SparkSession, base: str, source_hash: str, role: str, build: Callable[[], DataFrame], partition_by: Iterable[str] = ()) -> DataFrame:
    """Read the table prepared for this source and contract, or build and store it once."""
    path = f"{base}/source_hash={source_hash}/contract={CONTRACT}/role={role}"
    found = _read(spark, path)
    if found is None:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        found = spark.read.parquet(path)
    return found


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV parts with a header; written by the tasks, never gathered."""
    (df.select(*columns) if columns else df).write.mode("errorifexists").option("header", True).csv(path)


#: Columns of a forecast export, one row for each record and month.
EXPORT = ("metric", "level", "brand", "entity_key", "model_name", "plc", "month", "forecast_type", "route", "value", "share")


def export_rows(metric: str, levels: dict[str, DataFrame]) -> DataFrame:
    """The forecast tables of one metric as export rows; columns that a level lacks are empty."""
    out = None
    for level, df in levels.items():
        have = df.withColumns({"metric": F.lit(metric), "level": F.lit(level)})
        empty = {c: F.lit(None).cast("double") if c in ("value", "share") else F.lit("") for c in EXPORT}
        rows = have.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in have.columns and c not in ("value", "share") else
                             F.col(c).cast("double").alias(c) if c in have.columns else empty[c].alias(c) for c in EXPORT])
        out = rows if out is None else out.unionByName(rows)
    return out


# --- immutable runs -------------------------------------------------------------------------
#
# base/run_id=<id>/attempt=<unique>/<table>/   the tables, written by one writer
# base/run_id=<id>/manifest.json               written last and never replaced; names the attempt that counts
#
# A run is what its manifest says. An attempt without one is nobody's: a killed writer leaves it behind, and a second writer that
# finds a manifest removes its own.

def _fs(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def _seal(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()


def manifest(spark: SparkSession, base: str, rid: str) -> dict | None:
    """What the run's manifest says; None where there is none or its writing was not finished."""
    path, fs = _fs(spark, f"{base}/run_id={rid}/manifest.json")
    if not fs.exists(path):
        return None
    lines = [r.value for r in spark.read.text(path.toString()).collect()]              # two lines
    return json.loads(lines[0]) if len(lines) == 2 and _seal(lines[0]) == lines[1] else None


def _commit(spark: SparkSession, base: str, rid: str, body: dict) -> bool:
    """Write the manifest if there is none. Creating a file that must not exist yet is one step for the file system, so of two
    writers one succeeds; an unfinished manifest, of a writer that died at it, is replaced."""
    path, fs = _fs(spark, f"{base}/run_id={rid}/manifest.json")
    text = json.dumps(body, sort_keys=True)
    over = fs.exists(path) and manifest(spark, base, rid) is None
    try:
        out = fs.create(path, over)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(f"{text}\n{_seal(text)}\n".encode()))
    out.close()
    return True


def open_run(spark: SparkSession, base: str, rid: str, verify: bool = False) -> dict[str, DataFrame] | None:
    """The tables of a committed run; None where there is none. With ``verify`` their content must be what was committed."""
    m = manifest(spark, base, rid)
    if m is None:
        return None
    tables = {t: spark.read.parquet(f"{base}/run_id={rid}/{m['attempt']}/{t}") for t in m["tables"]}
    if verify:
        for t, df in tables.items():
            if fingerprint(df).first().fingerprint != m["tables"][t]["fingerprint"]:
                raise ValueError(f"table {t} of run {rid} is not what was committed")
    return tables


def get_or_create_run(spark: SparkSession, base: str, rid: str, build: Callable[[], dict[str, DataFrame]], about: dict | None = None) -> dict[str, DataFrame]:
    """Tables of an immutable run: those of its manifest, or built, written under an own attempt and committed together.

    However many writers start, all return the tables of the one that committed. ``about`` is kept in the manifest.
    """
    found = open_run(spark, base, rid)
    if found is not None:
        return found
    attempt, said = f"attempt={uuid.uuid4().hex}", {}
    place = f"{base}/run_id={rid}/{attempt}"
    for name, df in build().items():
        df.write.mode("errorifexists").parquet(f"{place}/{name}")
        f = fingerprint(spark.read.parquet(f"{place}/{name}")).first()
        said[name] = {"fingerprint": f.fingerprint, "rows": f.row_count}
    if not _commit(spark, base, rid, {"run_id": rid, "attempt": attempt, "tables": said, "about": about or {}, "contract": CONTRACT}):
        path, fs = _fs(spark, place)
        fs.delete(path, True)
    return open_run(spark, base, rid)


def attempts_left(spark: SparkSession, base: str, rid: str) -> list[str]:
    """Attempts of a run that its manifest does not name: leftovers, or writers at work."""
    path, fs = _fs(spark, f"{base}/run_id={rid}")
    own = (manifest(spark, base, rid) or {}).get("attempt")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if n.startswith("attempt=") and n != own)


def manifest_rows(spark: SparkSession, base: str, rid: str) -> DataFrame:
    """(table, rows, fingerprint) as the manifest has them."""
    m = manifest(spark, base, rid)
    return spark.createDataFrame([(t, v["rows"], v["fingerprint"]) for t, v in sorted(m["tables"].items())], "table string, rows bigint, fingerprint string")
