"""Secret scans over a ledger of blobs.

Every version of a text is addressed by its content. A blob is scanned once for a version of the rules, however
many paths hold it and however often the scan is run; findings are joined back to all paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.shared import new_folder
from lociq.llm.spans import find_spans, listed

RULES_VERSION = 1
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]++"
#: Runs of these characters are whole, so short ones can be passed over at once.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
FORGE = r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "forge")


def detect(text: Column) -> dict[str, Column]:
    """Spans by kind; those of BASE first. `text` must not be null."""
    value = lambda s: F.regexp_extract(s["match"], ASSIGN, 1)
    return {
        "assign": F.filter(find_spans(text, ASSIGN), lambda s: F.length(value(s)) >= 6),
        "access": F.filter(find_spans(text, ACCESS, "AKIA"), lambda s: F.length(s["match"]) >= 20),
        "hex": find_spans(text, HEX),
        "pem": find_spans(text, PEM, "-----BEGIN"),
        "forge": find_spans(text, FORGE, "gh"),
    }


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules_version: int = RULES_VERSION) -> DataFrame:
    """(blob, text) of each distinct text that `ledger` (blob, rules_version) lacks under these rules.

    Copies of a text meet in partial aggregates, so one with many paths is no hot key: a task passes it on once.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules_version: int = RULES_VERSION) -> DataFrame:
    """Findings of blobs not in the ledger: blob, rules_version, and one array of spans for each kind.

    `versions` has path (any type) and text; null texts are the empty blob. The result is also the ledger's next
    part. Null paths, several versions under one path and equal rows need no care: only contents count here.
    """
    found = unseen(versions, ledger, rules_version).select("blob", *[s.alias(k) for k, s in detect(F.col("text")).items()])
    slim = lambda k: F.transform(k, lambda s: s.dropFields("before", "after", "match")).alias(k)
    return found.select("blob", F.lit(rules_version).alias("rules_version"), *[slim(k) for k in KINDS])


def advance(folder: str, versions: DataFrame, rules_version: int = RULES_VERSION) -> DataFrame:
    """Brings the ledger in `folder` up to date with `versions` and returns its rows under these rules.

    The ledger is a table of findings by (blob, rules_version). Each call appends the findings of what the table
    lacks; texts that it has aren't scanned, whichever paths they come under. A folder that isn't there yet is an
    empty ledger.
    """
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    scan(versions, known, rules_version).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).where(F.col("rules_version") == rules_version)


def findings_by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Every version's path, null or not, with its blob's findings; nulls where `findings` lacks the blob."""
    return versions.select("path", blob_id(F.col("text")).alias("blob")).join(findings, "blob", "left")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents are versions; their ledger is a table in the shared folder, from which all paths get their findings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    digested = advance(new_folder(spark), docs).select(
        "blob",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed([(k, F.col(k)) for k in BASE]), 256).alias("base_sha256"),
        listed([(k, F.col(k)) for k in KINDS]).alias("spans"),
    )
    return findings_by_path(docs, digested).withColumnRenamed("path", "doc_id").select(
        "doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "blob"
    )


def in_sql() -> str:
    """The query for DuckDB, whose expressions have no lookaround: a boundary of words does the same for FORGE, and runs of HEX are whole anyhow."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    kinds = {
        "assign": (assign, f"length(regexp_extract(m[i], '{assign}', 1)) >= 6"), "access": (r"AKIA[A-Z0-9]+", "length(m[i]) >= 20"), "hex": (r"[0-9a-f]{24,}", "true"),
        "pem": (PEM, "true"), "forge": (r"\bgh[pousr]_[A-Za-z0-9]{36}\b", "true"),
    }
    starts = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST({starts} AS BIGINT) AS s, CAST({starts} + length(m[i]) AS BIGINT) AS e
        FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM texts)) WHERE {ok}"""
        for rank, (kind, (p, ok)) in enumerate(kinds.items())
    )
    text = "string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}),
      sums AS (SELECT doc_id, {counts}, {text[:-1]}) FILTER (rank < {len(BASE)}) AS base, {text} AS spans FROM found GROUP BY doc_id)
      SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
      FROM texts t LEFT JOIN sums ON sums.doc_id = t.doc_id"""


ORACLE = in_sql()
