"""Queries over genotype calls, quality strata, read records and grouped events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions import fastq as fq
from lociq.operators import variants as va
from lociq.plans.fixtures import duck, view
from lociq.streaming import events as ev

PL = [f"CAST(abs(gt - {g}) * 5 * least(dp, 60) AS INT) AS pl{g}" for g in range(3)]
COLUMNS = ["doc_id", "CAST(16 * (doc_id % 2) + 64 * (doc_id % 4) AS INT) AS flag", "seq", "translate(seq, 'ACGTN', 'I5/+#') AS qual"]
READ = ", ".join(COLUMNS)
RECORD = "l_tax * 1000 AS qual, l_returnflag = 'A' AS known, l_linestatus = 'F' AS transition"


def likelihoods(spark, sf_dir):
    return view(spark, sf_dir, "fx_geno").selectExpr("site", "sample", "grp", *PL)


def reads(spark, sf_dir, name="fx_whole"):
    return view(spark, sf_dir, name).selectExpr(*COLUMNS)


def fastq_records(spark, sf_dir):
    name = F.concat(F.lit("r"), "doc_id")
    return reads(spark, sf_dir).select("doc_id", fq.record(name, F.col("flag"), F.col("seq"), F.col("qual")).alias("value"))


def quality_trim(spark, sf_dir):
    return reads(spark, sf_dir).select("doc_id", fq.trimmed(F.col("qual"), F.col("flag").bitwiseAND(16) != 0).alias("trimmed"))


def event_sessions(spark, sf_dir):
    aggs = F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n")
    return ev.gap_sessions(view(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "1 hour", *aggs).drop("span")


def event_windows(spark, sf_dir):
    own = ev.windowed(view(spark, sf_dir, "events"), "event_type", "ts", "1 hour", "1 hour", F.count("*").alias("n"))
    return own.select("event_type", F.date_format("span.start", "yyyy-MM-dd HH").alias("hour"), "n")


QUERIES = {
    "genotype_calls": lambda s, d: va.called(likelihoods(s, d)).select("site", "sample", "grp", "gt", "gq"),
    "pl_gap_histogram": lambda s, d: va.gap_histogram(likelihoods(s, d)),
    "quality_strata": lambda s, d: va.quality_strata(view(s, d, "lineitem").selectExpr(*RECORD.split(", "))),
    "fastq_records": fastq_records,
    "quality_trim": quality_trim,
    "event_sessions": event_sessions,
    "event_windows": event_windows,
}

LIKE = f"WITH l AS (SELECT site, sample, grp, {', '.join(PL)} FROM fx_geno), g AS (SELECT *, list_sort([pl0, pl1, pl2]) AS s FROM l) "
ORACLES = {
    "genotype_calls": duck(
        LIKE + """SELECT site, sample, grp, CAST(CASE s[1] WHEN pl0 THEN 0 WHEN pl1 THEN 1 ELSE 2 END AS INT) AS gt,
        CAST(least(s[2] - s[1], 99) AS INT) AS gq FROM g"""
    ),
    "pl_gap_histogram": duck(
        LIKE + "SELECT CAST(least(gap, 255) AS INT) AS gap, count(*) AS sites FROM (SELECT site, min(s[2] - s[1]) AS gap FROM g GROUP BY site) GROUP BY 1"
    ),
    "quality_strata": f"""SELECT DISTINCT qual, CAST(count(*) OVER w AS BIGINT) AS records, CAST(sum(CAST(known AS INT)) OVER w AS BIGINT) AS known,
        CAST(sum(CAST(transition AS INT)) OVER w AS BIGINT) AS transitions
        FROM (SELECT CAST(floor(qual) AS INT) AS qual, known, transition FROM (SELECT {RECORD} FROM lineitem))
        WINDOW w AS (ORDER BY qual DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fastq_records": duck(
        f"""SELECT doc_id, concat_ws(chr(10), concat('@r', doc_id, CASE flag & 192 WHEN 64 THEN '/1' WHEN 128 THEN '/2' ELSE '' END),
        CASE WHEN (flag & 16) <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, '+',
        CASE WHEN (flag & 16) <> 0 THEN reverse(qual) ELSE qual END) AS value FROM (SELECT {READ} FROM fx_whole)"""
    ),
    "quality_trim": duck(
        f"""WITH q AS (SELECT doc_id, CASE WHEN (flag & 16) <> 0 THEN qual ELSE reverse(qual) END AS qual FROM (SELECT {READ} FROM fx_whole)),
        c AS (SELECT doc_id, unnest(range(length(qual) - 34)) AS i, unnest(list_slice(string_split(qual, ''), 1, length(qual) - 34)) AS m FROM q WHERE length(qual) > 34),
        s AS (SELECT doc_id, i, sum(53 - unicode(m)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM c),
        o AS (SELECT *, min(CASE WHEN total < 0 THEN i END) OVER (PARTITION BY doc_id) AS stop FROM s),
        b AS (SELECT doc_id, first(i ORDER BY total DESC, i) AS place FROM o WHERE total > 0 AND (stop IS NULL OR i < stop) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(place, 0) AS INT) AS trimmed FROM q LEFT JOIN b USING (doc_id)"""
    ),
    "event_sessions": """SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN ts < before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, run""",
    "event_windows": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1, 2",
}
