"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Everything is a native expression over one row; no shuffle. Costs grow with the text and its matches, a little faster
than in proportion for tens of thousands of matches (see spans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.spans import bound, find_spans, listed, ranked, replaced

LOCAL = "[A-Za-z0-9._%+-]"
#: Each run of LOCAL is tried from its start, or from the end of the match before; elsewhere it can't match.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"

BASE = ("email", "ip", "card", "phone")
#: Score of a span that passes its validator, before context, and words that raise it when they stand near.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.7, "iban": 0.9}
NEAR = {
    "email": "mail|contact|write|reach",
    "ip": "\\bip\\b|address|host|server",
    "card": "card|visa|master|credit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
}
AGAINST = "example|sample|test|version|order|invoice|isbn"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    value = lambda d, i: F.when(
        (F.length(digits) - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    ).otherwise(d)
    figures = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(figures, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (spaces removed) leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def detect(text: Column) -> dict[str, Column]:
    """Spans by kind; those of BASE first. `text` must not be null."""
    part_ok = lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(999)) <= 255
    checks = {
        "email": (EMAIL, "@", None),
        "ip": (IP, ".", lambda s: F.forall(F.split(s["match"], r"\."), part_ok)),
        "card": (CARD, None, lambda s: (F.length(digits_of(s["match"])) <= 19) & luhn(digits_of(s["match"]))),
        "phone": (PHONE, "+", lambda s: F.length(digits_of(s["match"])).between(10, 15)),
        "iban": (IBAN, None, lambda s: mod97(F.replace(s["match"], F.lit(" "), F.lit("")))),
    }
    found = {}
    for kind, (pattern, needs, ok) in checks.items():
        spans = find_spans(text, pattern, needs)
        found[kind] = F.filter(spans, ok) if ok else spans
    return found


def score(kind: str, span: Column) -> Column:
    """Confidence of a validated span: its prior, moved by words within 40 code points on either side.

    Words past the next span of the same kind belong to that.
    """
    near = F.lower(F.concat_ws("\n", F.right(span["before"], F.lit(40)), F.left(span["after"], F.lit(40))))
    return F.round(
        F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                F.lit(PRIOR[kind])
                + F.when(near.rlike(NEAR[kind]), 0.2).otherwise(0.0)
                - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0),
            ),
        ),
        4,
    )


def scored(kind: str) -> Column:
    return F.transform(kind, lambda s: s.withField("score", score(kind, s)).dropFields("before", "after"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans for each kind, with scores.

    Null texts count as empty; an empty table gives an empty result; repeated rows are judged each by itself;
    other columns are ignored whatever their names.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.select("doc_id", *[s.alias(k) for k, s in detect(F.col("text")).items()])
    return found.select(
        "doc_id",
        *[scored(k).alias(k) for k in PRIOR],
    )


def sure(kind: str, spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: score(kind, s) >= least)


def mask(text: Column, least: float = 0.2) -> Column:
    """`text` with every span of at least that score replaced by its kind in angle brackets; null stays null.

    No span of the kinds in BASE scores less than the default. Overlapping spans are replaced together, under the
    kind that begins first.
    """
    found = detect(F.coalesce(text, F.lit("")))
    rows = F.concat(*[ranked(sure(kind, spans, least), rank, kind) for rank, (kind, spans) in enumerate(found.items())])
    return bound(F.array_sort(rows), lambda r: F.when(F.size(r) == 0, text).otherwise(replaced(text, r)))


def op7(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = listed([(k, F.col(k)) for k in BASE])
    scores = F.concat(*[F.transform(k, lambda s: s["score"]) for k in PRIOR])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base, 256).alias("base_sha256"),
        listed([(k, F.col(k)) for k in PRIOR]).alias("spans"),
        F.array_max(scores).alias("top_score"),
    )
