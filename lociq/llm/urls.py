"""URL filters: listed rules, and association rules mined by FP-growth from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BAD = "label=bad"
#: Least share of the labelled pages that hold a combination of tokens, and of those with it that are bad.
SUPPORT, CONFIDENCE = 0.002, 0.5


def host_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, verdict, rule) of the longest rule that fits, else null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host's suffixes, parts of its hyphened labels, the path's words and the query's keys."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.when(
        F.size(labels) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels))),
            lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        ),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    pieces = F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))
    words = F.transform(
        F.filter(F.split(path, "[/._-]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x)
    )
    keys = F.transform(
        F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1)),
        lambda x: F.concat(F.lit("q:"), x),
    )
    return F.array_distinct(F.concat(suffixes, pieces, words, keys))


def mine_rules(
    labelled: DataFrame, support: float, confidence: float, least: int = 20, partitions: int | None = None
) -> DataFrame:
    """rule_id, antecedent, confidence, support of token combinations that imply bad = 1.

    `labelled` has url and bad. Combinations need `support` as a share of the rows and `least` rows. A rule goes when it is
    no surer than the share of bad rows, or when a part of its antecedent has at least its confidence. FP-growth deals
    transactions out by token groups, and keeps on the driver no more than the frequent tokens, whose number is at
    most the mean number of tokens over `support`.
    """
    items = labelled.select(
        F.when(F.col("bad") == 1, F.array_append(tokens_of(F.col("url")), F.lit(BAD)))
        .otherwise(tokens_of(F.col("url")))
        .alias("items")
    )
    share = min(1.0, max(support, least / max(1, labelled.count())))
    growth = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence)
    model = (growth.setNumPartitions(partitions) if partitions else growth).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") > 1)).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )
    r, s = rules.alias("r"), rules.alias("s")
    # A more general rule shares a token with the special one; parts are compared token by token.
    parts = (
        s.select("antecedent", "confidence", F.explode("antecedent").alias("token")).alias("s")
        .join(r.select("antecedent", "confidence", F.explode("antecedent").alias("token")).alias("r"), "token")
        .where(
            (F.size("s.antecedent") < F.size("r.antecedent"))
            & (F.col("s.confidence") >= F.col("r.confidence"))
            & (F.size(F.array_except("s.antecedent", "r.antecedent")) == 0)
        )
        .select(F.col("r.antecedent").alias("antecedent"))
        .distinct()
    )
    kept = rules.join(parts, "antecedent", "left_anti")
    return kept.withColumn("rule_id", F.array_join("antecedent", " "))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence and rule_id of the surest mined rule whose tokens all stand in the url.

    The inverted index (token to rule) meets each distinct url's tokens; counts by url and rule are summed before
    the shuffle. Urls that no rule matches are absent.
    """
    index = rules.select(
        "rule_id", "confidence", F.size("antecedent").alias("needs"), F.explode("antecedent").alias("token")
    )
    own = urls.select("url").where(F.col("url").isNotNull()).distinct()
    hits = (
        own.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
        .join(index, "token")
        .groupBy("url", "rule_id", "confidence", "needs")
        .agg(F.count("*").alias("has"))
        .where("has = needs")
    )
    return hits.groupBy("url").agg(
        F.max(F.struct("confidence", "rule_id")).alias("best")
    ).select("url", "best.confidence", F.col("best.rule_id").alias("mined_rule"))


def judge(pages: DataFrame, labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every row of `pages`.

    Null urls and urls without "://" have empty host and path; they and urls without any matching rule are
    allowed. Repeated rows each get their verdict; other columns are ignored. Without labelled rows only the
    listed rules speak.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.withColumn("listed", longest_rule(F.col("host"), F.col("path")))
    if labelled.isEmpty():
        mined = pages.sparkSession.createDataFrame([], "url string, confidence double, mined_rule string")
    else:
        open_urls = ruled.where(F.col("listed").isNull())
        mined = match_rules(open_urls, mine_rules(labelled, support, confidence))
    return ruled.join(mined, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of pages whose document is labelled; the number that ends a url's path names its document.

    A page is bad if its document is toxic or of quality 0. Verdicts of listed rules are no labels: what they have in
    common says where the list has rules, not what is bad.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html?)?/?$", 1).try_cast("bigint")
    own = labels.where("quality is not null or toxic is not null").select(
        "doc_id", ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("bad")
    )
    return pages.select("url", number.alias("doc_id")).join(own, "doc_id").select("url", "bad")


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
