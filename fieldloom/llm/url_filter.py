"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed on full digests.

Each URL becomes the expressions host suffix + path prefix that any rule could have: suffixes of as many labels as rules
have, and prefixes that end at a slash, at the path's end, or at the length of a rule's path that ends elsewhere. The
expressions and the rules meet in an equi-join on the first 4 bytes of the SHA-256; the full digest confirms, and the rule
with the longest host, then the longest path, gives the verdict. Where no rule fits, the default verdict does.

Cases: a null URL or one without :// has an empty host and path, no rule and the default verdict. Repeated URLs are
judged once for each distinct host and path, so a hot URL costs nothing, and rows repeat as in the input. An empty rule
table gives the default verdict everywhere. Two rules of the same host and path: block wins. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the base.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Rows of rules up to which they are broadcast; beyond, the join shuffles.
BROADCAST_RULES = 100_000
#: Spellings of path lengths that rules without a final slash may have.
MOST_ODD_LENGTHS = 256

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, *LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: str, path: str) -> F.Column:
    return F.unhex(F.sha2(F.concat(F.col(host), F.lit("\u0000"), F.col(path)), 256))


def url_filter(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host + path, or null) and verdict for each row of urls."""
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(1)).alias("slashes"),
        F.array_sort(F.collect_set(F.when(~F.col("path").endswith("/"), F.length("path")))).alias("odd"),
    ).first()
    if len(shape["odd"]) > MOST_ODD_LENGTHS:
        raise ValueError("rules have paths of too many lengths that don't end with a slash")
    digest = _digest("host", "path")
    known = rules.withColumns({"digest": digest, "short": F.substring(digest, 1, 4)}).groupBy("short", "digest", "host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select("short", "digest", F.struct(F.length("host").alias("h"), F.length("path").alias("p"), F.concat("host", "path").alias("rule"), "verdict").alias("found"))
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    distinct = rows.select("host", "path").distinct()
    odd = F.array(*[F.lit(n) for n in shape["odd"]]).cast("array<int>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    pieces = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(pieces) - 1, F.lit(shape["slashes"])))),
        lambda k: F.when(F.size(pieces) > 1, F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))).otherwise(F.lit("")),
    )
    cut = F.transform(F.filter(odd, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    spelled = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.array_distinct(F.concat(prefixes, cut))).alias("prefix"))
        .withColumn("full", _digest("suffix", "prefix"))
    )
    best = (
        spelled.join(known, F.substring("full", 1, 4) == F.col("short"))
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max("found").alias("found"))
    )
    # A hot host and path would meet in one task here; its rows are dealt over salts, and the few rules found are repeated for each.
    salts = 16
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(best, ["host", "path", "salt"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )


