"""URL filters: host-suffix and path-prefix expressions, matched to rules on short hash prefixes, then whole digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, give_back, own_columns

#: Up to so many rules are broadcast (about 100 MB); more are joined by shuffle, with the urls' side salted.
BROADCAST_RULES = 500_000
SALTS = 32


def url_parts(url):
    """(host, path) columns. Host: what follows the first :// up to / ? # or the end, A-Z in lower case; path: what
    follows up to ? # or the end. Both are empty for null and where there is no ://."""
    whole = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, shape, 1)), F.regexp_extract(whole, shape, 2)


def digest(expression):
    return F.sha2(expression, 256)


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """urls with the columns host, path, rule and verdict (columns of these names are replaced).

    rules: (host, path, verdict), verdict allow or block; rows with a null are ignored. A rule fits its host and all
    subdomains where the url's path starts with its path; hosts of rules are taken without regard to the case of A-Z, as
    those of urls are. The longest rule wins, of equally long ones that with the longer host, and block wins where one rule
    has both verdicts. Without a rule the verdict is default, as a list of known sites says nothing about others. Every row
    stays, repeated ones too; a null or malformed url has an empty host and path, which no rule fits; a very long url is
    judged whole. No rules: all default. Other columns of urls, whatever their names, come back as they are.

    Each url becomes one row for each of its host suffixes and path prefixes whose number of labels and whose length some
    rule has (what is collected are these numbers, at most the longest rule's). They meet the rules on the first 32 bits of their digest.
    A task folds the rows of a url again before the shuffle, so a host with a third of all urls needs no care.
    """
    host, path = url_parts(F.col(url))
    known = (
        rules.dropna(subset=["host", "path", "verdict"]).filter("host <> ''")
        .groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
        .withColumn("r_whole", digest(F.concat("r_host", "r_path")))
    )
    known = known.select(F.substring("r_whole", 1, 8).alias("r_short"), "r_whole", F.length("r_host").alias("r_hlen"), F.length("r_path").alias("r_plen"), F.size(F.split("r_host", r"\.")).alias("r_depth"), "blocks")
    lengths = sorted(r[0] for r in known.select("r_plen").distinct().collect())
    depths = sorted(r[0] for r in known.select("r_depth").distinct().collect())
    base = urls.select(own_columns(urls, "host", "path", "rule", "verdict"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split(F.col("host"), r"\.")
    fitting = F.filter(F.array(*[F.lit(n) for n in depths] or [F.lit(0)]), lambda n: (n > 0) & (n <= F.size(labels)))
    suffixes = F.transform(fitting, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), lambda n: n <= F.length("path"))
    spread = base.withColumn("suffix", F.explode_outer(suffixes)).withColumn("plen", F.explode_outer(prefixes))
    spread = spread.withColumn("whole", digest(F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("plen")))))
    on = F.substring("whole", 1, 8) == F.col("r_short")
    if known.count() <= broadcast_rules:
        met = spread.join(F.broadcast(known), on, "left")
    else:
        known = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = spread.join(known, on & (F.pmod(F.col("row"), F.lit(SALTS)) == F.col("r_salt")), "left")
    sure = (F.col("whole") == F.col("r_whole")) & (F.length("suffix") == F.col("r_hlen")) & (F.col("plen") == F.col("r_plen"))
    rank = F.when(sure, F.struct((F.col("r_hlen") + F.col("r_plen")).alias("long"), F.col("r_hlen").alias("hlen"), F.col("blocks").alias("blocks")))
    best = met.groupBy("row", "own", "host", "path").agg(F.max(rank).alias("best"))
    hlen, plen = F.col("best.hlen"), F.col("best.long") - F.col("best.hlen")
    rule = F.when(F.col("best").isNotNull(), F.concat(F.substring(F.col("host"), F.length("host") - hlen + 1, hlen), F.substring(F.col("path"), F.lit(1), plen)))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks") == 1, "block").otherwise("allow")
    return give_back(best, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
