"""URL filter: fixed rules first, then rules mined from labels.

A fixed rule (host, path) fits its host and all subdomains where the path starts with the rule's;
the longest rule decides. For all other URLs, association rules decide: FP-growth mines the token
combinations of labelled URLs, and a combination blocks if enough bad URLs have it (support) and
enough of all URLs with it are bad (confidence). Rules that hold a smaller rule are dropped.

Tokens are scheme, host labels, host without its first label, path segments (runs of digits as
`#`), file ending, names of query parameters and whether there is a fragment. Matching goes through
an inverted index: a rule stands under its rarest token, only URLs with that token look at it, and
then all its tokens are compared.

Scale: labelled URLs are counted as distinct token sets where they can be, mining is Spark's
FP-growth, and URLs are matched once per distinct token set, so a host with a third of all rows is
few rows. Verdicts come back by a join between written tables on the token set, where adaptive
execution splits hot sets. The number of rules is bounded by the relative support.

Defined results: a null URL, or one without `://`, has empty host and path and no tokens; it is
allowed. Rows are judged one by one, repeated ids included. Without labels, or without rules that
reach the limits, the method allows. No token is left out of the counts of support and confidence;
combinations of kinds of tokens (see `mine`) can grow as powers of two. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import named, written

#: host, path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.001
MIN_ROWS = 8
MIN_CONFIDENCE = 0.8
BAD = "label:bad"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The sorted set of a URL's tokens; empty without a host."""
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    parts = F.concat(
        mark("scheme:", F.array(F.translate(F.regexp_extract(url, "^(.*?)://", 1), UPPER, LOWER))),
        mark("host:", F.split(host, "\\.")),
        mark("site:", F.array(F.regexp_extract(host, "^[^.]*\\.(.*\\..*)$", 1))),
        mark("path:", segments),
        mark("ending:", F.array(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))),
        mark("query:", names),
        mark("fragment:", F.array(F.when(F.instr(url, "#") > 0, "yes").otherwise(""))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def mine(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules (kinds, index_kind, confidence) that block, from labelled rows (tokens, bad), and rows (token, kind).

    Tokens that occur in the same labelled rows are one kind, by its first token. Kinds that are rules
    alone are not mined, nor are those of all rows: with them a combination is no rule or holds a smaller one.
    """
    spark = labelled.sparkSession
    nothing = spark.createDataFrame([], "kinds array<string>, index_kind string, confidence double")
    no_kinds = spark.createDataFrame([], "token string, kind string")
    labelled = written(labelled.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    rows = labelled.count()
    least = max(min_rows, int(-(-rows * min_support // 1)))
    if labelled.where("bad").count() < least:
        return nothing, no_kinds
    exploded = labelled.withColumn("token", F.explode("tokens"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "row")).alias(f"mark{seed}") for seed in (1, 2)]
    counts = exploded.groupBy("token").agg(F.count_if("bad").alias("bad_rows"), F.count(F.lit(1)).alias("rows"), *marks)
    counts = counts.where(F.col("bad_rows") >= least)
    same = Window.partitionBy("rows", "bad_rows", "mark1", "mark2")
    kinds = written(counts.withColumn("kind", F.min("token").over(same)).drop("mark1", "mark2"), "url-kinds")
    each = kinds.where("token = kind").withColumn("confidence", F.col("bad_rows") / F.col("rows"))
    rules = each.where(F.col("confidence") >= min_confidence).select(F.array("kind").alias("kinds"), "confidence")
    rest = each.where((F.col("confidence") < min_confidence) & (F.col("rows") < rows)).select("token")
    baskets = exploded.join(rest, "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    baskets = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    baskets = written(baskets, "url-baskets")
    n = baskets.count()
    if n >= least:
        # half a row less than `least`, so that rounding keeps combinations of exactly so many rows
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets)
        sets = found.freqItemsets.where(F.col("freq") >= least)
        sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
        bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
        bad = bad.select(F.array_remove("items", BAD).alias("kinds"), F.col("freq").alias("bad_freq"))
        mined = bad.join(sets, F.col("kinds") == F.col("items")).withColumn("confidence", F.col("bad_freq") / F.col("freq"))
        rules = rules.unionByName(mined.where(F.col("confidence") >= min_confidence).select("kinds", "confidence"))
    sized = each.select(F.col("kind"), "rows")
    rarest = rules.withColumn("kind", F.explode("kinds")).join(sized, "kind").groupBy("kinds", "confidence")
    rules = written(rarest.agg(F.min(F.struct("rows", "kind"))["kind"].alias("index_kind")), "url-rules")
    # a rule with another rule inside adds nothing: that one is looked up by its own rarest kind
    inner = rules.select(F.col("kinds").alias("inner"), F.col("index_kind").alias("inner_kind"))
    outer = rules.withColumn("inner_kind", F.explode("kinds")).join(inner, "inner_kind")
    outer = outer.where((F.size("inner") < F.size("kinds")) & (F.size(F.array_except("inner", "kinds")) == 0))
    return rules.join(outer.select("kinds").distinct(), "kinds", "left_anti"), kinds.select("token", "kind")


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    min_support: float = MIN_SUPPORT,
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the tokens of the mined rule that fits, if one does.

    `labels` has rows (page_id, bad). Of several labels of an id, a bad one holds.
    """
    url = named(url_col)
    rows = pages.select(named(id_col).alias("page_id"), url.alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    rows = written(rows.select("page_id", "host", "path", "tokens"), "url-pages")
    known = labels.groupBy(F.col("page_id")).agg(F.max("bad").alias("bad"))
    labelled = rows.join(known, "page_id").select("tokens", "bad")
    mined, kinds = mine(labelled, min_support, min_rows, min_confidence)
    profiles = rows.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(kinds, "token")
    members = F.collect_list(F.struct("kind", "token")).alias("members")
    profiles = profiles.groupBy("tokens").agg(F.collect_set("kind").alias("has"), members)
    looked = profiles.withColumn("index_kind", F.explode("has"))
    hits = looked.join(mined, "index_kind").where(F.size(F.array_except("kinds", "has")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("far"), "kinds"))["kinds"]
    hits = hits.groupBy("tokens").agg(best.alias("kinds"), F.first("members").alias("members"))
    # of each kind, the first token that the URL has
    token = lambda kind: F.array_min(F.filter("members", lambda x: x["kind"] == kind))["token"]
    hits = written(hits.select("tokens", F.array_sort(F.transform("kinds", token)).alias("combination")), "url-hits")
    judged = rows.join(hits, "tokens", "left")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("combination").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.array_join("combination", " ").alias("mined_rule"),
    )
