"""Verdicts on URLs by written rules, and by token rules mined from labelled URLs.

Everything is DataFrame work. URLs become sets of tokens (host labels with their place, path words,
query names). Spark's FP-growth mines the sets of labelled URLs together with their label; the
association rules that end in a label are pruned by support, confidence and lift, and a rule that adds tokens
to a more general one without gaining confidence goes. The support is a number of URLs, the same for every size of the
table. Two kinds of tokens would only multiply item sets: those that have one label only are rules by
themselves and are not mined, and of those that always occur together one stands for all, in the item sets as
in the URLs that are judged. Rules are matched by an inverted index: a
rule is listed under its rarest token only, and a candidate is confirmed by its whole token set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix.llm import common

#: Fixed by the task: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A mined rule holds in this many labelled URLs, is right this often, and more often than its label's share.
LEAST_URLS, CONFIDENCE, LIFT = 20, 0.8, 1.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(where + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Five kinds of tokens: the scheme, the last one and two host labels, the first one, path words, query names; no numbers.

    A path of any length gives all its words.
    """
    parts = F.split(host, r"\.")
    top = F.concat(F.lit("top="), F.element_at(parts, -1))
    site = F.concat(F.lit("site="), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "."))
    first = F.concat(F.lit("host="), F.element_at(parts, 1))
    words = F.transform(F.filter(F.split(F.lower(path), "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path="), w))
    names = F.transform(F.regexp_extract_all(F.lower(url), F.lit("[?&]([a-z_]+)="), F.lit(1)), lambda w: F.concat(F.lit("query="), w))
    scheme = F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))
    found = F.array_distinct(F.concat(F.array(scheme, top, site, first), words, names))
    return F.when((host == "") | url.isNull(), F.array().cast("array<string>")).otherwise(found)


EMPTY = "_rule array<string>, _verdict string, _confidence double, _support double"


def alike(often: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, stand-in): tokens that occur in the same labelled URLs, all of them, share the least of them as stand-in.

    A token's URLs are told by their number and two hashes of them.
    """
    shown = rows.select("_row", F.explode("_tokens").alias("_t")).join(often, "_t")
    told = shown.groupBy("_t").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("_row")).alias("_h1"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("_h2")
    )
    least = told.groupBy("_n", "_h1", "_h2").agg(F.min("_t").alias("_as"))
    return told.join(least, ["_n", "_h1", "_h2"]).select("_t", "_as")


def mined_from(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules over stand-ins, and (token, stand-in) of tokens that have another; from (_tokens, _label), all labelled rows."""
    spark = labelled.sparkSession
    rows = common.stored(labelled.where("_label is not null and size(_tokens) > 0").withColumn("_row", F.monotonically_increasing_id()))
    total = rows.count()
    none = spark.createDataFrame([], EMPTY), spark.createDataFrame([], "_t string, _as string")
    if total < LEAST_URLS:
        return none
    share = rows.groupBy("_label").agg((F.count(F.lit(1)) / total).alias("_share"))
    # Tokens below the limit can be in no rule.
    labels = rows.select("_label", F.explode("_tokens").alias("_t")).groupBy("_t", "_label").agg(F.count(F.lit(1)).alias("_n"))
    tokens_ = labels.groupBy("_t").agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"), F.max_by("_label", "_n").alias("_label"))
    tokens_ = common.stored(tokens_.where(F.col("_n") >= LEAST_URLS))
    # A token that has one label only is a rule that no further token can make surer, so it need not be mined.
    pure = tokens_.where("_n = _most").join(share, "_label").where(F.lit(1) >= LIFT * F.col("_share"))
    pure = pure.select(F.array("_t").alias("_rule"), F.col("_label").alias("_verdict"), F.lit(1.0).alias("_confidence"), (F.col("_n") / total).alias("_support"))
    often = tokens_.where("_n > _most").select("_t")
    stand = common.stored(alike(often, rows))
    items = rows.select("_row", F.explode("_tokens").alias("_t")).join(stand, "_t").groupBy("_row").agg(F.collect_set("_as").alias("_items"))
    label = F.array(F.concat(F.lit("label="), "_label"))
    items = rows.select("_row", "_label").join(items, "_row", "left").select(F.concat(F.coalesce("_items", F.array().cast("array<string>")), label).alias("items"))
    # A little under the limit, as the miner multiplies the share by the number of rows again.
    model = FPGrowth(itemsCol="items", minSupport=(LEAST_URLS - 0.5) / total, minConfidence=CONFIDENCE).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("label=") & ~F.exists("antecedent", lambda t: t.startswith("label=")))
    found = found.where(F.col("lift") >= LIFT).select(
        F.array_sort("antecedent").alias("_rule"), F.expr("substring(consequent[0], 7)").alias("_verdict"), F.col("confidence").alias("_confidence"), F.col("support").alias("_support")
    )
    found = common.stored(found)
    # A rule stands if no rule for the same verdict with fewer of its tokens is as sure; looked up token by token.
    short = found.select(F.col("_rule").alias("_r2"), F.col("_verdict").alias("_v2"), F.col("_confidence").alias("_c2"), F.element_at("_rule", 1).alias("_t"))
    long = found.select("_rule", "_verdict", "_confidence", F.explode("_rule").alias("_t"))
    covered = long.join(short, "_t").where((F.col("_v2") == F.col("_verdict")) & (F.size("_r2") < F.size("_rule")) & (F.col("_c2") >= F.col("_confidence")))
    covered = covered.where(F.size(F.array_except("_r2", "_rule")) == 0).select("_rule", "_verdict").distinct()
    found = found.join(covered, ["_rule", "_verdict"], "left_anti").select("_rule", "_verdict", "_confidence", "_support")
    return found.unionByName(pure), stand.where("_t <> _as")


def mined(labelled: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, support) from (_tokens, _label); see ``mined_from``."""
    return mined_from(labelled)[0]


def judged(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, method, confidence.

    ``labels`` has (id, label), the label ``block`` or ``allow``, one per id. A written rule decides where one fits;
    else the surest mined rule that matches, by confidence, support and then its tokens; else ``allow``.
    method says which: rule, mined or default. A NULL url or one without ``://`` has an empty host and path
    and is allowed. Repeated rows get equal verdicts. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.select("*", name.alias("_name"), verdict.alias("_told"), tokens(F.col("_url"), F.col("_host"), F.col("_path")).alias("_tokens"))
    rows = common.stored(rows)
    known = labels.select(F.col(labels.columns[0]).alias("_lid"), F.col(labels.columns[1]).alias("_label"))
    found, stand = mined_from(rows.join(known, F.col("_id") == F.col("_lid")).select("_tokens", "_label"))
    found = common.stored(found)
    # One row per distinct token set: urls differ in numbers mostly.
    sets = rows.where("_told is null and size(_tokens) > 0").select(F.array_sort("_tokens").alias("_set")).distinct()
    counts = found.select(F.explode("_rule").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    listed = found.select("*", F.explode("_rule").alias("_t")).join(counts, "_t").groupBy("_rule", "_verdict", "_confidence", "_support").agg(
        F.min_by("_t", F.struct("_n", "_t")).alias("_key")
    )
    # A set has a stand-in if it has any of the tokens it stands for.
    more = sets.select("_set", F.explode("_set").alias("_t")).join(stand, "_t").groupBy("_set").agg(F.collect_set("_as").alias("_also"))
    sets = sets.join(more, "_set", "left").select("_set", F.array_union("_set", F.coalesce("_also", F.array().cast("array<string>"))).alias("_all"))
    hit = sets.select("_set", "_all", F.explode("_all").alias("_key")).join(listed, "_key").where(F.size(F.array_except("_rule", "_all")) == 0)
    best = hit.groupBy("_set").agg(F.max(F.struct("_confidence", "_support", F.array_join("_rule", " ").alias("_r"), "_verdict")).alias("_best"))
    out = rows.withColumn("_set", F.array_sort("_tokens")).join(best, "_set", "left")
    method = F.when(F.col("_told").isNotNull(), "rule").when(F.col("_best").isNotNull(), "mined").otherwise("default")
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_name").alias("rule"),
        F.coalesce("_told", F.col("_best")["_verdict"], F.lit("allow")).alias("verdict"), method.alias("method"),
        F.when(F.col("_told").isNull(), F.col("_best")["_confidence"]).alias("confidence"),
    )
