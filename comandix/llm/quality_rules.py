"""Rules on single documents, and lines that too many documents of one host share.

Everything is built-in expressions. Line hashes are counted over the distinct documents of a host, whatever a line's
length. A line above the limit goes from all of them but one: the first document that has it keeps it and is not
depleted by it, so of a group of copies, exact or near, one stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix.llm import common

WINDOW = 5
#: A line is removed if more distinct documents of its host than these have it, however large the host is.
LEAST_DOCUMENTS = 20
#: A document is depleted if fewer words than these, or less than this part of its words, remain.
LEAST_WORDS, LEAST_PART = 10, 0.3


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def normalised(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def _repeated_words(grams: str) -> Column:
    """Words covered by a window that is found twice or more; ``grams`` has the hashes by position."""

    def places(s: Column) -> Column:
        def is_at(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))

        found = F.filter(s, lambda x, j: is_at(x, j - 1) | is_at(x, j + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return _total(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(x - F.get(p, j - 1), F.lit(WINDOW))).cast("long")))

    by_hash = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = F.size(F.array_distinct(grams)) < F.size(grams)
    return F.when(twice, let(let(by_hash, places), covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A narrow row per document: key, id, host, base figures, lines."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_t"))
    first = base.select(
        "_id",
        "_host",
        common.row_key("_id", "_host", "_t").alias("_k"),
        F.transform(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(common.WORD)).alias("_lines"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    second = first.select(
        *[c for c in first.columns if c not in ("_w", "_lines")],
        F.size("_w").cast("long").alias("n_words"),
        F.when(F.size("_w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_g"),
        F.transform("_lines", lambda line: F.xxhash64(line)).alias("_lh"),
        F.transform("_lines", lambda line: F.struct(normalised(line).alias("h"), F.regexp_count(line, F.lit(common.WORD)).alias("w"))).alias("_all"),
    )
    return second.select(
        "_id", "_host", "_k", "n_words", "word_chars", "n_symbols", "_all",
        (F.size("_lh") - F.size(F.array_distinct("_lh"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_g").alias("n_repeat_words"),
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, id, base figures, base_failed, frequent lines, kept.

    A NULL text is an empty one: no words, base_failed. A NULL host is a host of its own. Equal rows get
    equal verdicts and count as one document. Lines that differ only in case and white space are one line. A frequent line
    stays in the document of the host with the smallest id that has it (of equal ids, by the hash of the row).
    """
    rows = common.stored(measured(docs, id_col, text_col, host_col))
    lines = rows.select("_k", "_id", "_host", F.explode(F.array_distinct(F.transform("_all", lambda s: s["h"]))).alias("_h"))
    counts = lines.select("_host", "_h", F.xxhash64("_k").alias("_d")).distinct().groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") > LEAST_DOCUMENTS)
    often = common.stored(counts.select(F.col("_host").alias("_oh"), "_h"))
    hit = lines.join(often, (F.col("_host").eqNullSafe(F.col("_oh"))) & (lines["_h"] == often["_h"])).select("_k", "_id", "_host", lines["_h"])
    hit = common.stored(hit)
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_k"))
    first = hit.groupBy("_host", "_h").agg(first.alias("_f")).select(F.col("_f._k").alias("_k"), "_h")
    hit = hit.join(first, ["_k", "_h"], "left_anti")
    hit = hit.groupBy("_k").agg(F.collect_set("_h").alias("_often"))
    out = rows.join(hit, "_k", "left").withColumn("_often", F.coalesce("_often", F.array().cast("array<bigint>")))
    gone = _total(F.transform(F.filter("_all", lambda s: F.array_contains("_often", s["h"])), lambda s: s["w"].cast("long")))
    out = out.withColumn("n_frequent_words", gone)
    left = F.col("n_words") - F.col("n_frequent_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_frequent_words") > 0) & ((left < LEAST_WORDS) | (left < LEAST_PART * F.col("n_words")))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words"]
    return out.select("_k", F.col("_id").alias(id_col), *figures, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "_often")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with its columns, without rejected documents and without lines above the limits."""
    keep = judged(docs, id_col, text_col, host_col).where("kept").select("_k", F.col("_often").alias("_often_")).dropDuplicates(["_k"])
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    key = common.row_key(name[id_col], name[host_col], name[text_col])
    kept = inner.withColumn("_k", key).join(keep, "_k")
    lines = F.filter(F.split(name[text_col], "\n"), lambda line: ~(line.rlike(common.WORD) & F.array_contains("_often_", normalised(line))))
    text = F.when(F.size("_often_") > 0, F.array_join(lines, "\n")).otherwise(F.col(name[text_col]))
    return kept.select(*[(text if c == text_col else F.col(name[c])).alias(c) for c in docs.columns])
