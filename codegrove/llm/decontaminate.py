"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A document is contaminated by an item when it holds at least `containment` of the item's
distinct five-word shingles. Items are partitioned by their number n of shingles, in powers
of two. Each partition has its own sketch size: with e = n - ceil(containment * n), the
shingles that an item may miss, and E that of the partition's largest possible item, an item
keeps its min(n, E + 1 + E // 2) smallest hashes. A document that holds enough of the item
misses at most e of its sketch, so it must hit at least (sketch size - e) of it, which is
one or more: the search loses no document, however long that is, and the larger sketches of
the larger partitions leave few false candidates. Documents are not sketched; each hash of
theirs is looked up in the items' sketches. Candidates are verified by exact containment of
shingle texts.

Items of fewer than five words are shingled whole, by their own width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegrove.llm.common import materialize

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Tables of item shingles, candidates and findings up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_SPACE = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    text = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_SPACE))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"))


def _shingles(width: int, make) -> Column:
    """make(words...) for each run of `width` words in column w."""
    at = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: make(*(F.get("w", i + k) for k in range(width))))


def _join_words(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each document and item it contaminates.

    Words are the lower-cased text's runs of other characters than ASCII white space. Rows
    that share a doc_id (or item_id) are one document (item) with all their shingles.
    Null ids are skipped; null, empty and blank texts hold nothing and match nothing.
    Empty tables give an empty result; other columns are not read.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most five numbers
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("w"))

    def each_width(rows: DataFrame, *keys: str, make, of_width: bool) -> DataFrame:
        out = None
        for width in widths:
            part = rows.where(F.col("width") == width) if of_width else rows
            part = part.select(*keys, F.lit(width).alias("width"), F.explode(F.array_distinct(_shingles(width, make))).alias("s"))
            out = part if out is None else out.union(part)
        return out

    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_shingles long, containment double")
    item_shingles = each_width(items, "item_id", make=_join_words, of_width=True).distinct()
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    small = F.broadcast if item_shingles.count() <= BROADCAST_ROWS else lambda df: df

    hashes = each_width(items, "item_id", make=F.xxhash64, of_width=True).groupBy("item_id", "width").agg(F.array_sort(F.collect_set("s")).alias("h"))
    sketch = sketches(hashes, containment).select("item_id", "width", "least_hits", F.explode("sketch").alias("s"))
    probes = each_width(texts, "doc_id", make=F.xxhash64, of_width=False)
    met = probes.join(small(sketch), ["width", "s"]).groupBy("doc_id", "item_id", "least_hits").agg(F.count_distinct("s").alias("hits"))
    candidates = materialize(met.where("hits >= least_hits").select("doc_id", "item_id"), "candidates")

    # few candidates: their ids go to the texts; many: both are dealt out by id
    few = F.broadcast if candidates.count() <= BROADCAST_ROWS else lambda df: df
    held = each_width(texts.join(few(candidates.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", make=_join_words, of_width=False)
    hits = held.join(small(item_shingles), ["width", "s"]).join(few(candidates), ["doc_id", "item_id"], "left_semi")
    hits = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return hits.join(small(sizes), "item_id").where(share >= containment - 1e-9).select("doc_id", "item_id", "n_shared", "n_shingles", share.alias("containment"))


def sketches(hashes: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """hashes (item_id, width, h: sorted distinct hashes) with partition, sketch and least_hits, the hits that no contaminated document misses."""
    may_miss = lambda n: (n - F.ceil(n * F.lit(containment) - 1e-9)).cast("int")
    n = F.size("h")
    partition = F.floor(F.log2(n + F.lit(0.5))).cast("int")
    most = may_miss(F.pow(F.lit(2), partition + 1).cast("int") - 1)
    rows = hashes.withColumn("partition", partition).withColumn("sketch", F.slice("h", F.lit(1), F.least(n, most + 1 + F.floor(most / 2).cast("int"))))
    return rows.withColumn("least_hits", F.size("sketch") - may_miss(n))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs whose doc_id is not found contaminated; rows with a null doc_id stay."""
    found = materialize(find_contamination(docs, benchmark, containment).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    few = F.broadcast if found.count() <= BROADCAST_ROWS else lambda df: df
    return docs.join(few(found), F.col("doc_id").cast("long") == F.col("_found"), "left_anti").select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark),
ii AS (SELECT item_id, w, least(len(w), 5) AS width FROM i WHERE len(w) > 0),
isx AS (SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s FROM ii),
widths AS (SELECT DISTINCT width FROM ii),
dsx AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s FROM d, widths WHERE len(w) >= width),
sizes AS (SELECT item_id, count(*) AS n FROM isx GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM dsx JOIN isx USING (width, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8 - 1e-9
"""
