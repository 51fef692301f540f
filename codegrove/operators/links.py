"""Tags joined with the rule catalog, and reports on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegrove.operators.metrics import DETECTORS

#: Number words of the spoken summary.
NUMBER_WORDS = ("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten")

#: Entries of one tag in the broadcast index, at most.
MAX_LINKS = 10_000


def tag_index(entries: DataFrame) -> DataFrame:
    """(tag, entry_ord, tag_pos, entry_id, entry_kind, entry_title, entry_number): rules before candidates, repeats kept."""
    rows = entries.select("kind", "ord", "id", "title", "number", F.posexplode("related_tags").alias("tag_pos", "tag"))
    return rows.select(
        "tag",
        F.struct((F.col("kind") != "dogma").alias("candidate"), "ord", "tag_pos").alias("entry_ord"),
        F.col("id").alias("entry_id"),
        F.col("kind").alias("entry_kind"),
        F.col("title").alias("entry_title"),
        F.when(F.col("kind") == "dogma", F.col("number")).alias("entry_number"),
    )


def probe_results(tagged: DataFrame, entries: DataFrame | None) -> DataFrame:
    """tagged with links: array of (detector_ord, entry_ord, tag_name, entry_id, entry_kind, entry_title, entry_number), tag order then index order.

    The index is folded to one row, a map from tag to its ordered entries, and that row is
    broadcast, so functions are never shuffled. Its size is checked: a tag may have MAX_LINKS
    entries, far beyond a hand-written catalog; with more the query fails and says so.
    """
    kind = "array<struct<detector_ord: int, entry_ord: struct<candidate: boolean, ord: int, tag_pos: int>, tag_name: string, entry_id: string, entry_kind: string, entry_title: string, entry_number: int>>"
    if entries is None:
        return tagged.withColumn("links", F.array().cast(kind))
    index = tag_index(entries).where(F.col("tag").isin(*DETECTORS))
    entry = F.struct("entry_ord", "entry_id", "entry_kind", "entry_title", "entry_number")
    index = index.groupBy("tag").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))
    refused = F.raise_error(F.concat(F.lit("too many catalog entries claim the tag "), "tag"))
    index = index.select("tag", F.when(F.col("n") > MAX_LINKS, refused.cast("array<struct<entry_ord: struct<candidate: boolean, ord: int, tag_pos: int>, entry_id: string, entry_kind: string, entry_title: string, entry_number: int>>")).otherwise(F.col("entries")).alias("entries")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "entries"))).alias("index"))
    # one row with at most as many keys as there are detectors, each with MAX_LINKS entries
    joined = tagged.join(F.broadcast(index))
    links = F.flatten(F.transform("tags", lambda t: F.transform(F.coalesce(F.try_element_at("index", t["name"]), F.array()), lambda e: F.struct(
        t["detector_ord"].alias("detector_ord"), e["entry_ord"].alias("entry_ord"), t["name"].alias("tag_name"), e["entry_id"].alias("entry_id"),
        e["entry_kind"].alias("entry_kind"), e["entry_title"].alias("entry_title"), e["entry_number"].alias("entry_number")))))
    return joined.withColumn("links", links.cast(kind)).drop("index")


def links(probed: DataFrame) -> DataFrame:
    """One row per link of a function's tag to a catalog entry."""
    return probed.select("path", "fn_ord", "qualified_name", F.explode("links").alias("l")).select("path", "fn_ord", "qualified_name", "l.tag_name", "l.entry_id", "l.entry_kind", "l.entry_title", "l.entry_number")


def unlinked_tags(tag_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Tags that no catalog entry claims. The names that a catalog claims are broadcast: tags have few names, by which they would be dealt out to as few tasks."""
    return tag_rows.join(F.broadcast(tag_index(entries).select(F.col("tag").alias("name")).distinct()), "name", "left_anti")


def with_report(probed: DataFrame) -> DataFrame:
    """probed with report: the plain text for one function, and loc, its lines from def to end."""
    loc = F.col("end_lineno") - F.col("lineno") + 1
    head = F.format_string("=== Function Probe ===\nFile: %s\nFunction: %s (lines %d-%d, %d total)\n", "path", "qualified_name", "lineno", "end_lineno", "loc")
    none = F.lit(f"No tags from the detector set.\nDetectors: {', '.join(DETECTORS)}.\n(Absence of a tag is not absence of a problem.)")
    lines = F.transform("tags", lambda t: F.format_string("- [%s] at line %d, col %d\n  %s", t["name"], t["line"], t["col"], t["detail"]))
    found = F.concat(F.lit("Detected tags:\n"), F.array_join(lines, "\n"), F.lit("\n"))

    def label(e):
        rule = F.concat(F.lit("§"), e["entry_number"].cast("string"), F.lit(" "), e["entry_title"])
        return F.when((e["entry_kind"] == "dogma") & e["entry_number"].isNotNull(), rule).otherwise(F.concat(F.lit("(candidate) "), e["entry_title"]))

    linked = F.transform("links", lambda e: F.concat(F.lit("- ["), e["tag_name"], F.lit("] → "), label(e), F.lit("  ["), e["entry_id"], F.lit("]")))
    section = F.when(F.size("links") == 0, F.lit("Catalog links: none — no catalog dogma claims these tags yet.")).otherwise(F.concat(F.lit("Catalog links:\n"), F.array_join(linked, "\n")))
    return probed.withColumn("loc", loc).withColumn("report", F.concat_ws("\n", head, F.when(F.size("tags") == 0, none).otherwise(F.concat_ws("\n", found, section))))


def spoken_summary(names: Column) -> Column:
    """A sentence for an array column of tag names."""
    n = F.size(names)
    words = F.array(*map(F.lit, NUMBER_WORDS))
    number = F.coalesce(F.get(words, n - 1), n.cast("string"))
    said = F.array_join(F.transform(names, lambda x: F.replace(x, F.lit("-"), F.lit(" "))), ", ")
    found = F.concat(number, F.when(n == 1, F.lit(" tag found: ")).otherwise(F.lit(" tags found: ")), said, F.lit(". Trust score unknown."))
    return F.when(n == 0, F.lit("No tags detected. Trust score unknown.")).otherwise(found)
