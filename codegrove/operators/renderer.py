"""Catalog entries as Markdown: one ordered text per entry, and one ordered document per catalog.

The fixed headings are part of the output format and are in the catalog's language.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from codegrove.operators.validator import field, type_name

#: Markers of the output format.
TEXT = {
    "stub": "_Кейсы и honest verdict пока не заполнены (статус `stub`)._",
    "definition": "**Определение.** ",
    "origin": "**Origin.** ",
    "conditions": "**Условия провала.**",
    "counter": "**Контр-догмы.**",
    "sources": "**Источники.**",
    "follow": "_Следуй догме, когда:_",
    "break": "_Ломай догму, когда:_",
    "no-author": "⚠ без attribution (honesty-bug)",
    "updated": "_Обновлено: {} — schema v{}._",
}


@dataclass(frozen=True)
class Template:
    """The prose around the entries, which belongs to the catalog's owner; empty parts are left out."""

    banner: str = "<!-- Written by codegrove render-catalog from the catalog file; edit that file. -->"
    title: str = "# Catalog"
    intro: str = ""
    candidates: str = "## Candidates"
    footer: str = ""

    @classmethod
    def of_file(cls, path: str | Path) -> Template:
        """From a YAML mapping of part to text."""
        import yaml

        parts = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        names = {f.name for f in fields(cls)}
        if not isinstance(parts, dict) or not set(parts) <= names:
            raise ValueError(f"{path}: a template is a mapping with keys out of {', '.join(sorted(names))}")
        return cls(**{k: str(v).strip("\n") for k, v in parts.items()})


def _text(path: str, of="v") -> Column:
    """A field as text; null if absent or empty."""
    return F.nullif(F.try_variant_get(of, f"$.{path}", "string"), F.lit(""))


def _plain(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("None"))


def _bullets(items: Column, make) -> Column:
    """null for no items."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, make), "\n"))


def _source(v: Column) -> Column:
    get = lambda *keys: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys))
    title, url, summary = F.coalesce(get("title", "name"), F.lit("(untitled source)")), get("url", "source_url"), get("summary", "thesis")
    head = F.when(url.isNotNull(), F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"))).otherwise(F.concat(F.lit("- "), title))
    made = F.concat(head, F.coalesce(F.concat(F.lit(" — "), summary), F.lit("")))
    return F.when(type_name(v) == "dict", made).otherwise(F.concat(F.lit("- "), _plain(v)))


def _counter(v: Column) -> Column:
    get = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    head = F.concat(F.lit("- **"), F.coalesce(get("name"), F.lit("(untitled)")), F.lit("** — _"), F.coalesce(get("attribution"), F.lit(TEXT["no-author"])), F.lit("_"))
    url = F.coalesce(F.concat(F.lit(" ([source]("), get("source_url"), F.lit("))")), F.lit(""))
    return F.concat(head, url, F.coalesce(F.concat(F.lit("\n  > "), get("thesis")), F.lit("")))


def _cases(heading: str, path: str) -> Column:
    v, kind = field(path), type_name(field(path))
    size = F.size(F.try_variant_get("v", f"$.{path}", "array<variant>"))
    falsy = F.to_json(v).isin('""', "0", "false", "[]", "{}", "0.0")
    body = (
        F.when(kind == "str", F.concat(F.lit("- _"), F.try_variant_get("v", f"$.{path}", "string"), F.lit("_")))
        .when((kind == "list") & (size > 0), _bullets(F.try_variant_get("v", f"$.{path}", "array<variant>"), _source))
        .otherwise(F.concat(F.lit(f"- _unsupported value shape for `{heading}`: "), kind, F.lit("_")))
    )
    return F.when(kind.isNotNull() & ~falsy, F.concat(F.lit(f"**{heading}.**\n\n"), body))


def _related() -> Column:
    return F.when(F.size("related_tags") > 0, F.concat(F.lit("**Related tags:** "), F.array_join(F.transform("related_tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "), F.lit(".")))


def _labelled(label: str, path: str) -> Column:
    return F.concat(F.lit(TEXT[label]), _text(path))


def _join(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def _verdict() -> Column:
    has = F.coalesce((type_name(field("honest_verdict")) == "dict") & (F.to_json(field("honest_verdict")) != "{}"), F.lit(False))
    parts = [F.concat(F.lit("**Honest verdict** \\["), F.coalesce(_text("honest_verdict.status"), F.lit("pending")), F.lit("\\]."))]
    for label, key in (("follow", "follow_when"), ("break", "break_when")):
        items = F.try_variant_get("v", f"$.honest_verdict.{key}", "array<variant>")
        parts.append(F.concat(F.lit(TEXT[label] + "\n\n"), _bullets(items, lambda x: F.concat(F.lit("- "), _plain(x)))))
    parts.append(F.concat(F.lit("**Main signal:** "), _text("honest_verdict.main_signal")))
    return F.when(has, _join(*parts))


def blocks(entries: DataFrame) -> DataFrame:
    """entries with block: the Markdown of one entry, without the blank line after it."""
    rows = entries.withColumn("v", F.parse_json("raw"))
    marker = F.when(F.col("v01_priority"), F.lit(" 🎯")).otherwise(F.lit(""))
    head = F.concat(F.lit("## §"), F.col("number").cast("string"), F.lit(". "), "title", marker, F.lit("  \\["), "status", F.lit("\\]"))
    stub = _join(head, _labelled("definition", "definition"), _labelled("origin", "origin"), F.lit(TEXT["stub"]), _related())
    conditions = F.concat(F.lit(TEXT["conditions"] + "\n\n"), _bullets(F.try_variant_get("v", "$.failure_conditions", "array<variant>"), lambda x: F.concat(F.lit("- "), _plain(x))))
    counters = F.concat(F.lit(TEXT["counter"] + "\n\n"), _bullets(F.try_variant_get("v", "$.counter_dogmas", "array<variant>"), _counter))
    body = _join(head, _labelled("definition", "definition"), _labelled("origin", "origin"), conditions, _cases("Failure cases", "failure_cases"), _cases("Success cases", "success_cases"), counters, _verdict())
    # a full entry without tags ends with one more blank line, as one with tags ends with the tags' line
    full = F.concat(body, F.coalesce(F.concat(F.lit("\n\n"), _related()), F.lit("\n")))
    sources = F.concat(F.lit(TEXT["sources"] + "\n\n"), _bullets(F.try_variant_get("v", "$.sources", "array<variant>"), _source))
    candidate = F.concat(_join(F.concat(F.lit("### "), "title", F.lit("  \\["), "id", F.lit("\\]")), _text("note"), sources), F.coalesce(F.concat(F.lit("\n\n"), _related()), F.lit("\n")))
    block = F.when(F.col("kind") != "dogma", candidate).when(F.col("status") == "stub", stub).otherwise(full)
    return rows.withColumn("block", block).drop("v")


def render(entries: DataFrame, updated: str | None = None, schema_version: int = 1, template: Template = Template()) -> DataFrame:
    """(catalog, markdown): one document per catalog, rules by number, then candidates; it ends with one line break.

    A document is one row: a catalog is a hand-written file, of thousands of entries at most.
    """
    rows = blocks(entries)
    ordered = lambda kind, *key: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*key, "block"))))
    docs = rows.groupBy("catalog").agg(ordered("dogma", "number", "ord").alias("d"), ordered("candidate", "ord").alias("c"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: s["block"]), "\n\n"))
    own = lambda part: F.lit(part or None).cast("string")
    dated = own(updated and TEXT["updated"].format(updated, schema_version))
    candidates = F.concat(F.lit(f"{template.candidates}\n\n" if template.candidates else ""), text(F.col("c")))
    whole = _join(own(template.banner), own(template.title), dated, own(template.intro), text(F.col("d")), candidates, own(template.footer))
    return docs.select("catalog", F.concat(F.regexp_replace(whole, r"(?U)\s+\z", ""), F.lit("\n")).alias("markdown"))


def drift(rendered: DataFrame, written: DataFrame) -> DataFrame:
    """Lines (side, line_no, line) of two one-row texts (column text) that are not the same on both sides; empty if the texts are equal."""

    def lines(df: DataFrame) -> DataFrame:
        return df.select(F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    a, b = lines(rendered), lines(written)
    return a.exceptAll(b).withColumn("side", F.lit("rendered")).unionByName(b.exceptAll(a).withColumn("side", F.lit("written"))).select("side", "line_no", "line")


def rule_list(entries: DataFrame, stubs: bool = True, candidates: bool = False) -> DataFrame:
    """(ord, line): rules by number, then candidates in catalog order if asked for."""
    dogma = F.col("kind") == "dogma"
    rows = entries.where((dogma & (F.lit(stubs) | (F.col("status") != "stub"))) | (~dogma & F.lit(candidates)))
    marker = F.when(F.col("v01_priority"), F.lit(" 🎯")).otherwise(F.lit(""))
    rule = F.concat(F.lit("§"), F.col("number").cast("string"), F.lit(". "), "title", F.lit(" ["), "status", F.lit("]"), marker)
    line = F.when(dogma, rule).otherwise(F.concat(F.lit("- "), "title", F.lit("  ["), "id", F.lit("]")))
    return rows.orderBy(~dogma, "number", "ord").select("kind", "number", "ord", line.alias("line"))
