"""Six data-quality rules over catalog entries, as unions of DataFrames.

Entries carry their open fields as JSON, read as VARIANT. Every rule works per catalog,
so many catalogs can be checked at once. Messages quote values as Python's repr does for
plain strings, numbers and lists of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What a case field may say instead of listing cases.
MARKERS = ("need_cases", "need_data", "need_postmortems")
_BLANK = r"(?U)^\s*$"


def field(path: str, kind: str = "variant", of: str = "v") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def type_name(v: Column) -> Column:
    """Python's name for the type of a variant value; null for a JSON null or an absent value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(None))
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .otherwise("float")
    )


def quoted(text: Column) -> Column:
    plain = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(plain)


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(_BLANK)


def _issue(rule: int, severity: str, entity: Column, message: Column) -> list[Column]:
    return [F.col("catalog"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), entity.alias("entity"), message.alias("message")]


def _dogmas(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'dogma'").withColumn("v", F.parse_json("raw"))


def _entity() -> Column:
    return F.concat(F.lit("dogma:"), F.col("id"))


def rule_1(entries: DataFrame) -> DataFrame:
    """Every counter-position names its author."""
    items = _dogmas(entries).select("catalog", "id", F.posexplode(field("counter_dogmas", "array<variant>")).alias("i", "v"))
    is_map = F.coalesce(type_name(F.col("v")) == "dict", F.lit(False))
    shapes = items.where(~is_map).select(*_issue(1, "error", _entity(), F.concat(F.lit("counter_dogmas["), F.col("i").cast("string"), F.lit("] is not a mapping: "), F.when(type_name(F.col("v")) == "str", quoted(F.try_variant_get("v", "$", "string"))).otherwise(F.coalesce(F.to_json("v"), F.lit("None"))))))
    name = F.coalesce(field("name", "string"), F.concat(F.lit("<index "), F.col("i").cast("string"), F.lit(">")))
    nameless = items.where(is_map & blank(field("attribution", "string")))
    return shapes.unionByName(nameless.select(*_issue(1, "error", _entity(), F.concat(F.lit("counter_dogma '"), name, F.lit("' has no `attribution` (rule 1 — honesty-bug)")))))


def rule_2(entries: DataFrame) -> DataFrame:
    """A case field is a known marker, or a list of mappings with titles (a missing title is a warning)."""
    fields = F.array(*(F.struct(F.lit(f).alias("name"), field(f).alias("v")) for f in ("failure_cases", "success_cases")))
    values = _dogmas(entries).select("catalog", "id", F.inline(fields)).withColumn("t", type_name(F.col("v"))).where("t is not null")
    text = F.col("v").cast("string")
    unknown = values.where((F.col("t") == "str") & ~F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("")).isin(*MARKERS))
    allowed = "[" + ", ".join(f"'{m}'" for m in MARKERS) + "]"
    out = unknown.select(*_issue(2, "error", _entity(), F.concat("name", F.lit(": unknown marker "), quoted(text), F.lit(f". Allowed: {allowed} or a list of entries."))))
    other = values.where(~F.col("t").isin("str", "list"))
    out = out.unionByName(other.select(*_issue(2, "error", _entity(), F.concat("name", F.lit(": expected str marker or list, got "), "t"))))
    items = values.where("t = 'list'").select("catalog", "id", "name", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v")).withColumn("t", F.coalesce(type_name(F.col("v")), F.lit("NoneType")))
    place = F.concat("name", F.lit("["), F.col("i").cast("string"), F.lit("]"))
    out = out.unionByName(items.where("t <> 'dict'").select(*_issue(2, "error", _entity(), F.concat(place, F.lit(" must be a mapping with title/source_url/summary, got "), "t"))))
    untitled = items.where((F.col("t") == "dict") & (F.coalesce(field("title", "string"), F.lit("")) == ""))
    return out.unionByName(untitled.select(*_issue(2, "warning", _entity(), F.concat(place, F.lit(" is missing `title`")))))


def rule_3(entries: DataFrame) -> DataFrame:
    """Ids are unique over rules and candidates."""
    owner = F.when(F.col("kind") == "dogma", F.concat(F.lit("dogma §"), F.col("number").cast("string"))).otherwise("candidate")
    owners = F.array_sort(F.collect_list(F.struct((F.col("kind") != "dogma").alias("c"), "ord", owner.alias("owner"))))
    groups = entries.groupBy("catalog", "id").agg(F.count("*").alias("n"), owners.alias("owners")).where("n > 1")
    return groups.select(*_issue(3, "error", F.lit("catalog"), F.concat(F.lit("id "), quoted(F.col("id")), F.lit(" reused across entries: "), F.array_join(F.transform("owners", lambda o: o["owner"]), ", "))))


def rule_4(entries: DataFrame) -> DataFrame:
    """Numbers are unique, and the distinct ones are 1..N."""
    dogmas = entries.where("kind = 'dogma'")
    ids = F.array_sort(F.collect_list(F.struct("ord", "id")))
    reused = dogmas.groupBy("catalog", "number").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")
    out = reused.select(*_issue(4, "error", F.lit("catalog"), F.concat(F.lit("number §"), F.col("number").cast("string"), F.lit(" reused: "), listed(F.transform("ids", lambda x: quoted(x["id"]))))))
    got = dogmas.groupBy("catalog").agg(F.array_sort(F.collect_set("number")).alias("got")).withColumn("want", F.sequence(F.lit(1), F.size("got")))
    text = lambda c: listed(F.transform(F.array_sort(c), lambda x: x.cast("string")))
    message = F.concat(F.lit("dogma numbers are not a continuous 1..N sequence. Got "), text(F.col("got")), F.lit(". Missing: "), text(F.array_except("want", "got")), F.lit(". Extra/out-of-range: "), text(F.array_except("got", "want")), F.lit("."))
    return out.unionByName(got.where(F.col("got") != F.col("want")).select(*_issue(4, "error", F.lit("catalog"), message)))


def rule_5(entries: DataFrame) -> DataFrame:
    """A priority rule is not a stub."""
    return entries.where("kind = 'dogma' and v01_priority and status = 'stub'").select(*_issue(5, "error", _entity(), F.lit("v01_priority is true but status is 'stub' — priority dogmas must be at least 'draft'.")))


def rule_6(entries: DataFrame) -> DataFrame:
    """A final verdict has all its parts."""
    v = _dogmas(entries).where(field("honest_verdict.status", "string") == "final")

    def empty(name: str) -> Column:
        items = field(f"honest_verdict.{name}", "array<string>")
        return F.coalesce(~F.exists(items, lambda x: ~blank(x)), F.lit(True))

    parts = [(k, empty(k)) for k in ("follow_when", "break_when")] + [("main_signal", blank(field("honest_verdict.main_signal", "string")))]
    missing = F.array_compact(F.array(*(F.when(absent, F.lit(f"'{k}'")) for k, absent in parts)))
    found = v.withColumn("missing", missing).where(F.size("missing") > 0)
    return found.select(*_issue(6, "error", _entity(), F.concat(F.lit("honest_verdict.status is 'final' but these fields are empty/missing: "), listed(F.col("missing")))))


RULES = (rule_1, rule_2, rule_3, rule_4, rule_5, rule_6)


def validate(entries: DataFrame) -> DataFrame:
    """All issues (catalog, rule, severity, entity, message), ordered by catalog, rule, entity, message."""
    out = RULES[0](entries)
    for rule in RULES[1:]:
        out = out.unionByName(rule(entries))
    return out.orderBy("catalog", "rule", "entity", "message")


def has_errors(issues: DataFrame) -> bool:
    return bool(issues.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("bad")).first().bad)


def issue_line() -> Column:
    return F.concat(F.lit("  [rule "), F.col("rule").cast("string"), F.lit("] "), F.rpad("severity", 8, " "), F.lit(" "), "entity", F.lit(": "), "message")
