"""Licence scan by sentence rules, in DataFrame operations only.

Texts are cut into sentences; a normalised sentence that is known maps to an identifier;
the identifier sequence of a document is matched against rules, each an ordered list of
identifiers that must follow one another without another sentence between them.

A text is read twice: line by line, where every line break ends a sentence, and as wrapped
text, where only punctuation and lines without a letter or digit do. The second reading
leaves out list numbers; comment marks are no letters and vanish in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codegrove.llm.license_rules import RULES, identifiers, normalise

#: Sentences end at a line break, or at punctuation before white space.
SENTENCE_END = r"[.;:!?]*[ \t\r]*\n+|[.;:!?]+[ \t]+"

#: The same for wrapped text: each end is one of SENTENCE_END too. A comment mark such as ; ends nothing.
WRAPPED_END = r"[.;:!?]+[ \t\r]*\n+|(?<![\s.;:!?])[.;:!?]+[ \t]+|\n[^A-Za-z0-9\n]*\n"
LIST_NUMBER = r"^(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})$"
#: A list number that is not a sentence of its own: 1) or (a) before the first word.
LIST_MARK = r"^[^A-Za-z0-9]*(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})[)][ \t]+"

def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _table(spark, rows, schema) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # constants: their size is fixed


def scan_licenses(docs: DataFrame, rules: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Rules found: (doc_id, rule, license, first_sentence, n_sentences).

    first_sentence counts a text's non-blank sentences, read line by line, from 0. A rule of
    n sentences is found where its n identifiers stand on n sentences in a row, in either
    reading; a shorter rule inside is reported too. Null, empty and blank texts have no
    sentence. A null doc_id is reported as null; equal rows are reported once. An empty
    table gives an empty result; columns besides doc_id and text are not read.
    rules: (licence, sentences) by name; without, those of license_rules.
    """
    rules = rules or RULES
    names = identifiers(rules)
    spark = docs.sparkSession
    known = _table(spark, sorted(names.items()), "sentence string, name string")
    steps = _table(spark, [(rule, lic, len(parts), k, names[normalise(s)]) for rule, (lic, parts) in rules.items() for k, s in enumerate(parts)], "rule string, license string, n_sentences int, step int, name string")
    text = F.col("text").cast("string")
    lines = lambda t: F.filter(F.transform(F.split(t, SENTENCE_END), normalised), lambda s: s != "")
    read = lambda s, k: F.struct(normalised(F.regexp_replace(s, LIST_MARK, "")).alias("sentence"), k.alias("place"))
    whole = F.filter(F.transform(F.split(text, WRAPPED_END), read), lambda s: (s["sentence"] != "") & ~s["sentence"].rlike(LIST_NUMBER))
    found_in = lambda s: s["sentence"].isin(sorted(names))
    lined = F.filter(F.transform(lines(text), lambda s, k: F.struct(F.lit(0).alias("reading"), s.alias("sentence"), k.alias("at"), k.alias("place"))), found_in)
    wrapped = F.filter(F.transform(whole, lambda s, k: F.struct(F.lit(1).alias("reading"), s["sentence"].alias("sentence"), k.alias("at"), s["place"].alias("place"))), found_in)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.alias("text"), F.concat(lined, wrapped).alias("hits")).where(F.size("hits") > 0)
    # the line-wise number of a wrapped sentence: sentences of the parts before it
    before = F.aggregate(F.slice(F.split("text", WRAPPED_END), 1, F.col("hit.place")), F.lit(0), lambda n, part: n + F.size(lines(part)))
    rows = rows.select("doc_id", "rk", "text", F.explode("hits").alias("hit"))
    rows = rows.select("doc_id", "rk", "hit.reading", "hit.sentence", "hit.at", F.when(F.col("hit.reading") == 0, F.col("hit.place")).otherwise(before).alias("first"))
    hits = rows.join(known, "sentence").join(steps, "name")
    found = hits.groupBy("doc_id", "rk", "reading", "rule", "license", "n_sentences", (F.col("at") - F.col("step")).alias("start")).agg(F.count_distinct("step").alias("n"), F.min(F.when(F.col("step") == 0, F.col("first"))).alias("first_sentence"))
    return found.where("n = n_sentences").select("doc_id", "rk", "rule", "license", "first_sentence", "n_sentences").distinct().drop("rk")


#: Pieces of a rule as one expression over lower-cased raw text, for the SQL side: what may
#: stand between two words of a sentence, between two sentences, and a list number.
_CHAR = r"(?:[^a-z0-9\n.;:!?]|[.;:!?]+[^a-z0-9\s.;:!?])"
_INSIDE = rf"(?:{_CHAR}+[.;:!?]*|[.;:!?]+)"
_WRAPPED_INSIDE = rf"(?:{_CHAR}+[.;:!?]*|[.;:!?]+|{_CHAR}*\n[^a-z0-9\n]*)"
_BETWEEN = r"[^a-z0-9]*(?:\n|[.;:!?][ \t])[^a-z0-9]*"
_WRAPPED_BETWEEN = r"(?:[.;:!?]+[ \t]|[^a-z0-9]*(?:[^a-z0-9\s.;:!?][.;:!?]+[ \t]|[.;:!?][ \t\r]*\n|\n[^a-z0-9\n]*\n))[^a-z0-9]*"
_NUMBER = rf"(?:(?:[0-9]{{1,3}}|[a-z]|[ivx]{{1,4}})(?:[)][ \t]+|{_WRAPPED_BETWEEN})[^a-z0-9]*)?"


def rule_expression(sentences: list[str]) -> str:
    """A regular expression that finds a rule in a lower-cased text, read line by line or as wrapped text. It states the rule and does not cut the text."""

    def reading(inside: str, between: str, number: str) -> str:
        parts = (inside.join(normalise(s).split()) for s in sentences)
        return f"(?:^[^a-z0-9]*|[a-z0-9]{between}){number}" + f"{between}{number}".join(parts) + f"(?:[^a-z0-9]*$|{between})"

    return f"(?:{reading(_INSIDE, _BETWEEN, '')}|{reading(_WRAPPED_INSIDE, _WRAPPED_BETWEEN, _NUMBER)})"


def oracle_sql() -> str:
    """Which rules a text holds, by one regular expression for each rule."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    found = [f"SELECT doc_id, {quote(rule)} AS rule, {quote(lic)} AS license, {len(parts)} AS n_sentences FROM t WHERE contains(plain, {quote(normalise(parts[0]))}) AND regexp_matches(low, {quote(rule_expression(parts))})" for rule, (lic, parts) in RULES.items()]
    return "WITH t AS MATERIALIZED (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS plain FROM documents)\n" + "\nUNION ALL ".join(found)
