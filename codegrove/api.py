"""The engine's entry points for corpora, files and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegrove.functions.parser import functions, parse_errors, parse_sources, statements, top_level_functions
from codegrove.operators import links, metrics
from codegrove.sources.files import read_sources


class Corpus:
    """A parsed corpus. Filter sources before: filters do not pass the parser."""

    def __init__(self, sources: DataFrame, thresholds: metrics.Thresholds = metrics.Thresholds()):
        self.sources = sources
        self.parsed = parse_sources(sources)
        self.thresholds = thresholds

    @classmethod
    def of_files(cls, spark: SparkSession, path: str, glob: str = "*.py", thresholds: metrics.Thresholds = metrics.Thresholds()) -> Corpus:
        return cls(read_sources(spark, path, glob), thresholds)

    def functions(self) -> DataFrame:
        return functions(self.parsed)

    def statements(self) -> DataFrame:
        """One row per statement of a function."""
        return statements(parse_sources(self.sources, statements=True))

    def errors(self) -> DataFrame:
        return parse_errors(self.parsed)

    def metrics(self) -> DataFrame:
        return metrics.metrics(self.functions())

    def tagged(self) -> DataFrame:
        return metrics.with_tags(self.metrics(), self.thresholds)

    def tags(self) -> DataFrame:
        return metrics.tags(self.tagged())

    def probe(self, entries: DataFrame | None = None) -> DataFrame:
        """Every function with tags, catalog links, report and spoken summary; trust is not computed and stays null."""
        return self._reported(self.tagged(), entries)

    def _reported(self, tagged: DataFrame, entries: DataFrame | None) -> DataFrame:
        probed = links.with_report(links.probe_results(tagged, entries))
        names = F.transform("tags", lambda t: t["name"])
        return probed.withColumn("spoken", links.spoken_summary(names)).withColumn("trust_score", F.lit(None).cast("double"))

    def probe_function(self, qualified_name: str, entries: DataFrame | None = None) -> DataFrame:
        """probe() of the first function of that exact name in each file; no row where a file has none."""
        found = metrics.with_tags(metrics.metrics(self.find(qualified_name)), self.thresholds)
        return self._reported(found, entries)

    def top_level_functions(self) -> DataFrame:
        return top_level_functions(self.parsed)

    def find(self, qualified_name: str) -> DataFrame:
        return metrics.find(self.functions(), qualified_name)

    def listing(self) -> DataFrame:
        return metrics.listing(self.functions())
