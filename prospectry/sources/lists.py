"""Hand-kept lists in text files: keywords, seed URLs, rosters, domain maps, templates.

``ord`` / ``line_no`` rise with the line's place in the file. Read one file per call where the
order between lines matters.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import strip


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.monotonically_increasing_id().alias("ord"), "value")


def plain_list(lines: DataFrame, name: str) -> DataFrame:
    """S1/S2 grammar on ``(ord, value)``: trimmed, no blanks, no line that starts with ``#``."""
    kept = lines.filter(~F.col("value").startswith("#") & (strip(F.col("value")) != ""))
    return kept.select("ord", strip(F.col("value")).alias(name))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, keyword)``; a missing file is an empty list."""
    return plain_list(_lines(spark, path), "keyword")


def read_seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, url)``."""
    return plain_list(_lines(spark, path), "url")


def _tabbed(lines: DataFrame) -> DataFrame:
    line = lines.select("ord", strip(F.col("value")).alias("line"))
    line = line.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return line.select("ord", F.split("line", "\t").alias("part"))


def parse_roster(lines: DataFrame) -> DataFrame:
    """S3: ``(ord, name, country)`` out of ``name[<TAB>country]`` lines."""
    out = _tabbed(lines).select(
        "ord",
        strip(F.get("part", F.lit(0))).alias("name"),
        F.coalesce(strip(F.get("part", F.lit(1))), F.lit("")).alias("country"),
    )
    return out.filter(F.col("name") != "")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster(_lines(spark, path))


def parse_domain_map(lines: DataFrame) -> DataFrame:
    """One row per name out of ``name<TAB>country<TAB>domain`` lines; the last line wins."""
    rows = _tabbed(lines).filter(F.size("part") >= 3).select(
        F.col("ord").alias("line_no"),
        F.get("part", F.lit(0)).alias("name"),
        F.get("part", F.lit(1)).alias("country"),
        F.get("part", F.lit(2)).alias("domain"),
    )
    return last_per_name(rows)


def last_per_name(rows: DataFrame) -> DataFrame:
    """The row with the highest ``line_no`` for each name; combines before the shuffle."""
    last = rows.groupBy("name").agg(
        F.max(F.struct("line_no", "country", "domain")).alias("last")
    )
    return last.select("last.line_no", "name", "last.country", "last.domain")


def read_domain_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_domain_map(_lines(spark, path))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages or pasted text, one row per file: ``(file, content)``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def parse_template(text: Column) -> Column:
    """``struct(subject, body)``; a text that does not start with ``subject:`` is an error."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    first = F.substring_index(text, "\n", 1)
    rest = F.when(
        F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)
    ).otherwise(F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(rest, r"\n\z", ""), r"\A\n+", "")
    subject = strip(F.substr(first, F.instr(first, ":") + 1))
    good = F.lower(first).startswith("subject:")
    fail = F.raise_error(F.lit("a message template must start with a 'Subject:' line"))
    return F.when(good, F.struct(subject.alias("subject"), rest.alias("body"))).otherwise(fail)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(subject, body)``."""
    parsed = read_blob(spark, path).select(parse_template(F.col("content")).alias("t"))
    return parsed.select("t.subject", "t.body")
