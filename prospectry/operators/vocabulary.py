"""Keywords and denied hosts as tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import strip

#: Keywords sent to every task at once.
BLOCK_BYTES = 8 << 20
_PIECES = r"[^\p{L}\p{N}]+"
_ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _lowered(keywords: DataFrame) -> DataFrame:
    return keywords.select(F.lower(strip(F.col("keyword"))).alias("keyword")).filter("keyword <> ''").distinct()


def _bytes(words: DataFrame) -> int:
    return words.agg(F.sum(F.octet_length("keyword") + 64)).first()[0] or 0


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    if words:
        automaton.make_automaton()
    return automaton


def keyword_hits(
    texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(key, keyword)`` for every keyword of the table ``keywords`` that a text holds as whole
    words, whatever the case. ``key`` is unique in ``texts``.

    Keyword tables of about ``block_bytes`` at most go to all tasks as an automaton that reads a text
    once; what it finds is judged by the characters around it, and neither texts nor their runs are
    moved. In larger tables a keyword is looked up by its longest run of letters and digits, which
    has to be one of the text's runs: an equi-join of narrow rows, split for frequent words by
    adaptive execution because both sides are plain shuffles; keywords of several runs are then
    looked for in their text, which all candidates of a text meet at once: no text moves once for
    each keyword. Keywords without a letter or digit are found nowhere. Starts a job over the keywords.
    """
    runs = lambda c: F.filter(F.split(c, _PIECES), lambda w: w != "")
    longest = F.array_max(F.transform(runs(F.col("keyword")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    wanted = _lowered(keywords).select("keyword", longest["w"].alias("_run")).filter(F.col("_run").isNotNull())
    single = ~F.col("keyword").rlike(_PIECES)
    edge = r"[^\p{L}\p{N}]"
    padded = texts.select(key, F.concat(F.lit(" "), F.lower(text), F.lit(" ")).alias("_text"))
    if _bytes(wanted) <= block_bytes:
        block = texts.sparkSession.sparkContext.broadcast([r[0] for r in wanted.select("keyword").collect()])
        schema = T.StructType([texts.select(key).schema[0], T.StructField("hits", T.ArrayType(T.StringType()))])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block.value)
            for batch in batches:
                out = []
                for t in batch.column("_text").to_pylist():
                    hits = set()
                    for end, word in automaton.iter(t) if t and block.value else ():
                        around = t[end - len(word)] + t[end + 1]
                        if around == "  " or not (_ASCII_WORD.issuperset(around[0]) or _ASCII_WORD.issuperset(around[1])):
                            hits.add(around + word)
                    out.append(list(hits))
                yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=[key, "hits"])

        # characters other than ASCII are judged by the same classes as in the joins below
        hits = padded.mapInArrow(find, schema).select(key, F.explode("hits").alias("_hit"))
        return hits.filter(F.substring("_hit", 1, 2).rlike(f"^{edge}{edge}$")).groupBy(key).agg(
            F.collect_set(F.expr("substring(_hit, 3)")).alias("_found")).select(key, F.explode("_found").alias("keyword"))
    found = texts.select(key, F.explode(F.array_distinct(runs(F.lower(text)))).alias("_run"))
    pairs = found.join(wanted, "_run").select(key, "keyword")
    several = pairs.filter(~single).groupBy(key).agg(F.collect_set("keyword").alias("_wanted"))
    whole = several.join(padded, key).select(key, F.explode(F.filter(
        "_wanted", lambda k: F.regexp_like("_text", F.concat(F.lit(edge + r"\Q"), k, F.lit(r"\E" + edge))))).alias("keyword"))
    return pairs.filter(single).union(whole)


def keyword_substrings(
    texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(key, keyword)`` for every keyword of the table ``keywords`` that a text holds anywhere,
    whatever the case: the meaning of ``RuleSet.keywords``, for tables of any number.

    Keywords are dealt by hash into blocks of about ``block_bytes``, each of which goes to all tasks
    as one automaton that reads a text once, however many keywords there are. Texts are not moved.
    Empty and null keywords are found nowhere, null texts hold none. Starts a job for each block.
    """
    words = _lowered(keywords)
    size = _bytes(words)
    n = max(1, -(-size // block_bytes))
    schema = T.StructType([texts.select(key).schema[0], T.StructField("keywords", T.ArrayType(T.StringType()))])
    out = texts.select(key, F.lit(None).cast("string").alias("keyword")).limit(0)
    for i in range(n if size else 0):
        mine = words.filter(F.pmod(F.xxhash64("keyword"), F.lit(n)) == i)
        block = texts.sparkSession.sparkContext.broadcast([r[0] for r in mine.collect()])

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block.value)
            for batch in batches:
                found = [sorted({w for _, w in automaton.iter(t)}) if t and block.value else []
                         for t in batch.column("_text").to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=[key, "keywords"])

        hits = texts.select(key, F.lower(text).alias("_text")).mapInArrow(find, schema)
        out = out.union(hits.select(key, F.explode("keywords").alias("keyword")))
    return out


def without_denied_hosts(rows: DataFrame, denied: DataFrame, host: str = "host") -> DataFrame:
    """``rows`` whose host, and whose last two labels, are not in the table ``denied`` (``host``)."""
    names = denied.select(F.col("host").alias("_denied")).distinct()
    kept = rows.join(names, F.col(host) == F.col("_denied"), "left_anti")
    return kept.join(names, F.substring_index(host, ".", -2) == F.col("_denied"), "left_anti")
