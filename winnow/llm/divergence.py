"""Divergence of sources by an inverted index with corrections to a baseline (operator 11).

Texts are counted where they are read: each task adds up the terms of its documents
by language and source, in bounded dictionaries. The sums are dealt by language and
term, which gives the inverted index: for each kept term its postings, the sources
that hold it and how often. A pair of sources starts at V times the difference of
its shares of a term with no count. Postings then emit what differs from that: a
term that one source of a pair holds corrects the pair by the source's count alone,
so terms of equal count are corrected together; a term that both hold emits what
remains for that pair. Corrections of zero are not emitted. The terms in which a
source exceeds its language are ranked by a window.

Shares are whole numbers, 1 + floor(UNIT (count + ADDED) / (N + ADDED V)), and are
worked out in decimals, so that no count overflows them.

Cases: null texts, languages and sources count as ''. Rows are documents of their own,
whatever ids they have; doc_id and other columns aren't read. A language without kept
terms has pairs of value 0 and no ranked terms; a language of one source has no pairs.
Ties are ranked by item, in the order of UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.llm.shared import dropped, ship, written

LEAST_DOCUMENTS = 30
UNIT = 1_000_000_000
ADDED = 5
TOP = 50
#: Entries that a task's dictionaries hold before they are passed on; some 200 bytes each.
_HELD = 500_000
#: A-Z become a-z, other ASCII characters than letters become blanks, and all else stays: terms are what is between blanks.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_FOLDED).split()


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def counted(docs: DataFrame, held: int = _HELD) -> DataFrame:
    """lang, source, term (UTF-8), times and documents, summed within tasks only; with
    the term '' for each group of a language and a source that occurs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        holding: dict[tuple[str, str], Counter] = {}
        entries = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in times.items():
                found, n = holding[lang, source], len(own)
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64()), pa.array([found[t] for t in own], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "times", "documents"])
                for at in range(0, n, 20_000):
                    yield whole.slice(at, 20_000)
            times.clear()
            holding.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = lang.as_py(), source.as_py()
                own = times.setdefault(key, Counter({b"": 0}))
                found = holding.setdefault(key, Counter())
                before = len(own)
                words = terms(text.as_py())
                own.update(words)
                found.update(set(words))
                entries += len(own) - before
                if entries > held:
                    yield from passed_on()
                    entries = 0
        yield from passed_on()

    narrow = docs.select(_empty("lang").alias("lang"), _empty("source").alias("source"), _empty("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "lang string, source string, term binary, times long, documents long")


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The inverted index: lang, term, times (in the language) and postings (source,
    times) of the terms in at least so many documents of their language. The term ''
    has all sources of the language."""
    dealt = counted(docs).repartition("lang", "term")  # both sums below are within one partition
    sums = dealt.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("documents").alias("documents"))
    lists = sums.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("total"), F.collect_list(F.struct("source", "times")).alias("postings"))
    kept = lists.where((F.col("documents") >= least) | (F.octet_length("term") == 0))
    return kept.select("lang", F.col("term").cast("string").alias("term"), F.col("total").alias("times"), "postings")


def share(times: Column, n: Column, v: Column) -> Column:
    """Of UNIT, what a term with that count has among n occurrences of v terms."""
    whole = "decimal(20,0)"
    part = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (times + ADDED).cast(whole), (n + ADDED * v).cast(whole))
    return F.when(v > 0, 1 + part).otherwise(F.lit(0).cast("long"))


def _corrected(groups: DataFrame, held: DataFrame) -> DataFrame:
    """lang, source, item and value of each ordered pair of sources of a language.

    groups: lang, source, v, n and none (its share of a term with no count). held:
    lang, term, source, times, p and none, for each posting.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * F.abs(F.col("none") - F.col("other_none"))).alias("value"))
    equal = held.groupBy("lang", "source", "none", "times", "p").agg(F.count("*").alias("terms"))
    alone = equal.join(other, "lang").where("source <> item")
    alone = alone.withColumn("value", F.col("terms") * (F.abs(F.col("p") - F.col("other_none")) - F.abs(F.col("none") - F.col("other_none"))))
    second = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    both = held.join(second, ["lang", "term"]).where("source < item")
    both = both.withColumn("value", F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_none")) - F.abs(F.col("none") - F.col("other_p")) + F.abs(F.col("none") - F.col("other_none")))
    # one direction each: the lesser source first, summed before both directions are given
    lesser = [F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")]
    alone = alone.where("value <> 0").select("lang", *lesser, "value")
    emitted = alone.union(both.where("value <> 0").select("lang", "source", "item", "value")).union(base.where("source < item"))
    sums = emitted.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank.

    `pair`: item is another source of the language, value the sum of the differences
    of shares over the language's kept terms. `term`: item is a term of which the
    source has more than its language, value by how much, the `top` first ones.
    """
    postings = written(index(docs, least), "index")
    own = postings.where("term <> ''")
    langs = own.groupBy("lang").agg(F.count("*").alias("v"), F.sum("times").alias("lang_n"))
    flat = own.select("lang", "term", F.col("times").alias("lang_times"), F.inline("postings"))
    occurring = postings.where("term = ''").select("lang", F.inline("postings")).select("lang", "source")
    groups = occurring.join(flat.groupBy("lang", "source").agg(F.sum("times").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = written(groups.withColumn("none", share(F.lit(0), F.col("n"), F.col("v"))), "groups")
    held = flat.join(groups, ["lang", "source"]).withColumn("p", share(F.col("times"), F.col("n"), F.col("v")))
    held = written(held.withColumn("q", share(F.col("lang_times"), F.col("lang_n"), F.col("v"))), "held")
    pairs = _corrected(groups, held).withColumn("part", F.lit("pair"))
    more = held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    first = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select(columns)
    dropped(postings)
    return pairs.withColumn("rank", F.row_number().over(ranked)).select(columns).union(first)
