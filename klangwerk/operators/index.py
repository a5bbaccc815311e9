"""The built search index: postings written once, asked by many query batches (JN-01/02/06, SK-02, SK-11, SR-16, ST-01).

``build`` pronounces and analyses a lexicon once and writes its postings: a row per form and retrieval key with all that a
search needs of the form (usage, syllables, sounds).  Postings are bucketed and sorted by their key, so a few keys are read
from their buckets alone and many are joined without moving the postings.  Each posting carries its place among the forms of
its key and syllable count, so the most used ones, the only ones that a bounded lookup can take, are a filter in the scan.

An index lies under a folder with a manifest that is written last: what it was built from (the source's files), with
which rules, and how.  ``open_or_build`` reads an index that fits and builds it else.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangwerk.functions import phonology as P

from . import lexicon as L
from . import relational as O
from . import search as S
from . import workspace as W

#: Changes whenever rules or layout do.
RULES = "2"
#: Buckets of a small index; one more for every so many forms.
LEAST_BUCKETS, FORMS_PER_BUCKET = 8, 500_000
#: Keys of a query batch up to which they stand in the scan's filter; beyond it they are joined.
MAX_KEYS = 2_000
POSTING = "posting string, syllables int, place int, language string, form string, usage_rank long, sound string"


@dataclass
class Index:
    """A table of postings in the session's catalog."""

    spark: SparkSession
    table: str
    folder: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def words(self) -> DataFrame:
        """The pronounced lexicon that the postings are of."""
        return self.spark.read.parquet(f"{self.folder}/words")


def _table(folder: str) -> str:
    return "klangwerk_postings_" + hashlib.sha256(folder.encode()).hexdigest()[:16]


def files_of(df: DataFrame) -> str:
    """What tells whether a table was written anew: its files with size and time, without reading them."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f))
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def build(lexicon_rows: DataFrame, folder: str, source: str = "", buckets: int | None = None) -> Index:
    """SK-02: writes the postings of a lexicon and, last, the manifest."""
    spark = lexicon_rows.sparkSession
    words = W.settled(L.pronounce(lexicon_rows).withColumn("sound", P.sound(F.col("a.syllables"), F.col("a.primary_stress"))), f"{folder}/words")
    buckets = buckets or LEAST_BUCKETS + words.count() // FORMS_PER_BUCKET
    keys = L.channels(words, "sound").select(F.concat_ws(":", "channel", "key").alias("posting"), "syllables", "language", "form", "usage_rank", "sound")
    placed = O.top_per_group(keys, ["posting", "syllables"], [F.asc_nulls_last("usage_rank"), F.asc("form")], 2**31 - 1, "place").withColumn("place", F.col("place").cast("int"))
    columns = [x.split(" ")[0] for x in POSTING.split(", ")]
    name = _table(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (placed.select(*columns).repartition(buckets, "posting").write.format("parquet").mode("overwrite").option("path", f"{folder}/postings")
     .bucketBy(buckets, "posting").sortBy("posting", "syllables", "place").saveAsTable(name))
    facts = [("rules", RULES), ("source", source), ("buckets", str(buckets))]
    spark.createDataFrame(facts, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return Index(spark, name, folder)


def reopen(spark: SparkSession, folder: str, source: str | None = None) -> Index | None:
    """The index in a folder, registered again if the session does not know it; None if it is not complete or does not fit."""
    if not W.exists(spark, f"{folder}/manifest/_SUCCESS"):
        return None
    facts = {r.key: r.value for r in spark.read.parquet(f"{folder}/manifest").collect()}
    if facts.get("rules") != RULES or source is not None and facts.get("source") != source:
        return None
    name = _table(folder)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({POSTING}) USING parquet CLUSTERED BY (posting) SORTED BY (posting, syllables, place) INTO {facts['buckets']} BUCKETS LOCATION '{folder}/postings'")
    return Index(spark, name, folder)


def open_or_build(spark: SparkSession, name: str, source: str, lexicon_rows) -> Index:
    """The index called ``name`` of a source with that fingerprint in the shared folder; ``lexicon_rows()`` is asked only if
    it must be built.  Each build has a folder of its own, so a lost one does no harm."""
    root = f"{W.shared_dir(spark)}/klangwerk-index-{hashlib.sha256(f'{name}|{source}|{RULES}'.encode()).hexdigest()[:24]}"
    if W.exists(spark, f"{root}/current/_SUCCESS"):
        found = reopen(spark, spark.read.parquet(f"{root}/current").first().folder, source)
        if found:
            return found
    made = build(lexicon_rows(), f"{root}/{uuid.uuid4().hex}", source)
    spark.createDataFrame([(made.folder,)], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return made


def lookup(queries: DataFrame, index: Index, per_channel: int = S.CHANNEL_LIMIT) -> DataFrame:
    """JN-01/02 over the index: as `search.candidates`, with the sounds of both sides.

    ``queries``: a channel table (`lexicon.channels`) with a column sound.  Only buckets and places that can matter are read;
    the postings are not moved."""
    q = queries.select("language", F.col("form").alias("query"), F.col("sound").alias("query_sound"), F.col("syllables").alias("query_syllables"), F.col("usage_rank").alias("query_rank"),
                       "channel", "channel_order", F.concat_ws(":", "channel", "key").alias("posting"))
    t = index.postings.where(F.col("place") <= per_channel + 1)  # one more: the query itself
    wanted = [r[0] for r in q.select("posting").distinct().limit(MAX_KEYS + 1).collect()]
    if len(wanted) <= MAX_KEYS:
        t = t.where(F.col("posting").isin(wanted))
    hits = q.join(t.drop("place", "language"), "posting").where("query != form")
    order = [F.abs(F.col("syllables") - F.col("query_syllables")), F.asc("syllables"), F.asc_nulls_last("usage_rank"), F.asc("form")]
    bounded = O.top_per_group(hits, ["language", "query", "channel"], order, per_channel)
    first = lambda c: F.first(c).alias(c)
    return bounded.groupBy("language", "query", "form").agg(*map(first, ("query_sound", "query_syllables", "query_rank", "sound", "syllables", "usage_rank")), F.min("channel_order").alias("channel_order"))


def asked(queries: DataFrame) -> DataFrame:
    """The channel table of query words, pronounced by rule."""
    rows = queries if "usage_rank" in queries.columns else queries.withColumn("usage_rank", F.lit(None).cast("long"))
    return L.channels(L.pronounce(rows).withColumn("sound", P.sound(F.col("a.syllables"), F.col("a.primary_stress"))), "sound")


def search(queries: DataFrame, index: Index, limit: int = 50, order: str = "usage") -> DataFrame:
    """The rows of `search.search`, from a built index and with bounded scoring."""
    best = S.best_scored(lookup(asked(queries), index), order)
    return S.diversified(S.utility(best), limit).select("language", "query", "form", "tier", "types", "score", "utility", "position")
