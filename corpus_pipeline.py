"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again for the next one. All but the last return the columns of documents.

Every stage takes nulls in any column, texts of any length, repeated rows, empty tables and further columns, whose names may
repeat those of documents in another case or those that operators add; its docstring says what comes of them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, jaccard, langid, mixing, scratch, sharding

#: Documents whose n-grams are known to their language in a smaller share than this are rejected with the letterless ones,
#: if they have so many that the share tells something.
MIN_LANGUAGE_SCORE = 0.3
JUDGED_GRAMS = 20

_tables: list[tuple[int, int]] = []


def stage(function):
    """Frees the tables that the stage called before has cut: its result has been written by then."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _tables:
            scratch.forget(spark, *_tables.pop())
        since = scratch.mark()
        out = function(spark, docs, sf_dir)
        _tables.append((since, scratch.mark()))
        return out

    return run


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns _c0, _c1 and so on, and which of them has which (exact) name."""
    names = docs.columns
    return docs.toDF(*[f"_c{i}" for i in range(len(names))]), {n: f"_c{names.index(n)}" for n in names}


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those long enough to judge that no learned language knows.

    The latter stay if no language was learned at all, or not the one of their label. Null and empty texts have no letters
    and go; repeated rows are judged alike, ties between languages decide nothing here; an empty table stays empty.
    """
    d, c = plain(docs)
    model = langid.fit(d.where(~langid.held_out(c["doc_id"])), key=c["doc_id"], text=c["text"], lang=c["lang"])
    lettered = langid.predict(d, model, c["text"]).where(F.col("grams").isNotNull())
    if model.langs:
        label = F.col(c["lang"])
        other = label.isNotNull() & ~label.isin(list(model.langs))
        lettered = lettered.where((F.col("score") >= MIN_LANGUAGE_SCORE) | (F.col("grams") < JUDGED_GRAMS) | other)
    return lettered.select(*d.columns).toDF(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: that with the smallest doc_id, null ids last, ties by a hash of
    the text. Documents without words (null and empty texts too) all stay; of rows that repeat an id and a text one stays;
    an empty table stays empty."""
    return jaccard.keep_first(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go. Null and empty texts have none and stay; repeated rows go or
    stay together; with an empty benchmark all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated. Documents without words (null and empty
    texts too) once; a null source is a source of its own; repeated rows are taken one by one, in an order that only a row
    number tells apart; an empty table stays empty."""
    d, c = plain(docs)
    out = mixing.mix(d, mixing.cycling_quotas, key=c["doc_id"], text=c["text"], sources=c["source"], keep=tuple(d.columns))
    each = out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*d.columns).toDF(*docs.columns)


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document, with its shard and its place there, as sharding.shard_rows says: rows of one doc_id (or of
    none) share a shard and have places of their own, ties among equal rows fall anyhow; an empty table stays empty."""
    return sharding.shard_rows(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
#: Language ID, the join's hashes and the mix's seeded choice have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = scratch.cut(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
