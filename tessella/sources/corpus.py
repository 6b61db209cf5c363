"""A golden retrieval corpus in JSON files: topics, queries and negative queries, annotated and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC = "struct<id:string,language:string,script:string,description:string,triggers:array<string>,body:string>"
QUERY = "struct<group:string,locale:string,partition:string,query:string,expected:string>"
SCHEMA = f"schema string, license string, topics array<{TOPIC}>, queries array<{QUERY}>, negative_queries array<{QUERY}>"
#: The script of each language tag; what a corpus must have.
SCRIPTS = dict(
    x.split(":")
    for x in "am:Ethi ar:Arab bg:Cyrl bn:Beng de:Latn el:Grek en:Latn es:Latn fa:Arab fr:Latn gu:Gujr he:Hebr hi:Deva hy:Armn id:Latn ja:Jpan ka:Geor km:Khmr kn:Knda ko:Kore lo:Laoo ml:Mlym mr:Deva my:Mymr pa:Guru pl:Latn pt-BR:Latn ru:Cyrl sr-Cyrl:Cyrl si:Sinh sw:Latn ta:Taml te:Telu th:Thai tr:Latn uk:Cyrl ur:Arab vi:Latn zh-Hans:Hans zh-Hant:Hant".split()
)
TOPICS, LANGUAGES, SCRIPT_COUNT, QUERIES_A_LANGUAGE, NEGATIVES_A_LANGUAGE = 40, 40, 20, 3, 1


def _script(language):
    return F.create_map(*[x for k, v in SCRIPTS.items() for x in (F.lit(k), F.lit(v))])[language]


def read(spark: SparkSession, *paths: str, challenges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, queries, negatives) of corpus files. Topics without a language take that of the queries that expect them;
    a remedy is a challenge, other queries are for selection unless they say so; negatives are challenges. `challenges`:
    further queries (group, locale, query, expected)."""
    held = spark.read.schema(SCHEMA).option("multiLine", True).json(list(paths)).select("*", F.col("_metadata.file_name").alias("source"))
    part = lambda c: held.select("source", F.explode(c).alias("x")).select("source", "x.*")
    partition = F.coalesce("partition", F.when(F.col("group") == "remedy", "challenge").otherwise("selection"))
    queries = part("queries").withColumn("partition", partition)
    if challenges is not None:
        queries = queries.unionByName(challenges.select(F.lit("challenges").alias("source"), "group", "locale", F.lit("challenge").alias("partition"), "query", "expected"))
    known = queries.groupBy("expected").agg(F.min("locale").alias("_locale"))
    topics = part("topics").join(known, F.col("id") == F.col("expected"), "left").withColumn("language", F.coalesce("language", "_locale"))
    topics = topics.withColumn("script", F.coalesce("script", _script(F.col("language")))).drop("expected", "_locale")
    annotated = lambda df: df.withColumn("language", F.col("locale")).withColumn("script", _script(F.col("locale")))
    return topics, annotated(queries), annotated(part("negative_queries").withColumn("partition", F.lit("challenge")).drop("expected"))


def violations(topics: DataFrame, queries: DataFrame, negatives: DataFrame) -> DataFrame:
    """(code, subject) of what a corpus lacks; subject is the id, query, language or count concerned."""
    spark = topics.sparkSession

    def few(df: DataFrame, c: str, least: int, code: str) -> DataFrame:
        return df.agg(F.count_distinct(c).alias("n")).filter(F.col("n") < least).select(F.lit(code).alias("code"), F.col("n").cast("string").alias("subject"))

    def twice(df: DataFrame, c: str, code: str) -> DataFrame:
        return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(code).alias("code"), F.col(c).alias("subject"))

    tags = spark.createDataFrame(list(SCRIPTS.items()), "language string, want string")
    by = lambda df, name, when=None: df.groupBy("language").agg((F.count(F.lit(1)) if when is None else F.count_if(when)).alias(name))
    each = topics.select("language").distinct().join(by(queries, "q"), "language", "left").join(by(negatives, "n"), "language", "left").join(by(queries, "s", F.col("partition") == "selection"), "language", "left").join(by(queries, "c", F.col("partition") == "challenge"), "language", "left").fillna(0)
    lacking = lambda cond, code: each.filter(cond).select(F.lit(code).alias("code"), F.col("language").alias("subject"))
    parts = [
        few(topics, "id", TOPICS, "too-few-topics"), few(topics, "language", LANGUAGES, "too-few-languages"), few(topics, "script", SCRIPT_COUNT, "too-few-scripts"), twice(topics, "id", "repeated-topic"), twice(queries, "query", "repeated-query"), twice(negatives, "query", "repeated-negative"),
        queries.join(topics.select(F.col("id").alias("expected")), "expected", "left_anti").select(F.lit("unknown-topic").alias("code"), F.col("query").alias("subject")),
        topics.join(tags, "language", "left").filter("want is null or want <> script").select(F.lit("wrong-script").alias("code"), F.col("id").alias("subject")), tags.join(topics.select("language").distinct(), "language", "left_anti").select(F.lit("missing-language").alias("code"), F.col("language").alias("subject")),
        lacking(F.col("q") < QUERIES_A_LANGUAGE, "too-few-queries"), lacking(F.col("n") < NEGATIVES_A_LANGUAGE, "no-negative"), lacking(F.col("s") == 0, "no-selection"), lacking(F.col("c") == 0, "no-challenge"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
