"""A stored inverted index over texts: built once, extended by batches, searched without reading the texts again.

Three tables in one folder, bucketed so that a search shuffles its own terms and never the index:

- postings (token, key, batch): which rows hold a token, bucketed by token.
- words (gram, token, batch): the tokens that contain a gram of `gram` letters, shorter tokens as their own gram; bucketed
  by gram.
- rows (key, batch): which batch a key came with.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import settled

#: Bytes of text for a bucket of a new index.
BUCKET_BYTES = 64 << 20
#: Asked terms or words for a bucket up to which they are hashed, so that the index isn't sorted to meet them.
HASHED = 1 << 19


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder. token: what counts as a token, a regular expression; key: the type of keys."""

    spark: SparkSession
    folder: str
    buckets: int
    token: str
    gram: int
    key: str
    name: str

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    @property
    def postings(self) -> DataFrame:
        """token, key of the latest batch of each key."""
        rows = self.table("postings")
        return rows.drop("batch") if not self.replaced() else rows.join(self._gone().hint("merge"), ["key", "batch"], "left_anti").drop("batch")

    @property
    def words(self) -> DataFrame:
        """gram, token: once for each batch that holds the token. Tokens of replaced texts stay; they have no postings left."""
        return self.table("words").select("gram", "token")

    def frequencies(self) -> DataFrame:
        """token, texts: how many texts hold a token."""
        return self.postings.groupBy("token").agg(F.count("*").alias("texts"))

    def batches(self) -> int:
        return self.table("rows").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]

    def replaced(self) -> bool:
        """Whether any key came with more than one batch: the later one counts."""
        return self.batches() > 1 and not self._gone().isEmpty()

    def _gone(self) -> DataFrame:
        rows = self.table("rows")
        last = rows.groupBy("key").agg(F.max("batch").alias("last"), F.count("*").alias("n")).filter("n > 1").select("key", "last")
        return rows.join(last.hint("merge"), "key").filter("batch < last").select("key", "batch")


_COLUMNS = {"postings": ("token string, key {key}, batch int", "token"), "words": ("gram string, token string, batch int", "gram"), "rows": ("key {key}, batch int", "key")}


def open_index(spark: SparkSession, folder: str, buckets: int, key: str, token: str = r"[\p{L}\p{N}]+", gram: int = 3) -> TextIndex:
    """The index in a folder; its tables are made known to the session, empty where there are no files yet."""
    index = TextIndex(spark, folder, buckets, token, gram, key, f"text_index_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}")
    for kind, (columns, by) in _COLUMNS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {index.name}_{kind} ({columns.format(key=key)}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}/{kind}'")
    return index


def create_index(texts: DataFrame, folder: str, key: str, text_col: str, buckets: int | None = None, token: str = r"[\p{L}\p{N}]+", gram: int = 3) -> TextIndex:
    """Index a table of texts in an empty folder. buckets can't change later: without a number there is one for BUCKET_BYTES of text, 8 at least."""
    if buckets is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        buckets = max(8, -(-size // BUCKET_BYTES))
    index = open_index(texts.sparkSession, folder, buckets, texts.schema[key].dataType.simpleString(), token, gram)
    return add_texts(index, texts, key, text_col)


def add_texts(index: TextIndex, texts: DataFrame, key: str, text_col: str) -> TextIndex:
    """Add a batch. A key that came before is replaced; keys must be unique within the batch. Only the batch is read and shuffled.

    Null and empty texts have no tokens; null keys are left out.
    """
    number = index.batches() + 1
    rows = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text_col).alias("text"))
    cores = index.spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a few large files: their texts are dealt out before they are cut
        rows = rows.repartition(cores, "key")
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(index.token), F.lit(0)))
    _append(index, "postings", rows.select(F.explode(tokens).alias("token"), "key", F.lit(number).alias("batch")))
    said = index.table("postings").filter(F.col("batch") == number).select("token").distinct()
    _append(index, "words", said.select(F.explode(grams(F.col("token"), index.gram)).alias("gram"), "token", F.lit(number).alias("batch")))
    _append(index, "rows", rows.select("key", F.lit(number).alias("batch")))
    return index


def _append(index: TextIndex, kind: str, rows: DataFrame) -> None:
    by = _COLUMNS[kind][1]
    setting, spark = "spark.sql.maxConcurrentOutputFileWriters", index.spark
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2")  # a task has one bucket: its rows aren't sorted to be written
    try:
        rows.repartition(index.buckets, by).write.mode("append").format("parquet").bucketBy(index.buckets, by).saveAsTable(f"{index.name}_{kind}")
    finally:
        spark.conf.set(setting, before)


def grams(c: Column, n: int) -> Column:
    """The distinct substrings of n letters; a shorter string as a whole."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.lit(n))))


def passing_index(texts: DataFrame, key: str, text_col: str, token: str = r"[\p{L}\p{N}]+", gram: int = 3) -> PassingIndex:
    """What a search needs of an index, for texts that are searched once."""
    said = texts.filter(F.col(key).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(token), F.lit(0)))).alias("token"), F.col(key).alias("key"))
    postings = settled(said, "passing-index")
    return PassingIndex(postings, postings.select("token").distinct().select(F.explode(grams(F.col("token"), gram)).alias("gram"), "token"), token, gram)


@dataclass(frozen=True)
class PassingIndex:
    """postings (token, key) and words (gram, token) of a search's own texts."""

    postings: DataFrame
    words: DataFrame
    token: str
    gram: int


def index_matches(index: TextIndex | PassingIndex, terms: DataFrame, texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """request_id, term, key: each text whose lower-case form contains a request's term (request_id, term); once or more.

    A term has one token or more; one without any, or a null, finds nothing. The longest token of a term and the words that
    contain it share that token's first letters as a gram. A term that is one token stands where such a word does; of other
    terms the candidates' texts (texts: key, text_col) are looked at. All joins are on equal keys.
    """
    terms = settled(terms.select("request_id", F.lower("term").alias("term")).distinct(), "index-requests")
    pieces = F.regexp_extract_all("term", F.lit(index.token), F.lit(0))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    said = terms.select("term").distinct().filter(F.size(pieces) > 0).withColumn("piece", longest)
    said = settled(said.withColumn("gram", F.expr(f"substring(piece, 1, {index.gram})")), "index-terms")
    buckets = index.buckets if isinstance(index, TextIndex) else int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = lambda few: few.hint("shuffle_hash" if few.count() <= HASHED * buckets else "merge")
    within = meet(said.filter(F.length("piece") >= index.gram)).join(index.words, "gram").filter(F.contains("token", "piece")).select("term", "piece", "token")
    kinds = said.agg(F.collect_set(F.when(F.length("piece") < index.gram, F.length("piece"))).alias("short"), F.count_if(F.col("term") != F.col("piece")).alias("longer")).first()
    for n in kinds["short"]:  # fewer numbers than `gram`
        words = index.words.select("token").distinct().select("token", F.explode(grams(F.col("token"), n)).alias("gram"))
        within = within.unionByName(said.filter(F.length("piece") == n).hint("merge").join(words, "gram").select("term", "piece", "token"))
    asked = settled(within.hint("merge").join(terms, "term"), "index-asked")
    found = meet(asked).join(index.postings, "token").select("request_id", "term", "piece", F.col("key").alias(key))
    hits = found.filter(F.col("term") == F.col("piece")).select("request_id", "term", key)
    if not kinds["longer"]:
        return hits
    longer = found.filter(F.col("term") != F.col("piece")).select("request_id", "term", key).distinct().hint("merge").join(texts.select(key, text_col), key)
    return hits.unionByName(longer.filter(F.contains(F.lower(text_col), "term")).select("request_id", "term", key))


def index_hits(index: TextIndex | PassingIndex, terms: DataFrame, texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """index_matches, each once."""
    return index_matches(index, terms, texts, key, text_col).distinct()
