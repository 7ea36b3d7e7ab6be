"""Lexical search by stored postings: joins on words instead of scans per query.

A term counts where it occurs inside a text, so it is first matched with the corpus's distinct words, by the rarest of its grams; the
words lead to chunks. Not every chunk of every term is looked at. The best n known so far give a floor: n chunks have at
least t terms in the title and h terms at all. A chunk with h of a query's T terms has at least k of its rarest T - h + k, so only chunks with
k of those can still come in; very common words are never followed to their chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.operators.term_blocks import search_blocks
from parcelmart.scratch import stored

WORD_CLASS = "[\\p{L}\\p{N}_-]+"
WHOLE_WORD = "[\\p{L}\\p{N}]+"
PYTHON_WORD = re.compile(r"[^\W_]+")  # the same
GRAM = 3
WORD_WEIGHT = 0.1  # score of one matching word position
SEED_FACTOR = 4  # first candidates per wanted result
RARE_HITS = 3  # k above
BROADCAST_ROWS = 200_000  # words of queries that are sent to the places; for more, the places are shuffled by word
MANY_QUERIES = 32  # from so many queries on, following rare terms costs more than one pass over the texts, and blocks of queries meet all chunks
CHUNK_COLUMNS = ["chunk_id", "document_id", "title", "ordinal", "heading_path", "content"]


class Postings:
    """``words``: (gram, word, df), the distinct words by their grams; ``grams``: (gram, size), size the places of their words;
    ``places``: (word, chunk_no, n), n the occurrences in the content (0: only in the title); ``title_words``: (gram, word);
    ``titles``: (word, title); ``chunks``: the chunks as they were, numbered. A part is read from ``folder`` if it is among ``written``,
    else it is written there when a search first asks for it."""

    def __init__(self, chunks: DataFrame, folder: str, written: tuple[str, ...] = ()) -> None:
        self.chunks, self.folder, self.written = chunks, folder, written

    def _part(self, name: str, df: Callable[[], DataFrame], by: str) -> DataFrame:
        """Rows of a word or gram lie together, common ones are split."""
        if name in self.written:
            return self.chunks.sparkSession.read.parquet(f"{self.folder}/{name}")
        made = df()
        made.hint("rebalance", by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return made.sparkSession.read.schema(made.schema).parquet(f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        return name in self.written or name in self.__dict__

    @cached_property
    def places(self) -> DataFrame:
        return self._part("places", lambda: build_places(self.chunks), "word")

    @cached_property
    def words(self) -> DataFrame:
        return self._part("words", lambda: by_gram(self.places.groupBy("word").agg(F.count(F.lit(1)).alias("df"))), "gram")

    @cached_property
    def grams(self) -> DataFrame:
        return self._part("grams", lambda: self.words.groupBy("gram").agg(F.sum("df").alias("size")), "gram")

    @cached_property
    def titles(self) -> DataFrame:
        return self._part("titles", lambda: self.chunks.select("title").distinct().select(
            F.explode(F.array_distinct(_words(F.col("title")))).alias("word"), "title"), "word")

    @cached_property
    def title_words(self) -> DataFrame:
        return self._part("title_words", lambda: by_gram(self.titles.select("word").distinct()), "gram")


PARTS = ("places", "words", "grams", "titles", "title_words")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CLASS), F.lit(0))


def _grams(word: Column, sizes: Column) -> Column:
    """Distinct substrings of the sizes given (an array)."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda size: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1))), lambda i: F.substring(word, i, size)))))


def build_places(chunks: DataFrame) -> DataFrame:
    """(word, chunk_no, n) of content and title words. Texts are dealt by chunk, so that words are counted where they are."""
    def each(name: str, n: int) -> Column:
        found = F.transform(_words(F.col(name)), lambda w: F.struct(w.alias("word"), F.lit(n).alias("n")))
        return F.coalesce(found, F.array().cast("array<struct<word:string,n:int>>"))

    words = chunks.select("chunk_no", "content", "title").repartition("chunk_no").select(
        "chunk_no", F.inline(F.concat(each("content", 1), each("title", 0))))
    return words.groupBy("word", "chunk_no").agg(F.sum("n").alias("n"))


def by_gram(words: DataFrame) -> DataFrame:
    """The rows of a column of words, once for each substring of up to GRAM letters."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("word")))
    return words.select(F.explode(_grams(F.col("word"), sizes)).alias("gram"), "*")


def number_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """The chunks written below ``folder`` with a number each, and whatever else they have."""
    chunks.select(F.monotonically_increasing_id().alias("chunk_no"), "*").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunks")
    return chunks.sparkSession.read.parquet(f"{folder}/chunks")


def write_postings(chunks: DataFrame, folder: str) -> Postings:
    """The index of ``chunks`` (chunk_id, title, content) below ``folder``, with all its parts."""
    known = Postings(number_chunks(chunks.select(*[c for c in CHUNK_COLUMNS if c in chunks.columns]), folder), folder)
    return with_parts(known)


def with_parts(known: Postings) -> Postings:
    """All parts are written, also those no search has asked for."""
    for name in PARTS:
        getattr(known, name)
    return known


def read_postings(spark, folder: str) -> Postings:
    chunks = spark.read.parquet(f"{folder}/chunks")
    return Postings(chunks.select("chunk_no", *[c for c in CHUNK_COLUMNS if c in chunks.columns]), folder, PARTS)


# --- terms -------------------------------------------------------------------------------------------------


def _wild(term: Column) -> Column:
    return F.contains(term, F.lit("_"))


def _needle(term: Column) -> Column:
    """The part of a term that is looked up: the longest one between wildcards."""
    return F.reduce(F.split(term, "_"), F.lit(""), lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best))


def contains_term(text: Column, term: Column) -> Column:
    """Whether a lower-case text has the term; '_' is any one character."""
    return F.when(_wild(term), F.like(text, F.concat(F.lit("%"), term, F.lit("%")))).otherwise(F.contains(text, term))


def _anchors(index: Postings, queries: DataFrame) -> DataFrame:
    """(term, needle, gram, size, short): each asked term with the rarest gram of what is looked up. A short term is its own gram."""
    asked = queries.select(F.explode("terms").alias("term")).distinct().withColumn("needle", _needle(F.col("term")))
    size = F.least(F.lit(GRAM), F.length("needle"))
    sized = asked.select("term", "needle", F.explode(_grams(F.col("needle"), F.array(size))).alias("gram")).join(index.grams, "gram")
    rarest = sized.groupBy("term", "needle").agg(F.min(F.struct("size", "gram")).alias("best"))
    return rarest.select("term", "needle", "best.gram", "best.size", (F.length("needle") <= GRAM).alias("short"))


def _words_of(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """The words that hold each term, or, for one with wildcards, its longest part."""
    return words.join(anchors.select("term", "needle", "gram"), "gram").where(F.contains("word", F.col("needle")))


@dataclass(frozen=True)
class Asked:
    """``terms``: (query_id, term, place, before, met): a query's terms that may occur, rarest first; ``before``: places of those before;
    ``met``: how many. ``long_words``: (term, word) of terms longer than a gram; those of a short term are all words of its gram, and
    read only where the term is followed."""

    terms: DataFrame
    long_words: DataFrame
    anchors: DataFrame


def asked_terms(index: Postings, queries: DataFrame) -> Asked:
    anchors = stored(_anchors(index, queries), "lexical-anchors")
    long_words = stored(_words_of(anchors.where("NOT short"), index.words).select("term", "word", "df"), "lexical-words")
    sizes = long_words.groupBy("term").agg(F.sum("df").alias("df")).unionByName(
        anchors.where("short").select("term", F.col("size").alias("df")))
    by_query = Window.partitionBy("query_id")
    rarest = by_query.orderBy("df", "term")
    terms = queries.select("query_id", F.explode("terms").alias("term")).join(sizes, "term").select(
        "query_id", "term", F.row_number().over(rarest).alias("place"),
        (F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("df")).alias("before"),
        F.count(F.lit(1)).over(by_query).cast("int").alias("met"))
    return Asked(stored(terms, "lexical-terms"), long_words.select("term", "word"), anchors)


def _title_hits(index: Postings, queries: DataFrame, asked: Asked) -> DataFrame:
    """(query_id, title, title_hits) of the titles that have a term."""
    met = _words_of(asked.anchors, index.title_words).join(index.titles, "word").select("term", "title").distinct().where(
        contains_term(F.lower("title"), F.col("term")))
    return queries.select("query_id", F.explode("terms").alias("term")).join(met, "term").groupBy("query_id", "title").agg(
        F.count(F.lit(1)).cast("int").alias("title_hits"))


def chunks_of_terms(terms: DataFrame, asked: Asked, index: Postings) -> DataFrame:
    """(query_id, chunk_no, rare_hits) of the chunks that may hold one of the ``terms`` given, and how many of them."""
    short = _words_of(asked.anchors.where("short").join(terms.select("term").distinct(), "term", "left_semi"), index.words)
    words = asked.long_words.unionByName(short.select("term", "word"))
    bit = F.expr("shiftleft(1L, place)").alias("bit")
    followed = stored(
        terms.select("query_id", "term", bit).join(words, "term").groupBy("query_id", "word").agg(F.bit_or("bit").alias("bits")), "lexical-followed")
    how = "broadcast" if followed.count() <= BROADCAST_ROWS else "shuffle_hash"
    return index.places.select("word", "chunk_no").join(followed.hint(how), "word").groupBy("query_id", "chunk_no").agg(
        F.bit_count(F.bit_or("bits")).alias("rare_hits"))


# --- hits --------------------------------------------------------------------------------------------------

def _with_hits(pairs: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs with the number of terms in the title, of terms at all, and of words that are terms; pairs without any term go.

    Pairs and texts meet by chunk number. Counting eighteen terms in a text of some hundred characters is a plain loop over Arrow batches: Spark's
    functions of arrays would take a hundred times as long for it.
    """
    texts = chunks.select("chunk_no", "chunk_id", "title", "ordinal", F.lower("title").alias("low_title"), F.lower("content").alias("low"))
    joined = pairs.join(queries.select("query_id", "terms"), "query_id").join(texts, "chunk_no").select(
        "query_id", "chunk_id", "title", "ordinal", "terms", "low_title", "low")
    schema = T.StructType([*joined.schema.fields[:4], *[T.StructField(n, T.IntegerType()) for n in ("title_hits", "lexical_hits", "positions")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, {}
        for batch in batches:
            counts = []
            for terms, title, text in zip(*[batch.column(n).to_pylist() for n in ("terms", "low_title", "low")], strict=True):
                if text != last:
                    last, words = text, Counter(PYTHON_WORD.findall(text))
                met = [_has(title, t) for t in terms]
                counts.append((sum(met), sum(m or _has(text, t) for m, t in zip(met, terms, strict=True)),
                               sum(words[t] for t in terms if t in words)))
            columns = [pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=schema.names)

    return joined.mapInArrow(run, schema).where("lexical_hits > 0")


def _has(text: str, term: str) -> bool:
    if "_" not in term:
        return term in text
    return re.search(".".join(map(re.escape, term.split("_"))), text, re.DOTALL) is not None


def lexical_candidates(index: Postings, queries: DataFrame, n: int) -> DataFrame:
    """Best n chunks per query by terms met in the title, terms met at all, matching word positions, then title, ordinal, chunk_id.

    Two rounds. The first looks at the chunks of a query's rarest terms, some SEED_FACTOR x n, and the n best titles; its n-th best
    is the floor. The second looks at what can still reach the floor: with a title hit in it, the chunks of titles that have as many;
    else the chunks with as many of the query's rarest terms as the floor requires. A rare hit is a word that has the term, or its
    longest part, so it may count too much, never too little.

    A batch of MANY_QUERIES or more counts by blocks of queries and shares of chunks instead, with the same result.
    """
    queries = stored(queries.select("query_id", "terms").where(F.size("terms") > 0), "lexical-queries")
    if queries.count() >= MANY_QUERIES:
        return _ranked(search_blocks(index.chunks, queries, n), n)
    asked = asked_terms(index, queries)
    titles = stored(_title_hits(index, queries, asked), "lexical-titles")
    by_title = Window.partitionBy("query_id").orderBy(F.desc("title_hits"), "title")
    chunks = index.chunks
    keys = chunks.select("chunk_no", "title")
    best_titles = titles.withColumn("r", F.row_number().over(by_title)).where(F.col("r") <= n).drop("r")
    of_titles = best_titles.join(keys, "title").withColumn("r", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("title_hits"), "chunk_no"))).where(F.col("r") <= n)
    pair = ["query_id", "chunk_no"]
    seeds = stored(chunks_of_terms(asked.terms.where(F.col("before") < SEED_FACTOR * n), asked, index).select(*pair).unionByName(
        of_titles.select(*pair)).distinct(), "lexical-seeds")
    order = Window.partitionBy("query_id").orderBy(F.desc("title_hits"), F.desc("lexical_hits"))
    first = stored(_with_hits(seeds, chunks, queries), "lexical-first")
    floor = stored(first.withColumn("r", F.row_number().over(order)).where(F.col("r") == n).select(
        "query_id", F.col("title_hits").alias("floor_title"), F.col("lexical_hits").alias("floor_hits")), "lexical-floor")
    hits_needed = F.coalesce("floor_hits", F.lit(1))
    rare_needed = F.least(F.lit(RARE_HITS), hits_needed)
    open_terms = asked.terms.join(floor, "query_id", "left").where(
        (F.coalesce("floor_title", F.lit(0)) == 0) & (F.col("place") <= F.col("met") - hits_needed + rare_needed))
    rare = chunks_of_terms(open_terms, asked, index).join(floor, "query_id", "left").where(F.col("rare_hits") >= rare_needed)
    open_titles = titles.join(floor, "query_id").where("floor_title > 0 AND title_hits >= floor_title")
    pairs = rare.select(*pair).unionByName(open_titles.join(keys, "title").select(*pair)).distinct().join(seeds, pair, "left_anti")
    hits = _with_hits(pairs, chunks, queries).unionByName(first).join(floor, "query_id", "left").where(
        F.col("floor_hits").isNull() | (F.struct("title_hits", "lexical_hits") >= F.struct("floor_title", "floor_hits")))
    return _ranked(hits, n)


def _ranked(hits: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(
        F.desc("title_hits"), F.desc("lexical_hits"), F.desc("positions"), "title", "ordinal", "chunk_id"))
    return hits.withColumn("fts_score", F.round(F.col("positions") * WORD_WEIGHT, 8)).withColumn("fts_rank", rank).where(F.col("fts_rank") <= n).select(
        "query_id", "chunk_id", "title", "ordinal", "title_hits", "lexical_hits", "fts_score", "fts_rank")


# --- full-text score alone ---------------------------------------------------------------------------------


def whole_words(index: Postings, asked: DataFrame) -> DataFrame:
    """(word, chunk_no, n) of the ``asked`` words: runs of letters and digits, one row per joined word they stand in, or per place in the texts
    where no places have been written. Places of words that nobody asks for never move."""
    runs = lambda name: F.explode(F.regexp_extract_all(name, F.lit(WHOLE_WORD), F.lit(0))).alias("word")
    if index.has("places"):
        parts = index.places.where("n > 0").select(runs("word"), "chunk_no", "n")
    else:
        parts = index.chunks.select(runs(F.lower("content")), "chunk_no", F.lit(1).cast("bigint").alias("n"))
    return parts.join(asked, "word", "left_semi")


def word_scores(index: Postings, queries: DataFrame, n: int | None) -> DataFrame:
    """(query_id, chunk_id, fts_score): chunks by how many of their words are terms of the query; the best n, ties to the smaller id.

    A limited search follows no word that cannot matter. Per query the words' best chunks, n of each, give a floor. Words are left
    out, most frequent first, as long as their highest counts together stay below it: a chunk of such words only cannot
    come in. Of what the others lead to, chunks that reach the floor with those counts added are counted over all words.
    """
    terms = stored(queries.select("query_id", F.explode("terms").alias("word")).where(F.col("word").rlike(f"^{WHOLE_WORD}$")), "score-terms")
    named = index.chunks.select("chunk_no", "chunk_id")
    asked = terms.select("word").distinct()
    if n is None:
        # Places move once, by chunk; the sums and the chunk's name need no further shuffle. They swell by the queries of a word, so
        # the partitions are as many as set, not merged by the size of what is read.
        tasks = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return whole_words(index, asked).repartition(tasks, "chunk_no").join(terms, "word").groupBy("query_id", "chunk_no").agg(
            F.round(F.sum("n") * F.lit(WORD_WEIGHT), 8).alias("fts_score")).join(named, "chunk_no").select("query_id", "chunk_id", "fts_score")
    places = stored(whole_words(index, asked).groupBy("word", "chunk_no").agg(F.sum("n").alias("n")), "score-places")
    best_of_word = Window.partitionBy("word").orderBy(F.desc("n"), "chunk_no")
    tops = stored(places.withColumn("r", F.row_number().over(best_of_word)).where(F.col("r") <= n).drop("r"), "score-tops")
    sizes = places.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("n").alias("most"))
    by_query = Window.partitionBy("query_id")
    best_of_query = by_query.orderBy(F.desc("total"), "chunk_id")
    floor = tops.join(terms, "word").groupBy("query_id", "chunk_no").agg(F.sum("n").alias("total")).withColumn(
        "r", F.row_number().over(by_query.orderBy(F.desc("total")))).where(F.col("r") == n).select("query_id", F.col("total").alias("floor"))
    common = by_query.orderBy(F.desc("df"), "word").rowsBetween(Window.unboundedPreceding, 0)
    ranked = stored(terms.join(sizes, "word").withColumn("left_out", F.sum("most").over(common)).join(floor, "query_id", "left"), "score-words")
    needed = ranked.where(F.col("floor").isNull() | (F.col("left_out") >= F.col("floor"))).select("query_id", "word")
    others = ranked.where(F.col("left_out") < F.col("floor"))
    bound = others.groupBy("query_id").agg(F.max("left_out").alias("rest"), F.max("floor").alias("floor"))
    some = needed.join(places, "word").groupBy("query_id", "chunk_no").agg(F.sum("n").alias("total")).join(bound, "query_id", "left").where(
        F.col("floor").isNull() | (F.col("total") + F.col("rest") >= F.col("floor"))).select("query_id", "chunk_no", "total")
    more = some.select("query_id", "chunk_no").join(others.select("query_id", "word"), "query_id").join(
        places, ["word", "chunk_no"]).select("query_id", "chunk_no", F.col("n").alias("total"))
    counted = some.unionByName(more).groupBy("query_id", "chunk_no").agg(F.sum("total").alias("total")).join(
        bound.select("query_id", "floor"), "query_id", "left").where(F.col("floor").isNull() | (F.col("total") >= F.col("floor")))
    return counted.join(named, "chunk_no").withColumn("r", F.row_number().over(best_of_query)).where(F.col("r") <= n).select(
        "query_id", "chunk_id", F.round(F.col("total") * F.lit(WORD_WEIGHT), 8).alias("fts_score"))
