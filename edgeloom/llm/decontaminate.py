"""Benchmark decontamination on a positional inverted index.

``build_index`` stores the postings (document, position, term) of all texts for the terms that are asked
for, and for each document an end posting that tells its length. ``find_phrases`` starts from rare terms:
each window of ``WINDOW`` test words is looked up by the rarest of its terms, and only there; neighbouring
windows mostly share that term, so it is looked up once for all. A posting at p for the item's word j puts
the item on the document's diagonal p - j. The other words' postings, adjusted by their offsets, are then
intersected on that diagonal: the words that are there in a row, if at least a window's number, are hit.
``near`` gives proximity matches instead: all of an item's window terms within a span of words.

All of it is DataFrame operations; the only rows that are broadcast are test terms and items, and ids of candidate
documents, each only if they have ``BROADCAST_BYTES`` at most, which is summed up; beyond that the same joins are shuffled.

Defined results: null texts have no words, as have texts of separators only; an item of fewer than WINDOW
words, but not none, is one window; a null item_id is the item "", and items that repeat an id count once;
repeated documents are judged one by one; empty tables on either side give no hits; a text of any length is indexed
whole; other columns, of any name, are ignored, and ``clean`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import storage

WINDOW = 10
BROADCAST_BYTES = 16_000_000
#: All ASCII characters that words don't have; A-Z are words' characters until they are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = ""


def words(text: str) -> Column:
    """The words of a text, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")


def lowered(word: str) -> Column:
    """A-Z lower-cased; the quick function is right where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _small(frame: DataFrame, size: Column | None = None) -> DataFrame:
    """Marked for broadcast if its rows have BROADCAST_BYTES at most, else for a sorted join; ``size`` is what a row has besides 32 bytes."""
    total = frame.agg(F.sum(F.lit(32).cast("long") + (F.lit(0) if size is None else size)).alias("n")).first().n or 0
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame.hint("merge")


def build_index(docs: DataFrame, cut, terms: DataFrame | None = None) -> DataFrame:
    """Postings ``uid, doc_id, pos, term`` of ``docs(doc_id, text)``, stored by ``cut``; ``terms(word, term)`` limits and numbers them.

    Without ``terms`` every word is indexed under itself. The end posting's word is ``END``, its position the
    number of words, and it alone has ``doc_id``.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.array_append(words("text"), F.lit(END)).alias("words"))
    rows = rows.select("doc_id", "uid", F.posexplode("words").alias("pos", "word"))
    own = F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id")
    rows = rows.select("uid", own, "pos", lowered("word").alias("word"))
    if terms is None:
        return cut(rows.withColumnRenamed("word", "term"))
    return cut(rows.join(_small(terms, F.octet_length("word")), "word").select("uid", "doc_id", "pos", "term"))


def item_words(items: DataFrame) -> DataFrame:
    """``item, n, j, word``: the words of every test item; ``item`` is the id as a string."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("words"))
    # texts that repeat an id are items of their own inside
    named = named.withColumn("key", F.xxhash64("item", "words"))
    rows = named.select("item", "key", F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
    return rows.withColumn("word", lowered("word")).distinct()


def find_phrases(docs: DataFrame, items: DataFrame, cut, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The end postings ``uid, doc_id, n_words`` and the hits ``uid, item, first, last`` (word positions).

    ``cut`` stores the tables that serve them.
    """
    tests = cut(item_words(items))
    vocabulary = tests.select("word").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word")))
    terms = cut(vocabulary.withColumn("term", F.when(F.col("word") == END, -1).otherwise(F.monotonically_increasing_id())))
    index = build_index(docs, cut, terms)
    ends = index.where("term = -1").select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    postings = index.where("term >= 0").select("uid", "pos", "term")

    counts = postings.groupBy("term").agg(F.count("*").alias("found"))
    tests = tests.join(terms.hint("merge"), "word").join(counts.hint("merge"), "term", "left").fillna(0, ["found"])
    tests = cut(tests.select("item", "key", "n", "j", "term", "found"))
    # the rarest word of each window; an item's words are few and meet by item
    ahead = Window.partitionBy("key").orderBy("j").rowsBetween(0, window - 1)
    rarest = F.min(F.struct("found", "j", "term")).over(ahead).alias("rarest")
    starts = tests.select("key", "item", "n", "j", rarest, F.count("*").over(ahead).alias("here"))
    starts = starts.where(F.col("here") == F.least("n", F.lit(window))).where("rarest.found > 0")
    anchors = starts.groupBy("key", "rarest").agg(F.first("item").alias("item"), F.first("n").alias("n"), F.min("j").alias("low"), F.max("j").alias("high"))
    anchors = anchors.select("key", "item", "n", F.col("rarest.j").alias("j"), F.col("rarest.term").alias("term"), "low", (F.least(F.col("high") + window, F.col("n")) - 1).alias("high"))
    anchors = cut(anchors)

    placed = postings.join(_small(anchors, F.octet_length("item")), "term").select("uid", "key", "n", (F.col("pos") - F.col("j")).alias("diagonal"), "low", "high")
    # an anchor goes only if even the last of its windows begins before the document
    placed = placed.where(F.col("diagonal") + F.col("high") - F.least("n", F.lit(window)) + 1 >= 0)
    placed = cut(placed.groupBy("uid", "key", "diagonal").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    some = _small(placed.select("uid").distinct())
    lists = tests.groupBy("key").agg(F.first("item").alias("item"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "term"))).alias("words"))
    asked = placed.join(_small(lists, F.octet_length("item") + 32 * F.size("words")), "key").select("uid", "key", "item", "n", "diagonal", F.explode(F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + 1)).alias("w"))
    asked = asked.select("uid", (F.col("diagonal") + F.col("w.j")).alias("pos"), F.col("w.term").alias("term"), "key", "item", "n", "diagonal", F.col("w.j").alias("j"))
    there = postings.join(some, "uid", "left_semi").select("uid", "pos", "term")
    both = asked.unionByName(there, allowMissingColumns=True)
    # lists are intersected by meeting at their document: one exchange and sorts serve all three windows
    both = both.repartition("uid")
    met = F.max(F.col("key").isNull()).over(Window.partitionBy("uid", "pos", "term"))
    met = both.withColumn("met", met).where("met and key is not null")
    line = Window.partitionBy("uid", "key", "diagonal").orderBy("j")
    islands = met.withColumn("island", F.col("j") - F.row_number().over(line))
    hits = islands.groupBy("uid", "key", "diagonal", "island").agg(F.first("item").alias("item"), F.first("n").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    hits = hits.where(F.col("last") - F.col("first") + 1 >= F.least("n", F.lit(window)))
    return ends, cut(hits.select("uid", "item", "first", "last"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``; only this result stays stored."""
    with storage.Scratch(docs.sparkSession, "index") as scratch:
        ends, hits = find_phrases(docs, items, scratch.cut, window)
        before = Window.partitionBy("uid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.greatest(F.col("first"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
        new = hits.withColumn("new", F.greatest(F.lit(0), F.col("last") - begin + 1))
        found = new.groupBy("uid").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
        rows = ends.join(found.hint("merge"), "uid", "left")
        none = F.array().cast("array<string>")
        hit = F.coalesce("n_hit", F.lit(0)).cast("long")
        return storage.cut(rows.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                                       F.coalesce("items", none).alias("items"), (hit > 0).alias("contaminated")), "contamination")


def near(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """``doc_id, item, first``: places from which all distinct words of an item lie within ``span`` words."""
    tests = item_words(phrases)
    terms = tests.select("word").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word")))
    index = build_index(docs, lambda frame: storage.cut(frame, "postings"), terms.withColumn("term", F.col("word")))
    wanted = tests.groupBy("item", "key").agg(F.countDistinct("word").alias("kinds"))
    each = tests.select("item", "key", F.col("word").alias("term")).distinct().join(wanted.hint("merge"), ["item", "key"])
    rows = index.where(F.col("term") != END).join(_small(each, F.octet_length("term") + F.octet_length("item")), "term")
    ahead = Window.partitionBy("uid", "key").orderBy("pos").rangeBetween(0, span - 1)
    rows = rows.withColumn("there", F.size(F.collect_set("term").over(ahead))).where("there = kinds")
    ids = index.where(F.col("term") == END).select("uid", "doc_id")
    return rows.drop("doc_id").join(ids.hint("merge"), "uid").select("doc_id", "item", F.col("pos").alias("first"))


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, of whose words at most the share ``most`` is hit.

    Contaminated rows are known by id and text hash; while they are few, no text is shuffled.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), items)
    bad = found.where(F.col("n_hit") > most * F.col("n_words")).select(F.col("doc_id").alias("bad")).distinct()
    bad = _small(bad, F.coalesce(F.octet_length(F.col("bad.id").cast("string")), F.lit(0)))
    rows = docs.select(F.struct("*").alias("row"), key.alias("own"))
    return rows.join(bad, F.col("own").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
