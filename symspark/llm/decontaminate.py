"""Benchmark decontamination over a distributed positional inverted index, in DataFrame expressions only.

The index holds postings (term, document, position). A phrase is looked up from its rarest terms: the
posting lists of the two rarest are shifted by the terms' offsets and intersected, which leaves places
where the phrase can start; there the words are compared. Postings are kept for the terms that the
queries at hand read (or for all terms where none are given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save, small

PHRASE = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text: repeated ids with different texts stay apart by a hash of the text."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc_id, th, pos) of the documents; `terms`: a table of the terms to keep."""
    rows = _keyed(docs).select("doc_id", "th", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return (rows if terms is None else rows.join(small(terms), "term")).select("term", "doc_id", "th", "pos")


def windows(items: DataFrame, size: int = PHRASE) -> DataFrame:
    """The distinct windows of the items, saved: win, words, items (the ids, as text, of the items that have it)."""
    split = save(items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "bench-words")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size, F.lit(0)) + 1)
    spread = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    grouped = spread.groupBy("words").agg(F.collect_set("item").alias("items"))
    return save(grouped.select(F.monotonically_increasing_id().alias("win"), "words", "items"), "bench-windows")


def rarest_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Per window its two rarest terms (term, count) with offsets, as a and b; windows with a term in no document are left out.

    A window of one word has the same term for both.
    """
    spread = wins.select("win", F.posexplode("words").alias("off", "term")).join(counts, "term")
    sized = spread.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("t"))
    whole = sized.join(wins.select("win", F.size("words").alias("size")), "win").where("size(t) = size")
    return whole.select("win", F.get("t", F.lit(0)).alias("a"), F.coalesce(F.get("t", F.lit(1)), F.get("t", F.lit(0))).alias("b"))


def phrase_starts(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places (win, doc_id, th, start) where the offset-adjusted lists of both anchor terms meet."""

    def shifted(which: str) -> DataFrame:
        at = small(anchors).select("win", F.col(f"{which}.term").alias("term"), F.col(f"{which}.off").alias("off"))
        return index.join(at, "term").select("win", "doc_id", "th", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")

    one, two = shifted("a"), shifted("b").withColumnsRenamed({"win": "w", "doc_id": "d", "th": "t", "start": "s"})
    same = (F.col("win") == F.col("w")) & (F.col("th") == F.col("t")) & (F.col("start") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))
    return one.join(two, same, "left_semi").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """The documents, all columns kept, with n_words, n_hit, n_items, item_list and contaminated.

    docs: doc_id, text; items: item_id, text. A window is `size` consecutive words of an item; an item of
    fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.
    item_list: the item ids with occurring windows, as text, sorted as strings, comma-joined. A null or
    empty text has no words; items without words match nothing; rows that repeat a document get the same
    results, and so do rows without a doc_id. Input columns of these names are replaced.
    """
    made = ("n_words", "n_hit", "n_items", "item_list", "contaminated")
    docs = docs.drop(*made, "th", "_words", "_places")
    wins = windows(items, size)
    vocabulary = save(wins.select(F.explode("words").alias("term")).distinct(), "bench-terms")
    counts = save(postings(docs, vocabulary).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    anchors = save(rarest_terms(wins, counts), "bench-anchors")
    read = save(anchors.select(F.explode(F.array("a.term", "b.term")).alias("term")).distinct(), "anchor-terms")
    index = save(postings(docs, read), "postings")
    starts = phrase_starts(index, anchors).join(small(wins), "win")
    places = save(starts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "words", "items")).alias("_places")).withColumnsRenamed({"doc_id": "_id", "th": "_th"}), "places")
    rows = docs.withColumn("_words", words_of(F.col("text"))).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(small(places), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    hits = F.filter("_places", lambda p: F.slice("_words", p["start"] + 1, F.size(p["words"])) == p["words"])
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_hits", F.sort_array(F.transform(hits, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.size(p["words"])).alias("end"), p["items"].alias("items")))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grow = lambda a, p: F.struct(F.greatest(a["end"], p["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(a["end"], p["start"]))).alias("n"))
    rows = rows.withColumn("n_hit", F.coalesce(F.aggregate("_hits", zero, grow, lambda a: a["n"]), F.lit(0).cast("long")))
    rows = rows.withColumn("_items", F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda p: p["items"])))), F.array().cast("array<string>")))
    rows = rows.withColumn("n_items", F.size("_items").cast("long")).withColumn("item_list", F.array_join("_items", ",")).withColumn("contaminated", F.col("n_hit") > 0)
    return rows.select(*docs.columns, *made)


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int = 10) -> DataFrame:
    """Places where all terms of a query stand within `within` words of an occurrence of its rarest term.

    queries: query_id, text; their terms are the different words, and one without words matches nothing. Returns
    query_id, doc_id, pos (of the rarest term, from 0; ties go to the smallest term), a row for each place and row of
    `docs`; null texts have no words, rows that repeat a doc_id with different texts are searched each. Searched from the
    rarest term: the other lists meet it by stretches of `within` words, its own and the two beside it, so that a
    document's positions are never paired with all others.
    """
    asked = save(queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).distinct(), "near-terms")
    terms = save(asked.select("term").distinct(), "near-vocabulary")
    index = save(postings(docs, terms), "near-postings")
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    sized = asked.join(counts, "term", "left").groupBy("query_id").agg(F.count("*").alias("k"), F.count("n").alias("found"), F.min(F.struct("n", "term")).alias("rare"))
    sized = save(sized.where("k = found").select("query_id", "k", F.col("rare.term").alias("rare")), "near-queries")
    hit = index.withColumnsRenamed({"term": "rare"}).join(small(sized), "rare").select("query_id", "k", "doc_id", "th", "pos")
    beside = F.explode(F.sequence(F.expr(f"pos div {int(within) + 1}") - 1, F.expr(f"pos div {int(within) + 1}") + 1)).alias("stretch")
    hit = hit.select("*", beside)
    other = index.join(small(asked), "term").select(F.col("query_id").alias("q"), "term", F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"), F.expr(f"pos div {int(within) + 1}").alias("s"))
    same = F.col("query_id").eqNullSafe(F.col("q")) & (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("stretch") == F.col("s"))
    met = hit.join(other, same).where(F.abs(F.col("pos") - F.col("p")) <= within)
    return met.groupBy("query_id", "doc_id", "th", "pos", "k").agg(F.count_distinct("term").alias("n")).where("n = k").select("query_id", "doc_id", "pos")
