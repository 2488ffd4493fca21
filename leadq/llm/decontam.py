"""Benchmark decontamination: a positional inverted index of the training tokens, searched from the rarest test terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadq.llm.frames import small, text_of
from leadq.session import staged

WIDTH = 10
#: Everything that is no digit, no lower-case ASCII letter and no character beyond ASCII, once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The words of a text: A-Z lower-case, runs of digits, letters and characters beyond ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def windows(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, windows, items of windows) of test items, written out.

    terms(term, tid) are the distinct words; windows(wid, length, tids) the distinct runs of `width` words, of an item of fewer words that
    item; owners(wid, item) tell whose they are. Rows that share an item id are one item; a null item id counts as an empty one.
    """
    told = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), terms_of(text_of(text)).alias("words")).filter(F.size("words") > 0)
    words = told.select(F.explode("words").alias("term")).distinct()
    terms = staged(words.withColumn("tid", F.monotonically_increasing_id()), "decontam-terms")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    runs = told.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, width))).alias("run")).distinct()
    runs = staged(runs.withColumn("run", F.array_join("run", " ")), "decontam-runs")  # words hold no blanks
    named = staged(runs.select("run").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    owners = staged(runs.join(named, "run").select("wid", "item"), "decontam-owners")
    placed = named.select("wid", F.posexplode(F.split("run", " ")).alias("at", "term")).join(small(terms), "term").select("wid", "at", "tid")
    return terms, staged(placed, "decontam-placed"), owners


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of `docs`, written out: row, doc_id, n_words, pos, tid.

    One posting per occurrence of one of `terms` in a whole text, at positions from 0, and one for each document with a null tid, which
    keeps its length. A row number identifies the document, so rows without or with equal doc_ids stay apart. Documents aren't shuffled: a
    task writes the postings of the texts that it reads, and the columns compress to few bytes a posting.
    """
    told = docs.select(F.col(doc_id).alias("doc_id"), terms_of(text_of(text)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    # the entry before the first word stands for the document itself; no word is empty
    each = told.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "term"))
    own = terms.select("term", "tid").unionByName(terms.sparkSession.createDataFrame([("", -1)], "term string, tid long"))
    found = each.join(small(staged(own, "decontam-vocabulary")), "term")
    return staged(found.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), F.when(F.col("tid") >= 0, F.col("tid")).alias("tid")), "decontam-index")


def _by_rarity(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """wid, at, tid, length, rarity (1: the rarest) of the windows all of whose terms occur. Postings are counted with a map-side combine."""
    counts = postings.filter("tid is not null").groupBy("tid").agg(F.count("*").alias("n"))
    own = Window.partitionBy("wid")  # at most the words of one window
    known = placed.join(small(staged(counts, "decontam-counts")), "tid", "left").withColumns({"length": F.count("*").over(own), "known": F.count("n").over(own)})
    ranked = known.filter("known = length").withColumn("rarity", F.row_number().over(own.orderBy("n", "at")))
    return staged(ranked.select("wid", "at", "tid", "length", "rarity"), "decontam-rarity")


def phrases(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """row, wid, start, length of every occurrence of every window, written out.

    The postings of a window's rarest term, and of its next rarest, are shifted by the term's place in the window; a start that is in both
    lists is a candidate. Only then are the other terms looked up, in the postings of the documents that have candidates, and a
    candidate holds if each of its places has its term. So a frequent word costs nothing unless a window has no rarer ones. Each step
    meets by (document, position), so neither a frequent term nor a frequent passage makes a hot key.
    """
    ranked = _by_rarity(postings, placed)
    rare = ranked.filter("rarity <= 2").select("wid", "at", "tid", "length", "rarity")
    shifted = (
        postings.select("row", "pos", "tid")
        .join(small(rare), "tid")
        .select("row", "wid", "length", (F.col("pos") - F.col("at")).alias("start"), "rarity")
        .filter("start >= 0")
    )
    both = shifted.groupBy("row", "wid", "length", "start").agg(F.sum("rarity").alias("seen"))
    found = both.filter("seen = 3 or (length = 1 and seen = 1)").select("row", "wid", "start", "length")
    found = staged(found, "decontam-candidates")
    others = ranked.filter("rarity > 2").select("wid", "at", "tid")
    asked = found.filter("length > 2").join(small(others), "wid").select("row", "wid", "start", "length", (F.col("start") + F.col("at")).alias("pos"), "tid")
    where = small(staged(found.filter("length > 2").select("row").distinct(), "decontam-rows"))
    there = postings.filter("tid is not null").select("row", "pos", "tid").join(where, "row", "left_semi")
    # a place that many candidates ask for is looked up once
    held = staged(asked.select("row", "pos", "tid").distinct().join(there, ["row", "pos", "tid"], "left_semi"), "decontam-held")
    whole = asked.join(held, ["row", "pos", "tid"]).groupBy("row", "wid", "start", "length").agg(F.count("*").alias("n"))
    return staged(found.filter("length <= 2").unionByName(whole.filter("n = length - 2").drop("n")), "decontam-phrases")


def proximity(postings: DataFrame, placed: DataFrame, span: int) -> DataFrame:
    """row, wid, pos: postings of the rarest term of a window near which every other term of the window occurs, at most
    `span` words before or after, in any order. A term that the window repeats has to occur once.

    From the rarest term too: the other lists are asked for only within cells of `span` words around its postings.
    """
    terms = placed.groupBy("wid", "tid").agg(F.min("at").alias("at"))  # a window's distinct terms
    ranked = _by_rarity(postings, terms)
    rare = ranked.filter("rarity = 1").select("wid", "tid", "length")
    anchors = staged(postings.select("row", "pos", "tid").join(small(rare), "tid").select("row", "wid", "length", "pos"), "decontam-anchors")
    others = ranked.filter("rarity > 1").select("wid", "tid")
    cell = F.floor(F.col("pos") / span)
    asked = anchors.join(small(others), "wid").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    where = small(staged(anchors.select("row").distinct(), "decontam-rows"))
    there = postings.filter("tid is not null").join(where, "row", "left_semi").select("row", F.col("pos").alias("at"), "tid", cell.alias("cell"))
    near = asked.join(there, ["row", "tid", "cell"]).filter(F.abs(F.col("at") - F.col("pos")) <= span)
    whole = near.select("row", "wid", "length", "pos", "tid").distinct().groupBy("row", "wid", "length", "pos").agg(F.count("*").alias("n")).filter("n = length - 1")
    return anchors.filter("length = 1").select("row", "wid", "pos").unionByName(whole.select("row", "wid", "pos"))


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A word is hit if it lies inside an occurrence of a window: `width` consecutive words of an item, or a shorter item as a whole. n_items
    counts the items with windows that occur, and the digest is that of their ids, sorted as strings and joined by commas. Null and
    empty texts have no words; an item without words is never found. Rows without or with equal doc_ids are documents of their own, and
    repeated rows come back as often. Very long texts are postings like others. Other columns are ignored. Empty tables: no documents give an
    empty result, no items leave all documents clean.

    A document's figures are sums over its hits, with a map-side combine; only the distinct items of one document meet in one value.
    """
    terms, placed, owners = windows(items, width)
    postings = index(docs, terms)
    found = phrases(postings, placed)
    hit = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", "wid").distinct().join(small(owners), "wid").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    none = F.coalesce(F.col("n_hit"), F.lit(0))
    return (
        postings.filter("tid is null")
        .select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
        .join(hits.join(named, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            none.cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (none > 0).alias("contaminated"),
        )
    )
