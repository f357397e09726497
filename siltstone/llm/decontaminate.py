"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

1. The index holds the postings (document, term, position) of every whole document for the terms that
   occur in test items; other words can't match. It is built in one pass, which numbers the rows.
2. In each window of consecutive item words the terms with the fewest postings are anchors: two more than
   there are words that may differ, so two of them stand in place in every match (terms without postings
   are of those that differ). Offsets on which the lists of two anchors agree are candidates; the lists of
   the item's other terms are intersected with them, posting by posting.
3. A window whose terms all stand at their offsets is an exact phrase match; one in which a share of
   NEAR do, is a proximity match. None of either kind is missed.

A common word is an anchor only of a window of nothing but common words. Postings are joined by
equality, and what is gathered for one candidate is bounded by the item's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import ascii_lower, checkpointed, small, stored

#: Everything but digits, letters and non-ASCII; upper case is lowered before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
NEAR = 0.8
#: Terms, anchors and ids of candidate documents are broadcast up to this many (some 10 MB each), else shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def item_places(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, n, at, term_id) of every word of the items that have n, and (word, term_id). An item given twice counts once."""
    tests = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    places = tests.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).distinct()
    terms = checkpointed(places.select("word").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    return places.join(terms, "word").select("item", "n", "at", "term_id"), terms


def index(docs: DataFrame, terms: DataFrame, row: Column, own: Column, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, term_id, pos), (id, own, n_words)): the postings of all documents for ``terms``, and the documents themselves.

    Both are one stored table, made in one pass: each document has one more place before its words,
    which always stays. So ``row`` may number the rows as they are read, and no later pass can number
    them in another way.
    """
    places = F.concat(F.array(F.lit(None).cast("string")), words(F.col(text_col)))
    texts = docs.select(row.alias("id"), own.alias("own"), places.alias("places"))
    placed = texts.select("id", "own", (F.size("places") - 1).cast("long").alias("n_words"), F.posexplode("places").alias("pos", "word"))
    known = placed.join(small(terms, BROADCAST_ROWS), "word", "left").where(F.col("term_id").isNotNull() | (F.col("pos") == 0))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    table = stored(known.select("id", first("own"), first("n_words"), "term_id", (F.col("pos") - 1).alias("pos")), "postings")
    return table.where("pos >= 0").select("id", "term_id", "pos"), table.where("pos < 0").select("id", "own", "n_words")


def matches(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(id, item, offset, starts, near_starts, width): where windows of an item occur in a document.

    offset: the document position of the item's first word (may be negative where only a later part
    occurs). starts: item positions whose window of ``width`` words is an exact phrase match;
    near_starts: those of which a share of ``near`` stands in place (exact ones too). Items of fewer
    words than ``window`` (but not none) are one window. Rows with no start of either kind are left out.
    Ids must tell rows apart; ``report`` takes any.
    """
    places, terms = item_places(items, item_col, text_col)
    posted, _ = index(docs, terms, F.col(id_col), F.lit(None), text_col)
    return matches_of(posted, places, window, near)


def matches_of(posted: DataFrame, places: DataFrame, window: int, near: float) -> DataFrame:
    """``matches`` of an index and the places of the items' words."""
    weight = posted.groupBy("term_id").count()
    weighed = checkpointed(places.join(weight, "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0))))
    width = F.least("n", F.lit(window))
    spare = width - F.ceil(width * near)  # words of a window that may differ
    need = F.least(F.lit(2), width - spare)  # of the window's spare + need rarest terms so many stand in place
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least("at", F.col("n") - width)))
    ranked = F.sort_array(F.collect_list(F.struct("count", "at", "term_id")))
    rarest = weighed.select("*", starts.alias("start")).groupBy("item", "n", "start").agg(ranked.alias("r"))
    rarest = rarest.select("item", F.when(need == 1, 2).otherwise(1).alias("part"), F.explode(F.slice("r", F.lit(1), (spare + need).cast("int"))).alias("r"))
    rarest = rarest.where("r.count > 0")  # a term that no document has is one of those that differ
    anchors = checkpointed(rarest.select("item", "part", "r.at", "r.term_id").distinct())
    first = posted.join(small(anchors, BROADCAST_ROWS), "term_id").select("id", "item", "part", (F.col("pos") - F.col("at")).alias("offset"))
    agreed = first.groupBy("id", "item", "offset").agg(F.sum("part").alias("parts")).where("parts >= 2")  # a place has one term, so each anchor counts once
    offsets = agreed.select("id", "item", "offset")

    candidates = checkpointed(offsets)
    wanted = candidates.join(small(weighed.select("item", "n", "at", "term_id"), BROADCAST_ROWS), "item")
    wanted = wanted.withColumn("pos", F.col("offset") + F.col("at")).where("pos >= 0")
    lists = posted.join(small(checkpointed(candidates.select("id").distinct()), BROADCAST_ROWS), "id", "left_semi")
    joined = lists.join(wanted, ["id", "pos", "term_id"]).groupBy("id", "item", "n", "offset").agg(F.collect_set("at").alias("ats"))
    every = F.sequence(F.lit(0), F.col("n") - width)
    # For each start the number of the window's words that stand in place, as (start, number).
    in_place = lambda k: F.size(F.filter("ats", lambda x: (x >= k) & (x < k + width)))
    shares = F.transform(every, lambda k: F.struct(k.alias("k"), in_place(k).alias("in_place")))
    near_ones = F.filter(shares, lambda x: x["in_place"] >= F.ceil(width * near))
    found = joined.select("id", "item", "offset", width.alias("width"), near_ones.alias("near"))
    found = found.where(F.size("near") > 0)
    exact = F.filter("near", lambda x: x["in_place"] == F.col("width"))
    starts_of = lambda xs: F.transform(xs, lambda x: x["k"])
    return found.select("id", "item", "offset", starts_of(exact).alias("starts"), starts_of(F.col("near")).alias("near_starts"), "width")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) of every row of ``docs``.

    A word inside any exact window counts once, however many windows cover it. Items are listed by
    their id as a string, sorted, comma-joined. n_near_items: the items of which a window occurs exactly
    or with a share of NEAR of its words in place. Null texts have no words. Ids may repeat or be null:
    rows are told apart by a number of their own, and every row gives one row.
    """
    places, terms = item_places(items, item_col, text_col)
    posted, rows = index(docs, terms, F.monotonically_increasing_id(), F.col(id_col), text_col)
    found = matches_of(posted, places, window, NEAR)
    hit = F.flatten(F.transform("starts", lambda k: F.sequence(F.col("offset") + k, F.col("offset") + k + F.col("width") - 1)))
    exact = F.size("starts") > 0
    by_row = found.groupBy("id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(hit)))).cast("long").alias("hits"),
        F.sort_array(F.collect_set(F.when(exact, F.col("item").cast("string")))).alias("items"),
        F.count_distinct("item").alias("near_items"),
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    hits = F.coalesce("hits", F.lit(0)).cast("long")
    return rows.join(by_row, "id", "left").select(
        F.col("own").alias(id_col),
        "n_words",
        hits.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
        F.coalesce("near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )
