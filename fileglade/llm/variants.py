"""Spelling variants grouped by pivotal bigrams.

Words are maximal runs of ``[A-Za-zÀ-ÿ]`` in whole texts (a null text has none), A-Z
lower-cased. Let ``h`` be the unsigned CRC-32 of ``"<doc_id>:<run>"`` in UTF-8 (a null doc_id
is written as nothing); when 199 divides ``h`` the run loses its code point ``h % length``. Words
are the distinct results of at least ``min_length`` code points seen at least ``min_count``
times (``n``). Two words are near when one insertion, deletion or replacement of a code point
turns one into the other. A word's form is its near word of largest ``n`` (ties: the smallest in
code-point order) when that ``n`` is at least ``ratio`` times its own, else null; its root follows
forms to the last word.

Candidates come from pivotal prefix filtering with bigrams and one edit:

* bigrams are ranked by how often they occur over all words (rare first, then by text, then by
  position); a word's prefix is its first three, and its extended prefix every occurrence of a
  bigram ranked no later than the third;
* two disjoint bigrams of the prefix (positions two or more apart) with the least total
  frequency are its pivots, chosen by dynamic programming over the prefix in position order;
* one edit destroys at most one of two disjoint bigrams and moves the other by at most one
  place, and the word whose third prefix bigram ranks later holds the survivor in its extended
  prefix. So every near pair meets in an equality join of the pivots of the word whose third
  bigram ranks earlier (at their position and length, give or take one) with the other's
  extended prefix, and only that direction is joined;
* candidates are verified by Levenshtein distance exactly 1.

No pair outside a shared pivot is formed, and a bigram's join key carries its position and the
word's length, so a common bigram does not put its words in one task. Roots are found by pointer
jumping; forms have at least ``ratio`` times the count, so chains are short and never cycle.

Only the counts of the bigrams are broadcast: whatever grows with the words meets by a shuffle
and never passes the driver.

Edge cases: an empty table or one without words gives no rows; repeated documents count again;
very long texts and runs are read whole; extra input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import materialised

__all__ = ["grouped", "words"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = "[A-Za-zÀ-ÿ]+"
#: Bigrams of a word's prefix and pivots among them (q * edits + 1 and edits + 1 for q = 2).
PREFIX, PIVOTS = 3, 2


def _cut(doc_id: Column, run: Column) -> Column:
    word = F.translate(run, _UPPER, _UPPER.lower())
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    dropped = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.lit(1 << 30)))
    return F.when(h % 199 == 0, dropped).otherwise(word)


def words(documents: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: every word of the texts after the cut rule, counted over all documents."""
    # A run that long is found from its first letter, so the matches are exactly the maximal
    # runs of at least min_length letters; shorter runs, most of a text, are never built.
    long_runs = F.lit(f"{_RUN[:-1]}{{{min_length},}}")
    runs = documents.select(
        F.col("doc_id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), long_runs, 0)).alias("run")
    )
    cut = runs.select(_cut(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return cut.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _pivots(prefix: Column) -> Column:
    """Two disjoint bigrams of the prefix with the least total frequency.

    A pass in position order keeps the bigrams seen so far; the best pair ending at a bigram is
    it with the cheapest seen bigram at least two places before, and the best pair so far is
    carried on.
    """
    entry = "struct<freq:bigint,gram:string,pos:int>"
    pair = "struct<cost:bigint,first:struct<freq:bigint,gram:string,pos:int>,second:struct<freq:bigint,gram:string,pos:int>>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("seen"), F.lit(None).cast(pair).alias("best"))

    def step(acc: Column, g: Column) -> Column:
        partners = F.filter(acc["seen"], lambda s: s["pos"] <= g["pos"] - 2)
        cheapest = F.array_min(partners)
        here = F.when(
            F.size(partners) > 0,
            F.struct((cheapest["freq"] + g["freq"]).alias("cost"), cheapest.alias("first"), g.alias("second")),
        )
        best = F.when(
            acc["best"].isNull() | (here.isNotNull() & (here["cost"] < acc["best"]["cost"])), F.coalesce(here, acc["best"])
        ).otherwise(acc["best"])
        return F.struct(F.concat(acc["seen"], F.array(g)).alias("seen"), best.alias("best"))

    by_place = F.array_sort(prefix, lambda a, b: a["pos"] - b["pos"])
    best = F.aggregate(by_place, start, step)["best"]
    return F.array(best["first"], best["second"])


def _by_key(frame: DataFrame) -> DataFrame:
    """A side of a join that must meet the other by a sort-merge join.

    Spark guesses a side's size from its compressed files, and counts an exploded row as one, so
    it may broadcast through the driver what is many times its threshold.
    """
    return frame.hint("merge")


def _near_pairs(counted: DataFrame, spark) -> DataFrame:
    """(a, b) with a < b: every pair of words one edit apart."""
    grams = counted.select(
        "word", F.length("word").alias("len"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))),
    ).select("word", "len", (F.col("pos")).cast("int").alias("pos"), F.col("col").alias("gram"))
    # Bigrams of an alphabet of 90 letters: at most 8,100 rows, a proven bound for a broadcast.
    freq = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    ranked = grams.join(F.broadcast(freq), "gram").groupBy("word", "len").agg(
        F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))).alias("grams")
    )
    last = F.element_at(F.col("grams"), F.least(F.lit(PREFIX), F.size("grams")))
    profiled = ranked.select(
        "word", "len", last["freq"].alias("last_freq"), last["gram"].alias("last_gram"),
        F.filter("grams", lambda g: (g["freq"] < last["freq"]) | ((g["freq"] == last["freq"]) & (g["gram"] <= last["gram"])))
        .alias("extended"),
        _pivots(F.slice("grams", 1, PREFIX)).alias("pivots"),
    )
    profiled = materialised(profiled, spark)
    index = profiled.select(
        F.col("word").alias("r"), F.col("len").alias("r_len"), F.col("last_freq").alias("r_freq"),
        F.col("last_gram").alias("r_gram"), F.explode("extended").alias("g"),
    ).select("r", "r_len", "r_freq", "r_gram", F.col("g.gram").alias("gram"), F.col("g.pos").alias("r_pos"))
    shifts = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    probes = (
        profiled.select("word", "len", "last_freq", "last_gram", F.explode("pivots").alias("g"))
        .select(
            F.col("word").alias("s"), F.col("g.gram").alias("gram"),
            F.explode(F.transform(shifts, lambda d: F.col("g.pos") + d)).alias("r_pos"),
            F.col("len"), F.col("last_freq").alias("s_freq"), F.col("last_gram").alias("s_gram"),
        )
        .select(
            "s", "gram", "r_pos", "s_freq", "s_gram",
            F.explode(F.transform(shifts, lambda d: F.col("len") + d)).alias("r_len"),
        )
    )
    # The word whose third prefix bigram ranks no earlier holds the survivor: probe only that way.
    later = (F.col("r_freq") > F.col("s_freq")) | (
        (F.col("r_freq") == F.col("s_freq")) & (F.col("r_gram") >= F.col("s_gram"))
    )
    met = probes.join(_by_key(index), ["gram", "r_pos", "r_len"]).where((F.col("s") != F.col("r")) & later)
    pairs = met.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def grouped(
    documents: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word.

    ``min_length`` must be at least 4, so that every prefix holds two disjoint bigrams.
    """
    if min_length < 4:
        raise ValueError("min_length below 4 leaves words without two disjoint bigrams")
    spark = documents.sparkSession
    counted = materialised(words(documents, min_length, min_count), spark)
    pairs = _near_pairs(counted, spark)
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    others = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    linked = ends.join(_by_key(others), "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("o"))).alias("top"),
    )
    table = counted.join(_by_key(linked), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.k") >= ratio * F.col("n"), F.col("top.o")).alias("form"),
        F.when(-F.col("top.k") >= ratio * F.col("n"), -F.col("top.k")).cast("long").alias("form_n"),
    )
    table = materialised(table, spark)
    root = _roots(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("up")), spark)
    return (
        table.join(_by_key(root), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def _roots(edges: DataFrame, spark) -> DataFrame:
    """word, root: the last word on each chain of forms, by pointer jumping.

    A word has few near words and chains are short, so no ``up`` has many rows.
    """
    current = materialised(edges, spark)
    while True:
        step = current.select(F.col("word").alias("up"), F.col("up").alias("__next"))
        jumped = current.join(_by_key(step), "up", "left")
        moved = jumped.select("word", F.coalesce("__next", "up").alias("up"), F.col("__next").isNotNull().alias("m"))
        moved = materialised(moved, spark)
        if not moved.where("m").limit(1).count():
            return moved.select("word", F.col("up").alias("root"))
        current = moved.select("word", "up")
