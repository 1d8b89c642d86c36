"""Quality rules whose thresholds come from mergeable quantile sketches of language and source.

A sketch holds counts of logarithmic buckets, so it is a table of (group, rule, bucket, count):
two sketches merge by adding counts, and a quantile is exact up to the width of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileglade.llm.common import let, materialised, salted_join

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PCT = 10, 20

#: Buckets are 1/8 of a power of two wide; values below FLOOR share the lowest.
STEPS, FLOOR = 8, 1 / 1024
#: Groups with fewer documents use the merged sketch of their language, or of all documents.
MIN_GROUP = 50
#: A value above both ``q3 * FACTOR`` (up to HIGHEST) and its rule's least threshold is an outlier.
QUANTILE, FACTOR = 0.75, 4.0
#: Rules on ratios, with the least threshold that outliers of a tight group must pass too.
RULES = {
    "symbol_ratio": 0.08,  # symbols for each word character
    "dup_line_ratio": 0.30,  # lines equal to an earlier one, of lines with a word
    "word_length": 18.0,  # characters for each word
}
#: The highest limits, so that a group with much junk can't raise its own until nothing fails.
#: Words have none: scripts without blanks have long ones.
HIGHEST = {"symbol_ratio": 0.16, "dup_line_ratio": 0.60}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    """How many of some one-byte characters a text has."""
    found = F.lit(0)
    for c in characters:
        found = found + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return found.cast("long")


def _repeated(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.

    Sorting (hash, place) brings equal windows together; the places of those with an equal
    neighbour, sorted, cover ``min(WINDOW, gap to the next)`` words each.
    """
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(rows: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(rows, i - 1)["h"] == x["h"])
            after = F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(rows, twin), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(
                places,
                lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))),
            ),
            F.lit(0).cast("long"),
            lambda s, n: s + n,
        )

    return let(ordered, lambda rows: let(again(rows), covered))


def measure(docs: DataFrame) -> DataFrame:
    """Documents with the counts of ``MEASURES``, the ratios of ``RULES`` and ``base_failed``.

    Only DataFrame functions, one pass, no shuffle. A null text has no words. Columns of the input
    that have the name of a result are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANK_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumns({"__words": words, "__lines": lines})
    word = F.col("__words")
    grams = F.when(
        F.size(word) >= WINDOW,
        F.transform(
            F.slice(word, 1, F.size(word) - WINDOW + 1),
            lambda w, i: F.xxhash64(w, *[F.get(word, i + k) for k in range(1, WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    staged = staged.withColumns(
        {
            "n_words": F.size(word).cast("long"),
            "word_chars": (F.char_length(text) - _without(text, BLANKS)).cast("long"),
            "n_symbols": _without(text, SYMBOLS),
            "__n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__grams": grams,
        }
    ).drop("__words", "__lines")
    staged = staged.withColumn(
        "n_repeat_words",
        F.when(F.size("__grams") == F.size(F.array_distinct("__grams")), F.lit(0).cast("long"))
        .otherwise(_repeated(F.col("__grams"))),
    ).drop("__grams")
    count, chars = F.col("n_words"), F.col("word_chars")
    ratios = {
        "symbol_ratio": F.when(chars > 0, F.col("n_symbols") / chars),
        "dup_line_ratio": F.when(F.col("__n_lines") > 0, F.col("n_dup_lines") / F.col("__n_lines")),
        "word_length": F.when(count > 0, chars / count),
    }
    staged = staged.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in ratios.items()})
    failed = (count < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * count)
    return staged.withColumn("base_failed", failed).drop("__n_lines")


def bucket(value: Column) -> Column:
    """The sketch bucket of a ratio; its upper edge is ``2 ** (bucket / STEPS)``."""
    return F.ceil(F.lit(STEPS) * F.log2(F.greatest(value, F.lit(FLOOR))) - 1e-9).cast("int")


def sketches(measured: DataFrame) -> DataFrame:
    """One sketch for each (lang, source, rule): bucket counts. Documents that fail the base rules
    don't take part."""
    entries = F.array(
        *[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in RULES]
    )
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(entries).alias("e"))
    return rows.groupBy("lang", "source", "e.rule", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of wider groups."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], q: float = QUANTILE) -> DataFrame:
    """The q-quantile (an upper bucket edge) and the count of each sketch."""
    group = Window.partitionBy(*keys, "rule")
    below = F.sum("n").over(group.orderBy("bucket"))
    total = F.sum("n").over(group)
    rows = sketch.select(*keys, "rule", "bucket", below.alias("below"), total.alias("total"))
    edge = F.pow(F.lit(2.0), F.min("bucket") / STEPS)
    return rows.filter(F.col("below") >= q * F.col("total")).groupBy(*keys, "rule").agg(
        edge.alias("edge"), F.max("total").alias("total")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """The threshold of each rule for each (lang, source), one row with a column for each rule."""
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(merge(sketch, ["lang"]), ["lang"]).select(
        F.col("lang").alias("l"), F.col("rule").alias("r"), F.col("edge").alias("le"), F.col("total").alias("lt")
    )
    every = quantiles(merge(sketch, []), []).select(F.col("rule").alias("a"), F.col("edge").alias("ae"))
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("r")), "left")
    rows = rows.join(F.broadcast(every), F.col("rule") == F.col("a"), "left")  # a row for each rule
    edge = (
        F.when(F.col("total") >= MIN_GROUP, F.col("edge"))
        .when(F.col("lt") >= MIN_GROUP, F.col("le"))
        .otherwise(F.col("ae"))
    )
    least = highest = F.lit(None).cast("double")
    for rule, value in RULES.items():
        least = F.when(F.col("rule") == rule, F.lit(value)).otherwise(least)
        highest = F.when(F.col("rule") == rule, F.lit(HIGHEST.get(rule))).otherwise(highest)
    limit = F.greatest(F.least(edge * FACTOR, highest), least)
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, limit)).alias(f"max_{r}") for r in RULES]
    )


def verdicts(measured: DataFrame) -> DataFrame:
    """Written measures with ``kept``: the base rules hold and no ratio is an outlier of its group.

    A group all of whose documents fail the base rules has no thresholds and keeps none. Null
    languages and sources are groups like others. Equal rows get equal verdicts.
    """
    spark = measured.sparkSession
    limits = materialised(thresholds(sketches(measured)), spark)
    salt = F.xxhash64(*[c for c in ("doc_id", "n_words", "word_chars") if c in measured.columns])
    joined = salted_join(measured, limits, ["lang", "source"], salt)
    kept = ~F.col("base_failed")
    for rule in RULES:
        kept = kept & F.coalesce(F.col(rule) <= F.col(f"max_{rule}"), F.lit(False))
    return joined.withColumn("kept", kept).drop(*[f"max_{r}" for r in RULES])


def judged(docs: DataFrame) -> DataFrame:
    """Documents with measures and verdicts; what was measured is written once and read twice."""
    return verdicts(materialised(measure(docs), docs.sparkSession))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs).filter("kept").select(*docs.columns)
