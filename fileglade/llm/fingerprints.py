"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, hashed in the order of the text.

A k-mer is ``K`` consecutive words; a shorter text is one k-mer. The j-th occurrence of a k-mer is
an element of its own. Its hash picks one of ``BINS`` sketches and its rank there. Each sketch
takes its ``PICK`` minimal elements, puts them in text order and hashes the tuple, so texts agree
in a sketch if they share its minimal k-mers in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import let, materialised, prefix_sums, sized
from fileglade.llm.quality import BLANK_CLASS

K, BINS, PICK = 5, 64, 2


def _runs(rows: Column, key, body) -> Column:
    """``body(first, end)`` for each run of rows with equal ``key``; both are indexes."""
    every = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    heads = F.filter(every, lambda i: (i == 0) | (key(F.get(rows, i - 1)) != key(F.get(rows, i))))

    def bounded(heads: Column) -> Column:
        end = F.size(rows)
        return F.transform(heads, lambda s, r: body(s, F.coalesce(F.get(heads, r + 1), end)))

    return let(heads, bounded)


def kmer_hashes(text: Column) -> Column:
    """Hashes of a text's k-mers in order; none for a text without words."""

    def hashes(words: Column) -> Column:
        long = F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - K + 1, F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]),
        )
        one = F.when(F.size(words) > 0, F.array(F.xxhash64(words)))
        return F.when(F.size(words) >= K, long).otherwise(
            F.coalesce(one, F.array().cast("array<bigint>"))
        )

    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")
    return let(words, hashes)


def codes(hashes: Column) -> Column:
    """The signature: one number for each sketch that has elements, its low digits the sketch.

    Arrays are sorted as numbers that end in a place of the text: the low ``w`` binary digits,
    where ``2 ** w`` exceeds the number of k-mers. What is hashed on does not depend on ``w``.
    """
    shift, one = "shiftleft", F.lit(1).cast("long")

    def signature(own: Column) -> Column:
        row = F.struct(own.alias("h"), F.call_function(shift, one, F.length(F.bin(F.size(own)))).alias("w"))
        return let(row, sketches)

    def sketches(row: Column) -> Column:
        own, width = row["h"], row["w"]

        def placed(value: Column, at: Column) -> Column:
            return value - F.pmod(value, width) + at

        def number(rows: Column) -> Column:
            def run(first: Column, end: Column) -> Column:
                def element(i: Column) -> Column:
                    at = F.pmod(F.get(rows, i), width)
                    e = F.xxhash64(F.get(own, at.cast("int")), i - first)
                    return placed(F.shiftrightunsigned(e, 1), at)

                return F.transform(F.sequence(first, end - 1), element)

            return F.flatten(_runs(rows, lambda x: x - F.pmod(x, width), run))

        def sketch(rows: Column) -> Column:
            def run(first: Column, end: Column) -> Column:
                picked = F.slice(rows, first + 1, F.least(F.lit(PICK), end - first))
                ordered = F.sort_array(
                    F.transform(picked, lambda x: F.struct(F.pmod(x, width), F.shiftright(x, 31).alias("e")))
                )
                tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["e"]))
                code = F.pmod(tuple_hash, F.lit(1 << 25)) * BINS + F.shiftright(F.get(rows, first), 57)
                return code.cast("int")

            return _runs(rows, lambda x: F.shiftright(x, 57), run)

        by_hash = F.sort_array(F.transform(own, placed))
        return let(F.sort_array(let(by_hash, number)), sketch)

    return let(hashes, signature)


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits for each sketch that has elements."""
    return F.array_join(F.transform(signature, lambda c: F.lpad(F.hex(c), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches among those that have elements in either text; 1 if neither
    has any."""
    bins = [F.transform(s, lambda c: F.pmod(c, F.lit(BINS))) for s in (a, b)]
    either = F.size(F.array_union(*bins))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def signatures(docs: DataFrame) -> DataFrame:
    """Documents with ``fingerprint``, the signature of their text."""
    return docs.withColumn("fingerprint", as_text(codes(kmer_hashes(F.col("text")))))


def _order(docs: DataFrame) -> DataFrame:
    """Different (doc_id, text) in ascending order, written: doc_id, h, n_chars, place, n."""
    spark = docs.sparkSession
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").alias("n_chars"))
    ids = ids.distinct().repartitionByRange(sized(docs, "text", 64), "doc_id", "h")
    ids = ids.sortWithinPartitions("doc_id", "h").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")
    )
    ids = materialised(ids, spark)
    counts = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    firsts = prefix_sums(counts, "part", "part", "n", "first").select("part", "first")
    row = F.col("row").bitwiseAND((1 << 33) - 1)
    return ids.join(firsts, "part").select(
        "doc_id", "h", "n_chars", (F.col("first") + row).alias("place")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the signatures of both and of the next document.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many
    (or all) of the next document in ascending doc_id, the first one after the last. A null text is
    an empty one. Rows with equal doc_id follow each other in the order of a hash of their texts; repeated rows
    are one document in this order and each get its result. A single document is its own next.

    Texts are shuffled once by document; the beginnings of next documents, at most half as much,
    once more. Only ids and lengths are put in order.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = materialised(_order(texts), spark)
    n = order.count()
    after = order.select(
        F.col("doc_id").alias("next_doc"), F.col("h").alias("next_h"),
        F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"),
    )
    links = materialised(order.join(after, "place"), spark)
    texts = texts.withColumn("h", F.xxhash64("text"))

    def own(doc: str, h: str):
        return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("h") == F.col(h))

    heads = links.select(
        F.col("next_doc").alias("b_doc"), F.col("next_h").alias("b_h"),
        F.col("doc_id").alias("a_doc"), F.col("h").alias("a_h"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("half"),
    )
    heads = texts.join(heads, own("b_doc", "b_h")).groupBy("a_doc", "a_h", "b_doc", "b_h").agg(
        F.first(F.substring(F.col("text"), F.lit(1), F.col("half"))).alias("head")
    )
    n_chars = F.char_length("text")
    both = texts.join(heads, own("a_doc", "a_h")).select(
        "doc_id", "h", "b_doc", "b_h", n_chars.cast("long").alias("n_chars"), "text",
        F.concat(
            F.substring(F.col("text"), F.lit(1), n_chars - F.floor(n_chars / 2).cast("int")), F.col("head")
        ).alias("edited"),
    )
    both = both.select(
        "doc_id", "h", "b_doc", "b_h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        codes(kmer_hashes(F.col("text"))).alias("codes"),
        codes(kmer_hashes(F.col("edited"))).alias("edited_codes"),
    )
    both = materialised(both, spark)
    following = both.select(
        F.col("doc_id").alias("n_doc"), F.col("h").alias("n_h"), F.col("codes").alias("next_codes")
    ).dropDuplicates(["n_doc", "n_h"])
    same = F.col("b_doc").eqNullSafe(F.col("n_doc")) & (F.col("b_h") == F.col("n_h"))
    return both.join(following, same).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
