"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are the distinct words `[^\\x20\\x09-\\x0D]+` of a text after lower-casing A-Z. The lexicon keeps those within a
band of inverse document frequency: at least LEAST_DF documents and at most a share MOST_SHARE of them have the term.

The md5 of a term places it between 0 and 1. The lexicon subsets of level v are SUBSETS neighbouring stretches of 2**-v
from 0 on. A text's fingerprint has the subsets of LEVELS levels, the first of which is chosen by its number of terms m
as max(0, floor(log2(m)) - 1): a subset then holds few of its terms, so that an edit leaves some subsets as they were.
Of each subset, the terms of the lexicon that the text has are sorted and hashed; one without any is left out:

    level|level.subset=hash level.subset=hash ...

A text without any lexicon term in its subsets is known by `=` and the sha256 of the whole text. Equal texts have equal
fingerprints. Only terms in a text's subsets are looked up, 16 to 32 for a long text, since no other can be hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .skew import split_join

LEAST_DF, MOST_SHARE = 2, 0.1
SUBSETS, LEVELS, HASH_DIGITS = 8, 3, 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a term's place that are compared; bits that tell the SUBSETS apart.
_BITS, _SUBSET_BITS = 32, 3


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def lexicon(df: DataFrame, text_col: str = "text", least_df: int = LEAST_DF, most_share: float = MOST_SHARE) -> DataFrame:
    """(term) within the band, by the document frequencies of all rows of df; a null text counts as a document without terms."""
    total = df.count()
    counted = df.select(F.explode(terms(F.col(text_col).cast("string"))).alias("term")).groupBy("term").count()
    return counted.where((F.col("count") >= least_df) & (F.col("count") <= most_share * total)).select("term")


def _place(term: Column) -> Column:
    return F.conv(F.left(F.md5(term.cast("binary")), F.lit(_BITS // 4)), 16, 10).cast("bigint")


def sampled(text: Column) -> Column:
    """struct<level, terms>: a text's first level, and those of its terms that lie in the subsets of its levels."""

    def placed(x: Column) -> Column:
        level = F.coalesce(F.greatest(F.lit(0), F.floor(F.log2(F.size(x))).cast("int") - 1), F.lit(0))
        # as a hexadecimal number: where the last subset of the first level ends; g comes after all digits
        end = F.lpad(F.lower(F.hex(F.pow(F.lit(2.0), _BITS + _SUBSET_BITS - level).cast("bigint"))), _BITS // 4, "0")
        return F.struct(x.alias("terms"), level.alias("level"), F.when(level <= _SUBSET_BITS, "g").otherwise(end).alias("end"))

    def chosen(x: Column) -> Column:
        return F.struct(x["level"].alias("level"), F.filter(x["terms"], lambda t: F.md5(t.cast("binary")) < x["end"]).alias("terms"))

    # arrays of one element, so that what is inside is made once
    return F.transform(F.transform(F.array(terms(text)), placed), chosen)[0]


def _entries(level: Column, found: Column) -> Column:
    """The fingerprint's entries from its first level and its lexicon terms (term, place), sorted by term."""

    def stretch(v: Column, k: Column) -> Column:
        wide = F.pow(F.lit(2.0), _BITS - v)
        return F.struct(F.concat(v.cast("string"), F.lit("."), k.cast("string")).alias("name"), (k * wide).alias("low"), ((k + 1) * wide).alias("high"))

    subsets = F.flatten(F.transform(F.sequence(level, level + LEVELS - 1), lambda v: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: stretch(v, k))))

    def entry(s: Column) -> Column:
        own = F.filter(found, lambda t: (t["place"] >= s["low"]) & (t["place"] < s["high"]))
        told = F.array_join(F.transform(own, lambda t: t["term"]), " ")
        return F.when(told != "", F.concat(s["name"], F.lit("="), F.left(F.md5(told.cast("binary")), F.lit(HASH_DIGITS))))

    return F.filter(F.transform(subsets, entry), lambda x: x.isNotNull())


def likeness(a: Column, b: Column) -> Column:
    """How many of two fingerprints' subsets agree, 0 to 1, of those at common levels that either has; equal ones 1."""
    level = lambda x: F.substring_index(x, "|", 1).try_cast("int")
    entries = lambda x: F.split(F.substring_index(x, "|", -1), " ")
    first, last = F.greatest(level(a), level(b)), F.least(level(a), level(b)) + LEVELS - 1

    def common(x: Column) -> Column:
        return F.filter(entries(x), lambda e: F.substring_index(e, ".", 1).try_cast("int").between(first, last))

    slots = F.size(F.array_union(*(F.transform(common(x), lambda e: F.substring_index(e, "=", 1)) for x in (a, b))))
    both = F.size(F.array_intersect(common(a), common(b)))
    plain = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(plain | (first > last), 0.0).otherwise(F.coalesce(both / F.nullif(slots, F.lit(0)), F.lit(0.0)))


def fingerprints(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(key, fingerprint) of stored texts (key, sha256, sample) with the lexicon `words`; each key once.

    key: a number of the text, equal for equal texts; sample: sampled() of it."""
    each = texts.groupBy("key").agg(F.first(F.struct("sha256", "sample")).alias("x")).select("key", "x.sha256", F.col("x.sample.level").alias("level"), F.col("x.sample.terms").alias("terms"))
    each = store.keep(each, "imatch-texts")
    sent = each.select("key", F.explode("terms").alias("term"))
    met = split_join(sent, words, "term", ["key"]).select("key", F.struct("term", _place(F.col("term")).alias("place")).alias("found"))
    found = met.groupBy("key").agg(F.array_sort(F.collect_list("found")).alias("found"))
    entries = _entries(F.col("level"), F.col("found"))
    told = each.select("key", "sha256", "level").join(found, "key", "left").select("key", "sha256", "level", F.coalesce(entries, F.array().cast("array<string>")).alias("entries"))
    plain = F.concat(F.lit("="), F.col("sha256"))
    return told.select("key", F.when(F.size("entries") == 0, plain).otherwise(F.concat(F.col("level").cast("string"), F.lit("|"), F.array_join("entries", " "))).alias("fingerprint"))


def _bucketed(df: DataFrame, id_col: str) -> DataFrame:
    """df with `bucket`, which rises with the id: buckets of about equal numbers of rows, two for each shuffle partition."""
    many = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(id_col, [k / many for k in range(1, many)], 10_000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    # found in two steps: among every step-th cut, then among those up to the next
    whole, coarse = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (cuts, cuts[::step]))
    passed = F.size(F.filter(coarse, lambda x: x <= F.col(id_col)))
    near = F.size(F.filter(F.slice(whole, (passed - 1) * step + 1, F.lit(step)), lambda x: x <= F.col(id_col)))
    return df.withColumn("bucket", F.when(F.col(id_col).isNull() | (passed == 0), 0).otherwise((passed - 1) * step + near))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next): each text and that of the next row in descending order of ids, after the last one the first.

    Nulls come last, rows that share an id in the order of their texts' hashes. Each bucket of ids is a window; the first
    row of each also goes to the end of the bucket before it, and the very first to the end of the last."""
    rows = _bucketed(df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "id")
    # as many rows as there are buckets
    edges = rows.groupBy("bucket").agg(F.max("id").alias("edge_id"))
    above, over = Window.orderBy("bucket"), Window.partitionBy()
    edges = edges.select(F.col("bucket").alias("edge_bucket"), "edge_id", F.coalesce(F.lead("bucket").over(above), F.min("bucket").over(over)).alias("to"))
    first = (F.col("bucket") == F.col("edge_bucket")) & F.col("id").eqNullSafe(F.col("edge_id"))
    places = F.when(F.col("to").isNull(), F.array(F.struct(F.lit(False).alias("extra"), F.col("bucket").alias("bucket")))).otherwise(F.array(F.struct(F.lit(False).alias("extra"), F.col("bucket").alias("bucket")), F.struct(F.lit(True).alias("extra"), F.col("to").alias("bucket"))))
    placed = rows.join(F.broadcast(edges), first, "left").select("id", "text", F.xxhash64("text").alias("h"), F.explode(places).alias("p")).select("id", "text", "h", "p.extra", "p.bucket")
    w = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("id"), "h")
    return placed.select("id", "text", "extra", F.lead("text").over(w).alias("next")).where("NOT extra").drop("extra")


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of other."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(other, half))


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_df: int = LEAST_DF, most_share: float = MOST_SHARE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): a row for each row of df.

    edited: see edited(), with the text of the next row in descending order of ids, see with_next(). near_edited and
    near_next: likeness() to the fingerprint of the edited text and of the next row's text. The lexicon comes of all
    texts of df. A null or empty text has the fingerprint of its sha256 and stays empty; a single row is its own next.
    Texts are told apart by 64-bit hashes inside the joins. Ids are whole numbers; rows that repeat one are documents of
    their own. An empty table gives an empty result. Other columns are not read. Nothing but cut points of ids and a
    count of rows reaches the driver.
    """
    with store.scratch():
        words = store.keep(lexicon(df, text_col, least_df, most_share), "imatch-lexicon")
        met = with_next(df, id_col, text_col).select("id", "text", "next", edited(F.col("text"), F.col("next")).alias("edited"))
        sha = lambda x: F.sha2(F.col(x).cast("binary"), 256)
        rows = met.select(
            F.col("id").alias("doc_id"),
            F.char_length("text").cast("bigint").alias("n_chars"),
            *(F.struct(F.xxhash64(x).alias("key"), sha(x).alias("sha256"), sampled(F.col(x)).alias("sample")).alias(x) for x in ("text", "edited")),
            F.xxhash64("next").alias("next_key"),
        )
        rows = store.keep(rows, "imatch-rows")
        known = store.keep(fingerprints(rows.select("text.*").union(rows.select("edited.*")), words), "imatch-fingerprints")
        flat = rows.select("doc_id", "n_chars", F.col("text.key").alias("text_key"), F.col("edited.key").alias("edited_key"), F.col("edited.sha256").alias("edited_sha256"), "next_key")
        out = flat
        for name, key in (("fingerprint", "text_key"), ("edited_fingerprint", "edited_key"), ("next_fingerprint", "next_key")):
            out = split_join(out, known.select(F.col("key").alias(key), F.col("fingerprint").alias(name)), key, ["doc_id"], counts=flat.groupBy(key).count())
        mine = F.col("fingerprint")
        out = out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(mine, F.col("edited_fingerprint")).alias("near_edited"), likeness(mine, F.col("next_fingerprint")).alias("near_next"))
        return store.keep(out, "imatch-compared", outer=True)
