"""Document fingerprints: I-Match with randomised lexicons, in DataFrame functions only.

The lexicon holds terms whose document frequency lies in a band (as a share of all documents), so its inverse document
frequency does, too. SUBSETS random subsets of it are drawn by hashing terms; a fingerprint is one hash per subset, of the
document's distinct terms that lie in the subset (exclusive or of the terms' hashes). Subsets come in several densities, so that short and long
documents both have some of which they hold a few terms.

Copies count as documents, so the terms of a group of copies that holds more than HIGH of all rows are out of the band, as
are frequent words. So a fingerprint has two parts: the hashes over its terms in the band, and after '|' those over all of its
terms, by the same subsets. Pairs of which a document has few terms in the band are compared by the second parts.

At least a share LOW of all documents holds each term, so the lexicon has at most (mean distinct terms of a document) /
LOW terms, however many documents there are. Its size is counted before it is broadcast; beyond LEXICON_TERMS the join
shuffles instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Band of document frequencies, as shares of all documents.
LOW, HIGH = 0.001, 0.01
#: One in so many terms is in a subset; 16 subsets of each density.
DENSITIES = (4, 16, 64, 256)
PER_DENSITY = 16
SUBSETS = PER_DENSITY * len(DENSITIES)
LEXICON_TERMS = 400_000
#: A text with fewer terms of the lexicon, or with under one in so many of its terms there, is hashed over all of its terms.
FEW, FEW_SHARE = 8, 8
#: Bytes of text in a range of ids, within which the next document is found by a window, on average; and ranges at most, as the
#: driver holds where they begin (16 bytes each).
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def distinct_terms(text: Column) -> Column:
    """Distinct lower-cased words of letters, digits and non-ASCII characters; '' may be among them."""
    return F.array_distinct(F.split(F.lower(text), _SEPARATORS))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms in the band, written to the shared folder."""
    words = docs.select(F.explode(distinct_terms(F.col("text"))).alias("term")).where("term <> ''")
    frequency = words.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*")).first()[0]
    chosen = frequency.where((F.col("df") >= max(1.0, low * total)) & (F.col("df") <= max(1.0, high * total)))
    return stage(chosen.select("term", "df"), "lexicon")


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")


def subsets_of(code: Column) -> Column:
    """Bit k is set if the term of that hash is in subset k: all of as many random bits are set as halve one to its density."""
    mask = None
    for draw in range(max(DENSITIES).bit_length() - 1):
        spared = sum(((1 << PER_DENSITY) - 1) << PER_DENSITY * g for g, d in enumerate(DENSITIES) if d.bit_length() - 1 <= draw)
        bits = F.xxhash64(code, F.lit(draw)).bitwiseOR(_signed(spared))
        mask = bits if mask is None else mask.bitwiseAND(bits)
    return mask


def _pair(k: int) -> Column:
    """A term's share in the hashes of subset k (low half) and of the one SUBSETS / 2 further (high half). Bit k is shifted
    over a whole word: in so many columns conditions would make a method that the JVM doesn't compile."""
    bit = lambda k: F.shiftright(F.shiftleft("mask", 63 - k), 63)
    return bit(k).bitwiseAND(F.col("low")).bitwiseOR(bit(k + SUBSETS // 2).bitwiseAND(F.col("high")))


def _printed(pairs: list[str]) -> Column:
    """One hexadecimal hash per subset, '-' for a subset that holds no term."""
    value = f"shiftrightunsigned(shiftleft(element_at(array({', '.join(pairs)}), cast(k % {SUBSETS // 2} as int) + 1), if(k < {SUBSETS // 2}, 32, 0)), 32)"
    return F.expr(f"array_join(transform(transform(sequence(0, {SUBSETS - 1}), k -> {value}), v -> if(v = 0, '-', lpad(hex(v), 8, '0'))), ' ')")


def _agreement(a: str, b: str) -> Column:
    """For each subset 0 where neither fingerprint holds a term, 2 where the hashes are equal, else 1. Of two fingerprints the parts
    over terms in the band are compared, or those over all terms if either has few in the band."""
    part = lambda x: f"split(substring_index({x}, '|', if({a} like '=%' or {b} like '=%', -1, 1)), ' ')"
    return F.expr(f"zip_with({part(a)}, {part(b)}, (x, y) -> case when x = '-' and y = '-' then 0 when x = y then 2 else 1 end)")


def _likeness(equal: Column, codes: str) -> Column:
    """Share of equal hashes among subsets of which either document holds terms, of the density that shows most of it; 1 for
    equal fingerprints, 0 where neither has terms in subsets and they differ."""
    parts = [f"slice({codes}, {d * PER_DENSITY + 1}, {PER_DENSITY})" for d in range(len(DENSITIES))]
    shares = [f"size(filter({p}, c -> c = 2)) / greatest(size(filter({p}, c -> c > 0)), {PER_DENSITY // 2})" for p in parts]
    return F.when(equal, 1.0).otherwise(F.coalesce(F.expr(f"cast(greatest({', '.join(shares)}) as double)"), F.lit(0.0)))


def fingerprints(docs: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """keys and fingerprint of each row; keys name a row. known: a lexicon.

    A fingerprint is the subsets' hashes of the terms in the lexicon, or where those are few '=' and one hash of all terms;
    '|'; and the same subsets' hashes of all terms. Likenesses are found from fingerprints alone."""
    terms = distinct_terms(F.coalesce(text, F.lit("")))
    # The words' array is made before it is exploded: what stands beside explode() is evaluated for each word.
    made = docs.select(*keys, terms.alias("terms"))
    each = made.select(*keys, F.explode("terms").alias("term"))
    small = known.select("term", F.lit(True).alias("known"))
    if small.count() <= LEXICON_TERMS:
        small = F.broadcast(small)
    each = each.join(small, "term", "left")
    each = each.select(*keys, F.when(F.col("known").isNotNull(), -1).otherwise(0).cast("bigint").alias("known"), F.when(F.col("term") == "", 0).otherwise(F.xxhash64("term")).cast("bigint").alias("code"))
    low = F.col("code").bitwiseAND(_signed((1 << 32) - 1))
    each = each.select(*keys, "known", "code", subsets_of(F.col("code")).alias("mask"), low.alias("low"), F.col("code").bitwiseXOR(low).alias("high"))
    pairs = range(SUBSETS // 2)
    each = each.select(*keys, "known", "code", *[_pair(k).alias(f"p{k}") for k in pairs])
    held = each.groupBy(*keys).agg(
        F.count(F.when(F.col("code") != 0, 1)).alias("n_terms"), (-F.sum("known")).alias("n_known"), F.bit_xor("code").alias("plain"),
        *[F.bit_xor(f"p{k}").alias(f"all{k}") for k in pairs], *[F.bit_xor(F.col(f"p{k}").bitwiseAND(F.col("known"))).alias(f"band{k}") for k in pairs],
    )
    own, band = _printed([f"all{k}" for k in pairs]), _printed([f"band{k}" for k in pairs])
    few = (F.col("n_known") < FEW) | (F.col("n_known") * FEW_SHARE < F.col("n_terms"))
    first = F.when(few, F.concat(F.lit("="), F.hex("plain"))).otherwise(band)
    return held.select(*keys, F.concat(first, F.lit("|"), own).alias("fingerprint"))


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows with their range (span) of ids and place in it, by id and text. Ranges are as many as the texts need to be small;
    where they begin is found over ids and the first characters of the texts alone, so rows of one id are parted, too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(16, -(-size // RANGE_BYTES)))
    # Hexadecimal digits order as the bytes that they stand for.
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_head": F.hex(F.encode(F.substring("text", 1, 8), "UTF-8"))})
    parts = keyed.select("_id", "_head").repartitionByRange(ranges, "_id", "_head").withColumn("part", F.spark_partition_id())
    begins = sorted({tuple(r.begin) for r in parts.groupBy("part").agg(F.min(F.struct("_id", "_head")).alias("begin")).collect()})[1:]
    ids, heads = (f"split('{','.join(str(x[k]) for x in begins)}', ',')" for k in (0, 1))
    ids = f"cast({ids} as array<bigint>)"
    halves = ", ".join(str(1 << k) for k in range(len(begins).bit_length() - 1, -1, -1))
    passed = f"try_element_at({ids}, a + b) < _id or (try_element_at({ids}, a + b) = _id and try_element_at({heads}, a + b) <= _head)"
    span = F.expr(f"aggregate(array({halves}), 0, (a, b) -> if({passed}, a + b, a))") if begins else F.lit(0)
    place = F.row_number().over(Window.partitionBy("span").orderBy("_id", "text"))
    return keyed.withColumn("span", span).withColumn("place", place).drop("_id", "_head")


def _with_next(rows: DataFrame, value: str, name: str, order: list[str]) -> DataFrame:
    """Adds the value of the next row in (span, order); after the last comes the first. Each span's first row is looked up
    by its place, which is one row per span."""
    within = Window.partitionBy("span").orderBy(*order)
    firsts = rows.where("place = 1").select("span", F.col(value).alias("first_value"))
    spans = firsts.select("span").withColumn("all", F.lit(0))
    over = Window.partitionBy("all").orderBy("span")
    whole = Window.partitionBy("all")
    follows = spans.select(F.col("span"), F.coalesce(F.lead("span").over(over), F.min("span").over(whole)).alias("following"))
    heads = follows.join(firsts.withColumnRenamed("span", "following"), "following").select("span", F.col("first_value"))
    last = F.lead("place").over(within).isNull()
    out = rows.withColumn("_inner", F.lead(value).over(within)).withColumn("_last", last)
    out = out.join(F.broadcast(heads), "span", "left")
    return out.withColumn(name, F.when(F.col("_last"), F.col("first_value")).otherwise(F.col("_inner"))).drop("_inner", "_last", "first_value")


def fingerprint_report(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of texts and of their edited copies, with likenesses.

    docs: doc_id, text; other columns are ignored. The edited copy: the last floor(n_chars / 2) characters are replaced by
    the first as many (or all) of the next document, by doc_id and then text; after the last comes the first.
    Null is an empty text; rows of a null doc_id come first; rows that repeat a doc_id are rows of their own; one row is its
    own next; a very long text is one cell of one task; an empty table gives no rows. Equal texts have equal fingerprints.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs, low, high)
    rows = _with_next(_ordered(docs), "text", "next_text", ["place"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.select("span", "place", "doc_id", "n_chars", "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select(
        "span", "place", "doc_id", "n_chars", "edited_sha256",
        F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("text").alias("text")), F.struct(F.lit(1).alias("copy"), F.col("edited").alias("text")))).alias("x"),
    ).select("span", "place", "doc_id", "n_chars", "edited_sha256", "x.copy", "x.text")
    carried = ["doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(both, ["span", "place", "copy", *carried], "text", known)
    one = lambda copy: F.max(F.when(F.col("copy") == copy, F.col("fingerprint")))
    wide = prints.groupBy("span", "place", *carried).agg(one(0).alias("this"), one(1).alias("edited"))
    wide = stage(wide, "fingerprints")
    final = _with_next(wide, "this", "next", ["place"])
    final = final.withColumns({"with_edited": _agreement("this", "edited"), "with_next": _agreement("this", "next")})
    near = lambda other, codes: _likeness(F.col("this") == F.col(other), codes)
    return final.select(
        "doc_id", "n_chars", "edited_sha256", F.col("this").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        near("edited", "with_edited").alias("near_edited"), near("next", "with_next").alias("near_next"),
    )
