"""Document fingerprints by winnowing.  DataFrame functions only.

Tokens are runs of characters that aren't white space; a run of more than PIECE characters has a token
at each of its characters that PIECE characters follow from, so that text without spaces has tokens
too and they don't depend on where a passage begins in its run.  Each K tokens in a row have a rolling
hash, the polynomial of their own hashes in BASE modulo PRIME.  Spark's arrays have no scan that hands
the last hash on to the next, so the polynomials grow by doubling instead: those of two tokens from
those of one, those of four from two of two; each token is hashed once.  Of every WINDOW hashes in a row the least is chosen, the rightmost among equals, and the chosen (hash,
position) pairs are the fingerprint.  So any match of at least K + WINDOW - 1 tokens shares a choice
(within a run, PIECE + K + WINDOW - 2 characters), and no match shorter than K tokens counts.

Hash and negated position share one long, so that the plain minimum of longs is the least hash with
the rightmost place, and each choice is distinct by its place.

Defined results: a text of fewer than K tokens has one gram of them all, fewer grams than a window
one window; null and empty texts have no fingerprint entries, are alike to each other (1.0) and
unlike all others (0.0); texts of any length are read whole; rows that repeat an id follow each other
in an order of a hash of text and place in the table, and a null id comes last; an empty table gives
an empty result; only the id and the text are read, so further columns may have any name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 4, 4
PIECE = 8
#: Bits of a position in a packed entry; the hash has the 63 - PLACE_BITS above.
PLACE_BITS = 29
_PLACES = 1 << PLACE_BITS
#: The largest prime of 63 - PLACE_BITS bits, and a base whose square times it stays within a long.
PRIME, BASE = (1 << 34) - 41, 15485
#: White space, as the inside of a character class.
_SPACE = r"\x20\x09-\x0D"


def tokens(text: Column, piece: int = PIECE, sliding: bool = True) -> Column:
    """The tokens of a text as array<string>; without `sliding`, long runs are cut into pieces side by side.

    Each match of the sliding form takes one character and looks ahead for the token that begins
    there: `piece` characters, or a whole shorter run.
    """
    text = F.coalesce(text, F.lit(""))
    if not sliding:
        return F.regexp_extract_all(text, F.lit(rf"[^{_SPACE}]{{1,{piece}}}"), F.lit(0))
    some = f"[^{_SPACE}]"
    short = rf"|(?<!{some}){some}{{1,{piece - 1}}}(?!{some})" if piece > 1 else ""
    return F.regexp_extract_all(text, F.lit(rf"(?=({some}{{{piece}}}{short})){some}"), F.lit(1))


def entries(df: DataFrame, text: str, name: str, piece: int = PIECE, sliding: bool = False) -> DataFrame:
    """df with the fingerprint of the column `text` as `name` array<long>, of tokens() of that form.

    Each step is a column of its own, so that no step's lambda holds another step's array and works
    it out again for every element.
    """
    token, two, gram, pair = (f"_{name}_{x}" for x in ("tokens", "two", "grams", "pairs"))
    get = lambda a, i: F.get(F.col(a), i)
    df = df.withColumn(token, F.transform(tokens(F.col(text), piece, sliding), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    # Past the end a token counts as 0, which only texts of fewer than K tokens see.
    then = lambda x, a, i, step: (x * F.lit(BASE**step) + F.coalesce(get(a, i + step), F.lit(0))) % F.lit(PRIME)
    df = df.withColumn(two, F.transform(token, lambda x, i: then(x, token, i, 1)))
    n = F.greatest(F.size(token) - (K - 1), F.least(F.size(token), F.lit(1)))
    pack = lambda h, i: h * F.lit(_PLACES) + (F.lit(_PLACES - 1) - i)
    df = df.withColumn(gram, F.transform(F.slice(F.col(two), F.lit(1), n), lambda x, i: pack(then(x, two, i, 2), i)))
    # Minimum of four in two steps of two; past the end, get() is null and least() passes over it.
    df = df.withColumn(pair, F.transform(gram, lambda x, i: F.least(x, get(gram, i + 1))))
    w = F.greatest(F.size(gram) - (WINDOW - 1), F.least(F.size(gram), F.lit(1)))
    df = df.withColumn(name, F.array_distinct(F.transform(F.slice(F.col(pair), F.lit(1), w), lambda x, i: F.least(x, get(pair, i + 2)))))
    return df.drop(token, two, gram, pair)


def hashes(name: str) -> Column:
    """The distinct hashes of packed entries."""
    return F.array_distinct(F.transform(F.col(name), lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1.0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def digest(name: str) -> Column:
    """Lower-case hex of the SHA-256 of the entries, in order of place."""
    return F.sha2(F.array_join(F.transform(F.col(name), lambda x: F.hex(x)), " "), 256)


def _buckets(docs: DataFrame, id_col: str, bytes_each: int, quantiles: int) -> tuple[DataFrame, int]:
    """docs with _k and _h, its place in the order (_k descending, _h), and _bucket, which rises with it.

    Ids are cut at `quantiles` quantiles, which the driver holds, and each range between two cuts evenly
    into as many parts as `bytes_each` asks for.  A cut that several quantiles share is an id that many
    rows have: those rows are a range of their own, cut by _h into as many parts as it has quantiles.
    """
    spark = docs.sparkSession
    docs = docs.withColumns({"_k": F.coalesce(F.col(id_col), F.lit(-(2**63)).cast("long")), "_h": F.xxhash64("text", F.monotonically_increasing_id())})
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(-(-total // bytes_each), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(parts, quantiles)
    each = -(-parts // ranges)
    found = docs.agg(F.percentile_approx("_k", [i / ranges for i in range(1, ranges)], 4 * quantiles).alias("q"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).first() if ranges > 1 else None
    if not found or not found["q"]:
        return docs.withColumn("_bucket", F.lit(0).cast("long")), 1
    cuts = sorted(set(found["q"]))
    times = [found["q"].count(x) for x in cuts]
    array = lambda of: F.array(*[F.lit(x).cast("long") for x in of])
    ends, often = array([found["lo"], *cuts, found["hi"]]), array([0, *times])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    # Binary search for the number of cuts that are not above the id.
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(cuts)) & (F.get(ends, n + step) <= F.col("_k")), n + step).otherwise(n))
    docs = docs.withColumn("_at", at)
    low, high = F.get(ends, F.col("_at")), F.get(ends, F.col("_at") + 1)
    docs = docs.withColumns({"_often": F.get(often, F.col("_at")), "_low": low.cast("double"), "_wide": high.cast("double") - low.cast("double")})
    hot = (F.col("_often") > 1) & (F.col("_k") == low)
    share = lambda x, n: F.least(F.greatest(F.floor(x * n), F.lit(0)), n - 1)
    by_id = F.lit(each - 1) - share(F.coalesce(F.try_divide(F.col("_k").cast("double") - F.col("_low"), F.col("_wide")), F.lit(0.0)), F.lit(each))
    by_hash = share(F.col("_h").cast("double") / F.lit(2.0**64) + 0.5, F.col("_often") * each)
    range_at = 2 * (len(cuts) - F.col("_at")) + hot.cast("int")  # the rows of a frequent id come after those above it
    wide = each * max(times) + 1
    bucket = (range_at * F.lit(wide) + F.when(hot, by_hash).otherwise(by_id)).cast("long")
    return docs.withColumn("_bucket", bucket).drop("_at", "_often", "_low", "_wide"), parts


def edited(docs: DataFrame, id_col: str = "doc_id", bytes_each: int = 16 << 20, quantiles: int = 4096) -> DataFrame:
    """docs(id, text) -> id, _text, _chars, _edited, _fp, _edited_fp, _next (hashes of the next document), _next_id.

    The next document follows in descending order of ids; after the last comes the first.  Rows are dealt
    once, by ranges of that order, and the first text of each range is handed to the range before, so no
    row looks beyond its task.  One row for each range (that is, for each `bytes_each` of text) is all
    that meets in one task.
    """
    docs = docs.select(id_col, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs, parts = _buckets(docs, id_col, bytes_each, quantiles)
    n_tasks = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(id_col, F.col("text").alias("_text"), "_k", "_h", "_bucket").repartition(n_tasks, "_bucket")
    order = Window.partitionBy("_bucket").orderBy(F.desc("_k"), "_h")
    firsts = dealt.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_bucket", F.col("_text").alias("_first"), F.col(id_col).alias("_first_id"))
    every = Window.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(every), F.last("_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    handed = firsts.select("_bucket").withColumn("_to", before).join(firsts, "_bucket")
    handed = entries(handed, "_first", "_first_fp", sliding=True).select(F.col("_to").alias("_bucket"), "_first", "_first_id", hashes("_first_fp").alias("_first_hashes"))

    fp = entries(dealt, "_text", "_fp", sliding=True).withColumn("_hashes", hashes("_fp"))
    fp = fp.withColumns({"_next": F.lead("_hashes").over(order), "_next_text": F.lead("_text").over(order), "_next_id": F.lead(id_col).over(order)}).join(handed, "_bucket")
    end = F.col("_next_text").isNull()
    fp = fp.withColumns({"_next_id": F.when(end, F.col("_first_id")).otherwise(F.col("_next_id")), "_next": F.coalesce("_next", "_first_hashes"), "_next_text": F.coalesce("_next_text", "_first")})
    n = F.char_length("_text")
    fp = fp.withColumn("_chars", n.cast("long")).withColumn("_cut", F.floor(F.col("_chars") / 3).cast("int"))
    fp = fp.withColumn("_edited", F.concat(F.substr("_text", F.lit(1), F.col("_chars").cast("int") - F.col("_cut")), F.substr("_next_text", F.lit(1), F.col("_cut"))))
    return entries(fp, "_edited", "_edited_fp", sliding=True)
