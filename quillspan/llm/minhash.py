"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

All column expressions. Every word run ("shingle") of a text is hashed once; the hash's top bits choose
one of ``BINS`` bins and each bin keeps its least hash. An empty bin takes the value of the first filled
bin on its own walk over all bins (start and stride are hashes of the bin, and attempt t looks at
start + t * stride instead of at a fresh hash, which reaches every bin once and no bin twice; bins walk
independently, so borrowed values are spread evenly over the filled bins). Of each value the low ``BITS`` bits are kept, one hex digit a
bin. Two fingerprints agree in a bin by chance in one of 16 cases; :func:`likeness` takes that out again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
WORDS = 5
SHIFT = 64 - BIN_BITS
LOW = (1 << SHIFT) - 1
NO_WORDS = "0" * BINS
#: Steps of a walk that are tried one by one before all of it is looked at.
QUICK_STEPS = 6
#: Rows that meet in one window when texts are set beside their successors (the root of all rows, if that is more).
BUCKET_ROWS = 500


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _walks() -> tuple[list[int], list[int]]:
    """Start and stride of each bin's walk: bin i looks at ``start + t * stride mod BINS`` for t = 0, 1, ...; odd strides reach all."""
    starts, strides = [], []
    for i in range(BINS):
        x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        x ^= x >> 31
        starts.append(x % BINS)
        strides.append((x >> 32) % BINS | 1)
    return starts, strides


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash of every run of ``words`` words of the lower-cased text (of all words, if fewer); no words, no hashes."""
    hashed = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        long = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]))
        return F.when(n >= words, long).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(hashed, runs)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin in the order of bins; an empty bin has the largest hash of its range.

    The hashes are sorted together with those largest values, and the first of each range is kept.
    """
    marks = F.array(*[F.lit(((b - BINS // 2) << SHIFT) | LOW) for b in range(BINS)])

    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.element_at(h, F.greatest(i, F.lit(1))), SHIFT)))

    return _let(F.sort_array(F.concat(hashes, marks)), firsts)


def _dense(bins: Column) -> Column:
    """The bins with every empty one filled from the first filled bin on its walk."""
    starts, strides = _walks()
    steps = [F.array(*[F.lit((s + t * d) % BINS + 1) for s, d in zip(starts, strides, strict=True)]) for t in range(QUICK_STEPS)]
    start, back = F.array(*map(F.lit, starts)), F.array(*[F.lit(pow(d, -1, BINS)) for d in strides])
    full = lambda h: h.bitwiseAND(LOW) != LOW

    def fill(b: Column) -> Column:
        filled = F.filter(F.transform(b, lambda h, i: F.when(full(h), i)), lambda i: i.isNotNull())

        def look(filled: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                quick = [_let(F.element_at(b, F.element_at(step, i + 1)), lambda x: F.when(full(x), x)) for step in steps]
                # the number of steps to each filled bin is known by the stride's inverse; the least number wins
                far = F.transform(filled, lambda j: ((j - F.element_at(start, i + 1)) * F.element_at(back, i + 1)).bitwiseAND(BINS - 1) * BINS + j)
                return F.when(full(h), h).otherwise(F.coalesce(*quick, F.element_at(b, F.array_min(far).bitwiseAND(BINS - 1) + 1)))

            return F.transform(b, one)

        return _let(filled, look)

    return _let(bins, fill)


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text as ``BINS`` hex digits; null and wordless texts have all zeros."""

    def digits(hashes: Column) -> Column:
        # the kept bits come from the value hashed with its bin, so that a short text's few values agree by chance in each bin anew
        values = F.transform(_dense(_bins(hashes)), lambda h, i: F.lower(F.hex(F.xxhash64(h, i).bitwiseAND((1 << BITS) - 1))))
        return F.when(F.size(hashes) > 0, F.array_join(values, "")).otherwise(F.lit(NO_WORDS))

    return _let(shingle_hashes(F.coalesce(text, F.lit("")), words), digits)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of the shingle sets behind two fingerprints, without the chance matches."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance))
    return F.when(a == b, 1.0).when((a == NO_WORDS) | (b == NO_WORDS), 0.0).otherwise(estimate)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows (doc, text, guest) in buckets of consecutive ids, and the window in which ``lead`` gives the next document.

    The bounds of the buckets are ids that occur, so the first row of the next bucket (of the first one,
    after the last) is known by its id in the scan, and is sent to its predecessor's bucket as well, as a
    guest. Texts are shuffled once. Ids are integers; null ids come first, with the least long, and null texts
    are empty; rows of one id are ordered by text.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    n = docs.count()
    parts = max(1, n // max(BUCKET_ROWS, math.isqrt(n)))
    cuts = [i / parts for i in range(1, parts)]
    least, more = docs.select(F.min(key), F.percentile_approx(key, cuts or [0.5], max(10_000, 20 * parts))).first()
    bounds = sorted({least if least is not None else 0, *((more or []) if cuts else [])})
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse, fine = F.array(*[F.lit(g[0]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])

    def bucket(k: Column) -> Column:
        group = F.size(F.filter(coarse, lambda x: x <= k))
        return (group - 1) * width + F.size(F.filter(F.element_at(fine, group), lambda x: x <= k)) - 1

    own = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key")).withColumn("bucket", bucket(F.col("key")))
    first = F.exists(F.element_at(fine, F.floor(F.col("bucket") / F.lit(width)).cast("int") + 1), lambda x: x == F.col("key"))
    before = F.when(F.col("bucket") == 0, len(bounds) - 1).otherwise(F.col("bucket") - 1)
    here, there = F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(before.cast("int").alias("bucket"), F.lit(1).alias("guest"))
    rows = own.withColumn("seat", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    return rows.select("doc", "text", "key", "seat.bucket", "seat.guest"), Window.partitionBy("bucket").orderBy("guest", "key", "text")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Every document's fingerprint, an edited text's, and their likeness: (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last half (rounded down, in code points) replaced by as many first code points of
    the next document by ascending id (or all of them; after the last document comes the first). Null texts
    are empty; an empty table gives an empty result; repeated rows keep their rows; other columns take no part.
    """
    rows, window = beside_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(window), F.lit(1), half))
    seen = rows.withColumn("edited", edited).select("doc", "key", "bucket", "guest", "text", F.coalesce("edited", F.lit("")).alias("edited"))
    marked = seen.withColumn("fingerprint", fingerprint(F.col("text"), words)).withColumn("next_fingerprint", F.lead("fingerprint").over(window))
    kept = marked.filter("guest = 0").withColumn("edited_fingerprint", fingerprint(F.col("edited"), words))
    return kept.select(
        F.col("doc").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
