"""Quality rules by distribution divergence, in DataFrame operations only.

A document's histogram of character classes and its histogram of common words are held against the reference of its
language by the Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). The references are the
corpus's own: all documents' histograms, summed by language; a language's common words are its most frequent ones in all
documents, in lower case. Short documents are not judged by a histogram that they are
too short for.
"""

from __future__ import annotations


from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_same, lower_ascii

SYMBOLS = r"[#*$%&|<>]"
#: Words that can be common ones: of letters, and characters beyond ASCII.
LETTERS = r"[^\x00-\x60\x7B-\x7F]+"
#: Bins of the word histogram: so many of the language's most frequent words; all other words are one more bin.
BINS = 8
CLASSES = 7

MIN_CHARS = 250
MIN_WORDS = 100
#: References with less text than this judge nothing.
MIN_REFERENCE_WORDS = 1000
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.25
WINDOW = 5


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, although body names it several times."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Places covered by the windows whose hash another window has too."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda o, i, step: F.get(o, i + step)["h"] == F.get(o, i)["h"]
    twice = let(ordered, lambda o: F.filter(
        F.transform(o, lambda x, i: F.when(F.coalesce(same(o, i, 1), F.lit(False)) | F.coalesce(same(o, i, -1), F.lit(False)), x["i"])),
        lambda i: i.isNotNull()))
    return let(F.array_sort(twice), lambda at: F.aggregate(
        F.transform(at, lambda v, i: F.least(F.get(at, i + 1) - v, F.lit(WINDOW))), F.lit(0), lambda t, v: t + v))


def window_hashes(words: Column) -> Column:
    """A hash of each window of WINDOW words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= WINDOW, let(hashed, lambda h: F.transform(
        F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    ).otherwise(F.array().cast("array<long>"))


def split_words(text: Column) -> Column:
    """The words of a text: its six kinds of white space are made one, so that a plain split will do."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, common: each language's BINS most frequent words in lower case, ties by code point.

    Words are counted before they are shuffled, and of each partition only its first BINS words go on to the ranking, so
    that a language of a great share is no large group. A language without such words has no row.
    """
    x = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(split_words(lower_ascii(F.col("text")))).alias("word"))
    x = x.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("word").rlike(f"^{LETTERS}$"))
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("nth") <= BINS)
    return x.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("nth", "word")))["word"].alias("common"))


def measured(docs: DataFrame, common: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, carried (the columns in carry), the base counts and the two histograms of every document; null texts have no words.

    classes: a-z, A-Z, 0-9, white space, symbols, ASCII beyond those, other characters. Only the second and later ones
    are counted one by one, in what is left without a-z and white space. bins: the common words of the row's language
    (common_words) in any case, then all other words.
    """
    x = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0), *carry).alias("carried"))
    x = join_same(x, common, ["lang"], "left")
    x = x.withColumn("words", split_words(F.col("text"))).withColumn("lower", split_words(lower_ascii(F.col("text"))))
    x = x.withColumn("hashes", window_hashes(F.col("words"))).withColumn("rest", F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", ""))
    x = x.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
    word = lambda i: F.coalesce(F.get("common", F.lit(i)), F.lit("\n"))
    long = lambda c: c.cast("long")
    x = x.select(
        "doc_id", "lang", "carried",
        long(F.size("words")).alias("n_words"),
        long(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("rest", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(F.lit(0))).alias("n_repeat_words"),
        long(F.char_length("text")).alias("chars"),
        long(F.char_length("rest")).alias("n_rest"),
        *[long(F.regexp_count("rest", F.lit(p))).alias(k) for k, p in (("upper", "[A-Z]"), ("digit", "[0-9]"), ("ascii", r"[\x00-\x7F]"))],
        *[long(F.size("lower") - F.size(F.array_remove("lower", word(i)))).alias(f"b{i}") for i in range(BINS)],
    )
    lower, other = F.col("word_chars") - F.col("n_rest"), F.col("n_rest") - F.col("ascii")
    x = x.withColumn("classes", F.array(lower, "upper", "digit", F.col("chars") - F.col("word_chars"), "n_symbols", F.col("ascii") - F.col("upper") - F.col("digit") - F.col("n_symbols"), other))
    known = reduce(lambda a, b: a + b, [F.col(f"b{i}") for i in range(BINS)])
    x = x.withColumn("bins", F.array(*[f"b{i}" for i in range(BINS)], F.col("n_words") - known))
    return x.select("doc_id", "lang", "carried", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "classes", "bins")


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, in bits; null where one is all zero."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    na, nb = total(a), total(b)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(a, b, lambda x, y: term(x / na, (x / na + y / nb) / 2) + term(y / nb, (x / na + y / nb) / 2))
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0))))


def references(counts: DataFrame) -> DataFrame:
    """One row for each language: the summed histograms (r_classes, r_bins) and words (r_words)."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)] + [F.sum(F.col("bins")[i]).alias(f"b{i}") for i in range(BINS + 1)]
    x = counts.groupBy("lang").agg(F.sum("n_words").alias("r_words"), *sums)
    return x.select("lang", "r_words", F.array(*[f"c{i}" for i in range(CLASSES)]).alias("r_classes"), F.array(*[f"b{i}" for i in range(BINS + 1)]).alias("r_bins"))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base counts, base_failed, kept, the two distances and carried (a struct of the columns in carry, if there
    are any), for every row of docs.

    kept is false if base_failed, or if a histogram is further from its language's reference than allowed. A text of
    fewer than MIN_CHARS characters (MIN_WORDS words) is not judged by the first (second) histogram, and languages with
    little text judge nothing. Null texts count as empty (no words: base_failed); null languages are a language of their
    own; equal rows are judged alike; other columns are ignored.
    """
    counts = cut(measured(docs, cut(common_words(docs)), carry))
    x = join_same(counts, cut(references(counts)), ["lang"])
    doubles = lambda c: F.col(c).cast("array<double>")
    enough = F.col("r_words") >= MIN_REFERENCE_WORDS
    x = x.withColumn("class_distance", F.when(enough & (F.col("chars") >= MIN_CHARS), distance(doubles("classes"), doubles("r_classes"))))
    x = x.withColumn("word_distance", F.when(enough & (F.col("n_words") >= MIN_WORDS), distance(doubles("bins"), doubles("r_bins"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance",
        *["carried"] * bool(carry))
