"""Quality rules by distribution divergence, with DataFrame and SQL functions only.

A document's histogram of character classes, and its histogram of its
language's most common words and of all its other words together, are compared
with the references of its language by Jensen-Shannon distance. The references
are the mean histograms of the language's documents that pass the base rule. Documents too short
for a histogram of characters keep the benefit of the doubt; those too short for
one of words fail the base rule, and no text is exempt for lack of common words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The most common words of each language, most common first.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas sur".split(),
}
#: Character classes: white space, capitals, digits, marks of prose, other ASCII marks; all else counts as letters.
CLASSES = {"space": r"[\x20\x09-\x0D]", "upper": r"\p{Lu}", "digit": "[0-9]", "mark": r"[.,;:'\"?()\-]", "symbol": r"[!#$%&*+/<=>@\[\\\]^_`{|}~]"}
MIN_WORDS = 50
#: Characters and common words that a histogram needs to be judged: a text without common words is judged too.
MIN_CHARS, MIN_COMMON = 200, 0
#: Largest distances (0 to 1) of kept documents. A text without common words lies at about 0.37 where a quarter of words are common.
MAX_CHARS, MAX_WORDS = 0.27, 0.30
SYMBOLS = "[#*$%&|<>]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def let(value: Column, use) -> Column:
    """use(value) with value worked out once for a row: a column named inside a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, place_bits: int | None = None) -> Column:
    """Words that lie in a window of three that the text has twice or more.

    Windows are sorted by their hash, with their place in its low bits, as many as
    the text needs, so equal ones are neighbours, which their words confirm. A
    window beside one of equal hash and other words is looked for in the whole
    text. The places of windows that occur again are sorted and cover three words
    each, less what the next one covers. place_bits takes the place of the bits
    that a text needs; what they leave of the hash changes no count.
    """
    hashed = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    no = F.lit(False)
    shift = lambda how, x, n: F.call_function(how, x, n)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce((F.get(at, i + 1) - p).cast("int"), F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    def counted(w: Column, bits: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: shift("shiftleft", hashed(w, i), bits).bitwiseOR(i.cast("long")))
        at = lambda e: e.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        alike = lambda e, other: F.coalesce(shift("shiftright", e, bits) == shift("shiftright", other, bits), no)
        words_too = lambda e, other: F.array(*[F.get(w, at(e) + k) for k in range(3)]) == F.array(*[F.get(w, at(other) + k) for k in range(3)])

        def again(r: Column, e: Column, i: Column) -> Column:
            before, after = F.get(r, i - 1), F.get(r, i + 1)
            near = alike(e, before) | alike(e, after)
            same = (alike(e, before) & words_too(e, before)) | (alike(e, after) & words_too(e, after))
            return F.when(~near, no).when(same, F.lit(True)).otherwise(F.exists(r, lambda o: (o != e) & alike(e, o) & words_too(e, o)))

        twins = lambda r: F.array_sort(F.transform(F.filter(r, lambda e, i: again(r, e, i)), at))
        return let(F.sort_array(keys), lambda r: let(twins(r), covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda w: let(F.lit(place_bits) if place_bits else F.length(F.bin(F.size(w).cast("long"))), lambda bits: counted(w, bits))))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with _words and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.col("_text")
    words = F.filter(F.split(text, common.GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return (
        docs.withColumn("_words", words)
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", (F.length(text) - count(text, CLASSES["space"])).cast("long"))
        .withColumn("n_symbols", count(text, SYMBOLS))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")).cast("long"))
        .drop("_lines")
    )


def features(docs: DataFrame) -> DataFrame:
    """Base counts and histograms (classes, counts of common words and of all others) of docs (doc_id, text, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.when(F.col("lang").isin(*COMMON), F.col("lang").cast("string"))
    rows = base_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), known.alias("lang"), F.xxhash64("text", "lang").alias("key")))
    counted = [count(F.col("_text"), p) for p in CLASSES.values()]
    rows = rows.withColumn("_counted", F.array(*counted)).withColumn("n_chars", F.length("_text").cast("long"))
    rest = F.col("n_chars") - F.aggregate("_counted", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("chars", F.concat("_counted", F.array(rest)))
    # common words are short: the others need no look-up
    short = F.filter(F.col("_words"), lambda w: F.length(w) <= 6)
    plain = F.transform(short, lambda w: F.lower(F.translate(w, ".,;:!?", "")))

    def tally(listed: Column) -> Column:
        text = F.concat(F.lit(" "), F.array_join(F.filter(plain, lambda w: F.array_contains(listed, w)), "  "), F.lit(" "))
        left = lambda t, w: F.length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        return let(text, lambda t: F.transform(listed, lambda w: F.floor((F.length(t) - left(t, w)) / (F.length(w) + 2)).cast("long")))

    times = F.lit(None).cast("array<bigint>")
    for name, words in COMMON.items():
        times = F.when(F.col("lang") == name, tally(F.array(*map(F.lit, words)))).otherwise(times)
    rows = rows.withColumn("_times", times).withColumn("common", F.concat("_times", F.array(F.col("n_words") - total(F.col("_times")))))
    return rows.select("doc_id", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "chars", "common")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """Mean histograms of the documents of each language (and of none) that pass the base rule: a row each of the known languages and one for the rest."""
    long = rows.where(~base_failed() & (F.col("n_chars") >= MIN_CHARS))
    share = lambda a, k: F.get(F.col(a), F.lit(k)) / F.greatest(total(F.col(a)), F.lit(1))
    n_common = len(COMMON["en"]) + 1
    means = [F.avg(share("chars", k)).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    means += [F.avg(share("common", k)).alias(f"w{k}") for k in range(n_common)]
    return long.groupBy("lang").agg(*means).select(
        F.col("lang").alias("ref_lang"), F.array(*[f"c{k}" for k in range(len(CLASSES) + 1)]).alias("ref_chars"), F.array(*[f"w{k}" for k in range(n_common)]).alias("ref_common")
    )


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram of counts from a reference of shares; null where either is missing."""
    n = F.greatest(total(counts), F.lit(1)).cast("double")
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(counts, reference, lambda c, q: part(c / n, (c / n + q) / 2) + part(q, (c / n + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(docs: DataFrame) -> DataFrame:
    """quality() with key, the hash of the text and language that a verdict rests on."""
    rows = common.stored(features(docs), "features")
    refs = references(rows)  # a row for each known language, and one
    both = rows.join(F.broadcast(refs), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    char = F.when(F.col("n_chars") >= MIN_CHARS, js_distance(F.col("chars"), F.col("ref_chars")))
    word = F.when(total(F.slice("common", 1, len(COMMON["en"]))) >= MIN_COMMON, js_distance(F.col("common"), F.col("ref_common")))
    far = F.coalesce(F.col("char_distance") > MAX_CHARS, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORDS, F.lit(False))
    return both.withColumn("char_distance", char).withColumn("word_distance", word).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame) -> DataFrame:
    """Judge docs (doc_id, text, lang).

    Result, a row for each row of docs: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance (null
    where there are too few characters, or no known language), kept. Null texts are empty; texts
    without words fail the base rule. A null or unknown language is compared with
    all such documents by characters alone. Rows repeat as often as in docs; an
    empty table gives no rows; other columns of docs are ignored.
    """
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs (text, lang and any other columns) less the rows that are judged bad; equal texts of a language share a verdict."""
    if "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    return common.without(docs, judged(docs).where("NOT kept"), {"doc_id": F.col("doc_id").cast("long"), "key": F.xxhash64("text", "lang")})


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir, "doc_id", "text", "lang"))
