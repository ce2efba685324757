"""Quality rules: divergence of a document's characters and common words from its language's reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, SPACES, cut, spread_join

LEAST_WORDS = 50
#: A histogram of fewer words or characters than its guard is not held against the reference.
LEAST_WORDS_COMMON, LEAST_CHARS = 100, 200
#: Distances (square roots of base-2 divergences) beyond which a document goes.
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.27
#: The most common words of some languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
#: Common words of a language; one that is not listed gets its own from this many documents on.
N_COMMON, LEAST_DOCS = 12, 50
#: Languages up to which their tables are broadcast; beyond, rows of a language meet copies of its row.
BROADCAST_LANGS = 50_000
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "beyond")
#: Positions take this many bits of a sort key; the rest is the window's hash.
_BITS = 30


def add_repeated_words(df: DataFrame, h: str) -> DataFrame:
    """Adds n_repeat_words: how many words lie in 3-word windows that stand twice or more; h: a 64-bit hash of each
    window, in order.

    Hash and position are packed into one long, so that the sort is one of primitives. Neighbours with equal high bits
    are candidates; these are sorted again by their whole hashes, and equal neighbours are repeated windows. Each step
    is a column of its own, since a lambda evaluates what it refers to once for each element."""
    low = F.lit((1 << _BITS) - 1).cast("long")
    high = F.lit(-(1 << _BITS)).cast("long")
    packed = F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long")))
    df = df.withColumn("_o", F.sort_array(packed))

    def equal(a: Column, b: Column) -> Column:
        return F.shiftright(a.bitwiseXOR(b), _BITS) == 0

    near = F.filter("_o", lambda x, i: F.coalesce(equal(F.get("_o", i - 1), x), F.lit(False)) | F.coalesce(equal(F.get("_o", i + 1), x), F.lit(False)))
    df = df.withColumn("_near", near)
    full = F.transform("_near", lambda x: F.struct(F.get(h, x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).alias("at")))
    df = df.withColumn("_full", F.array_sort(full))
    same = F.filter("_full", lambda x, i: F.coalesce(F.get("_full", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_full", i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(same, lambda x: x["at"]))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(at, start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(x - acc["last"], F.lit(3).cast("long"))).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", total).drop("_o", "_near", "_full")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, the character-class histogram and the common-word histogram of each text; the lower-cased
    words as other_words where the language is named but not listed, whose common words are yet to be found."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.columns
    df = docs.withColumn("_t", t)
    words = F.filter(F.split("_t", SPACES), lambda w: w != "")
    df = df.withColumn("_words", words)
    w, n = F.col("_words"), F.size("_words")
    windows = F.when(n >= 3, F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("_h", F.coalesce(windows, F.array().cast("array<bigint>")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(SPACE_WORD))
    # most characters are a-z and blanks: what is left without them is short, and is counted class by class
    rare = F.regexp_replace("_t", "[a-z ]+", "")
    df = df.select(*own, n.cast("long").alias("n_words"), "_words", "_h", F.length("_t").cast("long").alias("_len"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), lines.alias("_lines"), rare.alias("_r"))
    df = add_repeated_words(df, "_h")
    r = F.col("_r")
    rest = {"upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()\-]", "symbol": r"[\x21-\x7E&&[^A-Za-z0-9.,;:!?'\"()\-]]", "beyond": r"[^\x09-\x0D\x20-\x7E]"}
    df = df.withColumn("_c", F.struct(*[_count(r, p).alias(x) for x, p in rest.items()]))
    df = df.withColumn("n_symbols", _count(r, r"[#*$%&|<>]"))
    found = F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        found = F.when(F.col("lang") == lang, F.filter("_words", _is_one_of(common))).otherwise(found)
    df = df.withColumn("_found", F.transform(found, lambda x: F.lower(x)))
    by_lang = F.lit(None).cast("array<bigint>")
    for lang, common in COMMON_WORDS.items():
        by_lang = F.when(F.col("lang") == lang, F.array(*[F.size(F.filter("_found", _is(x))).cast("long") for x in common])).otherwise(by_lang)
    df = df.withColumn("other_words", F.when(~F.col("lang").isin(*COMMON_WORDS), F.transform("_words", lambda x: F.lower(x))))
    c = F.col("_c")
    lower = F.col("word_chars") - sum((c[x] for x in rest), F.lit(0))
    counts = {"lower": lower, "space": F.col("_len") - F.col("word_chars")} | {x: c[x] for x in rest}
    dup_lines = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    return df.select(*own, "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), "n_repeat_words", F.array(*[counts[x] for x in CLASSES]).alias("chars"), by_lang.alias("common"), "other_words")


def common_words(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """_named, _top: the N_COMMON words that most documents of a language hold, among those that pass the base rules, for
    languages that are not listed. Counting documents, not places, keeps a long text from making its words common. Counts
    are partial before their shuffle, and so is the choice of the first."""
    good = measured.where("other_words is not null and not base_failed")
    enough = good.groupBy(F.col("lang").alias("_named")).count().where(F.col("count") >= least_docs).select("_named")
    counts = good.select("lang", F.explode(F.array_distinct("other_words")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counts.withColumn("place", place).where(F.col("place") <= N_COMMON).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("first"))
    return enough.join(first, F.col("_named") == F.col("lang")).select("_named", F.col("first.word").alias("_top"))


def _is_one_of(words: tuple[str, ...]):
    return lambda w: F.lower(w).isin(*words)


def _is(word: str):
    return lambda w: w == word


def _is_at(i: int):
    return lambda w: w == F.get("_top", F.lit(i))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / F.greatest(total, F.lit(1.0))).otherwise(0.0))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length that sum to 1; null if one is null."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / F.greatest(a + b, F.lit(1e-300)))).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.when(both.isNotNull(), F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def judge(measured: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept to measured rows.

    The reference of a language is the sum of the histograms of its documents that pass the base rules: a table of as
    many rows as there are languages, summed with map-side partial sums. Languages that are not listed get common words
    of their own. A distance is null below its length guard, or without common words (a null language, or one of fewer
    than LEAST_DOCS documents that pass); then it decides nothing. A null language is one of its own."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    other = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = measured.withColumn("base_failed", failed)
    if not rows.where("other_words is not null").isEmpty():
        rows = spread_join(rows, cut(common_words(rows)), [("lang", "_named")], "left", BROADCAST_LANGS)
        rows = rows.withColumn("_own", F.filter("other_words", lambda w: F.array_contains("_top", w)))
        places = F.array(*[F.size(F.filter("_own", _is_at(i))).cast("long") for i in range(N_COMMON)])
        rows = rows.withColumn("common", F.coalesce("common", F.when(F.col("_top").isNotNull(), places))).drop("_named", "_top", "_own")
    rows = rows.drop("other_words").withColumn("_w", F.when(F.col("common").isNotNull(), F.concat("common", F.array(other))))
    width = N_COMMON + 1
    good = rows.where("not base_failed").groupBy(F.col("lang").alias("_lang"))
    sums = good.agg(*[F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))], *[F.sum(F.get("_w", F.lit(i))).alias(f"w{i}") for i in range(width)])
    reference = sums.select("_lang", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("_rc"), F.when(F.col("w0").isNotNull(), F.array(*[f"w{i}" for i in range(width)])).alias("_rw"))
    rows = spread_join(rows, cut(reference), [("lang", "_lang")], "left", BROADCAST_LANGS)
    by_chars = F.when(F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x) >= LEAST_CHARS, _distance(_shares(F.col("chars")), _shares(F.col("_rc"))))
    by_words = F.when(F.col("n_words") >= LEAST_WORDS_COMMON, _distance(_shares(F.col("_w")), _shares(F.col("_rw"))))
    rows = rows.withColumn("char_distance", by_chars).withColumn("word_distance", by_words)
    verdict = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return rows.withColumn("kept", verdict).drop("_w", "_lang", "_rc", "_rw")


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, lang and all measures, verdicts and distances of each row. Null text counts as empty and fails; empty
    and repeated rows are judged like any other; other columns are ignored, so clashing names do no harm."""
    return judge(cut(measure(docs.select("doc_id", "lang", "text")).drop("text")), **limits)


