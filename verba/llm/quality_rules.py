"""Quality rules by distribution divergence from language references, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verba.llm.common import written
from verba.llm.textstats import SPACES, SYMBOLS, lines_of, neighbours, repeats_in, without, words_of

# Common function words by language (fixed values); other languages' common words are counted.
COMMON = {
    "de": ["das", "dem", "den", "der", "des", "die", "ein", "einer", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von",
           "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
           "was", "with"],
    "es": ["al", "con", "de", "del", "el", "en", "la", "las", "lo", "los", "para", "por", "que", "se", "un", "una", "y"],
    "fr": ["au", "dans", "de", "des", "du", "elle", "en", "et", "il", "la", "le", "les", "par", "pour", "que", "qui", "un", "une"],
}
WORDS = sorted(set().union(*COMMON.values()))
# Character classes: upper and lower case letters, digits, white space, symbols, sentence marks; the rest last.
LOWER, SPACE = r"\p{Ll}", r"[\x20\x09-\x0D]"
CLASSES = [r"\p{Lu}", LOWER, r"\p{Nd}", SPACE, r"[#*$%&|<>=@^~_\\/{}\[\]+]", r"[.,;:!?'\"()-]"]
ENDS = ".,;:!?،؛؟।॥…\"'()[]«»“”"  # signs around a word, where words are counted
N_COMMON, REF_DOCS = 20, 30  # counted words of a language; documents that make it a reference
WINDOW = 8  # words of a repeated passage
MIN_WORDS, MAX_REPEATED = 20, 30  # base rules: words; per cent of words in repeated passages
GUARD = 50  # shorter documents are not compared: their histograms say too little
CLASS_LIMIT, WORD_LIMIT, SLACK = 0.15, 0.34, 1.0  # distance allowed: limit + slack / sqrt(words)


def _repeat_words(df: DataFrame) -> DataFrame:
    """w (array of words) -> n_repeat_words: words in WINDOW-word windows found twice or more in w."""
    # hashes of 2, 4 and 8 neighbouring words, each from two of the one before
    def doubled(c, k):
        return neighbours(F.col(c), lambda a, b: F.xxhash64(a, b), k)

    df = df.withColumn("_h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("_h", doubled("_h", 1)).withColumn("_h", doubled("_h", 2))
    # a window found again has WINDOW - 3 runs of four words that were there before
    some = F.size("_h") - F.size(F.array_distinct("_h")) >= WINDOW - 3
    df = df.withColumn("_h", F.when(some, F.col("_h"))).withColumn("_g", doubled("_h", 4))
    by_hash = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), by_hash))
    none = F.expr("cast(array() as array<int>)")
    pairs = neighbours(F.col("_s"), lambda x, y: F.when(x["g"] == y["g"], F.array(x["p"], y["p"])).otherwise(none))
    df = df.withColumn("_d", F.array_sort(F.array_distinct(F.flatten(pairs))))
    # a repeated window adds its words up to where the next one begins
    step = F.when(F.size("_d") > 0, F.array_append(neighbours(F.col("_d"), lambda p, q: F.least(F.lit(WINDOW), q - p)), F.lit(WINDOW)))
    total = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0))).drop("_h", "_g", "_s", "_d")


def _counted(word):
    return F.lower(F.btrim(word, F.lit(ENDS)))


def _equal(k: int):
    return lambda x: x == k


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame | None:
    """(_lang, _own): the N_COMMON words of greatest mean share in a document, for each language outside COMMON
    with REF_DOCS documents of MIN_WORDS words; None if no language has as many. Each document weighs the same."""
    other = docs.select(docs[f"`{lang_col}`"].cast("string").alias("_lang"), docs[f"`{text_col}`"].alias("_t")) \
        .where(F.col("_lang").isNotNull() & ~F.col("_lang").isin(*COMMON))
    if other.groupBy("_lang").count().where(F.col("count") >= REF_DOCS).isEmpty():  # reads languages alone
        return None
    w = other.select("_lang", words_of(F.coalesce("_t", F.lit(""))).alias("w")).where(F.size("w") >= MIN_WORDS)
    one = w.select("_lang", (F.lit(10 ** 12) / F.size("w")).cast("long").alias("_p"), F.posexplode("w").alias("_k", "x"))
    words = one.groupBy("_lang", _counted(F.col("x")).alias("x")).agg(F.sum("_p").alias("_p"), F.count_if(F.col("_k") == 0).alias("_first"))
    words = written(words, "words")
    many = words.groupBy("_lang").agg(F.sum("_first").alias("_n")).where(F.col("_n") >= REF_DOCS)
    best = words.where(F.col("x").rlike(r"\p{L}")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_p"), "x"))).where(F.col("_r") <= N_COMMON)
    lists = best.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_r", "x"))).alias("_l"))
    return written(lists.join(many, "_lang", "left_semi").select("_lang", F.transform("_l", lambda r: r["x"]).alias("_own")), "common")


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, lists: DataFrame | None = None) -> DataFrame:
    """One row per input row: the id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    classes and common (counts by CLASSES and the rest, by WORDS and the rest); with ``lists`` of
    common_words() also own, the counts by the words of the language's list and the rest, or null."""
    df = docs.select(docs[f"`{id_col}`"].alias("_id"), docs[f"`{lang_col}`"].cast("string").alias("_lang"),
                     F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("_t"))
    own = []
    if lists is not None:
        own = ["own"]
        df = df.join(lists, "_lang", "left")
        # where each word stands in the list, 0 for the rest
        df = df.withColumn("_at", F.when(F.col("_own").isNotNull(), F.transform(words_of(F.col("_t")), lambda x: F.array_position(F.col("_own"), _counted(x)))))
        at = [F.size(F.filter("_at", _equal(k))).cast("long") for k in [*range(1, N_COMMON + 1), 0]]
        df = df.withColumn("own", F.when(F.col("_at").isNotNull(), F.array(*at))).drop("_own", "_at")
    t = F.col("_t")
    df = df.withColumn("w", words_of(t)).withColumn("_len", F.char_length(t).cast("long")) \
           .withColumn("word_chars", F.char_length(without(t, SPACES)).cast("long"))
    # lower case letters come in runs and white space is what words leave: cheaper than a match for each
    parts = {c: F.regexp_count(t, F.lit(c)).cast("long") for c in CLASSES}
    parts[LOWER] = (F.col("_len") - F.char_length(F.regexp_replace(t, LOWER + "+", ""))).cast("long")
    parts[SPACE] = F.col("_len") - F.col("word_chars")
    df = df.withColumn("classes", F.array(*parts.values()))
    plain = F.filter(F.transform("w", lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))), lambda x: x.isin(WORDS))
    df = df.withColumn("_c", F.concat(F.lit(" "), F.array_join(plain, "  "), F.lit(" ")))
    size = F.char_length("_c")
    common = [((size - F.char_length(F.replace("_c", F.lit(f" {x} ")))) / (len(x) + 2)).cast("long") for x in WORDS]
    df = df.withColumn("common", F.array(*common))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select("_id", "_lang", "_t", *own, "w", F.size("w").cast("long").alias("n_words"), "word_chars",
                   F.concat("classes", F.array(F.greatest(F.col("_len") - add("classes"), F.lit(0)))).alias("classes"),
                   F.concat("common", F.array(F.greatest(F.size("w") - add("common"), F.lit(0)))).alias("common"))
    df = _repeat_words(df)
    return df.select("_id", "_lang", "n_words", "word_chars", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), repeats_in(lines_of(t)).alias("n_dup_lines"), "n_repeat_words",
                     "classes", "common", *own)


def shares(counts):
    """Counts -> shares; all zero for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), total), F.lit(0.0)))


def js_distance(p, q):
    """Square root of the Jensen-Shannon divergence in bits, of two arrays of shares."""
    part = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
                      + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.sqrt(F.greatest(F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _clean():
    return ~base_failed() & (F.col("n_dup_lines") == 0) & (F.col("n_symbols") * 20 <= F.col("n_words"))


def _sums(column: str, n: int):
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def references(table: DataFrame) -> DataFrame:
    """measures() -> one row for each language of COMMON with REF_DOCS documents that pass the base rules, repeat
    no line and have few symbols: ref (language), rc and rw (shares over all of these)."""
    ok = table.where(_clean() & F.col("_lang").isin(*COMMON))
    sums = ok.groupBy(F.col("_lang").alias("ref")).agg(
        _sums("classes", len(CLASSES) + 1).alias("c"), _sums("common", len(WORDS) + 1).alias("w"), F.count(F.lit(1)).alias("n"))
    return sums.where(F.col("n") >= REF_DOCS).select("ref", shares("c").alias("rc"), shares("w").alias("rw"))


def own_references(table: DataFrame) -> DataFrame:
    """measures() with lists -> _lang, _rc and _rw as in references(), for each language with a list and
    REF_DOCS such documents."""
    sums = table.where(_clean() & F.col("own").isNotNull()).groupBy("_lang").agg(
        _sums("classes", len(CLASSES) + 1).alias("c"), _sums("own", N_COMMON + 1).alias("w"), F.count(F.lit(1)).alias("n"))
    return sums.where(F.col("n") >= REF_DOCS).select("_lang", shares("c").alias("_rc"), shares("w").alias("_rw"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance and word_distance.

    Base rules: too few words, or too many in repeated passages. Then the shares of character classes
    and of common words are compared with the references of the document's language by Jensen-Shannon
    distance; a limit grows by SLACK / sqrt(words), as sampling alone moves short histograms. Documents
    under GUARD words are not compared. The common words of a language outside COMMON are counted
    (common_words()). A language without a reference of its own, or null, has no distances, and nothing is
    rejected by them. Null text has no words and fails. Ids may be null or repeat. Empty table: no rows.
    References come from all documents, whose measures are written once; only the references of COMMON
    reach the driver, the others are joined by language."""
    lists = common_words(docs, text_col, lang_col)
    table = written(measures(docs, id_col, text_col, lang_col, lists), "measures")
    refs = {r["ref"]: r for r in references(table).collect()}  # a row for each language of COMMON at most
    df = table.withColumn("_c", shares("classes")).withColumn("_w", shares("common"))
    if lists is not None:
        df = df.join(written(own_references(table), "references"), "_lang", "left").withColumn("_o", shares("own"))

    def distance(hist, part, own):
        ds = [F.when(F.col("_lang") == x, js_distance(F.col(hist), F.array(*map(F.lit, r[part])))) for x, r in sorted(refs.items())]
        if lists is not None:
            ds.append(F.when(F.col(f"_{part}").isNotNull(), js_distance(F.col(own), F.col(f"_{part}"))))
        return F.coalesce(*ds) if ds else F.lit(None).cast("double")

    df = df.withColumn("class_distance", distance("_c", "rc", "_c")).withColumn("word_distance", distance("_w", "rw", "_o"))
    slack = F.lit(SLACK) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    far = (F.col("class_distance") > F.lit(CLASS_LIMIT) + slack) | (F.col("word_distance") > F.lit(WORD_LIMIT) + slack)
    verdict = (F.col("n_words") < GUARD) | ~F.coalesce(far, F.lit(False))
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"), "class_distance", "word_distance")
