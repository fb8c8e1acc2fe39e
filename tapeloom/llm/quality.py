"""Quality rules: base counts, and the divergence of a document's histograms from references of each language.

Two histograms are taken: characters by class, and the common words of all languages with one cell for every other
word. References are the sums of these histograms over all documents of a language. A document is compared with each
language by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1), and stays if both distances are
within their limits for one language. Short documents have histograms that mean little: from ``sure_words`` words down
to ``min_words`` the limit of the word histogram widens evenly to ``short_word_limit``, below that it is not asked, and
below ``min_chars`` characters neither is.

Everything is made of Spark SQL expressions on one pass over the texts; what is kept of a text is a few counts and
the counts of the common words in it. A null text has no words and fails the base rule; a null or other language does
not matter, as every document is compared with all references; with no reference at all the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import prepare, shared_folder, stored

# Common words of each language, lower case.
COMMON_WORDS = {
    "de": "als an auch auf das dem den der des die ein eine er es für im in ist mit nicht sich und von zu".split(),
    "en": "an and are as at be but by for from have in is it not of on or that the this to was with".split(),
    "es": "al como con de del el en es la las lo los más no o para por que se su un una y".split(),
    "fr": "au avec ce dans de des du en est et il la le les ne par pas pour que qui sur un une à".split(),
}

#: Character classes in the order in which they are taken out of a text; what is left is ``other``.
CLASSES = {
    "lower": "[a-z]+",
    "space": r"[ \x09-\x0D]+",
    "upper": "[A-Z]+",
    "letter": r"\p{L}+",
    "digit": r"\p{N}+",
    "mark": r"[.,;:!?'\"()\-]+",
}
SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[ \x09-\x0D]+"

MIN_WORDS, SURE_WORDS, MIN_CHARS = 40, 120, 200
#: A text without common words is 0.323 to 0.326 from the nearest reference of the given tables.
CHAR_LIMIT, WORD_LIMIT, SHORT_WORD_LIMIT = 0.30, 0.28, 0.32


def word_table(words: Iterable[str]) -> tuple[int, list[int], list[int]]:
    """A modulus that tells the words' hashes apart, and by remainder each word's hash and number."""
    hashes = [(xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) for w in words]
    modulus = 4 * len(hashes)
    while len({h % modulus for h in hashes}) < len(hashes):
        modulus += 1
    keys, numbers = [0] * modulus, [-1] * modulus
    for k, h in enumerate(hashes):
        keys[h % modulus], numbers[h % modulus] = h, k
    return modulus, keys, numbers


def longs(values: Iterable[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v != -(1 << 63) else f"({v + 1}L - 1L)" for v in values) + ")"


def doubles(values: Iterable[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


#: Hashes of the words in 5-word windows (interpreted lambdas: each is bound once by a one-element array).
WINDOWS = (
    "transform(array(word_hashes), w -> if(size(w) < 5, cast(array() as array<bigint>), "
    "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))))[0]"
)

#: Words in windows found more than once: equal windows meet in the sorted array, then the union of their spans is measured.
REPEATED = (
    "aggregate(transform(array(sort_array(transform(windows, (v, p) -> struct(v, p)))), s -> sort_array(filter("
    "transform(sequence(0, size(s) - 1), j -> if(coalesce(get(s, j - 1).v = get(s, j).v, false) or coalesce(get(s, j + 1).v = get(s, j).v, false), get(s, j).p, -1)), "
    "p -> p >= 0)))[0], struct(0L as n, -5 as last), (a, p) -> struct(a.n + least(5, p - a.last) as n, p as last), a -> a.n)"
)

#: Runs of equal numbers in a sorted array: (number, count).
RUNS = (
    "transform(array(sort_array(filter({ids}, i -> i >= 0))), s -> transform(array(filter(transform(s, (x, j) -> if(x <=> get(s, j + 1), -1, j)), j -> j >= 0)), "
    "e -> transform(e, (j, k) -> struct(get(s, j) as id, j - coalesce(get(e, k - 1), -1) as n))))[0][0]"
)


def features(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, characters of each class, and the counts of the common words."""
    vocabulary = sorted({w for words in common.values() for w in words})
    modulus, keys, numbers = word_table(vocabulary)
    blanks = "' \t\n\x0b\f\r'"
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("row_key"))
    rows = rows.withColumn("inner", F.expr(f"trim(BOTH {blanks} FROM text)"))
    rows = rows.withColumn("words", F.when(F.col("inner") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("inner", BLANK))).drop("inner")
    rows = rows.withColumn("word_hashes", F.expr("transform(words, w -> xxhash64(w))"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).drop("words")
    rows = rows.withColumn("windows", F.expr(WINDOWS))
    rows = rows.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(F.expr(REPEATED))).drop("windows")
    ids = f"transform(word_hashes, h -> if(get({longs(keys)}, cast(pmod(h, {modulus}L) as int)) = h, get({longs(numbers)}, cast(pmod(h, {modulus}L) as int)), -1L))"
    rows = rows.withColumn("common", F.expr(RUNS.format(ids=ids))).drop("word_hashes")
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    for name, pattern in CLASSES.items():
        rows = rows.withColumn("rest", F.regexp_replace("text", pattern, ""))
        rows = rows.withColumn(name, (F.char_length("text") - F.char_length("rest")).cast("long")).withColumn("text", F.col("rest"))
    rows = rows.withColumn("n_symbols", (F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"))
    rows = rows.withColumn("other", F.char_length("text").cast("long"))
    return rows.select("doc_id", "row_key", "lang", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", *CLASSES, "other", "common")


def references(found: DataFrame, common: dict[str, list[str]]) -> dict[str, tuple[list[float], list[float]]]:
    """For each language that has common words and documents: shares of character classes, and of its common words
    and all others. At most one row of sums for each of these languages, and each of their words, comes to the driver."""
    names = [*CLASSES, "other"]
    vocabulary = sorted({w for words in common.values() for w in words})
    known = found.where(F.col("lang").isin(list(common)))
    sums = {r["lang"]: r for r in known.groupBy("lang").agg(*(F.sum(c).alias(c) for c in (*names, "n_words"))).collect()}
    counts: dict[str, list[int]] = {lang: [0] * len(vocabulary) for lang in sums}
    for r in known.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.id").agg(F.sum("c.n").alias("n")).collect():
        counts[r["lang"]][r["id"]] = r["n"]
    out = {}
    for lang in sorted(sums):
        chars, words = sum(sums[lang][c] for c in names), sums[lang]["n_words"]
        if chars and words:
            out[lang] = ([sums[lang][c] / chars for c in names], [*(n / words for n in counts[lang]), 1 - sum(counts[lang]) / words])
    return out


def term(p: str, q: str) -> str:
    """p's and q's part of twice the divergence, in bits."""
    return f"(if({p} > 0, {p} * log2(2 * {p} / ({p} + {q})), 0D) + if({q} > 0, {q} * log2(2 * {q} / ({p} + {q})), 0D))"


def char_distance(shares: list[float]) -> Column:
    names = [*CLASSES, "other"]
    parts = " + ".join(term(f"({c} / n_chars)", f"{q!r}D") for c, q in zip(names, shares, strict=True))
    return F.expr(f"sqrt(greatest(0D, ({parts}) / 2))")


def word_distance(shares: list[float]) -> Column:
    """Words that the document lacks have their own share as their part of the sum."""
    *words, others = shares
    seen = f"aggregate(common, struct(0D as d, 0D as q, 0D as p), (a, c) -> transform(array(struct(c.n / n_words as p, get({doubles(words)}, cast(c.id as int)) as q)), x -> struct(a.d + {term('x.p', 'x.q')} as d, a.q + x.q as q, a.p + x.p as p))[0])"
    rest = f"transform(array({seen}), s -> s.d + greatest(0D, {sum(words)!r}D - s.q) + {term('greatest(0D, 1 - s.p)', f'{others!r}D')})[0]"
    return F.expr(f"sqrt(greatest(0D, ({rest}) / 2))")


def score(found: DataFrame, refs: dict[str, tuple[list[float], list[float]]], min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, sure_words: int = SURE_WORDS, short_word_limit: float = SHORT_WORD_LIMIT) -> DataFrame:
    """The base rule, the distances to each language, and the verdict."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = found.withColumn("base_failed", failed)
    has = F.col("n_words") > 0
    for lang, (chars, words) in refs.items():
        out = out.withColumn(f"char_{lang}", F.when(has, char_distance(chars))).withColumn(f"word_{lang}", F.when(has, word_distance(words)))
    missing = F.greatest(F.lit(0), sure_words - F.col("n_words")) / max(1, sure_words - min_words)
    within = word_limit + (short_word_limit - word_limit) * missing
    near = F.lit(not refs)
    for lang in refs:
        near = near | ((F.col(f"char_{lang}") <= char_limit) & ((F.col("n_words") < min_words) | (F.col(f"word_{lang}") <= within)))
    fits = (F.col("n_chars") < min_chars) | near
    return out.withColumn("kept", ~F.col("base_failed") & fits)


def judge(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, **limits: float) -> DataFrame:
    """doc_id, row_key, the base counts, base_failed, kept, and the distances; the columns read are doc_id, text and lang."""
    spark = prepare(docs.sparkSession)
    found = stored(features(docs, common), shared_folder(spark), "features")
    return score(found, references(found, common), **limits)


def quality_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
