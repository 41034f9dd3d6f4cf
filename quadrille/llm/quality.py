"""Quality rules, lines first (operator 10); DataFrame functions only, and no shuffle.

Every line is judged alone by punctuation, navigation, shouting, repetition and boilerplate rules. Failing
lines are removed, and a document that loses too many of its words with them is rejected. Beside that stand
the base statistics: repeated three-word windows, repeated lines, symbols, and the length in words.

All of it happens within a row. Word arrays are bound once by ``let`` so that no lambda splits a text again.
Repeated windows are looked for by 64-bit hashes first; only a text whose hashes repeat sorts its windows
themselves, so the count is exact and the common case is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
PHRASES = (
    "licensed under", "all rights reserved", "cookie policy", "cookie settings", "cookie notice", "privacy policy",
    "terms of use", "terms of service", "javascript", "lorem ipsum", "subscribe to our", "sign up for", "click here", "copyright",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "tous droits réservés", "politique de confidentialité",
    "conditions d'utilisation", "todos los derechos reservados", "política de privacidad", "términos y condiciones",
)
MENU_MARKS = "[|»›>•·/]"
MENU = "(?<![^\\s])[|»›>•·/]+(?![^\\s])"
# greedy from the start, so the search begins at the end of the line
ENDED = "(?s)^.*[.!?…。！？:;][\"'”’»)\\]*\\s]*$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeated(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""
    n = F.size(words)
    none = F.lit(0).cast("long")

    def window(i):
        return F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)

    def by_hash(hashes: Column) -> Column:
        # a hash's high bits with the place below them: sorting longs brings equal windows together
        low = F.length(F.bin(n))
        high = F.call_function("shiftleft", F.lit(-1).cast("long"), low)
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def near(rows: Column) -> Column:
            def same(x, y):
                return F.call_function("shiftrightunsigned", x.bitwiseXOR(y), low) == 0

            close = F.filter(
                rows,
                lambda x, k: F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False))
                | F.coalesce(same(x, F.get(rows, k - 1)), F.lit(False)),
            )
            return let(F.transform(close, lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")), exact)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(packed, near))

    def exact(places: Column) -> Column:
        named = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            found = F.filter(
                rows,
                lambda r, k: F.coalesce(r["w"] == F.get(rows, k + 1)["w"], F.lit(False))
                | F.coalesce(r["w"] == F.get(rows, k - 1)["w"], F.lit(False)),
            )
            return let(F.sort_array(F.transform(found, lambda r: r["i"])), covered)

        return let(named, twice)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(at, k - 1), F.lit(3))))
        return F.aggregate(gaps, none, lambda a, x: a + x)

    hashes = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, none).otherwise(let(hashes, by_hash))


def has_phrase(text: Column) -> Column:
    """Whether a known phrase occurs in the text, in letters of any case."""

    def among(low: Column) -> Column:
        found = F.lit(False)
        for p in PHRASES:
            found = found | F.contains(low, F.lit(p))
        return found

    return let(F.lower(text), among)


def line_fails(line: Column, words: Column, marks: Column) -> Column:
    """Whether a line with words breaks a rule. ``marks`` tells what its document contains at all.

    - punctuation: a short line must end a sentence;
    - navigation: a quarter of its words are menu separators;
    - symbols: one in three words, or more, carries a symbol;
    - shouting: capitals only;
    - repetition: fewer than a quarter of its words are different;
    - boilerplate: it holds one of the known phrases.
    """
    n = F.size(words)
    return (
        ((n < 10) & ~F.rlike(line, F.lit(ENDED)))
        | (marks["menu"] & (F.regexp_count(line, F.lit(MENU)) * 4 > n))
        | (marks["symbols"] & (F.regexp_count(line, F.lit(SYMBOLS)) * 3 > n))
        | ((n >= 8) & (F.size(F.array_distinct(words)) * 4 < n))
        | ((n >= 3) & (F.upper(line) == line) & (F.lower(line) != line))
        | (marks["phrase"] & has_phrase(line))
    )


def quality(
    docs: DataFrame,
    min_words: int = 50,
    max_repeated_percent: int = 50,
    max_lost_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
    base_failed and kept.

    A null or blank text has no words and fails the base rule. Repeated rows get equal results. Columns of
    ``docs`` with those names are replaced. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(lines: Column) -> Column:
        return let(F.flatten(F.transform(lines, lambda x: x["words"])), lambda words: figures(lines, words))

    def figures(lines: Column, words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            _repeated(words).alias("n_repeat_words"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
            F.aggregate(F.filter(lines, lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])).alias("n_lost_words"),
        )

    def by_line(marks: Column) -> Column:
        def one(line: Column) -> Column:
            return let(
                words_of(line),
                lambda w: F.struct(line.alias("line"), w.alias("words"), ((F.size(w) > 0) & line_fails(line, w, marks)).alias("fails")),
            )

        return let(F.filter(F.transform(F.split(text, "\n"), one), lambda x: F.size(x["words"]) > 0), judged)

    marks = F.struct(
        F.rlike(text, F.lit(MENU_MARKS)).alias("menu"), F.rlike(text, F.lit(SYMBOLS)).alias("symbols"), has_phrase(text).alias("phrase")
    )
    columns = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(
        *[F.col(c) for c in columns],
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(marks, by_line).alias("_found"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    return (
        rows.select(*columns, "n_symbols", "_found.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("n_lost_words") <= max_lost_percent * F.col("n_words")))
    )


RESULT = {"clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"}


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id and the figures and verdicts of ``quality``."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **{**options, "id_col": "doc_id", "text_col": "text"})
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words",
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )
