"""Line-first quality rules in column expressions.

Every line is judged by itself: bars and symbols of navigation and markup, shouting, phrases of boilerplate in a list
that is a parameter, and many words in which no clause ends. Rows of short lines in which no clause ends are
navigation too. Failing lines are removed, and a text that loses too large a part of its characters is rejected. The
base rules on word counts and repetition reject as well. Everything is an array expression over one row, so nothing is
exploded or shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import fence

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Base rules: least number of words, and the largest percentage of words in repeated 3-word windows.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: A text is rejected if it keeps less than this percentage of its characters.
KEPT_PERCENT = 70

# Phrases that mark a line of boilerplate, looked for in lower case; English, French, German, Spanish.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "lorem ipsum", "enable javascript", "use cookies", "click here", "sign up for our newsletter", "skip to content",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "conditions générales",
    "utilise des cookies", "cliquez ici", "abonnez-vous", "aller au contenu", "activer javascript",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "verwendet cookies", "hier klicken",
    "newsletter abonnieren", "zum inhalt springen", "javascript aktivieren", "allgemeine geschäftsbedingungen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos y condiciones", "aviso legal",
    "utiliza cookies", "haga clic aquí", "suscríbete", "saltar al contenido", "habilite javascript",
)
#: A line with this share of symbols (percent of its characters), or of words next to bars, is navigation or markup.
SYMBOL_PERCENT, BAR_PERCENT = 10, 20
#: A line that shouts: so many exclamation marks (percent of its words) without a lower-case letter.
SHOUT_PERCENT = 50
#: A line of so many words without any mark that ends a clause is no prose.
UNPUNCTUATED_WORDS = 40
CLAUSE_END = r"[.!?…。！？,;:]"
#: Navigation: so many lines in a row, each of at most so many words, in which no clause ends.
LINK_LINES, LINK_WORDS = 3, 3
LINK = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}[\x20\x09-\x0D]*$" % (LINK_WORDS - 1)
#: A character without which no rule on marks can fail a line.
ANY_MARK = r"[|»›#*$%&<>!]"

#: Bits of a window's place in the numbers by which windows that may repeat are found.
PLACE_BITS = 31

_STAYS, _FAILS, _LINK = 0, 1, 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _marked(line: Column) -> Column:
    """Whether a line is navigation between bars, markup, or shouting."""
    size, n_words = F.length(line), F.size(F.split(F.trim(line), WORD_GAP))
    return line.rlike(ANY_MARK) & (
        (_count_of(line, r"[|»›]") * 100 > n_words * BAR_PERCENT)
        | (_count_of(line, SYMBOLS) * 100 > size * SYMBOL_PERCENT)
        | ((_count_of(line, "!") * 100 >= n_words * SHOUT_PERCENT) & (line == F.upper(line)) & (F.lower(line) != line))
    )


def _any_of(low: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(x) for x in phrases), F.lit(False))


def line_codes(lines: Column, has_mark: Column, has_phrase: Column, phrases: tuple[str, ...]) -> Column:
    """For each line whether it stays, fails by itself, or fails in a row of links.

    has_mark and has_phrase say whether any line can fail by the marks and by the phrases at all.
    """
    def code(line: Column) -> Column:
        fails = (
            (has_mark & _marked(line))
            | (has_phrase & _any_of(F.lower(line), phrases))
            | (~line.rlike(CLAUSE_END) & (F.length(line) >= 2 * UNPUNCTUATED_WORDS - 1) & (F.size(F.split(F.trim(line), WORD_GAP)) >= UNPUNCTUATED_WORDS))
        )
        return F.when(fails, _FAILS).when(~line.rlike(CLAUSE_END) & line.rlike(LINK), _LINK).otherwise(_STAYS)

    return F.transform(lines, code)


def _in_row(codes: Column, i: Column) -> Column:
    """Whether place i lies in a row of LINK_LINES links or more."""
    def link(j: Column) -> Column:
        return F.coalesce(F.get(codes, j) == _LINK, F.lit(False))

    rows = (reduce(lambda a, b: a & b, (link(i - back + k) for k in range(LINK_LINES))) for back in range(LINK_LINES))
    return reduce(lambda a, b: a | b, rows)


def quality_signals(docs: DataFrame) -> DataFrame:
    """docs (text string) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A text whose windows all have different hashes repeats none. Else windows that share some bits of their hashes
    with others are sorted by hash, words and place, so that equal ones are neighbours in texts of any length, and each
    of their places covers 3 words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words, hashes, keys, places = (F.col(c) for c in ("_words", "_hashes", "_keys", "_places"))
    step = docs.withColumn("_words", words_of(F.col("text")))
    step = fence(step).withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))

    def hash_at(h: Column, i: Column) -> Column:
        return F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))

    step = fence(step).withColumn("_windows", F.slice(F.transform(hashes, hash_at), F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))))
    step = fence(step)
    packed = F.sort_array(F.transform("_windows", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))
    step = step.withColumn("_packed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), packed))

    def near(k: Column, i: Column) -> Column:
        other = F.shiftright(F.get(F.col("_packed"), i), PLACE_BITS)
        return F.coalesce(F.shiftright(k, PLACE_BITS) == other, F.lit(False))

    may = F.filter("_packed", lambda k, i: near(k, i + 1) | near(k, i - 1))
    step = fence(step).withColumn("_may", F.transform(may, lambda k: k.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")))
    keyed = F.transform("_may", lambda p: F.struct(F.get(F.col("_windows"), p).alias("h"), F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("i")))
    step = fence(step).withColumn("_keys", F.sort_array(keyed))

    def equal(k: Column, other: Column) -> Column:
        same = (k["h"] == other["h"]) & (k["a"] == other["a"]) & (k["b"] == other["b"]) & (k["c"] == other["c"])
        return F.coalesce(same, F.lit(False))

    again = F.filter(keys, lambda k, i: equal(k, F.get(keys, i + 1)) | equal(k, F.get(keys, i - 1)))
    step = fence(step).withColumn("_places", F.sort_array(F.transform(again, lambda k: k["i"])))
    covers = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    step = fence(step).select(
        *docs.columns,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return fence(step).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT))


def clean_lines(docs: DataFrame, phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """docs with clean_text, the lines of text that no rule removes, and loses_too_much."""
    text, lines, codes = F.coalesce(F.col("text"), F.lit("")), F.col("_lines"), F.col("_codes")
    out = docs.withColumn("_mark", text.rlike(ANY_MARK)).withColumn("_low", F.lower(text)).withColumn("_lines", F.split(text, "\n"))
    out = fence(out).withColumn("_phrase", _any_of(F.col("_low"), phrases))
    out = fence(out).withColumn("_codes", line_codes(lines, F.col("_mark"), F.col("_phrase"), phrases))
    out = fence(out)
    left = F.filter(lines, lambda x, i: (F.get(codes, i) == _STAYS) | (F.get(codes, i) == _LINK) & ~_in_row(codes, i))
    out = out.withColumn("clean_text", F.when(F.exists(codes, lambda c: c != _STAYS), F.array_join(left, "\n")).otherwise(text))
    out = fence(out.drop("_mark", "_low", "_lines", "_phrase", "_codes"))
    return out.withColumn("loses_too_much", F.length("clean_text") * 100 < F.length(text) * KEPT_PERCENT)


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    docs: doc_id long, text string. Words are runs without space and \\t..\\r. A null text is like an empty one: no
    words, so it fails the base rules. kept is false for base failures and for texts that lose more than
    100 - KEPT_PERCENT percent of their characters to the line rules. Repeated rows stay, other columns are ignored,
    an empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    judged = quality_signals(clean_lines(docs).drop("clean_text"))
    signals = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*signals, (~F.col("base_failed") & ~F.col("loses_too_much")).alias("kept"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_quality keeps, with their failing lines removed; all other columns as they are.

    A column n_chars, if there is one, is the length of the text that is left.
    """
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    kept = quality_signals(clean_lines(plain)).where(~F.col("base_failed") & ~F.col("loses_too_much"))
    new = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
