"""Line dedup by content-defined chunks of lines, in column expressions.

A rolling hash over the hashes of two neighbouring lines gives each line a value; a chunk ends after a line whose
value is a strict local minimum. Borders depend on the lines around them only, so a passage that is moved or follows
other lines is cut alike again, and minima are two lines or more apart. A line as long as a passage is a chunk of its
own. Chunks of two lines or more with a word in them, and such long lines, that occur again anywhere are found by
digest, confirmed by comparing their bytes, and removed except for the first occurrence in order of doc_id and place.

A chunk is found only if both its borders lie within what repeats. Passages of shorter lines are therefore found by
units: the shortest ranges of lines with PASSAGE_WORDS words from, and up to, every line. They need no borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, fence

#: Only chunks of so many lines count.
LEAST_LINES = 2
#: So many words are a passage. A line of as many is not joined with its neighbours and counts alone.
PASSAGE_WORDS = 50
#: A run of lines without a local minimum (equal values, or values that only rise or fall) is cut every so many lines,
#: counted from the run's own first line, so that these cuts move with the passage too.
MOST_LINES = 64
#: The kinds of ranges that are looked for.
CHUNKS, PASSAGES = "chunks", "passages"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def words_in(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def chunk_starts(values: Column, passages: Column) -> Column:
    """Places (from 0) at which a chunk starts by its lines, given each line's rolling value and whether it is a passage."""
    return F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0)
        | F.get(passages, i)
        | F.get(passages, i - 1)
        | F.coalesce((F.get(values, i - 1) < F.get(values, i - 2)) & (F.get(values, i - 1) < F.get(values, i)), F.lit(False)),
    )


def run_starts(starts: Column, n_lines: Column) -> Column:
    """starts, and every MOST_LINES-th line after a start up to the next."""
    return F.flatten(F.transform(starts, lambda s, k: F.sequence(s, F.coalesce(F.get(starts, k + 1), n_lines) - 1, F.lit(MOST_LINES))))


def _span(start: Column, n: Column) -> Column:
    """A range of lines as one long that sorts by its start."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(n.cast("long"))


def _start(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _size(span: Column) -> Column:
    return span.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _text(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, _start(span) + 1, _size(span)), "\n")


def _lengths(words: Column) -> Column:
    """For each of words (of lines that have any) how many from it on hold PASSAGE_WORDS together, 0 if all do not."""
    enough = PASSAGE_WORDS << 6  # sum and count are one long: no passage needs more than PASSAGE_WORDS lines

    def length(k: Column) -> Column:
        got = F.aggregate(F.slice(words, k + 1, PASSAGE_WORDS), F.lit(0).cast("long"), lambda a, w: F.when(a < enough, a + w.cast("long") * 64 + 1).otherwise(a))
        return F.when(got >= enough, got.bitwiseAND(F.lit(63))).otherwise(F.lit(0)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.size(words) - 1), length)


def passage_spans(docs: DataFrame) -> DataFrame:
    """docs (_words, the words of each line) with _units: the shortest ranges of PASSAGE_WORDS words from, and up to, each line.

    They begin and end at lines with words. Every range of lines that begins and ends so and has as many words is the
    union of the units within it, so units that repeat cover just the passages that repeat.
    """
    full, words, back, ahead, behind = (F.col(c) for c in ("_full", "_some", "_back", "_ahead", "_behind"))
    out = docs.withColumn("_full", F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get(F.col("_words"), i) > 0))
    out = fence(out).withColumn("_some", F.transform(full, lambda i: F.get(F.col("_words"), i)))
    out = fence(out).withColumn("_back", F.reverse(words))
    none = F.array().cast("array<int>")
    out = fence(out).withColumn("_ahead", F.when(F.size(words) > 0, _lengths(words)).otherwise(none)).withColumn("_behind", F.when(F.size(words) > 0, _lengths(back)).otherwise(none))
    out = fence(out).withColumn("_behind", F.reverse(behind))

    def between(k: Column, j: Column) -> Column:
        return _span(F.get(full, k), F.get(full, j) - F.get(full, k) + 1)

    down = F.transform(ahead, lambda n, k: F.when(n > 0, between(k, k + n - 1)))
    up = F.transform(behind, lambda n, k: F.when(n > 0, between(k - n + 1, k)))
    out = out.withColumn("_units", F.array_compact(F.array_union(down, up)))
    return fence(out).drop("_full", "_some", "_back", "_ahead", "_behind")


def with_starts(docs: DataFrame) -> DataFrame:
    """docs with _lines, their _hashes and _words, and _starts, the places at which chunks start."""
    lines, hashes, values, words, starts = (F.col(c) for c in ("_lines", "_hashes", "_values", "_words", "_starts"))
    out = docs.withColumn("_lines", lines_of(F.col("text").cast("string")))
    out = out.withColumn("_hashes", F.transform(lines, lambda x: F.xxhash64(x))).withColumn("_words", F.transform(lines, words_in))
    out = out.withColumn("_values", F.transform(hashes, lambda h, i: F.xxhash64(h, F.coalesce(F.get(hashes, i - 1), F.lit(0)))))
    out = out.withColumn("_passages", F.transform(words, lambda n: n >= PASSAGE_WORDS)).withColumn("_starts", chunk_starts(values, F.col("_passages")))
    out = fence(out).withColumn("_starts", run_starts(starts, F.size(lines)))
    return fence(out.drop("_values", "_passages"))


def _marks(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, own, span, digest) of every range of lines that counts: chunks, units of passages, or both."""
    lines, hashes, words, starts = (F.col(c) for c in ("_lines", "_hashes", "_words", "_starts"))
    out = with_starts(docs.where("doc_id IS NOT NULL").select("doc_id", "own", "text"))
    chunks = F.transform(starts, lambda s, k: _span(s, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s))
    out = fence(out.withColumn("_chunks", chunks)).withColumn(
        "_chunks", F.filter("_chunks", lambda c: (F.get(words, _start(c)) >= PASSAGE_WORDS) | (_size(c) >= LEAST_LINES) & F.exists(F.slice(words, _start(c) + 1, _size(c)), lambda n: n > 0))
    )
    if CHUNKS not in kinds:
        out = out.withColumn("_chunks", F.array().cast("array<bigint>"))
    out = fence(out)
    if PASSAGES in kinds:
        out = passage_spans(out)
    spans = F.array_union("_chunks", "_units") if PASSAGES in kinds else F.col("_chunks")
    out = fence(out.select("doc_id", "own", "_hashes", spans.alias("_spans")))
    marks = F.transform("_spans", lambda s: F.struct(s.alias("span"), F.xxhash64(F.slice(hashes, _start(s) + 1, _size(s))).alias("digest")))
    return out.select("doc_id", "own", F.explode(marks).alias("c")).select("doc_id", "own", "c.*")


#: A row is known by its doc_id and a hash of its text, so that rows that repeat an id are told apart.
ROW = ["doc_id", "own"]


def repeated_spans(docs: DataFrame, scratch: Scratch, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, own, span) of each such range of lines whose bytes occur before it, by doc_id and place, without overlap.

    Digests say which may repeat; only documents that hold such ranges are read again for their bytes. Aggregates are
    written before they are joined, so that a join can split the rows of a very common range.
    """
    marks = scratch.keep(_marks(docs, kinds))
    again = scratch.keep(marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    wanted = marks.join(again, "digest", "left_semi").groupBy(*ROW).agg(F.collect_set(F.struct("span", "digest")).alias("_wanted"))
    texts = fence(docs.join(wanted.hint("shuffle_hash"), ROW).select(*ROW, "_wanted", lines_of(F.col("text")).alias("_lines")))
    seen = texts.select(*ROW, F.explode(F.transform("_wanted", lambda w: F.struct(w["span"].alias("span"), w["digest"].alias("digest"), _text(F.col("_lines"), w["span"]).alias("text")))).alias("c"))
    seen = scratch.keep(seen.select(*ROW, "c.*"))
    # Equal bytes, not only equal digests: the text itself is the key. Minima are combined before the shuffle.
    first_doc = scratch.keep(seen.groupBy("digest", "text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = seen.join(first_doc, ["digest", "text", "doc_id"]).groupBy("digest", "text").agg(F.min(F.struct(*ROW, "span")).alias("first"))
    first = scratch.keep(first.select("digest", "text", "first.doc_id", "first.own", "first.span").toDF("digest", "text", "first_doc", "first_own", "first_span"))
    behind = _start(F.col("span")) >= _start(F.col("first_span")) + _size(F.col("first_span"))
    later = seen.join(first, ["digest", "text"]).where((F.col("doc_id") > F.col("first_doc")) | (F.col("own") != F.col("first_own")) | behind)
    out = scratch.keep(later.select(*ROW, "span").distinct())
    scratch.drop(marks, again, seen, first_doc, first)
    return out


def _removed(docs: DataFrame, scratch: Scratch, kinds: tuple[str, ...]) -> DataFrame:
    """docs (doc_id, text, ...) with _gone, the ranges of lines to remove (null for none)."""
    docs = docs.withColumn("own", F.xxhash64("text"))
    gone = repeated_spans(docs, scratch, kinds).groupBy(*ROW).agg(F.collect_list("span").alias("_gone"))
    return docs.join(gone.hint("shuffle_hash"), ROW, "left").drop("own")


def _left(lines: Column, gone: Column) -> Column:
    """Places of the lines that stay."""
    places = F.flatten(F.transform(gone, lambda s: F.sequence(_start(s), _start(s) + _size(s) - 1)))
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(places, F.array().cast("array<int>")))


def _joined(lines: Column, left: Column) -> Column:
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def _dedup(docs: DataFrame, scratch: Scratch, kinds: tuple[str, ...]) -> DataFrame:
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("_row"))
    out = fence(_removed(held, scratch, kinds).withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines_of(F.col("text")))))
    out = fence(out.withColumn("_left", _left(F.col("_lines"), F.col("_gone"))))
    text = F.when(F.col("text").isNull() | F.col("_gone").isNull(), F.col("text")).otherwise(_joined(F.col("_lines"), F.col("_left")))
    out = fence(out.select("_row", text.alias("_text")))
    new = {"text": F.col("_text")} | ({"n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs with the repeated chunks of text removed; all columns and rows stay, n_chars follows the text.

    docs needs doc_id (long) and text (string). The first occurrence of a chunk, by doc_id and then place in the
    text, stays. Texts that are null stay null; a text of which all chunks go becomes empty; single lines that are no
    passages and chunks without words always stay. Rows that repeat a doc_id are told apart by their texts, those that
    repeat both are cut alike; rows without a doc_id stay whole and do not count as an occurrence. An empty table gives no rows.
    """
    return _dedup(docs, scratch or Scratch(docs.sparkSession, "lines"), (CHUNKS,))


def dedup_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Like dedup_lines, for whole lines that hold PASSAGE_WORDS words or more together and occur before, wherever chunks end.

    Occurrences that overlap the first one in its own text stay.
    """
    return _dedup(docs, scratch or Scratch(docs.sparkSession, "lines"), (PASSAGES,))


def chunk_report(docs: DataFrame, scratch: Scratch | None = None, kinds: tuple[str, ...] = (CHUNKS,)) -> DataFrame:
    """(doc_id, n_lines, n_chunks, removed_chunks, removed_lines, kept_chars, kept_md5) for every row of docs.

    kinds says whether repeated chunks, passages or both go; removed_chunks counts the chunks of which no line stays.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lines, starts = F.col("_lines"), F.col("_starts")
    out = fence(with_starts(_removed(held, scratch, kinds)).withColumn("_left", _left(lines, F.col("_gone"))))
    chunk_of = F.flatten(F.transform(starts, lambda s, k: F.array_repeat(k, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)))
    out = fence(out.withColumn("_chunk_of", chunk_of).withColumn("_kept", _joined(lines, F.col("_left"))))
    held_chunks = F.size(F.array_distinct(F.transform("_left", lambda i: F.get(F.col("_chunk_of"), i))))
    return out.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(starts).cast("long").alias("n_chunks"), (F.size(starts) - held_chunks).cast("long").alias("removed_chunks"),
        (F.size(lines) - F.size("_left")).cast("long").alias("removed_lines"), F.length("_kept").cast("long").alias("kept_chars"), F.md5("_kept").alias("kept_md5"),
    )
