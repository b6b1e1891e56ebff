"""Cross-document line frequency (native DataFrame operations only).

A line is normalised (lower case, blanks collapsed, ends trimmed) and hashed.
Within one host a line's frequency is the number of distinct documents that hold
it; documents of equal text are one document (``count_copies`` counts each row
instead, with which a document that was copied often loses all of its lines and is
rejected with all its copies).  A line above the limits is boiler-plate and is
removed; a document that loses too much is rejected.

Limits: more than ``min_texts`` documents must hold the line.  A line of
``long_words`` words or more needs nothing else, so a passage is treated alike on
small and hot hosts; a shorter one, which unrelated documents also share by chance,
must be in more than ``per_mille`` of the host's documents as well.

Skew: counting runs in two steps, first distinct (host, line, text), then
(host, line) with partial sums, so neither a hot host nor a hot line meets in one
task.  The lines above the limit and what each text loses are written to tables;
these are broadcast when their measured size is within a bound, else the join is
left to adaptive execution, which can split a hot line.

Defined cases: a null text has no words and fails the base rules; a null host is
the host ``''``; lines without a word are never counted or removed; a line that is
repeated in a text counts once for it; a line in exactly as many documents as a
limit says stays; repeated rows are copies of one text and get equal results; an
empty table gives an empty result; other columns of the input are carried and never
read, but for those that bear the name of a result column, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.columns import blank_words, closed, pairs, reopened, text_key, unnested, with_grams
from lodestrata.storage import discard, materialise, sized

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineLimits:
    """When a line is removed, and a document rejected."""

    min_texts: int = 20
    #: Lines of fewer than ``long_words`` words must be in more than this share of the host's documents, too.
    per_mille: int = 5
    long_words: int = 10
    count_copies: bool = False
    #: Rejected when something was removed and less than one part in this many words is left,
    keep_one_in: int = 3
    #: or fewer than this many words.
    min_words_left: int = 10


def normalised_lines(text: Column) -> Column:
    """Lines as they are compared: lower case, blanks collapsed and trimmed, none empty."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\x0b\\f\\r]{2,}|[\\t\\x0b\\f\\r]", " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def _line_words(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", "")) + 1


def _covered(starts: Column, width: int) -> Column:
    """Number of positions in the union of [s, s + width) over sorted starts."""
    steps = pairs(starts, starts, 1, lambda a, b: F.least(F.lit(width), b - a))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x) + F.lit(width)


def base_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Repeated five-word windows are found inside the row: window hashes are
    compared as a set first, and only a document that has a repetition sorts its
    windows to find the positions.
    """
    kept = list(df.columns)
    whole = F.coalesce(F.col(text), F.lit(""))
    without = F.translate(whole, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    df = df.select(
        *kept,
        blank_words(F.col(text)).alias("__words"),
        F.length(without).cast("long").alias("word_chars"),
        (F.length(without) - F.length(F.translate(without, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    df = df.select(
        *kept, "word_chars", "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    df = with_grams(df, "__h", "__w", WINDOW)
    placed = F.sort_array(F.zip_with(F.col("__w"), F.sequence(F.lit(0), F.size("__w") - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    repeated = F.size("__w") != F.size(F.array_distinct("__w"))
    df = df.withColumn("__s", F.when(repeated, placed))
    same = pairs(F.col("__s"), F.col("__s"), 1, lambda a, b: a["h"] == b["h"])
    df = df.withColumn("__e", F.when(F.col("__s").isNotNull(), same))
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, F.col("__e")), F.concat(F.col("__e"), no), lambda a, b: a | b)
    starts = F.sort_array(F.array_compact(F.zip_with(F.col("__s"), either, lambda x, twice: F.when(twice, x["p"]))))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), starts))
    df = df.withColumn("n_repeat_words", F.when(F.col("__p").isNull(), F.lit(0)).otherwise(_covered(F.col("__p"), WINDOW)).cast("long"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return df.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _host(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def removed_lines(docs: DataFrame, text: str = "text", host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Per (host, different text) that loses a line: line words, words removed, hashes removed."""
    keyed = docs.select(_host(F.col(host)).alias("__host"), text_key(F.col(text)).alias("__key"), F.col(text).alias("__text"))
    parts = F.array_distinct(F.transform(normalised_lines(F.col("__text")), lambda x: F.struct(F.xxhash64(x).alias("line"), _line_words(x).alias("w"))))
    lines = materialise(
        unnested(keyed, parts, "__host", "__key")
        .groupBy("__host", "__key", F.col("x.line").alias("__line")).agg(F.max("x.w").alias("w"), F.count("*").alias("rows")),
        "lines",
    )
    weight = F.col("rows") if limits.count_copies else F.lit(1)
    held = lines.groupBy("__host", "__line").agg(F.sum(weight).alias("n"), F.max("w").alias("w")).where(F.col("n") > limits.min_texts)
    texts = keyed.groupBy("__host", "__key").agg(F.count("*").alias("rows"))
    hosts = texts.groupBy("__host").agg(F.sum(weight).alias("texts"))
    common = (F.col("w") >= limits.long_words) | (F.col("n") * 1000 > F.col("texts") * limits.per_mille)
    above = materialise(held.join(hosts, "__host").where(common).select("__host", "__line"), "frequent-lines")
    hit = lines.join(sized(above), ["__host", "__line"])
    removed = hit.groupBy("__host", "__key").agg(F.sum("w").alias("removed_words"), F.collect_list("__line").alias("removed_hashes"))
    totals = lines.groupBy("__host", "__key").agg(F.sum("w").alias("line_words"))
    out = materialise(removed.join(totals, ["__host", "__key"]), "removed-lines")
    discard(lines, above)
    return out


def judge(docs: DataFrame, text: str = "text", host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """All rows of ``docs`` with the base metrics, removed_words, removed_hashes, depleted and kept."""
    inner, given = closed(docs)
    lost = removed_lines(inner.select(given[text].alias("text"), given[host].alias("source")), limits=limits)
    lost = sized(lost).withColumnsRenamed({"removed_words": "__removed", "removed_hashes": "__hashes", "line_words": "__line_words"})
    left = F.col("__line_words") - F.col("__removed")
    depleted = F.coalesce((left < limits.min_words_left) | (left * limits.keep_one_in < F.col("__line_words")), F.lit(False))
    inner = inner.withColumns({"__host": _host(given[host]), "__key": text_key(given[text]), "__text": given[text]})
    # The row id keeps a later filter above the metrics: pushed below, their expressions would be copied into it many times over.
    measured = base_metrics(inner, "__text").withColumn("__row", F.monotonically_increasing_id())
    found = measured.join(lost, ["__host", "__key"], "left").withColumns({
        "removed_words": F.coalesce("__removed", F.lit(0)).cast("long"), "removed_hashes": F.col("__hashes"), "depleted": depleted,
        "kept": ~F.col("base_failed") & ~depleted & (F.col("__row") >= 0),
    })
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed_hashes", "depleted", "kept")
    return found.select(*reopened(given, *added))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text less the lines whose normalised hash is in ``hashes`` (null: unchanged)."""
    def kept(line: Column) -> Column:
        flat = F.btrim(F.regexp_replace(F.lower(line), "[ \\t\\x0b\\f\\r]{2,}|[\\t\\x0b\\f\\r]", " "))
        return ~F.array_contains(hashes, F.xxhash64(flat))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), kept), "\n"))


def rejected_out(docs: DataFrame, text: str = "text", host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that pass, without the lines above the limits; the columns of ``docs``."""
    inner, given = closed(docs)
    where = {name: i for i, name in enumerate(docs.columns)}
    judged = judge(inner, f"__in{where[text]}", f"__in{where[host]}", limits).where("kept")
    body = without_lines(given[text], F.col("removed_hashes"))
    return judged.select(*(body.alias(name) if name == text else c.alias(name) for name, c in given.items()))
