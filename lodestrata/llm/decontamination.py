"""Benchmark decontamination by winnowing (native DataFrame operations only).

Texts become k-gram hashes; from every window of w consecutive k-grams the
smallest hash is kept as fingerprint.  A shared run of at least w + k - 1 words
contains a whole window, so both sides keep the same fingerprint for it: with
k = w = 7 every shared run of 13 words is found.  Because w + k - 1 is exactly
the length of a contract window, each window owns one fingerprint, the minimum
over its own k-grams; a hit is extended by comparing the whole windows (128-bit
hashes) that own the fingerprint.  Items shorter than 13 words are one window of
their own length m, for which k = (m + 1) div 2 and w = m - k + 1.

Plan: (1) the fingerprints of all texts for all window lengths, in one pass, as a
set per text, against the items' fingerprints; only texts with a common one go on,
and take their common fingerprints along.  (2) The windows of these texts that own
one of them, once for equal texts, against the items' windows.  (3) All documents
get the hits of their text.  A side of a join is broadcast only when its measured
size is within a bound.

Skew: copies of a text are reduced to one before windows are made, the sides of
the joins hold fixed-width rows, and sums per text are pre-aggregated.

Defined cases: a null text or item text has no words; an item without words has
no window; a null item_id is reported as the id ``null``; items that share an id
count once; a text of exactly 1 / share hit words is contaminated; repeated
documents each keep their row; with no benchmark rows nothing is hit; an empty
table gives an empty result; further columns of either table are carried or
ignored, but for those of ``docs`` that bear the name of a result column, which
replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.columns import alnum_words, closed, reopened, text_key, unnested, with_grams
from lodestrata.storage import discard, materialise, sized

WINDOW = 13


def _split(length: int) -> tuple[int, int]:
    """k and w with k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


def _with_fingerprints(df: DataFrame, length: int) -> DataFrame:
    """From array column __h add __f<length>: the fingerprint owned by each window of ``length`` words."""
    k, w = _split(length)
    df = with_grams(df, "__h", f"__g{length}", k)
    df = with_grams(df, f"__g{length}", f"__f{length}", w, F.least)
    return df.drop(f"__g{length}")


def _hashed(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    return df.select(*keep, words.alias("__words")).select(*keep, F.size("__words").alias("__n"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))


def _windows(hashed: DataFrame, length: int, *keep: str, marks: str | None = None) -> DataFrame:
    """One row for each window: start, fingerprint and 128-bit window hash; with ``marks`` only those that own a fingerprint of this array."""
    df = hashed.withColumn("__h2", F.transform("__h", lambda x: F.xxhash64(F.lit(7), x)))
    df = _with_fingerprints(df, length)
    df = with_grams(df, "__h", "__a", length)
    df = with_grams(df, "__h2", "__b", length).withColumnsRenamed({f"__f{length}": "f", "__a": "a", "__b": "b"})
    own = F.transform(F.arrays_zip("f", "a", "b"), lambda x, i: F.struct(i.alias("start"), x["f"].alias("f"), x["a"].alias("a"), x["b"].alias("b")))
    df = df.select(*keep, own.alias("x"), *([marks] if marks else []))
    rows = F.filter("x", lambda x: F.array_contains(F.col(marks), x["f"])) if marks else F.col("x")
    return unnested(df, rows, *keep).select(*keep, "x.start", F.lit(length).alias("length"), "x.f", "x.a", "x.b")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """The windows of all items, written once, and the window lengths in use."""
    base = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    hashed = materialise(_hashed(base, alnum_words(F.col("text")), "item"), "items")
    short = sorted(r[0] for r in hashed.where((F.col("__n") > 0) & (F.col("__n") < WINDOW)).select("__n").distinct().collect())  # at most 12 values
    lengths = [*short, WINDOW]
    parts = [_windows(hashed.where(F.col("__n") == m), m, "item") for m in short]
    parts.append(_windows(hashed.where(F.col("__n") >= WINDOW), WINDOW, "item"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialise(out.drop("start").distinct(), "item-windows"), lengths


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per different text with a hit: its key, n_hit, the longest hit, the sorted ids of its items and the spans (start, length)."""
    windows, lengths = item_windows(items, item_id, item_text)
    texts = docs.select(F.col(text).alias("__text")).select(text_key(F.col("__text")).alias("__key"), "__text")

    hashed = _hashed(texts, alnum_words(F.col("__text")), "__key")
    for m in lengths:
        hashed = _with_fingerprints(hashed, m)
    every = F.array_distinct(F.concat(*[f"__f{m}" for m in lengths]))
    wanted = materialise(windows.select(F.col("f").alias("mark")).distinct(), "item-marks")
    found = unnested(hashed, every, "__key").withColumnRenamed("x", "mark").join(sized(wanted), "mark", "left_semi")
    marked = materialise(found.groupBy("__key").agg(F.collect_set("mark").alias("__marks")), "marked-texts")

    # One row for each different text that has a common fingerprint.
    chosen = texts.join(sized(marked), "__key").dropDuplicates(["__key"])
    chosen = materialise(_hashed(chosen, alnum_words(F.col("__text")), "__key", "__marks"), "marked-words")
    found = None
    for m in lengths:
        part = _windows(chosen, m, "__key", marks="__marks")
        found = part if found is None else found.unionByName(part)
    found = found.join(sized(windows), ["length", "f", "a", "b"]).select("__key", "start", "length", "item")
    spans = F.sort_array(F.collect_set(F.struct("start", "length")))
    per_text = found.groupBy("__key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    # Spans in order of their starts: words covered, and the longest stretch without a gap.
    state = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(0).alias("hit"), F.lit(0).alias("longest"))

    def add(s: Column, x: Column) -> Column:
        stop = F.greatest(s["end"], x["start"] + x["length"])
        begin = F.when(x["start"] > s["end"], x["start"]).otherwise(s["begin"])
        return F.struct(
            begin.alias("begin"), stop.alias("end"), (s["hit"] + stop - F.greatest(s["end"], x["start"])).alias("hit"),
            F.greatest(s["longest"], stop - begin).alias("longest"),
        )

    covered = F.aggregate("spans", state, add)
    out = materialise(
        per_text.withColumn("covered", covered).select("__key", F.col("covered.hit").cast("long").alias("n_hit"), F.col("covered.longest").cast("long").alias("longest"), "items", "spans"), "hits",
    )
    discard(wanted, marked, chosen, windows)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", share: int = 20) -> DataFrame:
    """All rows of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and longest_hit (words in the longest hit stretch)."""
    inner, given = closed(docs)
    own = hits(inner.select(given[text].alias("text")), items, "text", item_text, item_id)
    found = sized(own).select(
        "__key", F.col("n_hit").alias("__hit"), F.col("longest").alias("__longest"), F.size("items").cast("long").alias("__items"),
        F.sha2(F.array_join("items", ","), 256).alias("__sha"),
    )
    counted = inner.withColumns({"__key": text_key(given[text]), "n_words": F.size(alnum_words(given[text])).cast("long")})
    hit = F.coalesce(F.col("__hit"), F.lit(0)).cast("long")
    out = counted.join(found, "__key", "left").withColumns({
        "n_hit": hit, "n_items": F.coalesce("__items", F.lit(0)).cast("long"), "items_sha256": F.coalesce("__sha", F.sha2(F.lit(""), 256)),
        "contaminated": (hit > 0) & (hit * share >= F.col("n_words")), "longest_hit": F.coalesce("__longest", F.lit(0)).cast("long"),
    })
    return out.select(*reopened(given, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit"))


def clean_rows(docs: DataFrame, items: DataFrame, text: str = "text", longest: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are neither contaminated nor hold a hit stretch of ``longest`` words (a full window)."""
    inner, given = closed(docs)
    judged = decontaminate(inner, items, f"__in{docs.columns.index(text)}")
    return judged.where(~F.col("contaminated") & (F.col("longest_hit") < longest)).select(*reopened(given))
