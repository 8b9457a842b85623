"""Conversations: lines, budgets, context windows, signals, grounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import normalised, text_of


def lines(messages: DataFrame) -> DataFrame:
    """User and assistant turns as ``ROLE: text``."""
    return messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), text_of("text")).alias("line"))


def budget(messages: DataFrame, most: int) -> DataFrame:
    """The latest lines of each conversation within ``most`` letters; of the line that crosses the limit the end stays."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(messages).withColumn("_used", F.coalesce(F.sum(F.length("line") + 2).over(w), F.lit(0))).where(F.col("_used") < most)
    kept = F.least(F.length("line").cast("long"), F.lit(most) - F.col("_used"))
    return rows.select("conv_id", "turn", kept.alias("kept"), F.expr("right(line, cast(least(length(line), {0} - _used) as int))".format(most)).alias("line"))


def head_tail(messages: DataFrame, head: int = 4, tail: int = 10) -> DataFrame:
    """The first and last turns of long conversations; short ones whole."""
    by = Window.partitionBy("conv_id")
    rows = messages.withColumn("_a", F.row_number().over(by.orderBy("turn"))).withColumn("_z", F.row_number().over(by.orderBy(F.desc("turn"))))
    return rows.where((F.col("_a") <= head) | (F.col("_z") <= tail)).drop("_a", "_z")


# The ladders of patterns, strong and weak, and the contexts that silence the weak ones. Word borders are those of ASCII.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
STRONG = (
    r"(?:记住|记一下|备忘|别忘了|长期记住)\s*[:：]?\s*([^。\n]{4,200})",
    r"以后\s*([^。\n]{2,80})\s*(?:要|请|一定)?\s*(?:做|处理|记得|注意)",
    r"(?i)(?:remember|note that|don't forget|never forget|long-term remember)\s*[:：]?\s*([^.\n]{4,200})",
    rf"(?i){_B}(always|never)\s+([a-z][^.\n]{{4,150}})",
)
WEAK = (
    r"(?:以后都|以后请|以后记得|下次记得|下次注意|约定|规则是|从今往后|今后)\s*[:：,，]?\s*([^。\n]{4,150})",
    r"(?:记住这个|注意这个|留意一下|请注意)\s*[:：,，]?\s*([^。\n]{4,150})",
    rf"(?i){_B}(going forward|from now on|henceforth|note this|bear in mind|keep in mind){_E}\s*[:：,，]?\s*([^.]{{4,150}})",
    rf"(?i){_B}(let'?s (?:always|never)){_E}\s+([^.]{{4,150}})",
)
NEGATIVE = (rf"(?i){_B}(?:(?:eslint|prettier|noqa|tsconfig|build\s*error){_E}|type:(?=[A-Za-z0-9_]))", rf"(?i){_B}(?:commit|push|pr|merge|git){_E}")


def signals(messages: DataFrame) -> DataFrame:
    """User turns of 6 to 2000 letters that ask to keep something, with ``strength`` and ``content``, what is to be kept.

    The first pattern of a ladder whose content (its first group, freed of punctuation around it) has 4 to
    500 letters counts; the weak ladder counts only outside of talk about builds and version control.
    """
    rows = messages.where((F.col("role") == "user") & F.length(F.trim(text_of("text"))).between(6, 2000))
    text = F.trim(text_of("text"))
    content = lambda pattern: F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^[,，、;；:：\s]+|[,，、;；:：\s]+$", "")
    told = lambda ladder, strength: F.transform(F.array(*map(content, ladder)), lambda c: F.struct(F.lit(strength).alias("strength"), c.alias("content")))
    silent = text.rlike(NEGATIVE[0]) | text.rlike(NEGATIVE[1])
    both = F.concat(told(STRONG, "strong"), F.when(silent, F.array().cast("array<struct<strength:string,content:string>>")).otherwise(told(WEAK, "weak")))
    first = F.slice(F.filter(both, lambda t: F.length(t["content"]).between(4, 500)), 1, 1)
    return rows.select("*", F.inline(first))


#: Windows of evidence that are held by every task; more are met by a join.
MOST_NEEDLES = 200_000


def grounding(evidence: DataFrame, transcripts: DataFrame, window: int = 30, stride: int = 15) -> DataFrame:
    """``item_id, doc_id`` where an item's normalised text, or a window of it, stands in a document's.

    Windows have one length, so a document's places are hashed in one vectorised pass and looked up
    among the windows; a hit is compared letter by letter. While there are at most MOST_NEEDLES
    windows they are broadcast; beyond, documents and windows meet in a join on the hash.
    """
    items = evidence.select("item_id", normalised(F.substring(F.trim(text_of("text")), 1, 200)).alias("e"), F.length(F.trim(text_of("text"))).alias("_n")).where("_n >= 6 and length(e) >= 6")
    starts = F.sequence(F.lit(0), F.greatest(F.length("e") - window, F.lit(0)), F.lit(stride))
    # Of an item over a window long, any window will do; a shorter one must stand as a whole.
    windows = F.when(F.length("e") > window, F.transform(starts, lambda i: F.substring("e", i + 1, F.lit(window)))).otherwise(F.array("e"))
    needles = items.select("item_id", F.explode(windows).alias("needle"))
    texts = transcripts.select("doc_id", normalised("text").alias("t"))
    if needles.limit(MOST_NEEDLES + 1).count() <= MOST_NEEDLES:
        held: dict[str, list[int]] = {}
        for r in needles.collect():
            held.setdefault(r.needle, []).append(r.item_id)
        return _grounded_here(texts, held, evidence.schema["item_id"], transcripts.schema["doc_id"])
    gram = F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - window + 1, F.lit(1))), lambda i: F.xxhash64(F.substring("t", i, F.lit(window))))
    keys = needles.where(F.length("needle") == window).select("item_id", "needle", F.xxhash64("needle").alias("h")).distinct()
    hits = texts.select("doc_id", F.explode(F.array_distinct(gram)).alias("h")).join(keys, "h").join(texts, "doc_id").where(F.contains("t", F.col("needle"))).select("item_id", "doc_id")
    # Shorter ones have 6 letters at least: they meet on the first 6, and are then looked for as a whole.
    short = needles.where(F.length("needle") < window).select("item_id", "needle", F.xxhash64(F.substring("needle", 1, 6)).alias("h"))
    sixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 5, F.lit(1))), lambda i: F.xxhash64(F.substring("t", i, F.lit(6))))
    met = texts.select("doc_id", F.explode(F.array_distinct(sixes)).alias("h")).join(short, "h").join(texts, "doc_id").where(F.contains("t", F.col("needle")))
    return hits.unionByName(met.select("item_id", "doc_id")).distinct()


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _rolling(text: str, width: int) -> np.ndarray:
    """A hash of every run of ``width`` letters."""
    x = _letters(text) + np.uint64(1)
    if len(x) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + x[k : k + len(out)]
    return out


def _grounded_here(texts: DataFrame, held: dict[str, list[int]], item, doc) -> DataFrame:
    """Hits of the windows in ``held``, one narrow pass."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = sorted({len(n) for n in shared.value})
        known = {w: np.unique(np.concatenate([_rolling(n, w) for n in shared.value if len(n) == w])) for w in widths}
        for b in batches:
            rows: list[tuple[int, int]] = []
            for i, t in enumerate(b.column("t").to_pylist()):
                found: set[int] = set()
                for w in widths:
                    for at in np.flatnonzero(np.isin(_rolling(t, w), known[w])).tolist():
                        found.update(shared.value.get(t[at : at + w], ()))
                rows += [(k, i) for k in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], to_arrow_type(item.dataType)), b.column("doc_id").take(pa.array([r[1] for r in rows], pa.int64()))], ["item_id", "doc_id"])

    return texts.mapInArrow(run, StructType([item, doc]))
