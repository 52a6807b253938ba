"""Benchmark decontamination with DataFrame functions only.

A window of L words that occurs in a document covers a block of k = (L + 1) // 2 words
that starts at a multiple of k. So only every k-th position of a document is looked up,
in a hash set of all k-word runs of the benchmark's windows; where a block is known, the
few windows that may cover it are looked up in the set of windows and so verified word
by word. Both sets come from the benchmark alone. They are broadcast while the windows
number at most `broadcast_windows` and take few bytes, and joined by shuffle beyond it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch, few

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS, BROADCAST_BYTES = 50_000, 8 << 20


def normalised(text: Column) -> Column:
    """The words in lower case (A-Z only), one space between them; null: empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, NOT_WORD, " "))


def words_of(clean: Column) -> Column:
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """item, n, window: every window of every item, n words joined by a space each."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(normalised(F.col(text_col))).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    windows = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    return items.select("item", "n", F.explode(windows).alias("window")).distinct()


def _hits(docs: DataFrame, windows: DataFrame, k: int, small: bool) -> DataFrame:
    """row, n_words, first, last, item: the windows of 2k - 1 or 2k words in each document, first being 0-based.

    Also a row with null first, last and item for each document. Where the sets are
    broadcast, the block "" stands for the document itself, so that one scan serves both.
    """
    lengths = [n for n in (2 * k - 1, 2 * k) if n > 0]
    wanted = windows.where(F.col("n").isin(lengths))
    inner = F.transform(
        F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice(F.split("window", " "), i, F.lit(k)), " ")
    )
    runs = wanted.select(F.explode(inner).alias("block")).distinct()
    block_pattern = r"[^ ]+" if k == 1 else r"(?:[^ ]+ ){%d}[^ ]+" % (k - 1)
    blocks = F.regexp_extract_all("clean", F.lit(block_pattern), F.lit(0))
    if small:
        one = windows.sparkSession.range(1)
        runs = runs.unionByName(one.select(F.lit("").alias("block")))
        wanted = wanted.unionByName(one.select(F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"), F.lit("").alias("window")))
        at = docs.select("row", "words", F.posexplode(F.concat(F.array(F.lit("")), blocks)).alias("nth", "block")).join(F.broadcast(runs), "block")
    else:  # the words come back by a join of their own, as a shuffled row for each block mustn't carry them all
        at = docs.select("row", F.posexplode(blocks).alias("nth", "block")).withColumn("nth", F.col("nth") + 1).join(runs.hint("merge"), "block").select("row", "nth")
        at = at.join(docs.select("row", "words").hint("merge"), "row")
    # Block nth (1-based) starts at word (nth - 1) * k; a window of n words that covers it starts at most n - k before.
    start = (F.col("nth") - 1) * k

    def window(before: int, n: int) -> Column:
        first = start - before
        return F.struct(first.alias("first"), F.lit(n).alias("n"), F.array_join(F.slice("words", F.greatest(first, F.lit(0)) + 1, F.lit(n)), " ").alias("window"))

    near = F.array(*[window(before, n) for n in lengths for before in range(n - k + 1)])
    itself = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit("").alias("window")))
    tried = at.select("row", F.size("words").alias("n_words"), F.explode(F.when(F.col("nth") == 0, itself).otherwise(near)).alias("c"))
    tried = tried.where("c.first >= 0 and c.first + c.n <= n_words").select("row", "n_words", "c.first", "c.n", "c.window")
    found = tried.join(F.broadcast(wanted) if small else wanted.hint("merge"), ["n", "window"])
    real = F.col("n") > 0
    found = found.select(
        "row", "n_words", F.when(real, F.col("first")).alias("first"), F.when(real, F.col("first") + F.col("n")).alias("last"), "item"
    )
    if small:
        return found
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("first", "int"), ("last", "int"), ("item", "string"))]
    return found.unionByName(docs.select("row", F.size("words").alias("n_words"), *nothing))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row per input row.

    A window is `width` consecutive words of an item; an item with fewer words, but not
    none, is one window. n_hit counts the document's words inside any occurrence of a
    window, spans are the maximal runs of such words (first, last: 0-based, last
    exclusive), n_items the items with a window that occurs. Null and empty texts have
    no words and are clean; null and empty items have no window. Rows that repeat an id
    are judged each on its own, and a null id stays null. An item id that is null has
    no name: its windows count as hits but not as an item. Extra columns are ignored.
    """
    windows, lengths, small = prepared(benchmark, item_id_col, item_text_col, width, broadcast_windows)
    clean = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("clean"))
    clean = clean.select(F.struct(F.monotonically_increasing_id().alias("at"), "doc_id").alias("row"), "clean", words_of(F.col("clean")).alias("words"))
    blocks = sorted({(n + 1) // 2 for n in lengths} | {(width + 1) // 2})
    if not small or len(blocks) > 1:  # read more than once: numbered and written before
        clean = Scratch(docs.sparkSession).save(clean.drop("words")).withColumn("words", words_of(F.col("clean")))
    hits = None
    for k in blocks:
        found = _hits(clean, windows, k, small)
        hits = found if hits is None else hits.unionByName(found)
    grouped = hits.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last")))).alias("at"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # Windows in order of their starts grow the run at hand, or close it and begin the next.
    span = "struct<first:int,last:int>"
    run = lambda f, l: F.struct(F.greatest(f, F.lit(0)).cast("int").alias("first"), l.cast("int").alias("last"))
    closed = lambda acc: F.when(acc["now"]["last"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
    runs = F.aggregate(
        "at",
        F.struct(F.array().cast(f"array<{span}>").alias("done"), run(F.lit(0), F.lit(0)).alias("now")),
        lambda acc, x: F.when(
            (acc["now"]["last"] > 0) & (acc["now"]["last"] >= x["first"]),
            F.struct(acc["done"].alias("done"), run(acc["now"]["first"], F.greatest(acc["now"]["last"], x["last"])).alias("now")),
        ).otherwise(F.struct(closed(acc).alias("done"), run(x["first"], x["last"]).alias("now"))),
        closed,
    )
    grouped = grouped.withColumn("spans", runs)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + (x["last"] - x["first"]))
    return grouped.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def prepared(benchmark: DataFrame, id_col: str, text_col: str, width: int, broadcast_windows: int) -> tuple[DataFrame, list[int], bool]:
    """The table of windows, their lengths (at most `width` numbers) and whether they are few enough to broadcast."""
    windows = Scratch(benchmark.sparkSession).save(windows_of(benchmark, id_col, text_col, width))
    known = windows.agg(F.collect_set("n").alias("n"), F.count("*").alias("all"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    return windows, known["n"], known["all"] <= broadcast_windows and known["bytes"] <= BROADCAST_BYTES


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words in `spans`, which are in order and apart, and the separators after them."""
    gap = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # the text still has A-Z
    pieces = F.regexp_extract_all(text, F.lit(f"[^{gap}]+[{gap}]*"), F.lit(0))
    head = F.regexp_extract(text, f"^[{gap}]*", 0)
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"]))
    ends = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(pieces)))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(pieces, b + 1, F.greatest(e - b, F.lit(0)))))
    return F.when(F.size(spans) > 0, F.concat(head, F.array_join(kept, ""))).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of docs, without contaminated documents or (cut="spans") without the hit words.

    Whole documents go by id: rows that repeat an id go if one of them is contaminated,
    and rows with a null id stay. Words are cut row by row, of rows that are numbered and
    written before; ids may repeat or be null. Columns may have any names.
    """
    if cut == "documents":
        found = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("doc_id").cast("long").alias("gone"))
        found = Scratch(docs.sparkSession).save(found.where("gone is not null").distinct())
        rows = docs.select(F.struct("*").alias("all"))
        return rows.join(few(found), F.col("all").getField(id_col) == F.col("gone"), "left_anti").select("all.*")
    rows = Scratch(docs.sparkSession).save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")))
    text = F.col("all").getField(text_col)
    found = contamination(rows.select("row", text.alias("text")), benchmark, "row", "text", **options).where("contaminated").select(F.col("doc_id").alias("hit"), "spans")
    joined = rows.join(found, F.col("row") == F.col("hit"), "left")
    shorter = F.coalesce(without_spans(text, F.col("spans")), text)
    return joined.select(*[(shorter if c == text_col else F.col("all").getField(c)).alias(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4_SQL = f"""
with doc as (select doc_id, {_SQL_WORDS} as w from documents),
item as (select item_id, {_SQL_WORDS} as w from benchmark),
item_window as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from (select item_id, w, least(len(w), 10) as n from item where len(w) > 0))),
doc_window as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from doc cross join (select distinct n from item_window) where len(w) >= n)),
hit as (select doc_id, i, d.n, item_id from doc_window d join item_window using (n, win)),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
