"""Benchmark decontamination by spaced-seed hashing; DataFrame operations only.

A mask looks at some of the words in a short span and ignores the others. For
each mask and position, the looked-at words are hashed, in documents and in
benchmark items; documents whose hashes meet a benchmark's are aligned with that
item at the hit, and the alignment is verified: some WINDOW consecutive words of
the item (all of a shorter item) must agree with the document but for at most
``substitutions`` words. The first of MASKS
alone hits every window of 13 with two substitutions. Items shorter than a window
have whole runs of words besides: as many equal parts as substitutions and one more,
of which one is always intact; those below WHOLE words, whose parts would say
little, are one part and must agree in all words. Documents are looked through for
runs of the lengths that such items have, if any.

Hashes of the benchmark are distinct values; they are broadcast up to BROADCAST_ROWS,
beyond that both sides are shuffled by hash. Only texts with hits are read again.

Words: letters and digits, lower-cased. Defined results: null and empty texts and
items have no words and never agree; repeated rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import materialize

#: The looked-at places of each mask.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 4, 7))
WINDOW, SUBSTITUTIONS = 13, 2
#: Items of fewer words are found as a whole alone.
WHOLE = 8
#: Rows of 8 to 40 bytes that are broadcast at most; their count is taken first.
BROADCAST_ROWS = 1_000_000
#: Shares that the hits of one hash are dealt to where seeds are too many for a broadcast.
SALTS = 16


def word_array(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seed_hashes(words: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """array<array<bigint>>: for each mask the hash at each position; ``words`` names an array of hashes."""
    out = []
    for k, mask in enumerate(masks):
        span = mask[-1] + 1
        looked = ", ".join(f"{words}[i + {p}]" if p else f"{words}[i]" for p in mask)
        out.append(f"if(size({words}) >= {span}, transform(sequence(0, size({words}) - {span}), i -> xxhash64({looked}, {k})), cast(array() as array<bigint>))")
    return F.expr(f"array({', '.join(out)})")


def checked_broadcast(small: DataFrame, rows: int | None = None) -> DataFrame:
    """``small`` marked for broadcast if its count allows; else as it is, for a shuffled join."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def _positions(df: DataFrame, keys: list[str], text: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """keys, position, hash of each seed of each text."""
    hashed = df.select(*keys, F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    seeds = hashed.select(*keys, F.explode(seed_hashes("w", masks)).alias("h"))
    return seeds.select(*keys, F.posexplode("h").alias("position", "hash"))


def _part_words(n: Column, substitutions: int) -> Column:
    """Words of each part of an item of ``n`` words, fewer than a window."""
    return F.when(n < max(WHOLE, substitutions + 1), n).otherwise(F.floor(n / (substitutions + 1))).cast("int")


def _item_positions(items: DataFrame, window: int, substitutions: int, masks: tuple[tuple[int, ...], ...]) -> tuple[DataFrame, tuple[tuple[int, ...], ...]]:
    """item_id, position, hash of each seed of each item, and ``masks`` with those of short items behind them."""
    sized = items.select("item_id", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    n = F.size("w")
    part = F.when(n.between(1, window - 1), _part_words(n, substitutions))
    # Lengths of parts lie below a window's: a few values.
    lengths = sorted(r[0] for r in sized.select(part.alias("part")).where("part IS NOT NULL").distinct().collect())
    every = masks + tuple(tuple(range(k)) for k in lengths)
    seeds = sized.select("item_id", n.alias("n"), part.alias("part"), F.posexplode(seed_hashes("w", every)).alias("mask", "h")).select("item_id", "n", "part", "mask", F.posexplode("h").alias("position", "hash"))
    own = F.get(F.array(*[F.lit(k) for k in (*[0] * len(masks), *lengths)]), F.col("mask"))
    wanted = (F.col("mask") < len(masks)) | ((own == F.col("part")) & (F.col("position") % F.col("part") == 0))
    return seeds.where(wanted).select("item_id", "position", "hash"), every


def keyed_texts(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` with __k1 and __k2, two hashes of the whole text: equal texts share them, so copies are verified once."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit("second"), text)})


def _met(hits: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """Hits with the items and places that have their hash. Common words give hot hashes: seeds are broadcast, or hits dealt by text and hash."""
    if item_seeds.count() <= BROADCAST_ROWS:
        return hits.join(F.broadcast(item_seeds), "hash")
    copies = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("k1", "position"), F.lit(SALTS)).cast("int")).join(copies, ["hash", "salt"])


def _most_within(same: str, span: Column) -> Column:
    """Most ones in ``span`` places in a row of an array, by a sliding sum in one pass."""
    at = lambda i: F.get(F.col(same), i)

    def step(acc: Column, i: Column) -> Column:
        now = acc["now"] + at(i) - F.when(i >= span, at(i - span)).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.when(i >= span - 1, F.greatest(acc["most"], now)).otherwise(acc["most"]).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.sequence(F.lit(0), F.size(same) - 1), start, step, lambda acc: acc["most"])


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks: tuple[tuple[int, ...], ...] = MASKS, text_column: str = "text") -> DataFrame:
    """k1, k2, item_ids (ascending), most_words of each distinct contaminated text."""
    keyed = keyed_texts(docs.select(text_column), text_column).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seeds, masks = _item_positions(items, window, substitutions, masks)
    item_seeds, _ = materialize(seeds.select("item_id", F.col("position").alias("item_position"), "hash"), "item-seeds")
    hashes = checked_broadcast(item_seeds.select("hash").distinct())
    hits, _ = materialize(_positions(keyed, ["k1", "k2"], "text", masks).join(hashes, "hash", "left_semi").distinct(), "hits")
    aligned, _ = materialize(_met(hits, item_seeds).select("k1", "k2", "item_id", (F.col("position") - F.col("item_position")).alias("shift")).distinct(), "aligned")
    texts = aligned.select("k1", "k2").distinct()
    hit_texts = keyed.join(checked_broadcast(texts), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    words, _ = materialize(hit_texts.select("k1", "k2", word_array(F.col("text")).alias("doc_words")), "hit-words")
    item_words = items.select("item_id", word_array(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    # Beside the item lies the part of the document that the shift puts there. Words of a document meet last, so no copy of them is shuffled.
    beside = F.transform("item_words", lambda w, i: (F.get(F.col("doc_words"), (i + F.col("shift")).cast("int")).eqNullSafe(w)).cast("int"))
    lined = aligned.join(item_words, "item_id").join(words, ["k1", "k2"]).select("k1", "k2", "item_id", beside.alias("same"))
    span = F.least(F.lit(window), F.size("same"))
    most = _most_within("same", span)
    spared = F.when(F.col("span") < min(max(WHOLE, substitutions + 1), window), F.lit(0)).otherwise(F.lit(substitutions))
    found = lined.select("k1", "k2", "item_id", most.alias("words"), span.alias("span")).where(F.col("words") >= F.col("span") - spared)
    return materialize(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("most_words")), "verdict")[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """doc_id, contaminated, kept, n_items, item_ids (ascending), most_words (most agreeing words in a window) for every row."""
    verdict = verdicts(docs, benchmark, text_column=text_column, **options)
    keyed = keyed_texts(docs.select(F.col(id_column).alias("doc_id"), text_column), text_column).select("doc_id", F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    joined = keyed.join(checked_broadcast(verdict), ["k1", "k2"], "left")
    return joined.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.col("item_ids").isNull().alias("kept"),
        F.when(F.col("item_ids").isNull(), F.lit(0)).otherwise(F.size("item_ids")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast(dict(verdict.dtypes)["item_ids"])).alias("item_ids"),
        F.coalesce(F.col("most_words").cast("int"), F.lit(0)).alias("most_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all of their columns."""
    verdict = verdicts(docs, benchmark, text_column=text_column, **options).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return keyed_texts(docs, text_column).join(checked_broadcast(verdict), ["__k1", "__k2"], "left_anti").select(*docs.columns)
