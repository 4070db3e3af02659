"""Mixing sources to target weights by hash order and exact budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanledger.llm.common import WORD, hash_bits, key_text, pack_row, unpack_row, word_count
from spanledger.session import materialize

#: Hash ranges of a source whose sums are added up side by side.
PARTS = 4096
_KEY = ["key", "id", "size", "check"]


def _slim(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """The sort key of every record: a hash of its id, then what tells rows apart."""
    return docs.select(
        F.col(source_col).alias("source"),
        hash_bits(key_text(F.col(id_col))).alias("key"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("check"),
    )


def _ranked(totals: DataFrame) -> DataFrame:
    """Totals with a rank by source (code points, null last) from a range sort.

    The rank inside a range comes from the row ids of the sorted table, the
    ranks before it from the row counts of the ranges.
    """
    ordered = materialize(
        totals.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id())
    )
    place = ordered.withColumn("range", F.shiftright("row", 33)).withColumn("at", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of the sort, whatever the number of sources.
    offsets = (
        place.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return place.join(F.broadcast(offsets), "range").select("source", "source_size", (F.col("at") + F.col("offset")).alias("rank"))


def source_targets(slim: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: its size and target, by weights in code-point order.

    The targets share ``share`` times all sizes by weight. None exceeds
    ``cap`` times its source's size; what is above is shared again by weight
    among the others until none is above.
    """
    totals = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sources = materialize(
        _ranked(totals).select(
            "source",
            "source_size",
            F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(cap))).alias("most"),
        )
    )
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("most") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(full, F.col("most"))).alias("held"),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("free"),
        ).first()
        free = row["free"] or 0.0
        if not free:
            break
        risen = (whole * float(share) - (row["held"] or 0.0)) / free
        if risen <= level:
            break
        level = risen
    return sources.select(
        "source",
        "source_size",
        F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(records, sources): the sort keys of all records and the budget of each source.

    Each source's records stand in the order of a hash of their ids. The
    source is taken whole ``epochs`` times; the records before its cut are
    taken once more and the record at the cut gives ``at_cut`` words, so the
    words taken are the target's whole number. The cut is found from the sums
    of ``PARTS`` hash ranges; only the range that holds it is sorted.
    """
    slim = materialize(_slim(docs, id_col, source_col, text_col))
    sources = materialize(source_targets(slim, weights, share, cap))
    sources = sources.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    ).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    part = F.shiftright("key", 60 - PARTS.bit_length() + 1)
    sums = slim.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("part")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    holding = (
        sums.withColumn("after", F.sum("words").over(upto))
        .alias("a")
        .join(sources.alias("b"), same)
        .filter((F.col("after") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("after")))
        .select("a.source", "part", (F.col("rest") - F.col("after") + F.col("words")).alias("left"))
    )
    # Equal keys (repeated rows) share what is left at the cut.
    inside = (
        slim.withColumn("part", part)
        .alias("a")
        .join(holding.alias("b"), same & (F.col("a.part") == F.col("b.part")))
        .select("a.source", *_KEY, "left")
        .groupBy("source", *_KEY, "left")
        .agg(F.count("*").alias("copies"))
    )
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size", "check")
    words = F.col("size") * F.col("copies")
    cuts = (
        inside.withColumn("after", F.sum(words).over(order))
        .filter((F.col("after") - words <= F.col("left")) & (F.col("left") < F.col("after")))
        .select(
            "source",
            *(F.col(c).alias(f"cut_{c}") for c in _KEY),
            F.floor((F.col("left") - F.col("after") + words) / F.col("copies")).cast("long").alias("at_cut"),
        )
    )
    joined = sources.alias("a").join(cuts.alias("b"), same, "left").drop(F.col("b.source"))
    return slim, materialize(joined)


def _taken() -> tuple[Column, Column]:
    """(whole epochs of a record, words of a last partial one)."""
    at = F.struct("key", F.struct(F.col("id").isNotNull(), "id"), "size", "check")
    cut = F.struct("cut_key", F.struct(F.col("cut_id").isNotNull(), "cut_id"), "cut_size", "cut_check")
    # Without a cut the rest is 0 and no record is taken once more.
    before = F.col("cut_key").isNotNull() & (at < cut)
    return (
        F.col("epochs") + before.cast("int"),
        F.when(F.col("cut_key").isNotNull() & (at == cut), F.col("at_cut")).otherwise(F.lit(0)),
    )




def mix_records(docs: DataFrame, **options) -> DataFrame:
    """One row per record: id, size, source, source_size, target and words taken.

    ``taken`` counts repeats. A null text, and one without words, has size 0
    and takes nothing. A null source is a source of its own and comes last.
    Repeated rows count each. An empty table gives no rows. Other columns are
    ignored. The order depends on ids alone, so a rerun agrees.
    """
    slim, sources = mix_plan(docs, **options)
    whole, part = _taken()
    return (
        slim.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", *(F.col(f"s.{c}") for c in sources.columns if c != "source"))
        .select(
            "id",
            "size",
            "source",
            "source_size",
            "target",
            (whole * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def _first_words(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    import re

    word = re.compile(WORD)
    for texts, counts in parts:
        out = []
        for text, n in zip(texts, counts, strict=True):
            end = 0
            if text is not None and n and n > 0:
                for i, found in enumerate(word.finditer(text), 1):
                    if i == n:
                        end = found.end()
                        break
            out.append(text[:end] if text is not None else None)
        yield pd.Series(out, dtype=object)


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``.

    A document comes once for each epoch that takes it whole; the one at its
    source's cut comes once more with the text up to the cut. Documents that
    take no words are gone. Text is cut for one document of a source.
    """
    _, sources = mix_plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    keyed = docs.select(
        pack_row(docs),
        F.col(source_col).alias("source"),
        hash_bits(key_text(F.col(id_col))).alias("key"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("check"),
    ).filter(F.col("size") > 0)
    whole, part = _taken()
    rows = (
        keyed.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", *(F.col(f"s.{c}") for c in sources.columns if c != "source"))
        .select("__row", whole.alias("whole"), part.alias("part"))
    )
    cut_text = F.pandas_udf(_first_words, "string")
    # Only a document at a cut sends its text to Python.
    sent = F.when(F.col("part") > 0, F.col(f"__row.{text_col}"))
    rows = rows.withColumn("cut", cut_text(sent, F.col("part")))
    times = F.flatten(
        F.array(
            F.array_repeat(F.lit(False), F.col("whole").cast("int")),
            F.array_repeat(F.lit(True), (F.col("part") > 0).cast("int")),
        )
    )
    rows = rows.select("__row", "cut", F.explode(times).alias("is_cut"))
    rows = rows.select(
        F.when(F.col("is_cut"), F.col("__row").withField(text_col, F.col("cut"))).otherwise(F.col("__row")).alias("__row")
    )
    return unpack_row(rows, docs.columns)
