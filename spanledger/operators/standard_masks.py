"""Matching against a catalog of bounded vocabulary: one row of bit masks for each subject.

Words, phrases, articles and sections of such a catalog are numbered. A subject
is then a few longs, gathered by one aggregation that combines map-side, and
everything about a (subject, standard) pair is computed in its row: no row is
made for a matched phrase, and pairs are never shuffled. Catalogs beyond the
bounds go through the joins of :mod:`spanledger.operators.standards`, with the
same results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanledger.functions import rules

#: Bits of a mask column; the sign is left out.
WIDTH = 60
#: Bounds of a catalog that is numbered: rows of one table, standards, words or phrases.
CATALOG_ROWS, CATALOG_STANDARDS, CATALOG_VALUES = 16_384, 256, 600

#: Bits whose values are looked up at once, in a list for each of their combinations.
CHUNK = 8

#: Feature tokens that stand for articles.
ARTICLE_TOKENS = ("12", "13", "14", "15", "50")


def is_feature(token: Column) -> Column:
    return ~token.isin(*ARTICLE_TOKENS) & ~token.startswith("article-") & ~token.startswith("annex-iv-")


def _feature(token: str) -> bool:
    return token not in ARTICLE_TOKENS and not token.startswith(("article-", "annex-iv-"))


class Bits:
    """Values of one kind and their places in the mask columns."""

    def __init__(self, kind: str, values: Iterable[str]):
        self.kind = kind
        self.places = {value: n for n, value in enumerate(sorted(set(values)))}
        self.columns = [f"{kind}{n}" for n in range(-(-len(self.places) // WIDTH))]

    def masks(self, values: Iterable[str]) -> list[int]:
        out = [0] * len(self.columns)
        for value in values:
            place = self.places.get(value)
            if place is not None:
                out[place // WIDTH] |= 1 << place % WIDTH
        return out

    def place(self, value: str | None) -> tuple[int, int]:
        """Column number and bit; no bit for a value that nothing matches."""
        n = self.places.get(value)
        return (0, 0) if n is None else (n // WIDTH, 1 << n % WIDTH)


def bounded_rows(df: DataFrame, limit: int = CATALOG_ROWS) -> list | None:
    """The rows of a catalog table, or None beyond ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows as a local relation, which needs no task to be read."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = [dict(zip(schema.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(listed, schema=to_arrow_schema(schema)), schema)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def common(one: list[Column], other: list[Column]) -> Column:
    """Number of bits that two rows of masks share."""
    return reduce(lambda a, b: a + b, (F.bit_count(a.bitwiseAND(b)) for a, b in zip(one, other, strict=True)), F.lit(0)).cast("bigint")


def subject_masks(tokens: DataFrame, pieces: list[Bits], wholes: list[tuple[Bits, Callable[[str], str | None]]]) -> DataFrame:
    """One row for each subject: flags of what it supplied, and its masks.

    ``pieces`` are matched by the words of feature tokens; ``wholes`` by whole
    tokens, after a function that gives the token of a value or None. Tokens may repeat.
    """
    bits = [*pieces, *(b for b, _ in wholes)]
    columns = [name for b in bits for name in b.columns]
    known: dict[tuple[bool, str], dict[str, int]] = {}
    for b, token_of, whole in [*((b, str, False) for b in pieces), *((b, f, True) for b, f in wholes)]:
        for value in b.places:
            n, bit = b.place(value)
            if (key := token_of(value)) is not None:
                known.setdefault((whole, key), {})[b.columns[n]] = bit
    schema = T.StructType([T.StructField("whole", T.BooleanType()), T.StructField("key", T.StringType()), *(T.StructField(name, T.LongType()) for name in columns)])
    dimension = local_rows(tokens.sparkSession, [(*key, *(found.get(name, 0) for name in columns)) for key, found in known.items()], schema)
    c = F.col
    token = c("token")
    feature = is_feature(token)
    keys = F.when(feature, F.concat(F.array(token), F.split(token, "-"))).otherwise(F.array(token)) if pieces else F.array(token)
    rows = tokens.filter("token is not null").select(
        "subject",
        feature.cast("int").alias("f"),
        token.rlike("^[0-9]+$").cast("int").alias("a"),
        token.startswith("annex-iv-").cast("int").alias("x"),
        F.posexplode(keys).alias("at", "key"),
    )
    return (
        rows.withColumn("whole", c("at") == 0)
        .join(F.broadcast(dimension), ["whole", "key"], "left")
        .groupBy("subject")
        .agg(
            F.max("f").alias("has_features"),
            F.max("a").alias("has_articles"),
            F.max("x").alias("has_annex"),
            *(F.coalesce(F.bit_or(name), F.lit(0).cast("bigint")).alias(name) for name in columns),
        )
    )


@dataclass
class Masks:
    """A catalog as masks: rows of standards and the numbering of its parts."""

    sizes: list
    by_standard: dict[str, dict[str | None, list[str | None]]]
    words: Bits
    phrases: Bits
    articles: Bits
    annex: Bits
    phrase_words: list[tuple[str, list[str]]]

    _PARTS = (("characteristics", "c"), ("evidence_characteristics", "e"), ("articles", "r"), ("annex", "n"))

    def bits_of(self, part: str) -> Bits:
        return {"articles": self.articles, "annex": self.annex}.get(part, self.phrases)

    def subjects(self, tokens: DataFrame) -> DataFrame:
        """Flags and masks ``m`` (matched phrases), ``r`` (articles) and ``n`` (sections) of each subject."""
        rows = subject_masks(
            tokens,
            [self.words],
            [(self.phrases, lambda v: v if _feature(v) else None), (self.articles, lambda v: v.removeprefix("Article ")), (self.annex, str)],
        )
        flags = ("has_features", "has_articles", "has_annex")
        matched = []
        for n, name in enumerate(self.phrases.columns):
            tests = []
            for phrase, words in self.phrase_words:
                column, bit = self.phrases.place(phrase)
                if column == n and words:
                    fields = ", ".join(f"'{k}', {m}L" for k, m in zip(self.words.columns, self.words.masks(words), strict=True))
                    tests.append(f"named_struct('bit', {bit}L, 'least', {len(words)}{', ' if fields else ''}{fields})")
            exact = F.col(name)
            if tests and self.words.columns:

                def gathered(mask: Column, test: Column) -> Column:
                    shared = common([F.col(k) for k in self.words.columns], [test[k] for k in self.words.columns])
                    return F.when(shared * 2 >= test["least"], mask.bitwiseOR(test["bit"])).otherwise(mask)

                exact = F.aggregate(F.expr(f"array({', '.join(tests)})"), exact, gathered)
            matched.append(exact.alias(f"m{n}"))
        return rows.select("subject", *flags, *matched, *self.articles.columns, *self.annex.columns)

    def own(self, part: str) -> list[Column]:
        """Columns of a subject that answer to a part of a standard."""
        columns = self.bits_of(part).columns
        return [F.col(name.replace("p", "m", 1)) for name in columns]

    def part_masks(self, standard: str | None) -> dict[str, int]:
        out = {}
        for part, letter in self._PARTS:
            masks = self.bits_of(part).masks(self.by_standard[part].get(standard, ()))
            out |= {f"{letter}_{n}": mask for n, mask in enumerate(masks)}
        return out

    def matched(self, part: str, of: Callable[[str], Column] = F.col) -> Column:
        """Number of a part's values that the subject of the row matches; ``of`` gives a field of the standard."""
        letter = dict(self._PARTS)[part]
        own = self.own(part)
        return common(own, [of(f"{letter}_{n}") for n in range(len(own))])

    def standards(self, spark: SparkSession) -> DataFrame:
        """One row for each standard: sizes and part masks."""
        rows = [row.asDict() | self.part_masks(row["standard_id"]) for row in self.sizes if row["standard_id"] is not None]
        names = self.part_masks(None)
        fields = "standard_id string, ord int, characteristic_count long, article_count long, annex_count long, evidence_count long"
        schema = ", ".join([fields, *(f"{name} long" for name in names)])
        order = [f.split()[0] for f in schema.split(", ")]
        return local_rows(spark, [tuple(row[name] for name in order) for row in rows], schema)

    def lists(self, spark: SparkSession, parts: tuple[str, ...]) -> DataFrame:
        """``(standard_id, all, values, masks)`` of every standard with such parts.

        ``all`` has the values in code-point order; ``values`` has them with
        their places in :meth:`subject_lists`. A value of two kinds stands there twice.
        """
        kinds = self._starts(parts)
        rows = []
        for standard in sorted({s for part in parts for s in self.by_standard[part]}, key=str):
            values = set()
            for part in parts:
                bits = self.bits_of(part)
                for value in self.by_standard[part].get(standard, ()):
                    n, bit = bits.place(value)
                    values.add((value, kinds[bits.kind] + n + 1 if bit else 1, bit))
            values = sorted(values, key=lambda v: (v[0] is None, v[0] or "", v[1]))
            named = [dict(zip(("value", "at", "bit"), v, strict=True)) for v in values]
            rows.append((standard, [v[0] for v in values], named, all(v[2] for v in values), *self.part_masks(standard).values()))
        schema = "standard_id string, all array<string>, values array<struct<value: string, at: int, bit: bigint>>, whole boolean"
        return local_rows(spark, rows, ", ".join([schema, *(f"{name} bigint" for name in self.part_masks(None))]))

    def _starts(self, parts: tuple[str, ...]) -> dict[str, int]:
        """Where the mask columns of each kind begin in :meth:`subject_lists`."""
        starts, n = {}, 0
        for part in parts:
            bits = self.bits_of(part)
            if bits.kind not in starts:
                starts[bits.kind] = n
                n += len(bits.columns)
        return starts

    def subject_lists(self, tokens: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        """:meth:`subjects` with all masks of some parts in one array ``own``."""
        masks = {self.bits_of(part).kind: self.own(part) for part in parts}
        return self.subjects(tokens).withColumn("own", F.array(*(m for own in masks.values() for m in own), F.lit(0).cast("bigint")))

    def _chunks(self, parts: tuple[str, ...]) -> list[tuple[int, int, list[str]]]:
        """Runs of neighbouring bits in the order of their values: (place of the mask column, first bit, values)."""
        starts, every = self._starts(parts), {self.bits_of(part).kind: self.bits_of(part) for part in parts}
        placed = sorted((value, starts[kind] + n // WIDTH, n % WIDTH) for kind, bits in every.items() for value, n in bits.places.items())
        chunks: list[tuple[int, int, list[str]]] = []
        for value, column, bit in placed:
            if chunks and chunks[-1][0] == column and len(chunks[-1][2]) < CHUNK and chunks[-1][1] + len(chunks[-1][2]) == bit:
                chunks[-1][2].append(value)
            else:
                chunks.append((column, bit, [value]))
        return chunks

    def with_shared_values(self, pairs: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        """``pairs`` with the values that subject and standard share, as the array ``values`` in code-point order.

        A value of two kinds stands there twice. Eight bits choose a ready list,
        so a pair costs as many lookups as its masks have bytes.
        """
        shared: dict[str, Column] = {}
        for part in parts:
            letter, bits = dict(self._PARTS)[part], self.bits_of(part)
            for n, mine in enumerate(self.own(part)):
                name = f"h{self._starts(parts)[bits.kind] + n}"
                both = mine.bitwiseAND(F.col(f"{letter}_{n}"))
                shared[name] = shared[name].bitwiseOR(both) if name in shared else both
        lists = []
        for column, first, values in self._chunks(parts):
            table = json.dumps([[v for n, v in enumerate(values) if chosen >> n & 1] for chosen in range(1 << len(values))])
            chosen = F.shiftright(f"h{column}", first).bitwiseAND(F.lit((1 << len(values)) - 1)).cast("int")
            lists.append(F.get(F.from_json(F.lit(table), "array<array<string>>"), chosen))
        values = F.concat(*lists) if lists else F.array().cast("array<string>")
        return pairs.withColumns(shared).withColumn("values", values)

    def pairs(self, subjects: DataFrame, standards: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        """Subjects beside the standards of which they match something."""
        return subjects.crossJoin(F.broadcast(standards)).filter(_any([self.matched(part) > 0 for part in parts]))

    def all_held(self, parts: tuple[str, ...]) -> Column:
        """Whether the subject of the row matches all that the standard has."""
        tests = [F.col("whole")]
        for part in parts:
            letter = dict(self._PARTS)[part]
            for n, mine in enumerate(self.own(part)):
                tests.append(mine.bitwiseAND(F.col(f"{letter}_{n}")) == F.col(f"{letter}_{n}"))
        return reduce(lambda a, b: a & b, tests)

    @staticmethod
    def holds(value: Column) -> Column:
        """Whether the subject of the row has the bit of a value of :meth:`lists`."""
        return F.element_at("own", value["at"]).bitwiseAND(value["bit"]) != 0


def catalog_masks(tables: dict[str, DataFrame], sizes: DataFrame | None) -> Masks | None:
    """The catalog as masks, or None where it exceeds the bounds."""
    by_standard: dict[str, dict[str | None, list[str | None]]] = {}
    for part, column in (("characteristics", "characteristic"), ("evidence_characteristics", "characteristic"), ("articles", "article"), ("annex", "annex")):
        listed = by_standard[part] = {}
        if part not in tables:
            continue
        rows = bounded_rows(tables[part].select("standard_id", column))
        if rows is None:
            return None
        for standard, value in rows:
            listed.setdefault(standard, []).append(value)
    values = {part: {v for own in listed.values() for v in own if v} for part, listed in by_standard.items()}
    phrases = values["characteristics"] | values["evidence_characteristics"]
    phrase_words = [(p, sorted(set(p.split("-")) - {""} - set(rules.PHRASE_STOP_WORDS))) for p in sorted(phrases)]
    words = {w for _, own in phrase_words for w in own} - set(rules.FEATURE_STOP_WORDS)
    known = Bits("p", phrases)
    articles = Bits("r", (a for a in values["articles"] if re.fullmatch("Article [0-9]+", a)))
    annex = Bits("n", (a for a in values["annex"] if a.startswith("annex-iv-")))
    rows = bounded_rows(sizes, CATALOG_STANDARDS) if sizes is not None else []
    standards = {s for listed in by_standard.values() for s in listed}
    if rows is None or max(len(words), len(known.places), len(articles.places), len(annex.places)) > CATALOG_VALUES or len(standards) > CATALOG_STANDARDS:
        return None
    return Masks(rows, by_standard, Bits("w", words), known, articles, annex, phrase_words)
