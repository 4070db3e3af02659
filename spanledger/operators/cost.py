"""Token usage and EUR cost (CST-01 to CST-06, AGG-09, AGG-10, VAL-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.functions import variants as V
from spanledger.operators.skew import lookup_join
from spanledger.session import broadcast_if_small, fits_broadcast, hold
from spanledger.sources.tables import _values_of, folded_entries

MONEY = "decimal(38,12)"
#: The largest rate has 13 whole digits.
RATE = "decimal(25,12)"
TOKEN_COLUMNS = (
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "cached_input_tokens",
    "reasoning_tokens",
)
MONEY_COLUMNS = (
    "uncached_input_cost_eur",
    "cached_input_cost_eur",
    "non_reasoning_output_cost_eur",
    "reasoning_output_cost_eur",
    "input_cost_eur",
    "output_cost_eur",
    "total_cost_eur",
)
RATE_COLUMNS = ("input_rate", "output_rate", "cached_input_rate", "reasoning_rate")

_TOKEN_KEYS = sorted(
    {key for names in rules.USAGE_ALIASES.values() for key in rules.squash(names)}
    | set(rules.squash(rules.USAGE_DETAILS))
)
_CONTAINERS = rules.squash(rules.USAGE_CONTAINERS)


def _sql_set(names) -> str:
    return "(" + ", ".join(f"'{name}'" for name in names) + ")"


def locate_usage(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``usage``, the usage object inside a provider payload (text or VARIANT), at any depth.

    Container keys come first, then an object that itself looks like usage,
    then the other children in order. Each node carries a sort key whose parts
    say which of the three it is; the smallest key wins.
    """
    if payloads.schema[payload].dataType.typeName() == "string":
        root = f"try_parse_json({payload})"
    else:
        root = payload
    folded = "regexp_replace(lower(e.key), '[^a-z0-9]', '')"
    def decoded(v: str) -> str:
        head = f"left(trim(leading ' \\n\\t\\r' from {V.sql_text(v)}), 1)"
        return f"if(schema_of_variant({v}) = 'STRING' and {head} in ('[', '{{'), try_parse_json({V.sql_text(v)}), {v})"

    place = "lpad(cast(p as string), 10, '0')"
    # A level needs a bracket, also inside JSON that stands in a text; the search ends earlier if nothing is open.
    written = payload if payloads.schema[payload].dataType.typeName() == "string" else f"to_json({payload})"
    depth = f"length(regexp_replace({written}, '[^{{\\\\[]', '')) + 1"
    of_object = (
        f"transform(map_entries({V.sql_map('n.v')}), (e, p) -> named_struct("
        f"'k', concat(n.k, if({folded} in {_sql_set(_CONTAINERS)}, '0', '2'), {place}, '/'), "
        f"'v', {decoded('e.value')}, 'open', true))"
    )
    of_list = (
        f"transform({V.sql_list('n.v')}, (q, p) -> named_struct("
        f"'k', concat(n.k, '2', {place}, '/'), 'v', {decoded('q')}, 'open', true))"
    )
    itself = "array(named_struct('k', concat(n.k, '1'), 'v', n.v, 'open', false))"
    grown = (
        f"if(not n.open, array(n), concat({itself}, coalesce({of_object}, {of_list}, "
        "cast(array() as array<struct<k:string,v:variant,open:boolean>>))))"
    )
    nodes = f"""aggregate(sequence(0, coalesce({depth}, 0)),
        named_struct('done', false, 'items', array(named_struct('k', '', 'v', {root}, 'open', true))),
        (acc, i) -> if(acc.done, acc, named_struct(
            'done', not exists(acc.items, n -> n.open),
            'items', flatten(transform(acc.items, n -> {grown})))),
        acc -> acc.items)"""
    looks = (
        f"exists(map_keys({V.sql_map('n.v')}), k -> "
        f"regexp_replace(lower(k), '[^a-z0-9]', '') in {_sql_set(_TOKEN_KEYS)})"
    )
    candidates = f"filter({nodes}, n -> not n.open and coalesce({looks}, false))"
    best = (
        f"array_sort({candidates}, (a, b) -> case when a.k < b.k then -1 when a.k > b.k then 1 else 0 end)"
    )
    return hold(payloads.withColumn("usage", F.expr(f"get({best}, 0).v")))


def _count(text: Column) -> Column:
    """Exact non-negative integer text to BIGINT, else null."""
    whole = F.regexp_replace(text, r"\.0+$", "")
    number = F.when(whole.rlike(r"^\+?[0-9]+$"), whole).try_cast("decimal(38,0)")
    return F.when(number <= rules.MAX_EXACT_TOKENS, number.cast("bigint"))


def extract_token_usage(
    usage_rows: DataFrame, *, allow_missing: bool = False, allow_total_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(token_usage, rejects)`` from the ``usage`` object of each row."""
    c = F.col
    details = _sql_set(rules.squash(rules.USAGE_DETAILS))
    opened = usage_rows.withColumn("entries", folded_entries("usage")).withColumn(
        "detail_entries",
        F.expr(
            f"flatten(transform(filter(entries, e -> e.key in {details}), "
            f"e -> coalesce(transform(map_entries({V.sql_map('e.value')}), d -> named_struct("
            "'key', regexp_replace(lower(d.key), '[^a-z0-9]', ''), 'value', d.value)), "
            "cast(array() as array<struct<key:string,value:variant>>))))"
        ),
    )
    direct = {f: _values_of("entries", names) for f, names in rules.USAGE_ALIASES.items()}
    nested = {
        f: _values_of("detail_entries", names)
        for f, names in rules.USAGE_ALIASES.items()
        if f in ("input", "output", "cached", "reasoning")
    }
    staged = opened.select(
        "*",
        *(
            (F.when(F.size(direct[f]) > 0, direct[f]).otherwise(nested[f]) if f in nested else direct[f]).alias(f"v_{f}")
            for f in rules.USAGE_ALIASES
        ),
    )
    counted = staged.select(
        "*",
        *(F.array_distinct(F.transform(f"v_{f}", _count)).alias(f"n_{f}") for f in rules.USAGE_ALIASES),
    )
    value = {f: F.get(f"n_{f}", F.lit(0)) for f in rules.USAGE_ALIASES}
    problems = [
        F.when(F.size(f"n_{f}") > 1, F.lit(f"conflicting {f} counts")) for f in rules.USAGE_ALIASES
    ] + [
        F.when(F.exists(f"n_{f}", lambda n: n.isNull()), F.lit(f"{f} count is not an exact integer"))
        for f in rules.USAGE_ALIASES
    ]
    no_parts = (F.size("n_input") == 0) & (F.size("n_output") == 0)
    if not allow_missing:
        problems.append(F.when(c("usage").isNull(), F.lit("no usage object found")))
    problems.append(
        F.when(c("usage").isNotNull() & no_parts & (F.size("n_total") == 0), F.lit("no input or output count"))
    )
    if not allow_total_only:
        problems.append(F.when(no_parts & (F.size("n_total") > 0), F.lit("only a total was reported")))
    filled = counted.withColumn("problems", F.array_compact(F.array(*problems))).select(
        *usage_rows.columns,
        "problems",
        F.coalesce(value["input"], F.when(no_parts, value["total"]), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(value["output"], F.lit(0)).cast("bigint").alias("output_tokens"),
        value["total"].alias("reported_total"),
        (F.coalesce(value["cached"], F.lit(0)) + F.coalesce(value["cache_creation"], F.lit(0))).cast("bigint").alias("cached_input_tokens"),
        F.coalesce(value["reasoning"], F.lit(0)).cast("bigint").alias("reasoning_tokens"),
    ).withColumn("total_tokens", c("input_tokens") + c("output_tokens"))
    checked = filled.withColumn(
        "problems",
        F.concat(
            "problems",
            F.array_compact(
                F.array(
                    F.when(
                        (F.size("problems") == 0) & (c("reported_total") != c("total_tokens")),
                        F.lit("total differs from input + output"),
                    )
                )
            ),
            F.when(F.size("problems") == 0, usage_problems()).otherwise(F.array().cast("array<string>")),
        ),
    ).drop("reported_total")
    checked = hold(checked)
    good = checked.filter(F.size("problems") == 0).drop("problems")
    bad = checked.filter(F.size("problems") > 0).select(
        *usage_rows.columns, F.array_join("problems", "; ").alias("reason")
    )
    return good, bad


def usage_problems() -> Column:
    """Rules over the five token columns as an array of texts (VAL-13)."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(F.least(*(c(t) for t in TOKEN_COLUMNS)) < 0, F.lit("negative token count")),
            F.when(F.greatest(*(c(t) for t in TOKEN_COLUMNS)) > rules.MAX_EXACT_TOKENS, F.lit("token count above the exact limit")),
            F.when(c("total_tokens") != c("input_tokens") + c("output_tokens"), F.lit("total is not input + output")),
            F.when(c("cached_input_tokens") > c("input_tokens"), F.lit("cached exceeds input")),
            F.when(c("reasoning_tokens") > c("output_tokens"), F.lit("reasoning exceeds output")),
        )
    )


def usage_checks(usage: DataFrame) -> DataFrame:
    """Rows that break a usage rule, one row per broken rule."""
    return usage.withColumn("problem", F.explode(usage_problems()))


def estimate_tokens(text: Column) -> Column:
    """Four UTF-8 bytes per token, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("bigint")


def _money(tokens: Column, rate: Column) -> Column:
    """tokens x rate / 1e6, half-up at 12 decimals."""
    # Whole millions and the rest apart, so that the largest counts and rates stay exact in 38 digits.
    rate = rate.cast(RATE)
    millions = F.floor(tokens / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(10,0)")
    rest = F.pmod(tokens, F.lit(1_000_000)).cast("decimal(6,0)")
    part = rest * (rate * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(25,18)")
    return (millions * rate + F.round(part, 12)).cast(MONEY)


def priced(usage: DataFrame, rate_cards: DataFrame, default_model: str | None = None) -> DataFrame:
    """Usage with its rate card (JN-05); ``default_model`` prices unknown models."""
    cards = rate_cards.select("model", *RATE_COLUMNS)
    joined = lookup_or_broadcast(usage, cards, ["model"])
    if default_model is None:
        return joined
    fallback = broadcast_if_small(
        cards.filter(F.col("model") == default_model).select(
            F.lit(default_model).alias("default_model"),
            *(F.col(r).alias(f"default_{r}") for r in RATE_COLUMNS),
        )
    )
    known = F.col("input_rate").isNotNull()
    both = joined.withColumn("default_model", F.lit(default_model)).join(fallback, "default_model", "left")
    picked = both.select(
        *(c for c in joined.columns if c not in RATE_COLUMNS),
        *(F.when(known, F.col(r)).otherwise(F.col(f"default_{r}")).alias(r) for r in RATE_COLUMNS),
    )
    return picked


def lookup_or_broadcast(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Broadcast the right side when it is measured as small, else a lookup join."""
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, "left")
    return lookup_join(left, right, on)


def priced_by_position(usage: DataFrame, rate_cards: DataFrame) -> DataFrame:
    """Positional pairing: record ``position`` n takes the card at ``position`` n."""
    return usage.join(rate_cards.select("position", "model", *RATE_COLUMNS), "position", "left")


def token_cost(priced_usage: DataFrame) -> DataFrame:
    """Add the cost columns.

    ``cached_input_rate_override`` and ``reasoning_rate_override`` columns win
    when present. Cached and reasoning rates default to input and output rates.
    """
    c = F.col
    names = priced_usage.columns

    def rate(name: str, default: str) -> Column:
        choices = [c(f"{name}_override")] if f"{name}_override" in names else []
        return F.coalesce(*choices, c(name), c(default)).cast(RATE)

    rated = priced_usage.withColumn("cached_input_rate", rate("cached_input_rate", "input_rate")).withColumn(
        "reasoning_rate", rate("reasoning_rate", "output_rate")
    )
    parts = rated.select(
        "*",
        _money(c("input_tokens") - c("cached_input_tokens"), c("input_rate")).alias("uncached_input_cost_eur"),
        _money(c("cached_input_tokens"), c("cached_input_rate")).alias("cached_input_cost_eur"),
        _money(c("output_tokens") - c("reasoning_tokens"), c("output_rate")).alias("non_reasoning_output_cost_eur"),
        _money(c("reasoning_tokens"), c("reasoning_rate")).alias("reasoning_output_cost_eur"),
    )
    sums = parts.select(
        "*",
        (c("uncached_input_cost_eur") + c("cached_input_cost_eur")).cast(MONEY).alias("input_cost_eur"),
        (c("non_reasoning_output_cost_eur") + c("reasoning_output_cost_eur")).cast(MONEY).alias("output_cost_eur"),
    )
    return sums.withColumn("total_cost_eur", (c("input_cost_eur") + c("output_cost_eur")).cast(MONEY))


def scale_costs(costs: DataFrame, count: str, multiplier: int = 1) -> DataFrame:
    """Multiply tokens and money by ``count`` x ``multiplier`` evaluations.

    An amount beyond the exact range becomes null; it does not fail the job.
    """
    if multiplier < 0:
        raise ValueError("evaluation multiplier cannot be negative")
    factor = F.try_multiply(F.col(count).cast("bigint"), F.lit(multiplier).cast("bigint"))
    return costs.withColumns(
        {
            "evaluation_count": factor.cast("bigint"),
            **{t: F.try_multiply(F.col(t).cast("bigint"), factor) for t in TOKEN_COLUMNS},
            **{m: F.try_multiply(F.col(m).cast(MONEY), factor.cast("decimal(19,0)")).try_cast(MONEY) for m in MONEY_COLUMNS},
        }
    )


def token_totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Token sums per group; a sum above the exact limit fails the job."""
    fields = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")
    sums = usage.groupBy(*by).agg(*(F.sum(F.col(f).cast("decimal(28,0)")).alias(f) for f in fields))
    over = F.greatest(*(F.col(f) for f in fields)) > rules.MAX_EXACT_TOKENS
    checked = sums.select(
        *by,
        *(
            F.when(over, F.raise_error(F.lit("aggregated token count exceeds exact limit")))
            .otherwise(F.col(f).cast("bigint"))
            .cast("bigint")
            .alias(f)
            for f in fields
        ),
    )
    return checked.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def cost_rollup(costs: DataFrame, by: list[str]) -> DataFrame:
    """Sums per group; model and rates only where all records agree."""
    rows = costs if "evaluation_count" in costs.columns else costs.withColumn("evaluation_count", F.lit(1).cast("bigint"))

    def agreed(name: str) -> Column:
        # A null rate counts as a value of its own.
        same = F.min(name).eqNullSafe(F.max(name)) & (F.count(name).isin(0) | (F.count(name) == F.count("*")))
        return F.when(same, F.max(name)).alias(name)

    model = F.when(F.min("model").eqNullSafe(F.max("model")), F.max("model")).otherwise("multiple")
    grouped_model = [] if "model" in by else [model.alias("model")]
    return rows.groupBy(*by).agg(
        *grouped_model,
        *(F.sum(t).alias(t) for t in TOKEN_COLUMNS),
        *(F.sum(m).cast(MONEY).alias(m) for m in MONEY_COLUMNS),
        *(agreed(r) for r in RATE_COLUMNS),
        F.sum("evaluation_count").alias("evaluation_count"),
    )


def cost_checks(costs: DataFrame) -> DataFrame:
    """Declared amounts that do not add up, one row per broken rule (CST-06)."""
    c = F.col
    broken = F.array_compact(
        F.array(
            F.when(c("input_cost_eur") != c("uncached_input_cost_eur") + c("cached_input_cost_eur"), F.lit("input cost is not the sum of its parts")),
            F.when(c("output_cost_eur") != c("non_reasoning_output_cost_eur") + c("reasoning_output_cost_eur"), F.lit("output cost is not the sum of its parts")),
            F.when(c("total_cost_eur") != c("input_cost_eur") + c("output_cost_eur"), F.lit("total cost is not input + output")),
            F.when(F.least(*(c(m) for m in MONEY_COLUMNS)) < 0, F.lit("negative amount")),
        )
    )
    return costs.withColumn("problem", F.explode(F.concat(broken, usage_problems())))
