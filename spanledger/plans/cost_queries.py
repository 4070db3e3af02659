"""Queries over token usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators import cost
from spanledger.plans.registry import query, table
from spanledger.sources.tables import read_rate_cards


def _text(*names: str) -> list:
    return [F.col(n).cast("string").alias(n) for n in names]


@query(
    "doc_token_estimates",
    "select doc_id, cast(ceil(octet_length(encode(text)) / 4.0) as bigint) as tokens from documents",
)
def doc_token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", cost.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "conv_token_totals",
    """with u as (select conv_id, case when role = 'assistant' then 0 else cast(ceil(octet_length(encode(text)) / 4.0) as bigint) end as i,
      case when role = 'assistant' then cast(ceil(octet_length(encode(text)) / 4.0) as bigint) else 0 end as o from conversations)
    select conv_id, cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens, cast(0 as bigint) as cached_input_tokens,
      cast(0 as bigint) as reasoning_tokens, cast(sum(i) + sum(o) as bigint) as total_tokens from u group by conv_id""",
)
def conv_token_totals(spark, folder):
    tokens = cost.estimate_tokens(F.col("text"))
    answer = F.col("role") == "assistant"
    usage = table(spark, folder, "conversations").select(
        "conv_id",
        F.when(answer, 0).otherwise(tokens).cast("bigint").alias("input_tokens"),
        F.when(answer, tokens).otherwise(0).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cached_input_tokens"),
        F.lit(0).cast("bigint").alias("reasoning_tokens"),
    )
    return cost.token_totals(usage, ["conv_id"])


# --- line costs: quantity as tokens, part brand as model --------------------------

_CARDS = """cards as (select p_brand as model,
  cast(cast(round(min(p_retailprice) * 100) as bigint) / 100 as decimal(24,12)) as input_rate,
  cast(cast(round(max(p_retailprice) * 100) as bigint) / 100 as decimal(24,12)) as output_rate,
  case when max(p_size) > 49 then cast(cast(round(min(p_retailprice) * 10) as bigint) / 100 as decimal(24,12)) end as cached_rate,
  case when min(p_size) > 1 then cast(cast(round(max(p_retailprice) * 300) as bigint) / 100 as decimal(24,12)) end as reasoning_rate
  from part group by p_brand)"""
_USAGE = """usage as (select l_orderkey, l_linenumber, p_brand as model, o_custkey,
  cast(l_quantity as bigint) * 1001 as i, cast(l_suppkey as bigint) % 97 as o,
  cast(l_linenumber as bigint) * 100 as c, (cast(l_suppkey as bigint) % 97) // 2 as r
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""
_PARTS = """parts as (select u.*, k.input_rate, k.output_rate, coalesce(k.cached_rate, k.input_rate) as cached_rate,
  coalesce(k.reasoning_rate, k.output_rate) as reasoning_rate from usage u join cards k on u.model = k.model),
costs as (select *, cast(round((i - c) * cast(input_rate as decimal(18,6)) * cast(0.000001 as decimal(7,6)), 12) as decimal(38,12)) as c1,
  cast(round(c * cast(cached_rate as decimal(18,6)) * cast(0.000001 as decimal(7,6)), 12) as decimal(38,12)) as c2,
  cast(round((o - r) * cast(output_rate as decimal(18,6)) * cast(0.000001 as decimal(7,6)), 12) as decimal(38,12)) as c3,
  cast(round(r * cast(reasoning_rate as decimal(18,6)) * cast(0.000001 as decimal(7,6)), 12) as decimal(38,12)) as c4 from parts)"""
_WITH = f"with {_CARDS}, {_USAGE}, {_PARTS}"


def _cards(spark, folder) -> DataFrame:
    cents = lambda c, k=100: (F.round(c * k, 0).cast("bigint").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,12)")
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("model")).agg(
        cents(F.min(price)).alias("input_rate"),
        cents(F.max(price)).alias("output_rate"),
        F.when(F.max(size) > 49, cents(F.min(price), 10)).alias("cached_input_rate"),
        F.when(F.min(size) > 1, cents(F.max(price), 300)).alias("reasoning_rate"),
    )


def _usage(spark, folder) -> DataFrame:
    c = F.col
    part = table(spark, folder, "part").select("p_partkey", c("p_brand").alias("model"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    output = c("l_suppkey") % 97
    return (
        table(spark, folder, "lineitem")
        .join(part, c("l_partkey") == c("p_partkey"))
        .join(orders, c("l_orderkey") == c("o_orderkey"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "model",
            "o_custkey",
            (c("l_quantity").cast("bigint") * 1001).alias("input_tokens"),
            output.alias("output_tokens"),
            (c("l_quantity").cast("bigint") * 1001 + output).alias("total_tokens"),
            (c("l_linenumber").cast("bigint") * 100).alias("cached_input_tokens"),
            F.floor(output / 2).cast("bigint").alias("reasoning_tokens"),
        )
    )


def _costs(spark, folder) -> DataFrame:
    return cost.token_cost(cost.priced(_usage(spark, folder), _cards(spark, folder)))


@query(
    "line_costs",
    f"""{_WITH} select l_orderkey, l_linenumber, model, cast(c1 as string) as uncached_input_cost_eur, cast(c2 as string) as cached_input_cost_eur,
    cast(c3 as string) as non_reasoning_output_cost_eur, cast(c4 as string) as reasoning_output_cost_eur,
    cast(c1 + c2 + c3 + c4 as string) as total_cost_eur from costs""",
)
def line_costs(spark, folder):
    return _costs(spark, folder).select(
        "l_orderkey", "l_linenumber", "model",
        *_text("uncached_input_cost_eur", "cached_input_cost_eur", "non_reasoning_output_cost_eur", "reasoning_output_cost_eur", "total_cost_eur"),
    )


def _rollup_sql(by: str) -> str:
    return f"""{_WITH} select {by}, cast(sum(i) as bigint) as input_tokens, cast(sum(o) as bigint) as output_tokens,
    cast(sum(i + o) as bigint) as total_tokens, cast(sum(c) as bigint) as cached_input_tokens, cast(sum(r) as bigint) as reasoning_tokens,
    cast(sum(c1) + sum(c2) as string) as input_cost_eur, cast(sum(c3) + sum(c4) as string) as output_cost_eur,
    cast(sum(c1) + sum(c2) + sum(c3) + sum(c4) as string) as total_cost_eur, count(*) as evaluation_count"""


_ROLLUP = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens")
_MONEY = ("input_cost_eur", "output_cost_eur", "total_cost_eur")


@query("cost_by_model", _rollup_sql("model") + ", cast(min(input_rate) as string) as input_rate from costs group by model")
def cost_by_model(spark, folder):
    rolled = cost.cost_rollup(_costs(spark, folder), ["model"])
    return rolled.select("model", *_ROLLUP, *_text(*_MONEY, "input_rate"), "evaluation_count")


@query(
    "cost_by_customer",
    _rollup_sql("o_custkey")
    + ", case when count(distinct model) = 1 then min(model) else 'multiple' end as model from costs group by o_custkey",
)
def cost_by_customer(spark, folder):
    rolled = cost.cost_rollup(_costs(spark, folder), ["o_custkey"])
    return rolled.select("o_custkey", "model", *_ROLLUP, *_text(*_MONEY), "evaluation_count")


@query(
    "evaluation_cost_scaled",
    f"""{_WITH} select o_custkey, cast(sum((c1 + c2 + c3 + c4) * l_linenumber * 3) as string) as total_cost_eur,
    cast(sum(l_linenumber * 3) as bigint) as evaluation_count, cast(sum(i * l_linenumber * 3) as bigint) as input_tokens from costs group by o_custkey""",
)
def evaluation_cost_scaled(spark, folder):
    scaled = cost.scale_costs(_costs(spark, folder), "l_linenumber", 3)
    rolled = cost.cost_rollup(scaled, ["o_custkey"])
    return rolled.select("o_custkey", *_text("total_cost_eur"), "evaluation_count", "input_tokens")


@query(
    "default_priced_lines",
    f"""with {_CARDS}, {_USAGE}, d as (select input_rate from cards where model = 'Brand#1')
    select u.model, cast(coalesce(k.input_rate, (select input_rate from d)) as string) as input_rate, count(*) as lines
    from usage u left join (select * from cards where model not in ('Brand#2', 'Brand#3')) k on u.model = k.model group by all""",
)
def default_priced_lines(spark, folder):
    known = _cards(spark, folder).filter(~F.col("model").isin("Brand#2", "Brand#3"))
    rows = cost.priced(_usage(spark, folder), known, default_model="Brand#1")
    return rows.groupBy("model", F.col("input_rate").cast("string").alias("input_rate")).agg(F.count("*").alias("lines"))


@query(
    "cost_checks",
    f"""{_WITH} select l_orderkey, l_linenumber, 'total cost is not input + output' as problem from costs where o = 5
    union all select l_orderkey, l_linenumber, 'cached exceeds input' from costs where c > i
    union all select l_orderkey, l_linenumber, 'negative amount' from costs where c1 < 0""",
)
def cost_checks(spark, folder):
    declared = _costs(spark, folder).withColumn(
        "total_cost_eur", F.col("total_cost_eur") + F.when(F.col("output_tokens") == 5, 1).otherwise(0)
    )
    return cost.cost_checks(declared).select("l_orderkey", "l_linenumber", "problem")


@query(
    "usage_checks",
    f"""with {_USAGE} select l_orderkey, l_linenumber, 'total is not input + output' as problem from usage where o > 90
    union all select l_orderkey, l_linenumber, 'cached exceeds input' from usage where c > i
    union all select l_orderkey, l_linenumber, 'reasoning exceeds output' from usage where o < 9 and r + 5 > o
    union all select l_orderkey, l_linenumber, 'negative token count' from usage where o < 9 and r + 5 < 0""",
)
def usage_checks(spark, folder):
    c = F.col
    usage = _usage(spark, folder).withColumns(
        {
            "total_tokens": c("total_tokens") + F.when(c("output_tokens") > 90, 1).otherwise(0),
            "reasoning_tokens": c("reasoning_tokens") + F.when(c("output_tokens") < 9, 5).otherwise(0),
        }
    )
    return cost.usage_checks(usage).select("l_orderkey", "l_linenumber", "problem")


# --- usage objects inside event payloads ---------------------------------------------

_K = "cast(json_extract(props, '$.k') as bigint)"


def _payloads(spark, folder) -> DataFrame:
    """Provider responses of several shapes around the count in ``props``."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    body = (
        F.when(
            kind == "click",
            F.concat(F.lit('{"id":"r","usage":{"prompt_tokens":'), k, F.lit(',"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":'), F.when(F.col("value") > 40, F.concat(k, F.lit("0"))).otherwise("0"), F.lit('}}}')),
        )
        .when(
            kind == "view",
            F.concat(F.lit('{"body":"{\\"usageMetadata\\":{\\"promptTokenCount\\":'), k, F.lit(',\\"candidatesTokenCount\\":\\"3\\",\\"totalTokenCount\\":'), (k.cast("bigint") + F.when(F.col("value") > 40, 4).otherwise(3)).cast("string"), F.lit('}}","input_tokens_note":1}')),
        )
        .when(kind == "signup", F.concat(F.lit('[{"a":{"total_tokens":'), k, F.lit("}}]")))
        .when(
            kind == "purchase",
            F.concat(F.lit('{"output_tokens":5,"input_tokens":'), k, F.lit(',"inputTokens":'), F.when(F.col("value") > 40, "1000").otherwise(k), F.lit(',"cache_creation_input_tokens":1,"reasoning_tokens":2}')),
        )
        .otherwise(F.lit('{"message":"no usage here"}'))
    )
    return table(spark, folder, "events").select("event_id", body.alias("payload"))


@query(
    "usage_from_payloads",
    f"""select event_id, {_K} as input_tokens, case event_type when 'click' then 7 when 'view' then 3 else 5 end::bigint as output_tokens,
    {_K} + case event_type when 'click' then 7 when 'view' then 3 else 5 end as total_tokens,
    case when event_type = 'purchase' then 1 else 0 end::bigint as cached_input_tokens, case when event_type = 'purchase' then 2 else 0 end::bigint as reasoning_tokens
    from events where (event_type = 'click' and value <= 40) or (event_type = 'view' and value <= 40)
      or (event_type = 'purchase' and value <= 40 and {_K} >= 1)""",
)
def usage_from_payloads(spark, folder):
    good, _ = cost.extract_token_usage(cost.locate_usage(_payloads(spark, folder)))
    return good.drop("payload", "usage")


@query(
    "usage_rejects",
    f"""select event_id, case event_type when 'click' then case when {_K} > 0 then 'cached exceeds input' else 'no usage object found' end when 'view' then 'total differs from input + output'
      when 'signup' then 'only a total was reported' when 'purchase' then case when value > 40 then 'conflicting input counts' else 'cached exceeds input' end
      else 'no usage object found' end as reason
    from events where event_type in ('signup', 'error') or (event_type = 'click' and value > 40) or (event_type = 'view' and value > 40)
      or (event_type = 'purchase' and (value > 40 or {_K} < 1))""",
)
def usage_rejects(spark, folder):
    _, bad = cost.extract_token_usage(cost.locate_usage(_payloads(spark, folder)))
    return bad.select("event_id", "reason")


def _card_json(spark, folder) -> DataFrame:
    """Parts as rate cards in per-million, per-thousand and per-token spellings."""
    c = F.col
    cents = F.round(c("p_retailprice") * 100, 0).cast("bigint").cast("string")
    body = (
        F.when(c("p_size") <= 10, F.concat(F.lit('{"modelName":"'), "p_name", F.lit('","input_eur_per_million":"€ '), cents, F.lit('","output_rate":'), cents, F.lit("}")))
        .when(c("p_size") <= 20, F.concat(F.lit('{"model":"'), "p_name", F.lit('","priceCard":{"input_eur_per_1k_tokens":"EUR 0.'), F.lpad(cents, 9, "0"), F.lit('","output_cost_per_token_eur":0.000001}}')))
        .when(c("p_size") <= 30, F.concat(F.lit('{"model":"'), "p_name", F.lit('","currency":"USD","input_rate":1,"output_rate":1}')))
        .when(c("p_size") <= 40, F.concat(F.lit('{"model":"'), "p_name", F.lit('","input_rate":1,"input_eur_per_1k_tokens":1,"output_rate":2}')))
        .otherwise(F.concat(F.lit('{"model":"'), "p_name", F.lit('","input_rate":1}')))
    )
    return table(spark, folder, "part").select("p_partkey", F.parse_json(body).alias("card"))


_CENTS = "cast(round(p_retailprice * 100) as bigint)"


@query(
    "rate_cards",
    f"""select p_name as model, case when p_size <= 10 then cast({_CENTS} as string) || '.000000000000' else
      cast(cast(cast('0.' || lpad(cast({_CENTS} as string), 9, '0') as decimal(24,12)) * 1000 as decimal(24,12)) as string) end as input_rate,
    case when p_size <= 10 then cast({_CENTS} as string) || '.000000000000' else '1.000000000000' end as output_rate from part where p_size <= 20""",
)
def rate_cards(spark, folder):
    good, _ = read_rate_cards(_card_json(spark, folder))
    return good.select("model", *_text("input_rate", "output_rate"))


@query(
    "rate_card_rejects",
    """select case when p_size <= 30 then 'only EUR pricing is supported' when p_size <= 40 then 'conflicting input rates'
      else 'output rate is required' end as reason, count(*) as cards from part where p_size > 20 group by all""",
)
def rate_card_rejects(spark, folder):
    _, bad = read_rate_cards(_card_json(spark, folder))
    return bad.groupBy("reason").agg(F.count("*").alias("cards"))
