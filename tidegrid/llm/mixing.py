"""Mixing sources to target weights by budgets on a tree of domains, languages and sources.

A budget of tokens goes down the tree. At each node it is shared among the
children by weight, but no child gets more than all leaves below it can give (a
leaf gives its documents' tokens up to `epochs` times); what one child cannot
take goes to its siblings, again by weight. So a shortage is made up among
siblings first, and an ancestor's other children see only what a whole branch
lacks. Shares are rounded down to whole tokens.

A leaf with a budget takes all its documents for as many epochs as fit whole,
and of the next one a prefix: documents in an order seeded by seed and epoch,
as many as the rest of the budget holds. The prefix is found by buckets of the
order, then buckets within the one where the budget ends, then rows, so no task
sees a whole leaf, however large.

All of it is column expressions, and the SQL below says the same.

Results in special cases: a null domain, language or source is a leaf of its
own with an empty name. Tokens are words between ASCII white space; a document
without any (empty or null text) is never selected. Rows that agree in doc_id,
language and source are one document, selected together. An empty table selects
nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": {}}  # whole numbers; 1 where nothing is said
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 2  # hex digits of the order that name a bucket, at each of two depths


def domain_of(source: Column) -> Column:
    """The domain of a source: here, the number at its end by four."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", "domain").otherwise(F.concat(F.lit("domain"), F.pmod(F.right(number, F.lit(9)).cast("long"), F.lit(4)).cast("string")))


def leaves_of(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs with the names of its leaf and its tokens in columns of a struct `leaf_of`."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    where = domain if domain is not None else domain_of(name("source"))
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("leaf_of", F.struct(F.coalesce(where, F.lit("")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), tokens.alias("n_tokens")))


def shared_out(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, int]) -> DataFrame:
    """Share `budget` (of the parent) among nodes with `capacity`; the nodes' own share replaces it.

    Children are taken in the order in which they run full as the budget grows
    (capacity by weight): a child is full if its share of what the fuller ones
    leave is at least its capacity. The others share what all full ones leave.
    """
    weight = F.lit(1)
    for key, value in weights.items():
        weight = F.when(F.col(level) == key, F.lit(value)).otherwise(weight)
    nodes = nodes.withColumn("weight", weight.cast("long"))
    by = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight"), level)
    group = Window.partitionBy(*parent)
    nodes = nodes.withColumn("before", F.sum("capacity").over(by) - F.col("capacity"))
    nodes = nodes.withColumn("open", F.sum("weight").over(group) - F.sum("weight").over(by) + F.col("weight"))
    nodes = nodes.withColumn("full", (F.col("budget") - F.col("before")) * F.col("weight") >= F.col("capacity") * F.col("open"))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(group)
    heavy = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group)
    nodes = nodes.withColumn("taken", taken).withColumn("heavy", heavy)
    own = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(budget - taken) * weight div heavy"))
    return nodes.withColumn("budget", own).drop("weight", "before", "open", "full", "taken", "heavy")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The budget of each leaf (domain, lang, source, tokens): whole epochs `full` and the rest of the tokens `rest`."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("budget"))
    nodes, up = None, None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(up.select(*parent, "budget"), parent) if parent else nodes.join(total)
        up = shared_out(nodes, parent, level, weights.get(level, {}))
    return up.select(*LEVELS, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest"))


def mixed_sources(docs: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = SEED, domain: Column | None = None) -> DataFrame:
    """Selected documents, a row for each epoch: doc_id, domain, lang, source, n_tokens, epoch (from 0).

    share is the budget as a part of all tokens.
    """
    rows = leaves_of(docs, domain).select(F.col("doc_id").cast("long").alias("doc_id"), "leaf_of.*").where("n_tokens > 0")
    rows = stored(rows.groupBy("doc_id", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")))
    plan = stored(budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), share, epochs, weights))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(plan, list(LEVELS)).withColumn("key", key)
    whole = rows.where("full > 0").select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("epoch"))
    chosen = [whole]
    # From here on, only the documents of the epoch that is not whole. `rest` is what the bucket at hand may still take.
    open_ = rows.where("rest > 0")
    bucket: list[str] = []
    pick = lambda df: df.select("doc_id", *LEVELS, "n_tokens", F.col("full").cast("int").alias("epoch"))
    for depth in range(2):
        inside, bucket = [*LEVELS, *bucket], [*bucket, f"bucket{depth}"]
        open_ = open_.withColumn(f"bucket{depth}", F.substring("key", 1 + depth * BUCKET_DIGITS, BUCKET_DIGITS))
        sums = open_.groupBy(*LEVELS, *bucket).agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
        to = F.sum("tokens").over(Window.partitionBy(*inside).orderBy(f"bucket{depth}"))
        sums = sums.withColumn("rest", F.col("rest") - to + F.col("tokens")).where("rest > 0")
        sums = stored(sums.withColumn("fits", F.col("rest") >= F.col("tokens")).drop("tokens"))
        open_ = open_.drop("rest").join(sums, [*LEVELS, *bucket])
        chosen.append(pick(open_.where("fits")))
        open_ = open_.where("not fits").drop("fits")
    to = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, *bucket).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen.append(pick(open_.withColumn("to", to).where("to <= rest")))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def op2_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens by target weights, with at most four epochs of a leaf."""
    return mixed_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.5, 4)


def _level_sql(level: str, parent: list[str], weights: Mapping[str, int]) -> str:
    """CTEs that share a budget out among the nodes of a level."""
    part = f"partition by {', '.join(parent)}" if parent else ""
    cases = " ".join(f"when '{k}' then {v}" for k, v in weights.items())
    weight = f"case {level} {cases} else 1 end" if cases else "1"
    up = f"join {parent[-1]}_shares u using ({', '.join(parent)})" if parent else "cross join total u"
    keys = ", ".join([*parent, level])
    return f"""
{level}_nodes as (
  select {keys}, cast(sum(capacity) as bigint) as capacity, cast(sum(tokens) as bigint) as tokens, {weight} as weight
  from leaves group by {keys}),
{level}_ordered as (
  select n.*, u.budget as above,
         sum(capacity) over (w rows unbounded preceding) - capacity as before,
         sum(weight) over (w rows between current row and unbounded following) as open
  from {level}_nodes n {up}
  window w as ({part} order by cast(capacity as double) / weight, {level})),
{level}_full as (select *, (above - before) * weight >= capacity * open as is_full from {level}_ordered),
{level}_left as (
  select *, sum(case when is_full then capacity else 0 end) over ({part}) as taken,
         sum(case when is_full then 0 else weight end) over ({part}) as heavy
  from {level}_full),
{level}_shares as (
  select {keys}, tokens, cast(case when is_full then capacity else (above - taken) * weight // heavy end as bigint) as budget
  from {level}_left)"""


def mixing_sql(share: float, epochs: int, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = SEED) -> str:
    levels = ",".join(_level_sql(level, list(LEVELS[:k]), weights.get(level, {})) for k, level in enumerate(LEVELS))
    return rf"""
with named as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as number,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as n
  from documents),
docs as (
  select doc_id, case when number = '' then 'domain' else 'domain' || (cast(right(number, 9) as bigint) % 4) end as domain, lang, source,
         cast(sum(n) as bigint) as n_tokens
  from named where n > 0 group by all),
leaves as (
  select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) as bigint) * {epochs} as capacity
  from docs group by all),
total as (select cast(floor(sum(tokens) * {share}) as bigint) as budget from leaves),
{levels},
planned as (
  select d.*, budget // tokens as whole, budget % tokens as rest,
         md5('{seed}:' || (budget // tokens) || ':' || coalesce(cast(doc_id as varchar), '')) as key
  from docs d join source_shares using (domain, lang, source)),
summed as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id rows unbounded preceding) as upto from planned)
select doc_id, domain, lang, source, n_tokens, cast(unnest(range(0, whole)) as int) as epoch from planned
union all
select doc_id, domain, lang, source, n_tokens, cast(whole as int) as epoch from summed where upto <= rest
"""


SQL = mixing_sql(0.5, 4)
