"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. The token budget is dealt from the root down: each node's
children get shares in proportion to their weights, none more than its whole subtree can supply (available tokens times
`max_epochs`). What a child cannot take goes to its siblings first; only what all of a node's children together cannot take
was withheld one level higher, where the node's own siblings get it. This is water filling with the level found from
running sums over the children in order of supply per weight.

A leaf with budget b and a tokens gives every document b div a whole epochs, and of the next epoch the prefix, in
an order drawn from the seed and the epoch, that comes closest to the rest. The prefix ends at a cut-off value of the order, found in two
steps: totals of `SLICES` ranges of the order, then running sums inside the one range where the rest is reached. So
no leaf is ordered in one task, and documents are not shuffled: they join the table of leaves (one row a leaf).

Defined results: NULL or empty texts have no tokens and are never chosen; a NULL id is ordered like an empty one;
NULL lang or source is the node `unknown`; rows with equal id share their place in the order and are taken together; weights
of unknown names are 1; a weight of 0 gives nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

SLICES = 4096
_BITS = 60  # of the order value
LEVELS = ["domain", "language", "origin"]


@dataclass
class Plan:
    """Targets of a mixture. Weights are relative among siblings; names left out weigh 1."""

    share: float = 0.5  #: of all available tokens, as the budget; ignored when `tokens` is set
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 7
    n_domains: int = 4  #: domains are drawn from the source name when the table has none
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {
        "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "origin": {}})


def leaf_columns(plan: Plan) -> dict[str, Column]:
    origin = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    return {"domain": F.concat(F.lit("d"), (F.conv(F.substring(F.md5(origin.cast("binary")), 1, 8), 16, 10).cast("bigint") % plan.n_domains).cast("string")),
            "language": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "origin": origin}


def token_count() -> Column:
    """Four bytes a token, rounded up."""
    return F.coalesce(F.ceil(F.octet_length("text") / 4.0), F.lit(0)).cast("bigint")


def _weight(plan: Plan, level: str) -> Column:
    w = F.lit(1.0)
    for name, value in plan.weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(float(value))).otherwise(w)
    return w


def _dealt(nodes: DataFrame, parents: list[str], level: str, plan: Plan) -> DataFrame:
    """Budgets of the children of each parent: `nodes` has the parents' `budget` and the children's `supply`."""
    n = nodes.withColumn("w", _weight(plan, level)).withColumn("supply", F.when(F.col("w") > 0, F.col("supply")).otherwise(F.lit(0.0)))
    own = Window.partitionBy(*parents, "budget") if parents else Window.partitionBy("budget")
    order = own.orderBy(F.when(F.col("w") > 0, F.col("supply") / F.col("w")).otherwise(F.lit(0.0)), level)
    n = n.withColumn("before", F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("after", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("level", F.when(F.col("after") > 0, F.greatest(F.lit(0.0), F.col("budget") - F.coalesce("before", F.lit(0.0))) / F.col("after")).otherwise(F.lit(0.0)))
    short = F.col("supply") <= F.col("level") * F.col("w")
    n = n.withColumn("water", F.max(F.when(~short, F.col("level"))).over(own))  # that of the first child that is not filled up
    return n.withColumn("budget", F.when(short, F.col("supply")).otherwise(F.least(F.col("supply"), F.col("water") * F.col("w")))).drop("w", "before", "after", "level", "water", "supply")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """`leaves` (domain, language, origin, tokens) with `budget`, a whole number of tokens."""
    leaves = leaves.withColumn("supply", F.col("tokens").cast("double") * plan.max_epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    goal = float(plan.tokens if plan.tokens is not None else int(total * plan.share))
    have = None
    for i, level in enumerate(LEVELS):
        keys = LEVELS[:i + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("budget", F.lit(goal)) if have is None else nodes.join(have, LEVELS[:i])
        have = _dealt(nodes, LEVELS[:i], level, plan)
    return leaves.drop("supply").join(have, LEVELS).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("bigint"))


def order_value(plan: Plan, epoch: Column) -> Column:
    text = F.concat_ws("-", F.lit(str(plan.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("bigint")


def cutoffs(docs: DataFrame, plan: Plan, slices: int = SLICES) -> DataFrame:
    """One row a leaf: LEVELS, tokens, budget, epochs (whole ones), cutoff (order value of the last document of the next one)."""
    narrow = docs.select(*[c.alias(n) for n, c in leaf_columns(plan).items()], "doc_id", token_count().alias("n_tokens")).where("n_tokens > 0")
    plans = stored(budgets(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan)
                   .withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens")), "leaves")
    placed = narrow.join(plans.where("rest > 0").select(*LEVELS, "epochs", "rest"), LEVELS).withColumn("place", order_value(plan, F.col("epochs") + 1)) \
        .withColumn("slice", F.expr(f"place div {(1 << _BITS) // slices}"))
    sums = placed.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("slice")))
    hit = upto.where("upto >= rest and upto - n < rest").select(*LEVELS, "slice", (F.col("upto") - F.col("n")).alias("before"))
    inside = placed.join(hit, [*LEVELS, "slice"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place")))
    # The document that crosses the target stays if that comes closer to it than leaving it out.
    inside = inside.withColumn("own", F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "place")))
    cross = inside.where("upto >= rest and upto - own < rest").groupBy(*LEVELS).agg(F.min(F.struct("place", F.expr("2 * upto - own <= 2 * rest").alias("stays"))).alias("c"))
    cut = cross.select(*LEVELS, F.when(F.col("c.stays"), F.col("c.place")).otherwise(F.col("c.place") - 1).alias("cutoff"))
    return stored(plans.join(cut, LEVELS, "left").select(*LEVELS, "tokens", "budget", "epochs", "cutoff"), "cutoffs")


def mixed(docs: DataFrame, plan: Plan | None = None, slices: int = SLICES, prefix: str = "") -> DataFrame:
    """`docs` with the columns domain, n_tokens and copies (how often the mixture takes the row; 0: not at all), named with `prefix`."""
    plan = plan or Plan()
    cut = cutoffs(docs, plan, slices)
    keys = {f"__{n}": c for n, c in leaf_columns(plan).items()}
    named = cut.select(*[F.col(n).alias(f"__{n}") for n in LEVELS], F.col("epochs").alias("__epochs"), F.col("cutoff").alias("__cutoff"))
    rows = docs.withColumns(keys).join(named, list(keys), "left")
    more = F.coalesce(order_value(plan, F.col("__epochs") + 1) <= F.col("__cutoff"), F.lit(False)).cast("int")
    copies = F.when(token_count() > 0, F.coalesce(F.col("__epochs"), F.lit(0)) + more).otherwise(0).cast("int")
    return rows.select(*docs.columns, F.col("__domain").alias(prefix + "domain"), token_count().alias(prefix + "n_tokens"), copies.alias(prefix + "copies"))
