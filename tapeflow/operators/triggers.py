"""Price triggers: creation, daily check, validation and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.rules import Panel, condition, explain_rules
from tapeflow.functions.scalars import lookup
from tapeflow.functions.windows import all_of, latest
from tapeflow.operators import sizing
from tapeflow.params import DEFAULTS


def create_triggers(hits: DataFrame, p=DEFAULTS) -> DataFrame:
    """Pending triggers from (symbol, strategy_id, timeframe, trigger_date, trigger_price) hits."""
    tf = F.col("timeframe")
    disc, days = lookup(tf, p.trigger_discount, 0.03), lookup(tf, p.trigger_expiry_days, 30)
    return hits.withColumns({
        "buy_below_pct": disc, "buy_below_price": F.col("trigger_price") * (1 - disc),
        "expiry_date": F.date_add("trigger_date", days), "current_price": F.col("trigger_price"),
        "distance_pct": F.lit(None).cast("double"), "status": F.lit("pending")})


def check_triggers(triggers: DataFrame, prices: DataFrame, as_of: str, invalid: DataFrame | None = None) -> DataFrame:
    """Next state of every trigger against the latest prices.

    Only pending rows with a price move: past expiry to expired, at or below the
    buy price to eligible, otherwise the price and distance are refreshed. Where ``prices`` has a
    column ``low``, that price decides.
    ``invalid`` (trigger_id) optionally marks pending rows invalidated first.
    """
    j = triggers.join(prices.select("symbol", F.col("price").alias("_p"), F.col("low" if "low" in prices.columns else "price").alias("_low")), "symbol", "left")
    if invalid is not None:
        j = j.join(invalid.select("trigger_id", F.lit(True).alias("_bad")), "trigger_id", "left")
    else:
        j = j.withColumn("_bad", F.lit(None).cast("boolean"))
    today = F.lit(as_of).cast("date")
    pending = F.col("status") == "pending"
    bad = pending & F.coalesce("_bad", F.lit(False))
    open_ = pending & F.col("_p").isNotNull() & ~bad
    expired = open_ & F.coalesce(today > F.col("expiry_date"), F.lit(False))
    live = open_ & ~expired
    below = live & (F.col("_low") <= F.col("buy_below_price"))
    dist = F.when(F.col("buy_below_price") > 0,
                  (F.col("_p") - F.col("buy_below_price")) / F.col("buy_below_price") * 100).otherwise(0.0)
    return j.withColumns({
        "status": F.when(bad, "invalidated").when(expired, "expired").when(below, "eligible").otherwise(F.col("status")),
        "current_price": F.when(live, F.col("_p")).otherwise(F.col("current_price")),
        "distance_pct": F.when(live, dist).otherwise(F.col("distance_pct"))}).drop("_p", "_low", "_bad")


def check_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many of the pending triggers stayed, became eligible or expired."""
    was = before.filter("status = 'pending'").select("trigger_id")
    a = after.join(was, "trigger_id", "left_semi")
    return a.agg(F.count_if(F.col("status") == "pending").alias("pending"),
                 F.count_if(F.col("status") == "eligible").alias("eligible"),
                 F.count_if(F.col("status") == "expired").alias("expired"))


def find_triggers(triggers: DataFrame, as_of: str, status: str = "all", timeframe: str | None = None, limit: int | None = None) -> DataFrame:
    """Triggers with their age, newest first; all of them without ``limit``."""
    conds = []
    if status != "all":
        conds.append(F.col("status") == status)
    if timeframe is not None:
        conds.append(F.col("timeframe") == timeframe)
    out = (triggers.filter(all_of(conds))
           .withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "trigger_date"))
           .orderBy(F.desc("trigger_date"), F.desc("trigger_id")))
    return out if limit is None else out.limit(limit)


def validate(triggers: DataFrame, latest_panel: DataFrame, docs: list[dict], positions: DataFrame, stocks: DataFrame,
             p=DEFAULTS) -> DataFrame:
    """Re-check entry rules, capital and sector fit of every trigger.

    ``latest_panel`` must hold, per symbol, ``checks_<i>`` of each document
    (``latest_checks``).
    """
    checks = F.coalesce(*[F.when(F.col("strategy_id") == d["strategy_id"], F.col(f"checks_{i}")) for i, d in enumerate(docs)])
    j = triggers.join(latest_panel.select("symbol", *[f"checks_{i}" for i in range(len(docs))]), "symbol", "left")
    j = j.withColumn("rule_checks", checks).drop(*[f"checks_{i}" for i in range(len(docs))])
    j = j.withColumn("price", F.coalesce("current_price", "buy_below_price"))
    j = sizing.ratio_size(j, positions, p)
    j = sizing.sector_exposure(j, positions, stocks, p)
    passed = F.coalesce(F.forall("rule_checks", lambda c: c["passed"]), F.lit(False))
    j = j.withColumns({"all_passed": passed, "capital_fit": F.col("qty") > 0, "sector_fit": F.col("allowed")})
    return j.withColumn("valid", F.col("all_passed") & F.col("capital_fit") & F.col("sector_fit"))


def rule_checks(panel: DataFrame, docs: list[dict]) -> DataFrame:
    """Add ``checks_<i>`` per document to a full panel."""
    ctx = Panel.of(panel)
    return panel.withColumns({f"checks_{i}": explain_rules(d["entry_rules"], ctx) for i, d in enumerate(docs)})


def latest_checks(panel: DataFrame, docs: list[dict]) -> DataFrame:
    """(symbol, date, ``checks_<i>`` per document) of the latest row of each symbol.

    The conditions look back, so they are judged on the full panel; their texts are written for the latest rows only."""
    ctx = Panel.of(panel)
    conds = [d["entry_rules"].get("conditions", []) for d in docs]
    passed = {f"_ok_{i}_{j}": condition(c, ctx) for i, cs in enumerate(conds) for j, c in enumerate(cs)}
    names = {n for cs in conds for c in cs for n in (c.get("indicator"), str(c.get("value")).removeprefix("indicator:"))}
    shown = [c for c in panel.columns if c in names and c not in ("symbol", "date")]
    last = latest(panel.select("symbol", "date", *shown, *[ok.alias(n) for n, ok in passed.items()]), ["symbol"], "date")
    return last.select("symbol", "date", *[explain_rules(d["entry_rules"], ctx, [F.col(f"_ok_{i}_{j}") for j in range(len(conds[i]))]).alias(f"checks_{i}")
                                           for i, d in enumerate(docs)])


def confirm_buys(triggers: DataFrame, orders: DataFrame, positions: DataFrame, latest_indicators: DataFrame,
                 parsed_catalog: DataFrame, as_of: str, p=DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Turn eligible triggers named in ``orders`` (trigger_id, override_price, note) into positions.

    Returns the next trigger snapshot and the new positions. Orders whose
    trigger is not eligible, or whose size is below one share, change nothing.
    Orders of a strategy are filled one after another, by trigger id: each lowers what the next
    may spend. A symbol without indicators is bought with the default levels.
    """
    from tapeflow.operators.portfolio import _with_rules
    from tapeflow.operators.strategies import stop_loss, table_rule_parts, target_price
    e = triggers.filter("status = 'eligible'").join(orders, "trigger_id")
    e = e.withColumn("price", F.coalesce("override_price", "current_price", "buy_below_price"))
    sized = sizing.sequential_size(e, positions, "trigger_id", p).filter("qty >= 1")
    r = _with_rules(sized, latest_indicators, parsed_catalog, how="left")
    parts = table_rule_parts()
    r = r.withColumn("stop_loss", stop_loss(parts, F.col("price"), F.col("price")))
    r = r.withColumn("target", target_price(parts, F.col("price"), F.col("stop_loss")))
    text = F.concat(F.lit("Trigger #"), "trigger_id", F.coalesce(F.concat(F.lit(" | "), "note"), F.lit("")))
    new = r.select(F.concat(F.lit("T-"), "trigger_id").alias("holding_id"), "symbol", "timeframe", "qty",
                   F.col("price").alias("avg_cost"), F.lit(as_of).cast("date").alias("entry_date"), "strategy_id",
                   "target", "stop_loss", F.lit(True).alias("is_active"), text.alias("notes"), "trigger_id")
    done = new.select("trigger_id", F.lit(True).alias("_done"))
    after = triggers.join(done, "trigger_id", "left").withColumn(
        "status", F.when(F.col("_done"), "bought").otherwise(F.col("status"))).drop("_done")
    return after, new.drop("trigger_id")


def set_status(triggers: DataFrame, ids: DataFrame, status: str, only=("pending", "eligible")) -> DataFrame:
    """Cancel (pending and eligible only) or, with ``only=None``, invalidate triggers."""
    j = triggers.join(ids.select("trigger_id", F.lit(True).alias("_hit")), "trigger_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    if only is not None:
        hit = hit & F.col("status").isin(*only)
    return j.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_hit")
