"""Mixing sources to target weights: a token budget handed down a domain - language - source tree.

Each node shares its budget among its children by weight, but no child gets more than its subtree
can supply in `max_epochs` epochs.  What a short child can't take goes to its siblings by their
weights; only when all siblings are full does the shortage show one level up, where the parent was
given no more than its subtree holds in the first place, so its own siblings have taken the rest.
All arithmetic is on integers, so the same weights give the same budgets everywhere.

A leaf then takes whole epochs of its documents while its budget lasts, and of one more epoch the
prefix, in a seeded order, whose tokens fit.  The order is by a hash of seed, epoch and doc_id.
The prefix is found from sums over hash ranges, so no leaf is sorted in one task, however large.

Nulls: a null text has no tokens; a null language or source is a leaf of its own with weight
`other`; rows with a null doc_id are ordered as the text '?'.  An empty text has 0 tokens and
comes with any prefix it falls in.  Ties (repeated ids) are taken or left together.  Extra columns
stay; with `mix`, columns named like the results are replaced, with `rows` every column comes out as
it went in.  A source's number is that of its last 18 digits.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Plan:
    """Production parameters of the mix."""

    seed: int = 17
    #: The mix has supply * numerator // denominator tokens, supply being one epoch of everything.
    numerator: int = 3
    denominator: int = 4
    max_epochs: int = 2
    domains: int = 4
    domain_weights: dict[str, int] = field(default_factory=lambda: {"d0": 40, "d1": 30, "d2": 20, "d3": 10})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    #: Weight of what the two tables don't name, and of every source.
    other: int = 10


LEVELS = ("domain", "lang", "source")
#: Hash digits that select the range of a document: 4096 ranges a leaf and epoch.
RANGE = 3


def tokens(text: str) -> Column:
    """Words, as runs of characters other than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def domain(source: str, domains: int) -> Column:
    """The domain of a source: the number that its last digits make, 18 at most, modulo `domains`; a source without a number is in domain 'other'."""
    number = F.regexp_extract(F.col(source), "([0-9]{1,18})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("bigint") % domains).cast("string")))


def _weight(col: str, table: dict[str, int], other: int) -> Column:
    w = F.lit(other)
    for name, value in table.items():
        w = F.when(F.col(col) == name, F.lit(value)).otherwise(w)
    return w.cast("bigint")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Waterfill: nodes have cap, w and the parent's budget; the result has their own as `budget`.

    In order of cap / w, a child is full if the level at which it fills is below the common one.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.sum("w").over(after))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    n = n.withColumn("full", wide("cap") * wide("w0") + wide("c0") * wide("w") <= wide("budget") * wide("w"))
    n = n.withColumn("cf", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))).withColumn("wo", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    open_share = F.expr("((cast(budget as decimal(38,0)) - cast(cf as decimal(38,0))) * cast(w as decimal(38,0))) div nullif(wo, 0)")
    return n.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(open_share.cast("bigint"))).drop("c0", "w0", "full", "cf", "wo", "cap", "w")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, supply, budget) from the supply of each leaf; as many rows as there are leaves."""
    cap = lambda df, keys: df.groupBy(*keys).agg(F.sum("supply").alias("supply")).withColumn("cap", F.col("supply") * plan.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total")).selectExpr(f"cast((cast(total as decimal(38,0)) * {plan.numerator}) div {plan.denominator} as bigint) as budget")
    d = cap(leaves, ["domain"]).crossJoin(total).withColumn("w", _weight("domain", plan.domain_weights, plan.other))
    d = _share(d, [], "domain").select("domain", "budget")
    la = cap(leaves, ["domain", "lang"]).join(d, "domain").withColumn("w", _weight("lang", plan.lang_weights, plan.other))
    la = _share(la, ["domain"], "lang").select("domain", F.col("lang").alias("la"), "budget")
    s = cap(leaves, ["domain", "lang", "source"])
    s = s.join(la, (s["domain"] == la["domain"]) & s["lang"].eqNullSafe(la["la"])).select(s["*"], la["budget"]).withColumn("w", F.lit(plan.other).cast("bigint"))
    return _share(s, ["domain", "lang"], "source").select("domain", "lang", "source", "supply", "budget")


def _place(epoch: Column, seed: int, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("?"))))


def measured(docs: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, mix_tokens): what decides, about 60 bytes a document, written once to the shared folder."""
    return shared.checkpoint(docs.select(F.col(doc_id).alias("doc_id"), domain(source, plan.domains).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), tokens(text).alias("mix_tokens")))


_LEAF = ("__d", "__l", "__s")


def _at_leaf(df: DataFrame, side: DataFrame, how: str = "inner", lang: str = "lang", source: str = "source", extra: Column | None = None, domain: str = "domain") -> DataFrame:
    on = (df[domain] == side["__d"]) & df[lang].eqNullSafe(side["__l"]) & df[source].eqNullSafe(side["__s"])
    return df.join(side, on if extra is None else on & extra, how).drop(*(side[c] for c in _LEAF))


def _quota(thin: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf: `__whole` epochs, and `__stop`, the place in the next epoch's order where its budget is used up (null: nowhere)."""
    q = budgets(thin.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("supply")), plan)
    q = q.withColumn("whole", F.expr(f"case when supply > 0 then least(budget div supply, {plan.max_epochs}) else 1 end"))
    q = q.withColumn("part", F.expr("case when supply > 0 then budget - whole * supply else -1 end"))
    q = shared.checkpoint(q.select(F.col("domain").alias("__d"), F.col("lang").alias("__l"), F.col("source").alias("__s"), "whole", "part"))
    # ranges of the order, then the documents of the one range in which the budget runs out
    p = _at_leaf(thin, shared.small(q, 200)).withColumn("h", _place(F.col("whole"), plan.seed, "doc_id")).withColumn("r", F.substring("h", 1, RANGE))
    ranges = p.groupBy(*LEVELS, "r", "part").agg(F.sum("mix_tokens").alias("rt"))
    ranges = ranges.withColumn("upto", F.sum("rt").over(Window.partitionBy(*LEVELS).orderBy("r")))
    border = ranges.where("upto > part").groupBy(*LEVELS).agg(F.min(F.struct("r", (F.col("upto") - F.col("rt")).alias("before"))).alias("b"))
    border = border.select(F.col("domain").alias("__d"), F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("b.r").alias("br"), F.col("b.before").alias("before"))
    inside = _at_leaf(p, shared.small(shared.checkpoint(border), 200), extra=F.col("r") == F.col("br"))
    in_order = Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stop = inside.withColumn("upto", F.col("before") + F.sum("mix_tokens").over(in_order)).where("upto > part").groupBy(*LEVELS).agg(F.min("h").alias("__stop"))
    out = q.join(stop, (q["__d"] == stop["domain"]) & q["__l"].eqNullSafe(stop["lang"]) & q["__s"].eqNullSafe(stop["source"]), "left")
    return shared.checkpoint(out.select(*_LEAF, F.col("whole").alias("__whole"), "__stop"))


def _take(df: DataFrame, quota: DataFrame, plan: Plan, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", domain: str = "domain", epoch: str = "epoch") -> DataFrame:
    """df, which has `domain`, with `epoch`: each row as often as its leaf's epochs take it."""
    cols = df.columns
    whole, stop = shared.fresh([*cols, epoch], "whole", "stop")
    quota = quota.withColumnsRenamed({"__whole": whole, "__stop": stop})
    df = _at_leaf(df, shared.small(quota, 200), lang=lang, source=source, domain=domain)
    more = (F.col(whole) < plan.max_epochs) & (F.col(stop).isNull() | (_place(F.col(whole), plan.seed, doc_id) < F.col(stop)))
    times = F.col(whole) + F.when(more, 1).otherwise(0)
    return df.where(times > 0).select(*cols, F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))).alias(epoch))


def chosen(docs: DataFrame, plan: Plan = Plan(), **columns: str) -> DataFrame:
    """(doc_id, domain, lang, source, mix_tokens, epoch) of the mix."""
    thin = measured(docs, plan, **columns)
    return _take(thin, _quota(thin, plan), plan)


def mix(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs, with domain and epoch added, as often as the mix takes them."""
    quota = _quota(measured(docs, plan, text, doc_id, lang, source), plan)
    return _take(docs.drop("epoch").withColumn("domain", domain(source, plan.domains)), quota, plan, doc_id, lang, source)


def rows(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs, as they were, as often as the mix takes them."""
    own, epoch = shared.fresh(docs.columns, "domain", "epoch")
    quota = _quota(measured(docs, plan, text, doc_id, lang, source), plan)
    return _take(docs.withColumn(own, domain(source, plan.domains)), quota, plan, doc_id, lang, source, own, epoch).select(docs.columns)
