"""Mixing sources to target weights by temperature.

The token share ``p`` of every source is raised to an exponent and normalised:
``w = p**a / sum(p**a)``. The exponent is bisected: the largest one whose weights
reach the target entropy, but not below the smallest one at which no source is
repeated more than ``max_epochs`` times within the budget. Every source then gets
``floor(w * budget)`` tokens. They are realised as permutations of the source's
documents: whole permutations while the budget lasts, then the head of one more. The
head ends where its tokens are nearest to the budget, so the document that crosses it is
taken if at most half of it is beyond, and every source gets its tokens within half a
document. A document's place in a permutation is the MD5 of seed, source, epoch number
and id.

Only sums move: one row per source, and one per (source, block of the permutation).
The end of the last permutation is found block by block and then inside one block,
so a source with a third of all documents is no larger task than any other, and
the texts themselves are never shuffled.

Defined cases: a null source is a source of its own; a null text has no tokens; a
source without tokens has weight 0 and none of its documents is taken; rows that
repeat an id have the same place and are taken together, as one document; weights are
rounded to nine places; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, free_name, materialize, quoted

STEPS = 60
HIGHEST = 8.0
#: Documents of a source that one block of its permutation should hold at most.
BLOCK_ROWS = 50_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _powers(shares: Column, a: Column) -> Column:
    """Sum of the powers of all shares; ``shares`` are ``(p, n)``, n sources with share p each."""
    return F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["p"], a))


def _entropy(shares: Column, a: Column) -> Column:
    """In bits, of the weights at exponent ``a``."""
    norm = _powers(shares, a)

    def add(s: Column, x: Column) -> Column:
        w = F.pow(x["p"], a) / norm
        return s - x["n"] * w * F.log2(w)

    return F.aggregate(shares, F.lit(0.0), add)


def _repeats(shares: Column, a: Column, scale: Column) -> Column:
    """The most times that a source is read; ``scale`` is budget over all tokens."""
    norm = _powers(shares, a)
    return F.aggregate(shares, F.lit(0.0), lambda s, x: F.greatest(s, F.pow(x["p"], a) / norm * scale / x["p"]))


def _bisect(high_enough, low: float, high: float) -> Column:
    """Middle of the last interval; ``high_enough(a)`` says that the answer is below."""
    state = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = high_enough(mid)
        return F.struct(
            F.when(up, s["lo"]).otherwise(mid).alias("lo"),
            F.when(up, mid).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), state, halve, lambda s: (s["lo"] + s["hi"]) / 2
    )


def source_plan(
    sources: DataFrame,
    budget: int | None = None,
    entropy_share: float | None = None,
    max_epochs: float | None = None,
) -> DataFrame:
    """``sources`` (source, tokens, n_docs) with ``alpha, weight, budget, epochs, rest``.

    ``entropy_share`` is the target entropy as a share of the greatest possible one,
    the logarithm of the number of sources. Exponents are searched from 0 to 8 for the
    entropy, so a lower entropy than 8 gives is not reached, and from 0 to 1 for
    ``max_epochs``: where ``budget`` is more than so many epochs of all tokens, the limit
    cannot hold and the mix is in proportion, which repeats least. ``epochs`` whole permutations are taken,
    and ``rest`` tokens of the next.
    """
    # Sources of as many tokens weigh alike: what comes together is one entry for each
    # number of tokens, fewer than twice the root of all tokens however many sources.
    all_ = (
        sources.where("tokens > 0")
        .groupBy("tokens")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum(F.col("tokens") * F.col("n")).alias("total"),
            F.sum("n").alias("sources"),
            F.array_sort(F.collect_list(F.struct(F.col("tokens").cast("double").alias("p"), "n"))).alias("each"),
        )
    )
    shares = F.transform("each", lambda x: F.struct((x["p"] / F.col("total")).alias("p"), x["n"].alias("n")))
    spend = F.lit(budget).cast("long") if budget is not None else F.col("total")
    scale = spend / F.col("total")
    # With no target the shares stay as they are.
    alpha = F.lit(1.0) if entropy_share is None and max_epochs is None else F.lit(0.0)
    if entropy_share is not None:
        goal = F.lit(float(entropy_share)) * F.log2(F.col("sources").cast("double"))
        alpha = _bisect(lambda a: _entropy(F.col("shares"), a) < goal, 0.0, HIGHEST)
    if max_epochs is not None:
        least = _bisect(
            lambda a: _repeats(F.col("shares"), a, F.col("scale")) <= float(max_epochs), 0.0, 1.0
        )
        alpha = F.greatest(alpha, least)
    mix = (
        all_.withColumn("shares", shares)
        .withColumn("spend", spend)
        .withColumn("scale", scale)
        .withColumn("alpha", F.round(alpha, 6))
        .withColumn("norm", _powers(F.col("shares"), F.col("alpha")))
        .select("alpha", "norm", "total", "spend")
    )
    # One row of four numbers, which become constants of the plan.
    alpha, norm, total, spend = mix.first()
    rows = sources.withColumns(
        {
            "alpha": F.lit(alpha).cast("double"), "norm": F.lit(norm).cast("double"),
            "total": F.lit(total).cast("long"), "spend": F.lit(spend).cast("long"),
        }
    )
    weight = F.when(
        F.col("tokens") > 0,
        F.round(F.pow(F.col("tokens") / F.col("total"), F.col("alpha")) / F.col("norm"), 9),
    ).otherwise(F.lit(0.0))
    return (
        rows.withColumn("weight", weight)
        .withColumn("budget", F.floor(F.col("weight") * F.col("spend")))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0))
        .select("source", "tokens", "n_docs", "alpha", "weight", "budget", "epochs", "rest")
    )


def _place(seed: int, source: Column, epoch: Column, id_: Column) -> Column:
    parts = [F.lit(str(seed)), F.coalesce(source.cast("string"), F.lit("")), epoch.cast("string")]
    return F.md5(F.concat_ws("|", *parts, F.coalesce(id_.cast("string"), F.lit(""))))


def _cuts(counts: DataFrame, plan: DataFrame, seed: int, digits: int) -> DataFrame:
    """``plan`` with the end of each source's last permutation: ``block, last_place``."""
    placed = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).select(
        counts["source"],
        counts["n_tokens"],
        plan["rest"],
        _place(seed, counts["source"], plan["epochs"], counts["id"]).alias("place"),
    )
    placed = placed.withColumn("block", F.substring("place", 1, digits))
    sums = placed.groupBy("source", "block").agg(
        F.sum("n_tokens").alias("n_tokens"), F.first("rest").alias("rest")
    )
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = (
        sums.withColumn("upto", F.sum("n_tokens").over(upto))
        .where("upto > rest")
        .groupBy("source")
        .agg(
            F.min("block").alias("block"),
            F.min_by(F.col("rest") - (F.col("upto") - F.col("n_tokens")), "block").alias("room"),
        )
    )
    inside = placed.join(
        edge.select(
            F.col("source").alias("edge_source"), F.col("block").alias("edge_block"), "room"
        ),
        placed["source"].eqNullSafe(F.col("edge_source"))
        & (placed["block"] == F.col("edge_block")),
    )
    # The default frame takes all rows of a place at once.
    upto = Window.partitionBy("source").orderBy("place")
    here = Window.partitionBy("source", "place")
    last = (
        inside.withColumn("upto", F.sum("n_tokens").over(upto))
        .withColumn("here", F.sum("n_tokens").over(here))
        .where("2 * upto - here <= 2 * room")
        .groupBy("source")
        .agg(F.max("place").alias("last_place"))
    )
    edge, last = edge.alias("e"), last.alias("l")
    return (
        plan.alias("p")
        .join(edge, F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .join(last, F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .select("p.*", "e.block", "l.last_place")
    )


def mixing_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: int | None = None,
    entropy_share: float | None = None,
    max_epochs: float | None = None,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Token counts per row (id, source, n_tokens), and the plan of each source."""
    counts = materialize(
        docs.select(
            quoted(id_col).alias("id"),
            quoted(source_col).alias("source"),
            count_words(quoted(text_col)).alias("n_tokens"),
        ),
        "tokens",
    )
    sources = materialize(
        counts.groupBy("source").agg(
            F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")
        ),
        "sources",
    )
    plan = materialize(source_plan(sources, budget, entropy_share, max_epochs), "plan")
    most = sources.agg(F.max("n_docs")).first()[0] or 0
    digits = 2
    while 16**digits * BLOCK_ROWS < most:
        digits += 1
    return counts, materialize(_cuts(counts, plan, seed, digits), "cuts")


def _copies(cut: DataFrame, seed: int, source: Column, id_: Column) -> Column:
    place = _place(seed, source, cut["epochs"], id_)
    head = (F.substring(place, 1, F.length(cut["block"])) < cut["block"]) | (
        place <= cut["last_place"]
    )
    copies = cut["epochs"] + F.when(head, 1).otherwise(0)
    return F.when(cut["tokens"] > 0, copies).otherwise(0).cast("int")


def source_mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", **target) -> DataFrame:
    """Rows ``id, source, n_tokens, alpha, weight, copies``: how often each row is taken.

    ``target``: ``budget``, ``entropy_share``, ``max_epochs`` as in :func:`source_plan`.
    """
    counts, cut = mixing_table(docs, id_col, source_col, text_col, seed=seed, **target)
    return counts.join(cut, counts["source"].eqNullSafe(cut["source"])).select(
        "id",
        counts["source"],
        "n_tokens",
        "alpha",
        "weight",
        _copies(cut, seed, counts["source"], counts["id"]).alias("copies"),
    )


def apply_mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text", **target) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    _, cut = mixing_table(docs, id_col, source_col, text_col, seed=seed, **target)
    n = free_name(docs, "copies")
    taken = docs.alias("d").join(cut, F.col(f"d.`{source_col}`").eqNullSafe(cut["source"]))
    taken = taken.select("d.*", _copies(cut, seed, F.col(f"d.`{source_col}`"), F.col(f"d.`{id_col}`")).alias(n))
    return taken.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).drop(n)
