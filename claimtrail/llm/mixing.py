"""Mixing sources to target weights by entropy balancing, in DataFrame terms.

Among all document rates between 0 and ``cap`` copies, the mix takes those of
least (bounded) relative entropy to an even rate that meet each source's words:

    minimise  sum r log r + (cap - r) log(cap - r)   so that  sum size * r = target

Its convex dual has one multiplier for each source, and the rates it gives are
exponentially tilted by the document's size: ``r = cap / (1 + exp(-lambda x))``
with ``x`` the size over the source's mean size.  Newton iterations on the dual
run as aggregates over the table of distinct (source, size) pairs, which holds
every document's contribution and does not grow with a source's rows once all
sizes occur.  Steps that leave the bracket of the root are replaced by halving.

Rounding keeps whole copies and gives the rest by sequential Poisson sampling:
documents with the smallest ``u / fraction`` (``u`` a hash of id and text) get one
more copy until the source's words are met.  The cut is found from histograms
of 2 x 4,096 bins, never by sorting a source in one task; three further rounds
fill what is left with documents that still fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from ._common import key_id, real_id, stored

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
TOLERANCE, STEPS = 1e-7, 60
BITS = 12                               # of each of the two histogram levels
ROUNDS = 4
WORD = r"[^\x20\x09-\x0D]+"


def _keys(df: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    return {"__id": key_id(F.col(id_col).cast("long")), "__body": F.xxhash64(text),
            "__src": F.coalesce(F.concat(F.lit("="), source), F.lit("")),       # null: the empty key
            "__size": F.regexp_count(text, F.lit(WORD)).cast("long")}


def targets(pairs: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``(src, docs, total, target)`` of ``pairs(src, size, n)``: weights by the
    sources' order, targets at most ``cap`` times the source, the excess shared
    again by weight.  The driver sees three sums a round."""
    per = pairs.groupBy("src").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("total"))
    ranked = global_rank(per, [F.col("src") == "", F.col("src")], "rank").df
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = stored(ranked.select("src", "docs", "total", weight.alias("w")), "sources")
    whole = per.agg(F.sum("total")).first()[0] or 0
    level, limit = 0.0, F.col("total") * cap
    while True:
        below = F.col("w") * F.lit(level) <= limit
        at_cap, open_w, n = per.agg(F.sum(F.when(~below, limit)), F.sum(F.when(below, F.col("w"))),
                                    F.count(F.when(below, 1))).first()
        new = (share * whole - (at_cap or 0.0)) / open_w if open_w else level
        if new <= level or not n:
            break
        level = new
    return per.select("src", "docs", "total", F.least(F.col("w") * F.lit(level), limit).alias("target"))


def rate(lam: Column, size: Column, scale: Column, cap: float) -> Column:
    return F.lit(cap) / (1 + F.exp(-lam * size / scale))


def multipliers(pairs: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """``wanted`` with the dual's solution ``lam`` and its ``scale``."""
    inf = F.lit(float("inf"))
    state = wanted.select(
        "*", F.greatest(F.lit(1.0), F.col("total") / F.col("docs")).alias("scale"),
        (F.col("target") >= F.col("total") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), (-inf).alias("lo"), inf.alias("hi"), F.lit(None).cast("double").alias("gap"))
    state = stored(state, "dual")
    fixed = ["src", "docs", "total", "target", "scale", "full"]
    for _ in range(STEPS):
        r = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        words = (F.col("n") * F.col("size")).cast("double")
        slopes = (pairs.join(state.where("not full").select("src", "lam", "scale"), "src")
                  .groupBy("src").agg(F.sum(words * r).alias("got"),
                                      F.sum(words * F.col("size") / F.col("scale") * r * (cap - r) / cap).alias("slope")))
        gap = F.col("got") - F.col("target")
        step = F.col("lam") - gap / F.col("slope")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        middle = (F.when((lo > -inf) & (hi < inf), (lo + hi) / 2)
                  .when(gap < 0, F.greatest(F.lit(1.0), 2 * F.col("lam"))).otherwise(F.least(F.lit(-1.0), 2 * F.col("lam"))))
        done = F.abs(gap) <= TOLERANCE * F.col("target")
        near = F.when(done | F.col("full") | gap.isNull(), F.col("lam")).when(
            (F.col("slope") > 0) & (step > lo) & (step < hi), step).otherwise(middle)
        state = stored(state.join(slopes, "src", "left").select(
            *fixed, near.alias("lam"), lo.alias("lo"), hi.alias("hi"),
            F.when(F.col("full") | gap.isNull(), 0.0).otherwise(F.abs(gap) / F.greatest(F.lit(1.0), F.col("target"))).alias("gap")),
            "dual")
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select(*fixed, "lam")


def _rated(df: DataFrame, cap: float) -> DataFrame:
    """Adds whole copies, and ``__b``: the place in the order of who gets one more."""
    r = F.when(F.col("full"), F.lit(cap)).otherwise(rate(F.col("lam"), F.col("__size"), F.col("scale"), cap))
    u = (F.shiftrightunsigned(F.xxhash64("__id", "__body", F.lit("copies")), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    out = df.withColumn("__rate", r).withColumn("__whole", F.floor("__rate").cast("long"))
    part = F.col("__rate") - F.col("__whole")
    place = F.floor(u / (u + part) * F.lit(float(1 << 2 * BITS))).cast("long")
    return out.withColumn("__b", F.when((part > 0) & (F.col("__size") > 0), place))


def _extra(rounds: int) -> Column:
    taken = F.lit(False)
    for k in range(rounds):
        taken = taken | ((F.col("__b") < F.col(f"cut{k}")) & (F.col("__size") <= F.col(f"room{k}")))
    return F.coalesce(taken, F.lit(False))


def _cumulated(rows: DataFrame, by: str, start: Column) -> DataFrame:
    """Per source (and bin, at most 4,096 of them) the words up to each bin; keeps
    the first bin that passes the room."""
    w = Window.partitionBy("__src").orderBy(by)
    sums = rows.groupBy("__src", by).agg(F.sum("__size").alias("s"), F.first("room").alias("room"), F.first(start).alias("start"))
    run = sums.withColumn("upto", F.col("start") + F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = run.where("upto > room").groupBy("__src").agg(F.min(F.struct(by, "upto", "s")).alias("x"))
    return over.select("__src", F.col(f"x.{by}").alias(by), F.col("x.upto").alias("upto"), F.col("x.s").alias("s"))


def cuts(sized: DataFrame, params: DataFrame, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """``params`` with ``cut0, room0, cut1, ...``: a document gets one more copy if
    its place is below a cut and its size fits that round's room."""
    top = 1 << 2 * BITS
    for k in range(rounds):
        rows = _rated(sized.join(params.withColumnRenamed("src", "__src"), "__src"), cap)
        rows = rows.withColumn("__more", _extra(k))
        used = rows.groupBy("__src").agg(F.sum(F.col("__size") * (F.col("__whole") + F.col("__more").cast("long"))).alias("used"))
        room = F.col("target") - F.col("used")
        now = stored(params.join(used.withColumnRenamed("__src", "src"), "src", "left")
                     .withColumn("room", F.coalesce(room, F.lit(0.0))).drop("used"), "room")
        fits = rows.join(now.select(F.col("src").alias("__src"), "room"), "__src").where(
            F.col("__b").isNotNull() & ~F.col("__more") & ((F.lit(k) == 0) | (F.col("__size") <= F.col("room"))))
        first = _cumulated(fits.withColumn("hi", F.shiftright("__b", BITS)), "hi", F.lit(0.0))
        inner = fits.withColumn("hi", F.shiftright("__b", BITS)).join(
            first.select("__src", "hi", (F.col("upto") - F.col("s")).alias("before")), ["__src", "hi"])
        second = _cumulated(inner.withColumn("low", F.col("__b") % (1 << BITS)), "low", F.col("before"))
        at = first.select("__src", "hi").join(second, "__src").select(
            F.col("__src").alias("src"),
            (F.shiftleft("hi", BITS) + F.col("low")).alias("at"), "upto", "s")
        # the last round may pass the target if that comes nearer to it
        past = (F.col("upto") - F.col("room") < F.col("room") - (F.col("upto") - F.col("s"))) & F.lit(k == rounds - 1)
        params = stored(now.join(at, "src", "left").select(
            *params.columns,
            F.when(F.col("at").isNull(), F.lit(top)).otherwise(F.col("at") + past.cast("long")).cast("long").alias(f"cut{k}"),
            (F.lit(float("inf")) if k == 0 else F.col("room")).alias(f"room{k}")), "cuts")
    return params


def plan(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(the documents' keys and sizes, the parameters of every source)."""
    keys = _keys(df, id_col, text_col, source_col)
    sized = stored(df.select(*(c.alias(k) for k, c in keys.items())), "sizes")
    pairs = stored(sized.groupBy(F.col("__src").alias("src"), F.col("__size").alias("size"))
                   .agg(F.count(F.lit(1)).alias("n")), "pairs")
    params = multipliers(pairs, targets(pairs, weights, share, cap), cap)
    return sized, cuts(sized, params, cap)


def _with_copies(df: DataFrame, params: DataFrame, cap: float) -> DataFrame:
    rated = _rated(df.join(params.withColumnRenamed("src", "__src"), "__src"), cap)
    return rated.withColumn("__copies", F.col("__whole") + _extra(ROUNDS).cast("long"))


def mix(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row.

    Sizes are words (null text: 0).  A null source is a source of its own, the
    last.  A source without words has target 0.  Rows that repeat id and text
    fall on the same side of the cut.  Null ids take part like others.  An empty
    table gives no rows; extra columns are not carried.
    """
    sized, params = plan(df, weights, share, cap, id_col, text_col, source_col)
    out = _with_copies(sized, params, cap)
    return out.select(
        real_id("__id").alias("doc_id"), F.when(F.col("__src") != "", F.expr("substring(__src, 2)")).alias("source"),
        F.col("__size").alias("size"), F.col("total").alias("source_size"), "target",
        F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken.
    Only the sources' parameters are joined; texts stay where they are if Spark
    finds that table small, and are split by its skew handling if not."""
    _, params = plan(df, weights, share, cap, id_col, text_col, source_col)
    keyed = df.select(F.struct("*").alias("__row"), *(c.alias(k) for k, c in _keys(df, id_col, text_col, source_col).items()))
    out = _with_copies(keyed, params, cap).where("__copies > 0")
    return out.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select("__row.*")
