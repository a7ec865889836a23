"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that they belong to;
one source each in the plain case). Each pattern supplies ``copies`` passes of its tokens,
every further pass at a higher cost; each source wants its quota. The cost of a pass is the
same for all patterns, so the optimal flow is a largest flow of first passes, then of second
ones on top of it, and so on: shortest augmenting paths, all of one length in one go, over
the small graph pattern -> source. What a pattern ships is then spread over its documents:
whole passes for all of them and the rest for a seeded selection.

The selection needs no total order: documents have a hash, sums over its leading digits find
the bin in which the quota ends, and that bin is cut into finer ones, a few digits at a time,
until the hash is known up to which documents are taken. Only sums and (hash, size) rows of
the bins in question are moved, and only sums of sources and patterns reach the driver;
beyond ``max_patterns`` it raises instead of collecting.

Edge cases: a null text has size 0; a null source is a source, the last one; documents of
size 0 take 0; sources of size 0 get target 0; a document without an id is known by its text;
repeated rows each count and may differ in what is taken only where the quota ends between
them; an empty table gives an empty table; extra columns are kept (a column named ``mix`` is
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved
from .words import free_names

#: Hex digits of the seeded order that a round of bins looks at, and rounds until whole hashes are compared.
DIGITS, ROUNDS = 3, 4


def words_of(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("bigint")


def waterfill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what a cap cuts off goes to the others by weight."""
    share, open_ = [0.0] * len(caps), [i for i, c in enumerate(caps) if c > 0]
    left = min(total, sum(caps))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= caps[i]]
        if not full:
            for i in open_:
                share[i] = unit * weights[i]
            break
        for i in full:
            share[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return share


def route(supply: dict[tuple, float], quota: dict, copies: int) -> dict[tuple, float]:
    """Tokens that each pattern ships: min-cost flow from passes over patterns to source quotas.

    supply: tokens of each pattern (a tuple of sources). A pass k of a pattern costs k a
    token, so flows are made largest pass by pass. Each phase finds the distance of every
    source from patterns with tokens left (a source is left for the patterns that ship to
    it), and sends what it can along shortest paths, no edge being looked at twice.
    """
    patterns, names = list(supply), list(quota)
    at = {s: j for j, s in enumerate(names)}
    goes = [[at[s] for s in p] for p in patterns]
    flow: list[dict[int, float]] = [{} for _ in names]  # of each source, by pattern
    left = [float(quota[s]) for s in names]
    sent = [0.0] * len(patterns)
    eps = 1e-6
    for level in range(1, copies + 1):
        room = [supply[p] * level - sent[i] for i, p in enumerate(patterns)]
        while True:
            depth_p, depth_s = [-1] * len(patterns), [-1] * len(names)
            edge, ends, depth = [i for i, r in enumerate(room) if r > eps and goes[i]], False, 0
            for i in edge:
                depth_p[i] = 0
            while edge and not ends:
                depth, fresh = depth + 1, []
                for i in edge:
                    for j in goes[i]:
                        if depth_s[j] < 0:
                            depth_s[j] = depth
                            fresh.append(j)
                ends = any(left[j] > eps for j in fresh)
                edge = []
                if not ends:
                    for j in fresh:
                        for i, f in flow[j].items():
                            if f > eps and depth_p[i] < 0:
                                depth_p[i] = depth
                                edge.append(i)
            if not ends:
                break
            to, back, held = [0] * len(patterns), [0] * len(names), {}  # how far each edge list has been used up
            for first in [i for i, r in enumerate(room) if r > eps and depth_p[i] == 0]:
                path: list[tuple[int, int]] = []  # steps from a pattern to a source; the next step's pattern ships to that source
                i = first
                while room[first] > eps:
                    if to[i] == len(goes[i]):  # a dead end: the step that led here is used up
                        if not path:
                            break
                        i, j = path.pop()
                        back[j] += 1
                        continue
                    j = goes[i][to[i]]
                    if depth_s[j] != depth_p[i] + 1 or depth_s[j] == depth and left[j] <= eps:
                        to[i] += 1
                    elif depth_s[j] < depth:
                        if j not in held:
                            held[j] = [k for k, f in flow[j].items() if f > eps and depth_p[k] == depth_s[j]]
                        if back[j] == len(held[j]):
                            to[i] += 1
                        elif flow[j][held[j][back[j]]] <= eps:
                            back[j] += 1
                        else:
                            path.append((i, j))
                            i = held[j][back[j]]
                    else:
                        steps = [*path, (i, j)]
                        over = [(steps[n + 1][0], steps[n][1]) for n in range(len(path))]  # what is taken back
                        most = min([room[first], left[j], *(flow[s][k] for k, s in over)])
                        for k, s in steps:
                            flow[s][k] = flow[s].get(k, 0.0) + most
                        for k, s in over:
                            flow[s][k] -= most
                        room[first] -= most
                        sent[first] += most
                        left[j] -= most
                        path, i = [], first
    return dict(zip(patterns, sent))


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, copies: int, max_patterns: int) -> tuple[list[tuple], dict]:
    """(rows of (pattern, tokens), quota of each source). sizes: (pattern array<string>, tokens)."""
    if sizes.limit(max_patterns + 1).count() > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns; group sources first")
    rows = [(tuple(r.pattern), int(r.tokens)) for r in sizes.collect()]
    held: dict = {}
    for pattern, tokens in rows:
        for s in pattern:
            held[s] = held.get(s, 0) + tokens
    order = sorted(held, key=lambda s: (s is None, s or ""))  # Python compares strings by code point
    share = waterfill([weights[i % len(weights)] for i in range(len(order))], [copies * held[s] for s in order], budget * sum(t for _, t in rows))
    return rows, dict(zip(order, share))


def cuts_of(marks: DataFrame, sums: DataFrame, quotas: DataFrame) -> DataFrame:
    """(q: row of ``quotas``, h, j, c) a pattern: documents with a hash below ``h`` are taken, and j of the c that have it; h null: all are.

    marks: (s, n, h) of every document; sums: (s, bin, tokens) by the first digits of h.
    Windows are over the bins of a pattern, at most 16 ** DIGITS rows.
    """
    same = F.col("d.s").eqNullSafe(F.col("q.sources"))
    ends = quotas.select("sources", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before"), "extra")
    for k in range(ROUNDS):
        if k:
            marks = saved(marks.alias("d").join(F.broadcast(ends).alias("q"), same).where(F.col("d.h").startswith(F.col("q.prefix"))).select("d.*"), "mix-marks")
            sums = marks.groupBy("s", F.substring("h", k * DIGITS + 1, DIGITS).alias("bin")).agg(F.sum("n").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = sums.withColumn("upto", upto).alias("d").join(F.broadcast(ends).alias("q"), same)
        over = bins.where(F.col("q.before") + F.col("d.upto") > F.col("q.extra")).groupBy("q.sources").agg(F.min(F.struct("d.bin", "q.prefix", (F.col("q.before") + F.col("d.upto") - F.col("d.tokens")).alias("before"), "q.extra")).alias("e"))
        ends = saved(over.select("sources", F.concat("e.prefix", "e.bin").alias("prefix"), "e.before", "e.extra"), "mix-ends")
    last = marks.alias("d").join(F.broadcast(ends).alias("q"), same).where(F.col("d.h").startswith(F.col("q.prefix"))).groupBy("q.sources", "q.before", "q.extra", "d.h").agg(F.max("d.n").alias("n"), F.count("*").alias("c"))
    upto = F.sum(F.col("n") * F.col("c")).over(Window.partitionBy("sources").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.floor((F.col("extra") - F.col("before") - F.col("upto") + F.col("n") * F.col("c")) / F.nullif("n", F.lit(0)) + 0.5)
    last = last.withColumn("upto", upto).withColumn("j", F.least(F.greatest(F.coalesce(fits, "c"), F.lit(0)), F.col("c")))
    # the first hash of which not all are taken, or else the last one
    cut = last.groupBy("sources").agg(F.coalesce(F.min(F.when(F.col("j") < F.col("c"), F.struct("h", "j", "c"))), F.max(F.struct("h", "j", "c"))).alias("d"))
    met = quotas.alias("q").join(cut.alias("e"), F.col("q.sources").eqNullSafe(F.col("e.sources")), "left")
    return saved(met.select(F.struct("q.*").alias("q"), F.col("e.d.h").alias("h"), F.col("e.d.j").alias("j"), F.col("e.d.c").alias("c")), "mix-cuts")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, copies: int = 2, seed: int = 11, sources: Column | None = None, size: Column | None = None, max_patterns: int = 200_000, out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out``, which takes the place of a column of that name: sources, size, pattern_size, quota (of its sources) and taken, the words that the mix takes of it, repeats counted.

    sources: array column of the sources of a document, by default its one ``source``.
    size: its words, by default counted in ``text``.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(sources)) if sources is not None else F.array(F.col("source"))
    size = words_of(F.col("text")) if size is None else size
    name = F.col("doc_id").cast("string")
    name = F.coalesce(name, F.md5(F.coalesce("text", F.lit("")))) if "text" in docs.columns else name
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), name, size.cast("string")))
    m, c, w = free_names(docs.columns, "m", "c", "w")
    source, mark_, room, part, before = (f"{x}_tied" for x in free_names([k.removesuffix("_tied") for k in docs.columns], "s", "h", "j", "p", "b"))
    held = docs.withColumn(m, F.struct(pattern.alias("s"), size.alias("n"), mark.alias("h")))
    marks = saved(held.select(f"{m}.*"), "mix-marks")
    sums = saved(marks.groupBy("s", F.substring("h", 1, DIGITS).alias("bin")).agg(F.sum("n").alias("tokens")), "mix-sums")
    rows, quota = targets(sums.groupBy(F.col("s").alias("pattern")).agg(F.sum("tokens").alias("tokens")), tuple(weights), budget, copies, max_patterns)
    ships = route({p: float(t) for p, t in rows}, quota, copies)
    plan = []
    for p, t in rows:
        passes = min(int(ships[p] / t + 1e-9), copies) if t else 0
        plan.append((list(p), t, float(sum(quota[s] for s in p)), passes, max(0.0, ships[p] - t * passes)))
    quotas = spark.createDataFrame(plan, "sources array<string>, pattern_size bigint, quota double, passes int, extra double")
    cuts = cuts_of(marks, sums, quotas)
    # a row a pattern, and there are at most max_patterns
    met = held.join(F.broadcast(cuts.select(F.struct("*").alias(c))), F.col(f"{m}.s").eqNullSafe(F.col(f"{c}.q.sources")))
    here = F.col(f"{m}.h") == F.col(f"{c}.h")
    more = F.when(F.col(f"{c}.h").isNull() | (F.col(f"{m}.h") < F.col(f"{c}.h")), 1).when(here & (F.col(f"{c}.j") > 0), 1).otherwise(0)
    if cuts.where("j > 0 AND j < c").isEmpty():
        met = met.withColumn(w, more)
    else:  # the quota ends between rows that share id and size: so many of them are numbered, part by part of the table they are written to
        met = saved(met, "mix-met")  # conditions on both sides' fields must not be pushed into the join
        split = here & (F.col(f"{c}.j") > 0) & (F.col(f"{c}.j") < F.col(f"{c}.c"))
        flat = [F.col(f"{m}.s").alias(source), F.col(f"{m}.h").alias(mark_), F.col(f"{c}.j").alias(room), F.spark_partition_id().alias(part)]
        tied = saved(met.where(split).select("*", *flat), "mix-tied")
        sizes = tied.groupBy(F.col(source).alias("s"), F.col(part).alias("p")).agg(F.count("*").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offset = saved(sizes.select(F.col("s").alias(f"{source}_"), F.col("p").alias(f"{part}_"), earlier.alias(before)), "mix-offsets")
        tied = tied.join(offset, F.col(source).eqNullSafe(F.col(f"{source}_")) & (F.col(part) == F.col(f"{part}_")))
        number = F.row_number().over(Window.partitionBy(source, part).orderBy(mark_)) + F.col(before)
        tied = saved(tied.withColumn(w, (number <= F.col(room)).cast("int")).drop(source, mark_, room, part, before, f"{source}_", f"{part}_"), "mix-numbered")
        met = met.where(~F.coalesce(split, F.lit(False))).withColumn(w, more).unionByName(tied)
    taken = F.col(f"{m}.n") * F.least(F.lit(copies), F.col(f"{c}.q.passes") + F.col(w))
    mixed = F.struct(F.col(f"{m}.s").alias("sources"), F.col(f"{m}.n").alias("size"), F.col(f"{c}.q.pattern_size").alias("pattern_size"), F.col(f"{c}.q.quota").alias("quota"), taken.alias("taken"))
    return met.select(*[F.col(f"`{x}`") for x in docs.columns if x != out], mixed.alias(out))
