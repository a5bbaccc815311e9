"""Beam search over n-gram tables of any size (MK-05, MK-09, MK-10, MK-14, JN-20).

The model is two tables of continuations, forward and backward, bucketed by model and context.  The frontier of all beams of all
requests is one DataFrame; a step joins the contexts of its states with the backward table, which does not move, weighs the
continuations of each state, and keeps the best states of each beam.  Beams are spread by their id, a beam has at most
``width`` states of at most 96 continuations a context, and every step is written to the shared folder, so that a lost
executor costs one step.  Of the model only the support of words passes the driver, and only if they are few.

Equal seeds give equal lines: the noise of a state is a hash of the seed and its words, and scores are compared to nine
decimals, so that the last bits of logarithms decide nothing.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import decoder as D
from . import workspace as W
from .decoder import END, START, Controls

#: Continuations of a context that a state may take.
CHOICES = 96
ROW = "model string, context string, next string, n long, total long, support double, place int"


@dataclass
class Tables:
    """Continuations (model, context, next, n, total, support, place) in both directions, bucketed by model and context."""

    forward: DataFrame
    backward: DataFrame
    order: int


#: Words up to which their support is sent to the tasks.
MAX_BROADCAST_WORDS = 500_000
#: Parts, by context, in which all transitions of a corpus are dealt to their buckets.
PARTS = 4


def build(forward: DataFrame, backward: DataFrame, order: int, folder: str | None = None, buckets: int = 16, most: int | None = None) -> Tables:
    """Writes the tables of a model from `decoder.continuations` of both directions (model, context, next, n), or from all
    transitions and the number of continuations that each context keeps (``most``).

    support tells how often a word follows any context: log(1 + n) / log(1024).  Rows are dealt to their bucket once, before
    they are placed."""
    spark = forward.sparkSession
    folder = folder or f"{W.shared_dir(spark)}/klangwerk-model-{uuid.uuid4().hex}"
    own, counted, out = Window.partitionBy("model", "context"), {}, []
    parts = 1 if most is None else PARTS
    for name, df in (("forward", forward), ("backward", backward)):  # each is read three times below, and is made of the whole corpus
        W.released(spark, path := f"{folder}/counted-{name}")
        for part in range(parts):  # one after the other, so that disk holds the shuffle of one
            some = df.select("model", "context", "next", "n").where(F.pmod(F.xxhash64("model", "context"), F.lit(parts)) == part)
            placed = some.repartition(buckets, "model", "context").withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "next")))
            placed = (placed if most is None else placed.where(F.col("place") <= most)).withColumn("total", F.sum("n").over(own))
            placed.write.mode("append").parquet(path)
            schema = placed.schema
            del some, placed
            W.released(spark)
        counted[name] = spark.read.schema(schema).parquet(path)
    uses = counted["forward"].unionByName(counted["backward"]).groupBy("model", "next").agg(F.least(F.lit(1.0), F.log1p(F.sum("n")) / math.log(1024)).alias("support"))
    uses = W.settled(uses, f"{folder}/uses")
    few = uses.count() <= MAX_BROADCAST_WORDS
    for name, df in counted.items():
        table = f"klangwerk_{name}_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        # a file that was counted has rows of one bucket, and where nothing is shuffled they stay together
        rows = df.join(F.broadcast(uses), ["model", "next"]) if few else df.join(uses, ["model", "next"]).repartition(buckets, "model", "context")
        (rows.select(*(x.split(" ")[0] for x in ROW.split(", "))).write.format("parquet").mode("overwrite")
         .option("path", f"{folder}/{name}").bucketBy(buckets, "model", "context").sortBy("model", "context", "place").saveAsTable(table))
        W.released(spark, f"{folder}/counted-{name}")
        out.append(spark.table(table))
    return Tables(*out, order)


def _nearest(around: Column, order: int, direction: str) -> Column:
    """array<struct<k, context>>: the words next to the open place, from one to ``order`` of them."""
    size = F.least(F.lit(order), F.size(around))
    part = lambda k: F.slice(around, 1, k) if direction == "backward" else F.slice(around, F.size(around) - k + 1, k)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(k.alias("k"), F.array_join(part(k), " ").alias("context"))))


def probabilities(asked: DataFrame, table: DataFrame, order: int, direction: str, *keys: str) -> DataFrame:
    """MK-02: keys and p of every row (keys, model, around, next): n / total of the longest context that was followed by next, else 0."""
    each = asked.select(*keys, "model", "next", F.explode_outer(_nearest(F.col("around"), order, direction)).alias("c")).select(*keys, "model", "next", "c.k", "c.context")
    # the table stays in its buckets; what is asked of it is little, and is moved
    asked_of = table.join(each.select("model", "context").distinct(), ["model", "context"], "left_semi")
    met = each.join(asked_of.select("model", "context", "next", (F.col("n") / F.col("total")).alias("p")), ["model", "context", "next"], "left")
    return met.groupBy(*keys).agg(F.coalesce(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("k"))), F.lit(0.0)).alias("p"))


def forward_scores(lines: DataFrame, tables: Tables, *keys: str) -> DataFrame:
    """MK-05: keys and p, the probabilities of all transitions of a line (keys, model, tokens), its end included, in order."""
    padded = F.concat(F.array_repeat(F.lit(START), tables.order), "tokens", F.array(F.lit(END)))
    place = F.posexplode(F.transform(F.sequence(F.lit(tables.order + 1), F.size(padded)), lambda i: F.struct(F.slice(padded, i - tables.order, tables.order).alias("around"), F.element_at(padded, i).alias("next"))))
    each = lines.select(*keys, "model", place.alias("at", "x")).select(*keys, "model", "at", "x.around", "x.next")
    p = probabilities(each, tables.forward, tables.order, "forward", *keys, "at")
    return p.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("p"))


def _repetition(prefix: Column, token: Column) -> Column:
    """What a word costs that the line has; null if it has it twice."""
    n = F.size(F.filter(prefix, lambda x: x == token))
    again = F.when((F.size(prefix) > 1) & (F.element_at(prefix, -1) == token), 1.2).otherwise(0.0)
    return F.when(n <= 1, F.when(n == 1, 0.65).otherwise(0.0) + again)


def _options(frontier: DataFrame, tables: Tables, c: Controls, step: int) -> DataFrame:
    """The continuations of every state: beam, state columns, next, p, k.

    The longest context that knows any counts first; while few words are found, one shorter adds others.  Far less likely ones
    than a context's best are left out, and only the best by weight and noise stay."""
    order = tables.order
    around = F.concat("prefix", "tail", F.array(F.lit(END)))
    # a shuffle by beam serves all windows below
    asked = frontier.repartition("beam").select("*", F.explode(_nearest(around, order, "backward")).alias("c"))
    met = asked.withColumn("context", F.col("c.context")).withColumn("k", F.col("c.k")).drop("c").join(tables.backward.where(F.col("place") <= CHOICES), ["model", "context"])
    free = ~F.col("next").isin(START, END)
    state = Window.partitionBy("beam", "state")
    found = met.where(free).withColumn("rep", _repetition(F.col("prefix"), F.col("next"))).where("rep IS NOT NULL").withColumn("q", F.col("n") / F.col("total"))
    best = F.max("q").over(Window.partitionBy("beam", "state", "k"))
    likely = found.where("q IS NOT NULL").withColumn("_best", best).where(F.col("q") >= F.col("_best") * (0.015 + c.naturalness * 0.12))
    longest = likely.withColumn("_k", F.max("k").over(Window.partitionBy("beam", "state", "next")))
    fresh = [F.coalesce(F.sum(F.when((F.col("_k") == j) & (F.col("k") == j), 1)).over(state), F.lit(0)) for j in range(1, order + 1)]
    before = sum((F.when(F.col("k") < j, fresh[j - 1]).otherwise(0) for j in range(2, order + 1)), F.lit(0))
    open_ = longest.withColumn("_before", before).where(F.col("_before") < 10)
    base = F.greatest(F.lit(1e-9), F.col("q")) * (0.78 + F.col("k") / order * (0.32 + c.naturalness * 0.52)) * (0.85 + F.col("support") * 0.3) * F.exp(-F.col("rep"))
    own = Window.partitionBy("beam", "state", "next").orderBy(F.desc("base"), F.desc("k"))
    weighed = open_.withColumn("base", base).withColumn("_n", F.row_number().over(own)).where("_n = 1")
    noise = F.crc32(F.concat_ws("\u0001", "seed", "state", "next").cast("binary")) / 4294967296
    weight = F.log(F.greatest(F.col("base"), F.lit(1e-12))) + c.weirdness * (noise - 0.5) * 0.7
    many = max(5, min(20, math.floor(7 + c.weirdness * 13 + 0.5)))
    ranked = weighed.withColumn("weight", F.round(weight, 9)).withColumn("_r", F.row_number().over(state.orderBy(F.desc("weight"), F.desc("k"), F.desc("n"), "next"))).where(F.col("_r") <= many)
    kept = [*frontier.columns, "next", F.col("q").alias("p"), "k"]
    plain = ranked.select(*kept)
    if not c.opening:
        return plain
    return _bridged(plain, met.where(F.size("opening") > 0).where(F.col("missing") == step + 1), tables, kept)


def _bridged(plain: DataFrame, met: DataFrame, tables: Tables, kept: list) -> DataFrame:
    """JN-20: before a fixed opening only words stand that were seen on both sides; where there is none, any."""
    order, state = tables.order, Window.partitionBy("beam", "state")
    left = met.select("beam", "model", "opening").distinct().select("beam", "model", F.explode(_nearest(F.col("opening"), order, "forward")).alias("c")).select("beam", "model", "c.k", "c.context")
    ahead = left.join(tables.forward.where(F.col("place") <= CHOICES), ["model", "context"])
    ahead = ahead.withColumn("_k", F.max("k").over(Window.partitionBy("beam"))).where("k = _k").select("beam", F.col("next").alias("_next"), (F.col("n") / F.col("total")).alias("_p"), F.col("k").alias("_ahead"))
    behind = met.withColumn("_k", F.max("k").over(state)).where("k = _k")
    both = behind.join(ahead.withColumnRenamed("beam", "_beam"), (F.col("beam") == F.col("_beam")) & (F.col("next") == F.col("_next"))).where(~F.col("next").isin(START, END))
    both = both.withColumn("q", F.sqrt(F.col("_p") * (F.col("n") / F.col("total")))).withColumn("k", F.least("k", "_ahead")).select(*kept)
    rest = plain.join(both.select("beam", "state").distinct(), ["beam", "state"], "left_anti").select(*plain.columns)
    return rest.unionByName(both)


def search(beams: DataFrame, tables: Tables, c: Controls = Controls()) -> DataFrame:
    """MK-09: beam, place, tokens, prefix and context_mean of lines of the target length that end in ``tail``.

    ``beams``: beam (id), model, tail, seed.  Lines are built from right to left; the best states by score stay, one for each
    beginning.  A tail that is longer than the line, or that nothing precedes, has no line."""
    spark, order = beams.sparkSession, tables.order
    folder = f"{W.shared_dir(spark)}/klangwerk-beam-{uuid.uuid4().hex}"
    length = max(D.COMPACT, min(D.LONGEST, c.target))
    width = max(10, min(36, math.floor(14 + c.weirdness * 22 + 0.5)))
    opening = F.array(*map(F.lit, c.opening)) if c.opening else F.array().cast("array<string>")
    start = beams.select("beam", "model", "tail", "seed", opening.alias("opening"), (F.lit(length - len(c.opening)) - F.size("tail")).alias("missing"), F.array().cast("array<string>").alias("prefix"),
                         F.lit("").alias("state"), F.lit(0.0).alias("score"), F.lit(0).alias("depth"))
    columns = start.columns
    frontier = W.settled(start.where("missing >= 0"), f"{folder}/0")
    done = [frontier.where("missing = 0").withColumn("place", F.lit(1))]
    most = frontier.agg(F.max("missing")).first()[0] or 0
    for step in range(most):
        grown = _options(frontier.where(F.col("missing") > step), tables, c, step)
        prefix = F.concat(F.array("next"), "prefix")
        grown = grown.select(*(x for x in columns if x not in ("prefix", "state", "score", "depth")), prefix.alias("prefix"), F.array_join(prefix, " ").alias("state"),
                             F.round(F.col("score") + F.log(F.greatest(F.col("p"), F.lit(1e-9))) + F.col("k") / order * 0.24, 9).alias("score"), (F.col("depth") + F.col("k")).alias("depth"))
        first = [F.desc("score"), F.desc("depth"), F.asc("state")]
        alike = Window.partitionBy("beam", F.array_join(F.slice("prefix", 1, order + 1), " ")).orderBy(*first)
        kept = grown.withColumn("_n", F.row_number().over(alike)).where("_n = 1").withColumn("place", F.row_number().over(Window.partitionBy("beam").orderBy(*first))).where(F.col("place") <= width)
        frontier = W.settled(kept.select(*columns, "place"), f"{folder}/{step + 1}")
        W.released(spark)
        done.append(frontier.where(F.col("missing") == step + 1))
        frontier = frontier.drop("place")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("beam", "place", "model", "tail", F.concat("opening", "prefix", "tail").alias("tokens"), "prefix", F.when(F.col("missing") > 0, F.col("depth") / F.col("missing")).otherwise(0.0).alias("context_mean"))


def with_entities(lines: DataFrame, entities: DataFrame, tables: Tables, *keys: str, most: int = 6) -> DataFrame:
    """MK-10: lines (keys, model, tokens, prefix, seed; the prefix begins at ``lead``) and variants in which an entity takes the place of as many words of
    the prefix, if few transitions of the new line are unseen: keys, tokens, entity, entity_quality, entity_at, place (0 for the line).

    ``entities``: model, entity (array of one to four words), quality; the 24 best of a model count."""
    e = entities.where(F.size("entity").between(1, 4)).withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("quality"), F.array_join("entity", " ")))).where("_n <= 24")
    n = F.size("entity")
    fits = lines.join(e.select("model", "entity", "quality"), "model").where(n <= F.size("prefix"))
    placed = fits.select("*", F.explode(F.sequence(F.lit(0), F.size("prefix") - n)).alias("entity_at"))
    at = F.col("lead") + F.col("entity_at")
    tokens = F.concat(F.slice("tokens", F.lit(1), at), "entity", F.slice("tokens", at + n + 1, F.size("tokens")))
    own = [*keys, "entity", "entity_at"]
    made = placed.withColumn("tokens", tokens)
    unseen = forward_scores(made.select(*own, "model", "tokens"), tables, *own).select(*own, (F.size(F.filter("p", lambda p: p == 0)) / F.size("p")).alias("unseen"))
    noise = F.crc32(F.concat_ws("\u0001", "seed", F.array_join("tokens", " "), F.array_join("entity", " ")).cast("binary")) / 4294967296
    good = made.join(unseen.where("unseen <= 0.18"), own).withColumn("entity_quality", F.col("quality") * 0.58 + (1 - F.col("unseen")) * 0.34 + noise * 0.08)
    ranked = good.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("entity_quality"), F.array_join("entity", " "), "entity_at"))).where(F.col("place") < most)
    plain = lines.select(*keys, "tokens", F.lit(None).cast("array<string>").alias("entity"), F.lit(None).cast("double").alias("entity_quality"), F.lit(None).cast("int").alias("entity_at"), F.lit(0).alias("place"))
    return plain.unionByName(ranked.select(*plain.columns))


#: Lines of an attempt that become drafts.
DRAFTS = 2


def draft(row: dict, c: Controls, order: int) -> tuple[float, float]:
    """MK-14: naturalness and utility of a line from its probabilities (p, start, end), context_mean and its tail's qualities."""
    p = row["p"]
    forward, zero = math.exp(sum(math.log(max(x, 1e-9)) for x in p) / len(p)), sum(x == 0 for x in p) / len(p)
    transition = D._unit(max(forward, 1e-9) ** 0.24 * (1 - zero))
    start, end = math.sqrt(row["start"]) if row["prefix_size"] else 0.0, row["end"] ** 0.35
    natural = D._unit(transition * 0.42 + D._unit(row["context_mean"] / order) * 0.18 + 0.5 * 0.15 + D._unit(start) * 0.09 + D._unit(end) * 0.06 + row["usage"] * 0.05)
    w = (0.38 + c.naturalness * 0.3, 0.22 + c.pressure * 0.32, 0.08)
    return natural, (natural * w[0] + row["phonetic"] * w[1] + row["support"] * w[2]) / sum(w)


def attempts(reservoirs: DataFrame, request: str, c: Controls, n: int, seed) -> DataFrame:
    """MK-08: the tails of n draws from each request's reservoir (a bounded list), in order: request, model, attempt, seed, tail and qualities."""
    kind = dict(reservoirs.dtypes)[request]

    def run(pdf):
        import pandas as pd

        key = pdf[request].iloc[0]
        rows = [r for r in pdf.sort_values("place").to_dict("records") if len(r["tokens"])]
        tails = [{"form": r["normalized"], "final": list(r["tokens"])[-1], "family": " ".join(list(r["tokens"])[-2:]), "quality": r["quality"], "row": r} for r in rows]
        draw, used, out = D.seeded_random(f"{seed}|{key}"), {}, []
        for i in range(n if tails else 0):
            t = D.choose(tails, draw, c, used)
            out.append((key, t["row"]["model"], i, f"{seed}|{key}|{i}", list(t["row"]["tokens"]), t["form"], t["family"], *(float(t["row"][x]) for x in ("phonetic", "usage", "support"))))
        return pd.DataFrame(out, columns=[request, "model", "attempt", "seed", "tail", "form", "family", "phonetic", "usage", "support"])

    return reservoirs.groupBy(request).applyInPandas(run, f"`{request}` {kind}, model string, attempt int, seed string, tail array<string>, form string, family string, phonetic double, usage double, support double")


def generate(tables: Tables, reservoirs: DataFrame, request: str, c: Controls = Controls(), count: int = 8, most: int = 128, seed=1337) -> DataFrame:
    """MK-14: request, rank, line, form, utility, natural: diverse lines that end in tails of each request's reservoir.

    ``reservoirs``: the rows of `decoder.tail_reservoir` with request, model, normalized, tokens, place; a bounded list for
    each request.  Tails are drawn until four times ``count`` different lines are found, at most ``most`` times; rounds of draws
    are searched at once."""
    spark = reservoirs.sparkSession
    folder = f"{W.shared_dir(spark)}/klangwerk-lines-{uuid.uuid4().hex}"
    drawn = W.settled(attempts(reservoirs, request, c, most, seed).withColumn("beam", F.xxhash64("seed")), f"{folder}/attempts")
    enough, size, lines, ready = 4 * count, max(1, -(-4 * count // DRAFTS)), None, None
    edges = [0, size]
    while edges[-1] < most:  # few rounds: requests that lack lines after one search all the more in the next
        edges.append(edges[-1] * 5)
    for i, (at, to) in enumerate(zip(edges, edges[1:])):
        asked = drawn.where((F.col("attempt") >= at) & (F.col("attempt") < to))
        if ready is not None:
            asked = asked.join(F.broadcast(ready), request, "left_anti")  # a row for each request at most
        found = search(asked, tables, c).where(F.col("place") <= DRAFTS)
        own = asked.select("beam", request, "attempt", "form", "family", "phonetic", "usage", "support")
        found = W.settled(found.join(own, "beam").withColumn("line", F.array_join("tokens", " ")), f"{folder}/lines-{i}")
        lines = found if lines is None else lines.unionByName(found)
        ready = lines.groupBy(request).agg(F.countDistinct("line").alias("n")).where(F.col("n") >= enough).select(request)
        if asked.select(request).distinct().join(ready, request, "left_anti").isEmpty():
            break
    # draws end with the attempt that completes the lines
    first = lines.groupBy(request, "line").agg(F.min("attempt").alias("attempt")).groupBy(request, "attempt").agg(F.count("*").alias("n"))
    seen = first.withColumn("_sum", F.sum("n").over(Window.partitionBy(request).orderBy("attempt")))
    last = seen.where(F.col("_sum") >= enough).groupBy(request).agg(F.min("attempt").alias("_last"))
    kept = W.settled(lines.join(last, request, "left").where(F.col("_last").isNull() | (F.col("attempt") <= F.col("_last"))).drop("_last"), f"{folder}/kept")
    keys = ["beam", "place"]
    p = forward_scores(kept.select(*keys, "model", "tokens"), tables, *keys)
    start = probabilities(kept.select(*keys, "model", F.col("prefix").alias("around"), F.lit(START).alias("next")), tables.backward, tables.order, "backward", *keys).withColumnRenamed("p", "start")
    end = probabilities(kept.select(*keys, "model", F.col("tail").alias("around"), F.lit(END).alias("next")), tables.forward, tables.order, "forward", *keys).withColumnRenamed("p", "end")
    scored = kept.join(p, keys).join(start, keys).join(end, keys).withColumn("prefix_size", F.size("prefix"))
    kind, order = dict(reservoirs.dtypes)[request], tables.order

    def choose(pdf):
        import pandas as pd

        drafts = {}
        for r in pdf.sort_values(["attempt", "place"]).to_dict("records"):
            natural, utility = draft(r, c, order)
            if r["line"] not in drafts or drafts[r["line"]]["raw"] < utility:
                drafts[r["line"]] = {"tokens": list(r["tokens"]), "form": r["form"], "family": r["family"], "raw": utility, "utility": round(utility, 6), "natural": round(natural, 6)}
        out = D.diverse_drafts(list(drafts.values()), count, c.weirdness)
        return pd.DataFrame([(pdf[request].iloc[0], d["rank"], " ".join(d["tokens"]), d["form"], d["utility"], d["natural"]) for d in out], columns=[request, "rank", "line", "form", "utility", "natural"])

    return scored.groupBy(request).applyInPandas(choose, f"`{request}` {kind}, rank long, line string, form string, utility double, natural double")
