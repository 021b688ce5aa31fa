"""Operators on knowledge-graph triples (h, r, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions.order import hash_order
from edgewright.plans.numbering import number_rows
from edgewright.plans.scratch import stash

KEY = ["h", "r", "t"]


def dedupe(triples: DataFrame, order: str = "triple_id") -> DataFrame:
    """The first row (by ``order``) of each (h, r, t)."""
    others = [c for c in triples.columns if c not in KEY]
    first = triples.groupBy(*KEY).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("x"))
    return first.select(*[F.col(c) if c in KEY else F.col(f"x.{c}").alias(c) for c in triples.columns])


def multiplicity(triples: DataFrame) -> DataFrame:
    """Rows with ``n_same``: how many rows have the same (h, r, t)."""
    counts = triples.groupBy(*KEY).agg(F.count("*").alias("n_same"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEY]
    return triples.alias("a").join(counts.alias("b"), same[0] & same[1] & same[2]).select("a.*", "b.n_same")


def codes(values: DataFrame, column: str, order: str) -> DataFrame:
    """``column``, ``code``: distinct values numbered 0, 1, ... by first appearance in ``order``."""
    first = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    return number_rows(first, ["__first", column], "code").select(column, "code")


def entity_codes(triples: DataFrame, order: str = "triple_id") -> DataFrame:
    """``entity``, ``code`` of heads and tails, a row's head before its tail."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("h").alias("entity"), (F.col(order) * 2).alias("at")), F.struct(F.col("t").alias("entity"), (F.col(order) * 2 + 1).alias("at")))).alias("e"))
    return codes(ends.select("e.*"), "entity", "at")


def encoded(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples as codes ``h_code``, ``r_code``, ``t_code``; a value without a code is an error when its row is read."""

    def known(code: str, value: str) -> Column:
        return F.when(F.col(code).isNull() & F.col(value).isNotNull(), F.raise_error(F.concat(F.lit("no code for "), value))).otherwise(F.col(code)).alias(code)

    out = triples
    for value, table, name in (("h", entities, "entity"), ("r", relations, "r"), ("t", entities, "entity")):
        out = out.join(table.select(F.col(name).alias(value), F.col("code").alias(f"{value}_code")), value, "left")
    return out.select("triple_id", known("h_code", "h"), known("r_code", "r"), known("t_code", "t"))


def incidence(triples: DataFrame, key: str = "triple_id") -> DataFrame:
    """``entity``, ``key``: every triple at either end; a triple from an entity to itself appears twice."""
    return triples.select(F.explode(F.array("h", "t")).alias("entity"), key).filter("entity is not null")


def corrupted(triples: DataFrame, tries: int = 5, per_triple: int = 1, seed: int = 0) -> DataFrame:
    """``triple_id``, ``draw``, ``h``, ``r``, ``t``: for each triple up to ``per_triple`` that were never observed, with head or tail exchanged.

    Head or tail and the entity to put there come from hashes of the id and the draw; draws
    that hit an observed triple are passed over, and the first that don't are kept.
    """
    sound = triples.filter("h is not null and r is not null and t is not null")
    names = entity_codes(sound).select("entity", "code")
    n = names.count()
    last = tries * per_triple

    def placed(rows: DataFrame, first: int, last: int) -> DataFrame:
        draws = rows.select("triple_id", *KEY, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("draw"))
        digits = hash_order(seed, "triple_id", "draw")
        pick = F.pmod(F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint"), F.lit(max(1, n))).alias("code")
        head = (F.conv(F.substring(digits, 13, 1), 16, 10).cast("int") % 2 == 0).alias("head")
        named = draws.select("*", pick, head).join(names, "code")
        return named.select("triple_id", "draw", F.when(F.col("head"), F.col("entity")).otherwise(F.col("h")).alias("h"), "r", F.when(F.col("head"), F.col("t")).otherwise(F.col("entity")).alias("t"))

    # nearly all triples are done with their first draws; only those with a hit among them draw on
    observed = sound.select(*KEY).distinct().withColumn("hit", F.lit(True))
    firsts = stash(placed(sound, 1, min(per_triple, last)).join(observed, KEY, "left"), "draws")
    short = stash(firsts.filter("hit").select("triple_id").distinct(), "short")
    kept = firsts.filter("hit is null").select("triple_id", "draw", *KEY)
    if last <= per_triple or short.isEmpty():
        more = kept.limit(0)
    else:
        more = placed(sound.join(short, "triple_id", "left_semi"), per_triple + 1, last).join(observed, KEY, "left_anti").select("triple_id", "draw", *KEY)
    mixed = kept.join(short, "triple_id", "left_semi").unionByName(more)
    ranked = mixed.withColumn("k", F.row_number().over(Window.partitionBy("triple_id").orderBy("draw"))).filter(F.col("k") <= per_triple)
    done = kept.join(short, "triple_id", "left_anti").withColumn("k", F.col("draw"))
    return done.unionByName(ranked).select("triple_id", F.col("k").cast("int").alias("draw"), *KEY)


def sampled_incident(triples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``triple_id``, ``entity``, ``other_id``: up to ``k`` other triples at each end of a triple, in hash order, no copy of the triple itself.

    Each entity offers its first candidates in hash order: of one entity's triples only the
    first k + (copies of the triple) can be wanted, so the list of a frequent entity is cut
    before it is joined.
    """
    ends = incidence(triples).join(multiplicity(triples).select("triple_id", "n_same", *KEY), "triple_id")
    most = (triples.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]) or 0
    order = Window.partitionBy("entity").orderBy(hash_order(seed, "triple_id"), "triple_id")
    offered = ends.select("entity", "triple_id", *KEY).distinct().withColumn("q", F.row_number().over(order)).filter(F.col("q") <= k + most)
    offered = offered.select("entity", "q", F.col("triple_id").alias("other_id"), *[F.col(c).alias(f"o_{c}") for c in KEY])
    own = ends.select("entity", "triple_id", *KEY).distinct().join(offered, "entity")
    other = ~(F.col("h").eqNullSafe(F.col("o_h")) & F.col("r").eqNullSafe(F.col("o_r")) & F.col("t").eqNullSafe(F.col("o_t")))
    ranked = own.filter(other).withColumn("k", F.row_number().over(Window.partitionBy("triple_id", "entity").orderBy("q")))
    return ranked.filter(F.col("k") <= k).select("triple_id", "entity", "other_id")


def _with_means(triples: DataFrame, vector: str) -> DataFrame:
    """``triples`` whose h, r and t are known, plus ``m_h``, ``n_h``, ``m_t``, ``n_t``: mean vector and number of the other triples at either end.

    A vector goes through each shuffle as one row, not as a row per position; vectors are of one length.
    """
    triples = triples.filter(F.size(vector) > 0)
    least, width = triples.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != width:
        raise ValueError(f"vectors of {least} to {width} positions")
    total = lambda over=None: [F.sum(F.col(vector)[k]) if over is None else F.sum(F.col(vector)[k]).over(over) for k in range(width or 0)]
    ends = triples.select(F.explode(F.array("h", "t")).alias("entity"), vector).filter("entity is not null")
    sums = ends.groupBy("entity").agg(F.array(*total()).alias("s"), F.count("*").alias("n"))
    same = Window.partitionBy(*KEY)
    known = triples.filter("h is not null and r is not null and t is not null").withColumn("__m", F.count("*").over(same))
    # without copies a triple's own share is its vector
    out = known.withColumn("__own", F.when(F.col("__m") > 1, F.array(*total(same))))
    times = F.when(F.col("h") == F.col("t"), 2).otherwise(1)
    for end in ("h", "t"):
        out = out.join(sums.withColumnRenamed("entity", end), end)
        left = F.col("n") - F.col("__m") * times
        own = F.coalesce("__own", vector)
        mean = F.zip_with("s", own, lambda s, x: F.when(left > 0, (s - x * times) / F.nullif(left, F.lit(0))).otherwise(0.0))
        out = out.select(*[c for c in out.columns if c not in ("s", "n")], mean.alias(f"m_{end}"), left.alias(f"n_{end}"))
    return out.drop("__m", "__own")


def context_means(triples: DataFrame, vector: str = "vec") -> DataFrame:
    """``triple_id``, ``end`` (h or t), ``n``, ``mean``: mean vector of the other triples at an end of each triple.

    Every copy of the triple itself is taken out again by its number; no other triple: zeros.
    """
    both = _with_means(triples.select("triple_id", *KEY, vector), vector)
    ends = F.array(*[F.struct(F.lit(x).alias("end"), F.col(f"n_{x}").alias("n"), F.col(f"m_{x}").alias("mean")) for x in "ht"])
    return both.select("triple_id", F.explode(ends).alias("x")).select("triple_id", "x.*")


def triple_tiles(triples: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one tile per triple.

    Nodes (``triple_id``, ``pos``, ``kind``, ``name``): head 0, the candidate itself 1, tail 2, then the sampled
    incident triples and their entities. Edges (``triple_id``, ``src``, ``dst``) join each triple with its two
    entities; a triple whose head is its tail has one.
    """
    own = triples.filter("h is not null and t is not null").select("triple_id", *KEY)
    sampled = sampled_incident(triples, k, seed).select("triple_id", "other_id").distinct()
    others = triples.select(F.col("triple_id").alias("other_id"), F.col("h").alias("o_h"), F.col("t").alias("o_t"))
    near = sampled.join(others, "other_id").filter("o_h is not null and o_t is not null").join(own, "triple_id")
    cand = lambda c: F.concat(F.lit("triple:"), c.cast("string"))
    ent = lambda c: F.concat(F.lit("entity:"), c)
    fixed = own.select("triple_id", F.explode(F.array(*[F.struct(F.lit(i).alias("first"), F.lit(kind).alias("kind"), name.alias("name")) for i, kind, name in ((0, "entity", ent(F.col("h"))), (1, "triple", cand(F.col("triple_id"))), (2, "entity", ent(F.col("t"))))])).alias("x")).select("triple_id", "x.*")
    more = near.select("triple_id", F.explode(F.array(F.struct(F.lit(3).alias("first"), F.lit("triple").alias("kind"), cand(F.col("other_id")).alias("name")), *[F.struct(F.lit(4).alias("first"), F.lit("entity").alias("kind"), ent(F.col(c)).alias("name")) for c in ("o_h", "o_t")])).alias("x")).select("triple_id", "x.first", "x.kind", "x.name")
    nodes = fixed.unionByName(more).groupBy("triple_id", "kind", "name").agg(F.min("first").alias("first"))
    nodes = nodes.select("triple_id", (F.row_number().over(Window.partitionBy("triple_id").orderBy("first", "name")) - 1).alias("pos"), "kind", "name")
    ends = own.select("triple_id", cand(F.col("triple_id")).alias("a"), F.explode(F.array("h", "t")).alias("b")).unionByName(near.select("triple_id", cand(F.col("other_id")).alias("a"), F.explode(F.array("o_h", "o_t")).alias("b")))
    edges = ends.select("triple_id", F.col("a").alias("src"), ent(F.col("b")).alias("dst")).distinct()
    return nodes, edges


def context_features(triples: DataFrame, vector: str = "vec") -> DataFrame:
    """``triple_id``, ``features``: of either end [cosine, length-normalised distance, log(1 + number)] against the triple's own vector, and the cosine and distance between both ends.

    Zero vectors give a cosine of 0.
    """
    return with_context(triples.select("triple_id", *KEY, vector), vector).select("triple_id", "features")


def with_context(triples: DataFrame, vector: str = "vec") -> DataFrame:
    """``triples`` without h, r and t, plus the ``features`` of ``context_features``."""
    from edgewright.operators.pair_features import cosine, norm

    both = _with_means(triples, vector)
    gap = lambda a, b: norm(F.zip_with(a, b, lambda x, y: x - y)) / F.sqrt(F.size(a).cast("double"))
    parts = []
    for end in ("h", "t"):
        m = F.col(f"m_{end}")
        parts += [cosine(F.col(vector), m), gap(F.col(vector), m), F.log1p(F.col(f"n_{end}").cast("double"))]
    parts += [cosine(F.col("m_h"), F.col("m_t")), gap(F.col("m_h"), F.col("m_t"))]
    return both.select(*[c for c in triples.columns if c not in KEY], F.array(*parts).alias("features"))
