"""Entities, co-occurrence edges and walks over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import keep, parts, small

#: Starts and nodes of a cell of the product of blocks that makes all walks of two hops.
CELL = 1000
#: Edges of a block of starts or of nodes, beyond which blocks have fewer starts or nodes.
BLOCK_EDGES = 2_000_000
#: Starts of a cell whose walks are made at once, and walks that are listed at once.
BAND, LISTED = 64, 1 << 20
#: Up to this many starts, walks of two hops meet by node.
FEW = 50


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(email_id, entity_id, kind, confidence): the best confidence of each pair."""
    return mentions.groupBy("email_id", "entity_id", "kind").agg(F.max("confidence").alias("confidence"))


def entity_idf(pairs: DataFrame, share: float = 0.5, least: int = 20) -> DataFrame:
    """(entity_id, kind, df, idf, ubiquitous) over the messages of ``pairs``."""
    n = F.broadcast(pairs.agg(F.count_distinct("email_id").alias("n")))  # one row
    df = pairs.groupBy("entity_id", "kind").agg(F.count("*").alias("df"))
    return df.crossJoin(n).select("entity_id", "kind", "df", (F.log1p(F.col("n") / F.col("df")) / F.log1p("n")).alias("idf"), ((F.col("n") >= least) & (F.col("df") / F.col("n") > share)).alias("ubiquitous"))


def relation(a_kind: Column, b_kind: Column, a: Column, b: Column) -> Column:
    """How the entity ``a`` of a message relates to ``b``; null where the pair is told from the other side."""
    work = ("case", "project")
    return (
        F.when((a_kind == "person") & b_kind.isin(*work), "participant_in")
        .when((a_kind == "case") & (b_kind == "project"), "belongs_to")
        .when(((b_kind == "person") & a_kind.isin(*work)) | ((a_kind == "project") & (b_kind == "case")), None)
        .when(a < b, "mentions")
    )


def told(a_kind: str | None, b_kind: str | None, less: bool) -> str | None:
    """``relation`` of two kinds, for arrays of pairs; ``less``: the first id is the smaller one."""
    work = ("case", "project")
    if a_kind == "person" and b_kind in work:
        return "participant_in"
    if a_kind == "case" and b_kind == "project":
        return "belongs_to"
    if (b_kind == "person" and a_kind in work) or (a_kind == "project" and b_kind == "case"):
        return None
    return "mentions" if less else None


def base_weight(rel: Column, a_confidence: Column, b_confidence: Column, half: Column | float = 0.5) -> Column:
    """What one message adds to a pair, before the rarity of its entities; ``half`` is half of a full confidence."""
    return F.when(rel == "participant_in", b_confidence).when(rel == "belongs_to", a_confidence).otherwise(half)


def relations(mentions: DataFrame) -> DataFrame:
    """(src, dst, rel, weight, evidence): people take part in cases and projects, cases belong to projects, others are mentioned together.

    Entities in more than half of all messages are dropped before the self-join; they would make most of its rows and get no edge.
    """
    pairs = cooccurrence(mentions)
    idf = keep(entity_idf(pairs).where("not ubiquitous").select("entity_id", "idf"), "idf")
    few = small(idf)
    known = pairs.join(few, "entity_id")
    if few is idf:
        known = keep(known, "known_pairs")
    a, b = known.alias("a"), known.alias("b")
    both = a.join(b, (F.col("a.email_id") == F.col("b.email_id")) & (F.col("a.entity_id") != F.col("b.entity_id")))
    rel = relation(F.col("a.kind"), F.col("b.kind"), F.col("a.entity_id"), F.col("b.entity_id"))
    base = base_weight(rel, F.col("a.confidence"), F.col("b.confidence"))
    edges = both.select(F.col("a.entity_id").alias("src"), F.col("b.entity_id").alias("dst"), rel.alias("rel"), (base * F.col("a.idf") * F.col("b.idf")).alias("w"), F.col("a.email_id").alias("email_id")).where("rel is not null")
    edges = edges.groupBy("src", "dst", "rel").agg(F.round(F.sum("w"), 4).alias("weight"), F.count("*").alias("evidence"))
    return edges.where("rel != 'belongs_to' or evidence >= 2")


def salience(mentions: DataFrame, *also: str) -> DataFrame:
    """(entity_id, also, emails, mentions, salience) from shares of the most-mailed entity and of fifty mentions; ``also`` are columns that an entity has one value of. Mentions are counted once."""
    per = keep(mentions.groupBy("entity_id", *also).agg(F.count_distinct("email_id").alias("emails"), F.count("*").alias("mentions")), "entity_counts")
    top = F.broadcast(per.agg(F.max("emails").alias("top")))  # one row
    value = 0.75 * F.log1p("emails") / F.log1p("top") + 0.25 * F.least(F.lit(1.0), F.log1p("mentions") / F.log1p(F.lit(50)))
    return per.crossJoin(top).select("entity_id", *also, "emails", "mentions", F.round(F.least(F.lit(1.0), value), 4).alias("salience"))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _steps(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, bucket): every edge both ways, with its best weight; a bucket holds weights between two neighbouring quarter powers of two. Edges without weight lead nowhere."""
    both = both_directions(edges).where("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0")
    return keep(both.withColumn("bucket", F.floor(F.log2("weight") * 4).cast("int")), "steps")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each start, the smaller node of equal ones."""
    nth = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "node"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _least(found: DataFrame, k: int) -> DataFrame:
    """(start, bar): the score of each start's k-th row; starts with fewer have none."""
    return _best(found, k).groupBy("start").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).select("start", "bar")


def _two_hops(step: DataFrame, one: DataFrame, share: float, k: int, open_: Callable[[DataFrame], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The ``k`` best nodes of each start within two hops, by a threshold algorithm on weight-sorted adjacency lists.

    ``one``: (start, node, score) of the first hop; a second hop multiplies by its weight and ``share``. No edge of a bucket leads to more than the bucket's best weight says. First each start looks into the ``k`` most promising
    buckets; the k-th score found is a bar, and of the other buckets only those are opened that may reach it. ``open_`` drops second-hop rows that don't count; ``join`` puts both hops together.
    """
    heads = keep(step.groupBy(F.col("src").alias("node"), "bucket").agg(F.max("weight").alias("most")), "buckets")
    promise = one.join(heads, "node").select("start", "node", "bucket", "score", (F.col("score") * F.col("most") * share).alias("bound"))
    bar = keep(_least(one, k), "bars")
    above = lambda df, bars: df.join(bars, "start", "left").where("bar is null or bound >= bar").drop("bar")
    nth = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("bound"), "node", "bucket"))
    promise = above(promise, bar)
    first = keep(promise.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), "first_buckets")

    def walk(some: DataFrame) -> DataFrame:
        far = step.select(F.col("src").alias("node"), "bucket", F.col("dst").alias("to"), "weight")
        met = some.join(far, ["node", "bucket"]).where("to != start")
        return open_(met.groupBy("start", F.col("to").alias("node")).agg(F.max(F.col("score") * F.col("weight") * share).alias("score")))

    two = keep(walk(first), "first_walks")
    bar = keep(_least(join(one, two), k), "bars")
    rest = above(promise.join(first.select("start", "node", "bucket"), ["start", "node", "bucket"], "left_anti"), bar)
    return _best(join(one, two.unionByName(walk(rest))), k)


def _band(to: int, at: np.ndarray, node: np.ndarray, score: np.ndarray, begin: np.ndarray, end: np.ndarray, end_to: np.ndarray, end_weight: np.ndarray, band: int) -> np.ndarray:
    """The best products over walks of two edges from each of ``band`` starts to each of ``to`` ends; -1 where there is none. First edges are (at, node, score); the second edges of a node are those from ``begin`` to ``end`` of the sorted ones."""
    far = np.full((band, to), -1.0)
    some = np.flatnonzero(end[node] > begin[node])
    some = some[np.argsort(node[some], kind="stable")]
    at, node, score = at[some], node[some], score[some]
    n = end[node] - begin[node]
    heads = np.flatnonzero(np.diff(node, prepend=-1))
    if n.sum() < 2048 * len(heads):  # few walks a node: they are listed
        flat, steps = far.reshape(-1), np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(steps, (steps[first - 1] if first else 0) + LISTED, "right")))
            m = n[first:last]
            which = np.repeat(np.arange(first, last), m)
            edge = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + begin[node[which]]
            np.maximum.at(flat, at[which] * to + end_to[edge], score[which] * end_weight[edge])
            first = last
        return far
    for low, high in zip(heads, np.append(heads[1:], len(node))):
        i, w = at[low:high], score[low:high]
        edges = slice(begin[node[low]], end[node[low]])
        j, v = end_to[edges], end_weight[edges]
        if len(i) == band and len(j) == to:  # all of the band: no rows are picked
            np.maximum(far, _spread(i, w, band)[:, None] * _spread(j, v, to)[None, :], out=far)
        else:
            cell = np.ix_(i, j)
            far[cell] = np.maximum(far[cell], w[:, None] * v[None, :])
    return far


def _spread(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``values`` at their places."""
    out = np.empty(n)
    out[at] = values
    return out


def _cell(begins: pa.StructArray, ends: pa.StructArray, share: float) -> Iterator[pa.RecordBatch]:
    """The walks (start, node, near, far) of a cell from its starts (start, list of first edges) to its nodes (to, list of last edges), in batches of ``BAND`` starts."""
    starts, nodes = begins.field("start"), ends.field("to")
    first, last = begins.field("edges"), ends.field("edges")
    one, two = first.flatten(), last.flatten()
    parts_ = [one.field("node"), two.field("node"), nodes, starts]
    codes = pa.concat_arrays(parts_).dictionary_encode()
    names, codes = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    one_node, two_node, node_code, start_code = np.split(codes, np.cumsum([len(p) for p in parts_])[:-1])
    score, weight = (a.to_numpy(zero_copy_only=False) for a in (one.field("score"), two.field("weight")))
    sizes, ends_ = (np.asarray(a.value_lengths().to_numpy(zero_copy_only=False), np.int64) for a in (first, last))
    order = np.argsort(two_node, kind="stable")
    end_to, end_weight = np.repeat(np.arange(len(nodes)), ends_)[order], weight[order]
    begin, end = (np.searchsorted(two_node[order], np.arange(names), side) for side in ("left", "right"))
    column = np.full(names, -1)
    column[node_code] = np.arange(len(nodes))
    bounds = np.append(0, np.cumsum(sizes))
    at = np.repeat(np.arange(len(starts)), sizes)
    for low in range(0, len(starts), BAND):
        high = min(low + BAND, len(starts))
        edges = slice(bounds[low], bounds[high])
        i, mid, w = at[edges] - low, one_node[edges], score[edges]
        far = _band(len(nodes), i, mid, w, begin, end, end_to, end_weight, high - low)
        near = np.full_like(far, -1.0)
        met = column[mid] >= 0
        near[i[met], column[mid[met]]] = w[met]
        own = column[start_code[low:high]]
        far[np.flatnonzero(own >= 0), own[own >= 0]] = -1.0
        no_near, no_far = near == -1.0, far == -1.0
        row, to = np.nonzero(~(no_near & no_far))
        if len(row):
            value = lambda a, no, by=1.0: pa.array(a[row, to] * by, mask=no[row, to])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([starts.take(pa.array(row + low)), nodes.take(pa.array(to)), value(near, no_near), value(far, no_far, share)], ["start", "node", "near", "far"])


def _walks(step: DataFrame, one: DataFrame, share: float) -> DataFrame:
    """(start, node, near, far): the best score of one hop and of two hops from each start to each node that it reaches, null where there is none.

    ``one``: (start, node, score) of the first hop. The result may hold every pair of a start and a node, so it is made as a product of blocks: starts and nodes are dealt to blocks, a task meets one block of each, and a pair's walks are
    all in its task, where they are products of arrays. No walk is shuffled or made a row; what is copied are lists of edges, once a block, and the blocks have fewer starts and nodes where these have many edges.
    """
    spark = step.sparkSession
    starts, nodes = one.select("start").distinct().count(), step.select("dst").distinct().count()
    if starts <= FEW:
        return _walks_of_few(step, one, share, starts, nodes)
    blocks = lambda some, held: max(2, -(-some // CELL), -(-held // BLOCK_EDGES))
    begun, edges = one.count(), step.count()
    rows, columns = blocks(starts, begun), blocks(nodes, edges)
    rows = max(rows, -(-2 * spark.sparkContext.defaultParallelism // columns))
    n = parts(spark, begun * columns + edges * rows, BLOCK_EDGES)  # for copying lists
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = one.repartition(n, "start").groupBy("start").agg(F.collect_list(F.struct("node", "score")).alias("edges"))
    last = step.repartition(n, "dst").groupBy(F.col("dst").alias("to")).agg(F.collect_list(F.struct(F.col("src").alias("node"), "weight")).alias("edges"))
    left = first.select(block("start", rows).alias("_row"), every(columns).alias("_column"), F.struct("start", "edges").alias("begin"))
    right = last.select(block("to", columns).alias("_column"), every(rows).alias("_row"), F.struct("to", "edges").alias("end"))
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(rows * columns, "_row", "_column")
    cells = dealt.groupBy("_row", "_column").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")).select("begins", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                begins, ends = (batch.column(c).slice(i, 1).flatten() for c in ("begins", "ends"))
                if len(begins) and len(ends):
                    yield from _cell(begins, ends, share)

    types = dict(one.dtypes)
    return cells.mapInArrow(run, f"start {types['start']}, node {types['node']}, near double, far double")


def _walks_of_few(step: DataFrame, one: DataFrame, share: float, starts: int, nodes: int) -> DataFrame:
    """``_walks`` from so few starts that their walks are no more than some for each edge: blocks would copy the first hop once for each block of nodes, and one task would have all nodes between.

    Both hops meet by the node between, in a part for each million walks. Where the pairs of a start and a node are more than a cell's, the ends are dealt to as many columns as there are cells, so that a node with many neighbours is not one task's alone.
    """
    columns = max(1, -(-starts * nodes // CELL**2))
    n = parts(step.sparkSession, step.count() * starts, 1_000_000)
    near = one.select("start", "node", F.col("score").alias("near"), F.lit(None).cast("double").alias("far"))
    left = one.select("node", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_column"), "start", "score").repartition(n, "node", "_column")
    right = step.select(F.col("src").alias("node"), F.pmod(F.xxhash64("dst"), F.lit(columns)).cast("int").alias("_column"), F.col("dst").alias("to"), "weight").repartition(n, "node", "_column")
    met = left.join(right, ["node", "_column"]).where("to != start")
    far = met.select("start", F.col("to").alias("node"), F.lit(None).cast("double").alias("near"), (F.col("score") * F.col("weight") * share).alias("far"))
    return near.unionByName(far).groupBy("start", "node").agg(F.max("near").alias("near"), F.max("far").alias("far"))


def neighbors_weighted(edges: DataFrame, starts: DataFrame, hops: int = 2, k: int | None = None) -> DataFrame:
    """(start, node, score, hop): the best product of weights over walks of up to ``hops`` edges; nodes may be met again, the start is left out.

    With ``k`` the best nodes of each start only; walks of two hops then open no list that can't hold one of them.
    """
    step = _steps(edges)
    start = starts.select(F.col("entity_id").alias("start")).distinct()
    one = start.join(step, start.start == step.src).select("start", F.col("dst").alias("node"), F.col("weight").alias("score"))
    best = F.max(F.struct("score", (-F.col("hop")).alias("near"))).alias("best")

    def join(first: DataFrame, second: DataFrame) -> DataFrame:
        both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
        return both.groupBy("start", "node").agg(best).select("start", "node", "best.score", (-F.col("best.near")).alias("hop"))

    if k and hops == 2:
        return _two_hops(step, keep(one, "first_hop"), 1.0, k, lambda df: df, join)
    if hops == 2:
        found = _walks(step, keep(one, "first_hop"), 1.0)
        return found.select("start", "node", F.greatest("near", "far").alias("score"), F.when(F.col("near") >= F.coalesce("far", F.lit(0.0)), 1).otherwise(2).alias("hop"))
    found = now = one.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        now = now.join(step, now.node == step.src).where("dst != start").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight")).alias("score")).select("start", "node", "score", F.lit(hop).alias("hop"))
        found = found.unionByName(now)
    found = found.groupBy("start", "node").agg(best).select("start", "node", "best.score", (-F.col("best.near")).alias("hop"))
    return _best(found, k) if k else found


def neighbors_decayed(edges: DataFrame, starts: DataFrame, k: int | None = None) -> DataFrame:
    """(start, node, score, hop) to two hops: a node keeps the hop it is first met at; scores are products of weights, the second halved. With ``k`` the best nodes of each start only, as in ``neighbors_weighted``."""
    step = _steps(edges)
    start = starts.select(F.col("entity_id").alias("start")).distinct()
    one = keep(start.join(step, start.start == step.src).select("start", F.col("dst").alias("node"), F.col("weight").alias("score")), "first_hop")
    unseen = lambda df: df.join(one.select("start", "node"), ["start", "node"], "left_anti")
    join = lambda first, second: first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    if k:
        return _two_hops(step, one, 0.5, k, unseen, join)
    return _walks(step, one, 0.5).select("start", "node", F.coalesce("near", "far").alias("score"), F.when(F.col("near").isNotNull(), 1).otherwise(2).alias("hop"))


def _searched(near: DataFrame, of: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(anchor, rank, email_id, score) from the nodes near the entities of each anchor."""
    scored = of.join(near, of.entity_id == near.start).select("anchor", "node", (F.col("salience") * F.col("score") / F.col("hop")).alias("score"))
    scored = scored.groupBy("anchor", "node").agg(F.max("score").alias("score"))
    hits = scored.join(first, "node").where("email_id != anchor").groupBy("anchor", "email_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc(F.round("score", 6)), "email_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor", "rank", "email_id", F.round("score", 6).alias("score"))


def graph_search(edges: DataFrame, mentions: DataFrame, salience_: DataFrame, anchors: DataFrame, k: int = 10, targets: DataFrame | None = None, width: int = 64) -> DataFrame:
    """(anchor, rank, email_id, score): other messages that mention entities near those of each anchor message (email_id); with ``targets`` (email_id) none but these.

    All messages of a node have the node's score, so a neighbour with more than ``k`` messages gives ``k`` hits, and no node below the best such neighbour of an entity can add one: of each entity only the nodes that reach this bar are
    looked at, and of its second hops none but those that may. Entities without such a neighbour take the (k + 1)-th message of their ``width`` nearest neighbours as their bar; where these have fewer, all nodes are looked at.
    """
    step = _steps(edges)
    linked = mentions.select("email_id", "entity_id").distinct()
    sal = salience_.select("entity_id", F.when(F.col("salience") == 0, 0.5).otherwise(F.col("salience")).alias("salience"))
    of = keep(anchors.select("email_id").distinct().join(linked, "email_id").select(F.col("email_id").alias("anchor"), "entity_id").join(sal, "entity_id"), "anchors")
    # equal scores go by id, so of a node none but its first k messages beside the anchor can be among the k best
    of_node = (linked if targets is None else linked.join(targets.select("email_id").distinct(), "email_id", "left_semi")).select("email_id", F.col("entity_id").alias("node"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("email_id"))
    first = keep(of_node.withColumn("nth", nth).where(F.col("nth") <= k + 1), "first_messages")
    starts = of.select(F.col("entity_id").alias("start"), "salience").distinct()
    one = keep(starts.join(step, starts.start == step.src).select("start", "salience", F.col("dst").alias("node"), F.col("weight").alias("score")), "first_hop")
    rich = one.join(first.where(F.col("nth") == k + 1).select("node"), "node").groupBy("start").agg(F.max("score").alias("bar"))
    poor = _best(one.join(rich, "start", "left_anti"), width).join(first.drop("nth"), "node").groupBy("start", "email_id").agg(F.max("score").alias("score"))
    poor = _least(poor.withColumnRenamed("email_id", "node"), k + 1)
    # scores are compared as rounded, after they were multiplied by the salience of the entity
    bars = starts.join(rich.unionByName(poor), "start", "left").select("start", F.coalesce(F.col("bar") - 1.01e-6 / F.col("salience"), F.lit(0.0)).alias("bar"))
    bars = keep(bars, "bars")
    most = step.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("most"))
    ahead = one.join(bars, "start").join(most, "node").where(F.col("score") * F.col("most") * 0.25 >= F.col("bar")).select("start", "node", "score")
    two = ahead.join(step, ahead.node == step.src).where("dst != start").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("weight") * 0.5).alias("score"))
    two = two.join(one, ["start", "node"], "left_anti").withColumn("hop", F.lit(2))
    near = one.select("start", "node", "score", F.lit(1).alias("hop")).unionByName(two)
    near = near.join(bars, "start").where(F.col("score") / F.col("hop") >= F.col("bar")).drop("bar")
    return _searched(near, of, first.drop("nth"), k)


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(email_id, chunk_id): the body chunk of the lowest ``ord`` of each message."""
    return chunks.where("kind = 'body'").groupBy("email_id").agg(F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"))


def fingerprint(mentions: DataFrame) -> DataFrame:
    """(entity_id, emails, hash): how many messages mention each entity, and a hash of their ids that doesn't depend on the order.

    The hash is of two sums of the ids' 60-bit digests, so that rows of an entity are only ever added up, never gathered.
    """
    pairs = mentions.select("entity_id", "email_id").distinct()
    digest = F.md5(F.col("email_id").cast("string"))
    lane = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return pairs.groupBy("entity_id").agg(F.count("*").cast("int").alias("emails"), F.substring(F.sha1(F.concat_ws(":", lane(1), lane(17))), 1, 20).alias("hash"))


def fragmentation(entities: DataFrame, mentions: DataFrame, exact: tuple[str, ...] = ("case", "document", "person")) -> DataFrame:
    """(kind, keyed, nodes, one_email, percent): of each kind of entity (entity_id, kind) how it is told apart, how many there are, and how many stand in one message at most."""
    per = entities.select("entity_id", "kind").distinct().join(mentions.groupBy("entity_id").agg(F.count_distinct("email_id").alias("emails")), "entity_id", "left")
    counted = per.groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("emails", F.lit(0)) <= 1).alias("one_email"))
    return counted.select("kind", F.when(F.col("kind").isin(*exact), "exact").otherwise("name").alias("keyed"), "nodes", "one_email", F.round(100.0 * F.col("one_email") / F.col("nodes"), 4).alias("percent"))


def rollup(projects: DataFrame, edges: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = ("case", "person"), projects_shown: int = 20, most: int = 12) -> DataFrame:
    """(project, place, kind, nth, node, score, hop, more): the most salient projects (entity_id, salience), and of each the ``most`` nearest entities of each kind within two hops, the nearest hop first, and how many more there are. ``entities``: (entity_id, kind)."""
    shown = projects.orderBy(F.desc("salience"), "entity_id").limit(projects_shown)
    shown = shown.select("entity_id", F.row_number().over(Window.orderBy(F.desc("salience"), "entity_id")).alias("place"))  # as many rows as are shown
    shown = keep(shown, "projects")
    near = neighbors_weighted(edges, shown).join(entities.where(F.col("kind").isin(*kinds)).select(F.col("entity_id").alias("node"), "kind").distinct(), "node")
    near = keep(near, "near_projects")
    n = F.broadcast(near.groupBy("start", "kind").agg(F.count("*").alias("n")))  # a row for each kind of the projects that are shown
    nth = F.row_number().over(Window.partitionBy("start", "kind").orderBy("hop", F.desc("score"), "node"))
    ranked = near.withColumn("nth", nth).where(F.col("nth") <= most).join(n, ["start", "kind"])
    return ranked.join(shown.withColumnRenamed("entity_id", "start"), "start").select(F.col("start").alias("project"), "place", "kind", "nth", "node", "score", "hop", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def email_sketches(mentions: DataFrame, bucket: Column) -> DataFrame:
    """(entity_id, bucket, sketch): mergeable sketches of the messages of each entity, one a bucket (a day, say), so that new messages only add buckets."""
    return mentions.groupBy("entity_id", bucket.alias("bucket")).agg(F.hll_sketch_agg("email_id", F.lit(14)).alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """(entity_id, emails): about how many messages mention each entity, from its sketches of any buckets; within 3 % nearly always."""
    return sketches.groupBy("entity_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("emails"))
