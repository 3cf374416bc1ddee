"""A manifest of a dataset as a Merkle forest, with a proof for every row.

A row's leaf is the hash of its fields. Leaves stand in order within their tree (one per value
of ``tree``); every ``FAN`` consecutive nodes have a parent, whose hash is that of
their hashes, until one is left, the subroot. Subroots are the leaves of a last tree.

Nodes carry nested intervals: a node of level k covers the leaf ranks from ``lo`` to before ``hi``, inside
one bucket of ``FAN ** k`` ranks. Going up, nodes meet by bucket. Going down, a level's nodes find
their parent by a join on the bucket and containment of their interval, and what the parent's
children cover besides the node itself are its siblings, left and right of it. Each node hands its own path
down, so that every join has at most ``FAN`` rows per key, whatever the size of a tree. Leaves ride in
their first parent's list of children, so only digests are ever shuffled.

Ranks come from one range partitioning of all leaves by tree, key and hash, nulls first, so that a tree
with most of the rows is spread too. A tree is known by the rank of its first leaf, never null.

Defined cases: null fields count as ``-``; a null tree is a tree of its own and the first; null keys come first;
repeated rows are leaves of their own, equal keys stand in the order of their hashes; a lone leaf is its
tree's subroot and a lone subroot the root; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import ascii_lower, saved
from netweave.operators.prep import ranked

FAN = 16
STEP = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Digest of fields, each as ``-`` or as byte count, colon and value."""
    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def _nodes(level: int) -> Column:
    """How many nodes a tree of n leaves has at a level."""
    width = FAN ** level
    return F.floor((F.col("n") + (width - 1)) / width)


def _bucket(level: int) -> Column:
    return F.floor(F.col("lo") / FAN ** level)


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of levels 1, 2, .. of a frame tree, n, lo, hi, hash, item: tree, n, lo, hi, hash, kids.

    ``n`` is the tree's number of leaves; ``kids`` are lo, hi, hash (and item at level 1) in order.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    below, kid = leaves, ["lo", "hi", "hash", "item"]
    while FAN ** len(levels) < most:
        k = len(levels) + 1
        met = below.where(_nodes(k - 1) > 1).groupBy("tree", "n", _bucket(k).alias("bucket")).agg(
            F.sort_array(F.collect_list(F.struct(*kid))).alias("kids"))
        nodes = met.select(
            "tree", "n", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.transform("kids", lambda c: c["hash"]), ""), 256).alias("hash"), "kids")
        below, _ = saved(nodes, f"nodes-{k}")
        levels.append(below)
        kid = ["lo", "hi", "hash"]
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree and hash of every tree's last node."""
    found = leaves.where("n = 1").select("tree", "hash")
    for k, nodes in enumerate(levels, 1):
        found = found.unionByName(nodes.where(_nodes(k) == 1).select("tree", "hash"))
    return found


def _beside(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent covers besides the interval: the hashes before it and behind it."""
    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda c: c["hash"]), "")
    return F.struct(
        joined(F.filter(kids, lambda c: c["hi"] <= lo)).alias("left"),
        joined(F.filter(kids, lambda c: c["lo"] >= hi)).alias("right"))


def proven(leaves: DataFrame, levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """tree, hash, item and path of every leaf; ``seeds`` has tree, path (from its last node on) and further columns.

    A path lists, from the leaf up, what is left and right of it in its run.
    """
    more = [c for c in seeds.columns if c not in ("tree", "path")]
    out = leaves.where("n = 1").join(seeds, "tree").select("tree", "hash", "item", "path", *more)
    above = None
    for k in range(len(levels), 0, -1):
        nodes = levels[k - 1]
        here = nodes.where(_nodes(k) == 1).join(seeds, "tree").select("tree", "lo", "hi", "kids", "path", *more)
        if above is not None:
            up = above.select(F.col("tree").alias("_tree"), _bucket(k + 1).alias("_bucket"), F.col("lo").alias("_lo"),
                              F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *more)
            inside = (F.col("tree") == F.col("_tree")) & (_bucket(k + 1) == F.col("_bucket")) & (
                F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            path = F.concat(F.array(_beside(F.col("_kids"), F.col("lo"), F.col("hi"))), F.col("_path")).alias("path")
            here = here.unionByName(nodes.where(_nodes(k) > 1).join(up, inside).select("tree", "lo", "hi", "kids", path, *more))
        above, _ = saved(here, f"paths-{k}")
    if above is None:
        return out
    each = above.select("tree", "kids", "path", *more, F.explode("kids").alias("kid"))
    path = F.concat(F.array(_beside(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), F.col("path")).alias("path")
    return out.unionByName(each.select("tree", F.col("kid.hash").alias("hash"), F.col("kid.item").alias("item"), path, *more))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda got, step: F.sha2(F.concat(step["left"], got, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, tree: str = "source", key: str = "doc_id",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: Column | None = None, text: str = "text") -> DataFrame:
    """key, leaf, subroot, root, path and folded_root of every row.

    Rows where ``tampered`` holds are folded from the leaf they have with A-Z of ``text`` in lower case.
    """
    columns = {f: F.col(f) for f in fields}
    own = leaf_hash(*columns.values())
    changed = leaf_hash(*[ascii_lower(c) if f == text else c for f, c in columns.items()])
    doubt = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(F.col(tree).alias("_tree"), F.col(key).alias("_key"), own.alias("hash"), F.when(doubt, changed).alias("other"))
    # Ranges are found from a sample of the rows, so the rows are hashed once and read from there.
    rows, _ = saved(rows, "leaves")
    placed, _ = saved(ranked(rows, ["_tree", "_key", "hash"]), "placed")
    firsts, _ = saved(placed.groupBy("_tree").agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("n")), "trees")
    named = firsts.withColumnRenamed("_tree", "_name")
    leaves = placed.join(named, F.col("_tree").eqNullSafe(F.col("_name"))).select(
        "tree", "n", (F.col("_rank") - F.col("tree")).alias("lo"), (F.col("_rank") - F.col("tree") + 1).alias("hi"), "hash",
        F.struct(F.col("_key").alias("key"), "other").alias("item"))
    levels = grown(leaves)
    last, _ = saved(tops(leaves, levels), "subroots")
    total = last.count()
    heads = ranked(last, ["tree"]).select(
        F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("_rank").alias("lo"),
        (F.col("_rank") + 1).alias("hi"), "hash", F.col("tree").alias("item"))
    heads, _ = saved(heads, "heads")
    upper = grown(heads)
    root = tops(heads, upper).first()
    start = heads.limit(1).select("tree", F.array().cast(STEP).alias("path"))
    seeds, _ = saved(proven(heads, upper, start).select(F.col("item").alias("tree"), F.col("hash").alias("subroot"), "path"), "seeds")
    out = proven(leaves, levels, seeds)
    return out.select(
        F.col("item.key").alias("key"), F.col("hash").alias("leaf"), "subroot", F.lit(root.hash if root else None).cast("string").alias("root"),
        "path", folded(F.coalesce("item.other", "hash"), F.col("path")).alias("folded_root"))
