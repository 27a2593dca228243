"""Merkle manifest of a dataset, with proofs by pointer jumping.

Leaves are digests of rows.  Within a group (the source) they ascend by key;
16 consecutive nodes make a node of the next level, until one is left, the
group's subroot.  The subroots, by group, make the root in the same way.

The nodes of such a run of 16 have the same ancestors, so one row stands for
the run.  It points to the run that its own digest lies in and holds the
sibling segment of that step.  A self-join gives each run its pointer's pointer
and appends the segment, which doubles the distance; after log2(height) joins
every run holds its segments up to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import materialize, parallel

TOP = -1     # number of the tree over the subroots; groups count from 0
_STEP = "struct<before:string,after:string>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hexadecimal sha256 of the parts' concatenated UTF-8 bytes."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest_of(*[field(c) for c in columns])


@dataclass
class Manifest:
    """The tree's tables.

    ``leaves``: one row a run of leaves: ``tree, run, members`` (their key,
    digest and extra columns in order) and ``alone``, the only leaf of a group.
    ``nodes``: ``tree, level, pos, digest, before, after`` of the inner nodes,
    with the concatenated digests of its run's other nodes.  ``subroots``:
    ``tree, subroot``.  ``root``: the digest, None for an empty dataset.
    """
    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def place_leaves(leaves: DataFrame, group: str, key: str, digest: str = "leaf") -> DataFrame:
    """Adds ``tree`` (the group's number in order, null first) and ``pos`` (the leaf's in its group).

    Rows are sorted into range partitions by (group, key, digest), so a group of
    any size is spread.  Numbers inside a partition are linked by a table of one
    row a partition.
    """
    order = [F.col(c).asc_nulls_first() for c in (group, key, digest)]
    b = materialize(leaves.repartitionByRange(parallel(leaves), *order).withColumn("block", F.spark_partition_id()), "merkle-order")
    inside = Window.partitionBy("block").orderBy(*order)
    # a group's rows are consecutive in its partition
    b = b.withColumn("g", F.dense_rank().over(Window.partitionBy("block").orderBy(order[0])))
    b = b.withColumn("own", F.row_number().over(Window.partitionBy("block", "g").orderBy(*order[1:])))
    at = F.struct("g", "own")
    ends = b.groupBy("block").agg(F.min_by(F.struct(group), at).alias("first"), F.max_by(F.struct(group), at).alias("last"),
                                  F.max("g").alias("groups"), F.max(at).alias("end"))
    carry, tree, before, last = [], -1, 0, None
    for e in sorted(ends.collect(), key=lambda e: e.block):      # one row a partition
        follows = last is not None and e.first[0] == last[0]
        first_tree = tree if follows else tree + 1
        carry.append((e.block, first_tree - 1, before if follows else 0))
        tree = first_tree + e.groups - 1
        before = e.end.own + (before if follows and e.groups == 1 else 0)
        last = e.last
    table = leaves.sparkSession.createDataFrame(carry, "block int, tree0 long, before long")
    return (b.join(F.broadcast(table), "block")
            .withColumn("tree", F.col("tree0") + F.col("g"))
            .withColumn("pos", (F.col("own") - 1 + F.when(F.col("g") == 1, F.col("before")).otherwise(0)).cast("long"))
            .select(*leaves.columns, "tree", "pos"))


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def siblings(digests: Column, i: Column) -> list[Column]:
    """The run's digests before and after its node ``i``."""
    return [joined(F.slice(digests, 1, i)).alias("before"), joined(F.slice(digests, i + 2, F.size(digests))).alias("after")]


def climb(nodes: DataFrame, fan: int, level: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All inner nodes of trees whose nodes of ``level`` are given as ``tree, pos, digest``, and their roots.

    A run 0 of a single node is its tree's only run: that node is the root.
    """
    every, roots = [], []
    while True:
        member = F.struct("pos", "digest")
        runs = materialize(nodes.groupBy("tree", F.floor(F.col("pos") / fan).cast("long").alias("run"))
                           .agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["digest"]).alias("digests")), f"{name}{level}")
        alone = (F.col("run") == 0) & (F.size("digests") == 1)
        flat = runs.select("tree", F.lit(level).alias("level"), "run", "digests", F.posexplode("digests").alias("i", "digest"))
        every.append(flat.select("tree", "level", (F.col("run") * fan + F.col("i")).alias("pos"), "digest",
                                 *siblings(F.col("digests"), F.col("i")), alone.alias("is_root")))
        roots.append(runs.where(alone).select("tree", F.lit(level).alias("level"), F.get("digests", F.lit(0)).alias("digest")))
        more = runs.where(~alone)
        if more.isEmpty():
            break
        nodes = more.select("tree", F.col("run").alias("pos"), digest_of(joined(F.col("digests"))).alias("digest"))
        level += 1
    out, top = every[0], roots[0]
    for e, r in zip(every[1:], roots[1:]):
        out, top = out.unionByName(e), top.unionByName(r)
    return out, top


def build(leaves: DataFrame, group: str, key: str, fan: int = 16, extra: tuple[str, ...] = ()) -> Manifest:
    """The manifest of ``leaves``: ``group``, ``key``, ``leaf`` (the digest) and ``extra`` columns, any of them null.

    Equal keys of a group are ordered by their digests; repeated rows are leaves each.
    """
    placed = place_leaves(leaves.select(group, key, "leaf", *extra), group, key)
    member = F.struct("pos", "leaf", F.col(key).alias("key"), *extra)
    runs = materialize(placed.groupBy("tree", F.floor(F.col("pos") / fan).cast("long").alias("run"))
                       .agg(F.array_sort(F.collect_list(member)).alias("members"))
                       .withColumn("alone", (F.col("run") == 0) & (F.size("members") == 1)), "merkle-leaves")
    above = runs.where(~F.col("alone")).select("tree", F.col("run").alias("pos"), digest_of(joined(F.col("members.leaf"))).alias("digest"))
    inner, roots = climb(above, fan, 1, "merkle")
    subroots = materialize(roots.select("tree", F.col("digest").alias("subroot"))
                           .unionByName(runs.where("alone").select("tree", F.get("members", F.lit(0))["leaf"].alias("subroot"))), "merkle-subroots")
    top, root = climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest")),
                      fan, 0, "merkle-top")
    found = root.select("digest").collect()                     # one row
    return Manifest(runs, inner.unionByName(top), subroots, found[0][0] if found else None)


def paths(m: Manifest, fan: int = 16) -> DataFrame:
    """``tree, level, run, steps, subroot``: each run's sibling segments from its own digest up to the root.

    Pointer jumping.  A run of level l makes the node (tree, l + 1, run); its
    pointer is that node's run.  The root of a group's tree counts as the
    node (TOP, 0, tree).  A run that has reached the root has no pointer.
    Of the runs at a distance d above, one may be the pointer of fan^d others:
    its row is repeated and the others are dealt to the copies.
    """
    step = F.array(F.struct("before", "after").cast(_STEP))
    n = F.floor(F.col("pos") / fan).cast("long")
    node = m.nodes
    tops = node.where(F.col("tree") == TOP).where("level = 0").select(
        F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "before", "after", "is_root", n.alias("to_run"))
    # inner nodes of the groups' trees (level >= 1) and of the top tree (level >= 1): the run below is (level - 1, pos)
    below = node.where("level > 0")
    plain = below.where("not is_root").select(
        "tree", (F.col("level") - 1).alias("level"), F.col("pos").alias("run"), step.alias("steps"), F.lit(None).cast("string").alias("subroot"),
        F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), n.alias("to_run"))
    last = below.where(F.col("is_root") & (F.col("tree") == TOP)).select(
        "tree", (F.col("level") - 1).alias("level"), F.col("pos").alias("run"), F.array().cast(f"array<{_STEP}>").alias("steps"),
        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("long").alias("to_tree"), F.lit(None).cast("int").alias("to_level"),
        F.lit(None).cast("long").alias("to_run"))
    ends = below.where(F.col("is_root") & (F.col("tree") != TOP)).select("tree", (F.col("level") - 1).alias("level"), F.col("pos").alias("run"))
    top = lambda c: F.when(~F.col("is_root"), c)        # noqa: E731  a single group: its subroot is the root
    crossing = ends.join(tops, "tree").select(
        "tree", "level", "run", F.when(F.col("is_root"), F.array().cast(f"array<{_STEP}>")).otherwise(step).alias("steps"), "subroot",
        top(F.lit(TOP).cast("long")).alias("to_tree"), top(F.lit(0)).alias("to_level"), top(F.col("to_run")).alias("to_run"))
    p = materialize(plain.unionByName(last).unionByName(crossing), "merkle-jump")
    distance = 1
    while not (open_ := p.where("to_run is not null")).isEmpty():
        copies = max(1, min(parallel(p), fan ** distance // 256))
        deal = F.pmod(F.xxhash64("tree", "level", "run"), F.lit(copies)).cast("int")
        far = (p.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("run").alias("to_run"),
                        F.col("steps").alias("more"), F.col("subroot").alias("far_subroot"), F.col("to_tree").alias("t"),
                        F.col("to_level").alias("l"), F.col("to_run").alias("r"),
                        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
               .join(open_.select("to_tree", "to_level", "to_run").distinct(), ["to_tree", "to_level", "to_run"], "left_semi"))
        on = ["to_tree", "to_level", "to_run", "copy"]
        jumped = open_.withColumn("copy", deal).join(far, on).select(
            "tree", "level", "run", F.concat("steps", "more").alias("steps"), F.coalesce("subroot", "far_subroot").alias("subroot"),
            F.col("t").alias("to_tree"), F.col("l").alias("to_level"), F.col("r").alias("to_run"))
        p = materialize(p.where("to_run is null").unionByName(jumped), "merkle-jump")
        distance *= 2
    return p.select("tree", "level", "run", "steps", "subroot")


def proofs(m: Manifest, fan: int = 16, extra: tuple[str, ...] = ()) -> DataFrame:
    """``key, leaf, <extra>, subroot, root, steps``: each leaf with the siblings of its way to the root.

    ``steps``: an array of (before, after), the concatenated digests of the
    run's other nodes; :func:`fold` recomputes the root from it.
    """
    way = paths(m, fan)
    low = way.where("level = 0 and tree <> -1").select("tree", "run", "steps", "subroot")
    members = m.leaves.where("not alone").join(low, ["tree", "run"]).select(
        F.col("members.leaf").alias("digests"), F.posexplode("members").alias("i", "m"), "steps", "subroot")
    many = members.select("m.key", "m.leaf", *[f"m.{c}" for c in extra], "subroot",
                          F.concat(F.array(F.struct(*siblings(F.col("digests"), F.col("i"))).cast(_STEP)), F.col("steps")).alias("steps"))
    # the only leaf of a group is a node of the top tree's lowest level
    tops = m.nodes.where(F.col("tree") == TOP).where("level = 0").select(
        F.col("pos").alias("tree"), "before", "after", "is_root", F.floor(F.col("pos") / fan).cast("long").alias("run"))
    upper = way.where(F.col("tree") == TOP).where("level = 0").select("run", "steps")
    lone = m.leaves.where("alone").select("tree", F.get("members", F.lit(0)).alias("m")).join(tops, "tree")
    one = lone.join(upper, "run", "left").select(
        "m.key", "m.leaf", *[f"m.{c}" for c in extra], F.col("m.leaf").alias("subroot"),
        F.when(F.col("is_root"), F.array().cast(f"array<{_STEP}>"))
        .otherwise(F.concat(F.array(F.struct("before", "after").cast(_STEP)), F.col("steps"))).alias("steps"))
    return many.unionByName(one).withColumn("root", F.lit(m.root).cast("string"))


def fold(start: Column, steps: str = "steps") -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source",
             key: str = "doc_id", tampered: Column | None = None, text: str = "text", fan: int = 16) -> DataFrame:
    """Proofs of all rows of ``docs`` (see :func:`proofs`), with ``altered``, the leaf of the tampered row or null.

    ``tampered``: the rows whose text is lower-cased (A-Z) after the manifest is
    made.  Texts are read once and only digests are moved.  Nulls in any column
    and repeated rows are leaves like others, an empty table has no row, and
    other columns of ``docs`` take no part.
    """
    known = {c: F.col(c) for c in columns}
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(group), F.col(key), leaf(list(known.values())).alias("leaf"),
                       F.when(hit, leaf(list((known | {text: low}).values()))).alias("altered"))
    return proofs(build(materialize(rows, "merkle-rows"), group, key, fan, ("altered",)), fan, ("altered",))


def check(docs: DataFrame) -> DataFrame:
    """The manifest's proofs checked against rows of which those with 5 | crc32(doc_id) were tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = manifest(docs, tampered=tampered)
    seen = out.withColumn("folded_root", fold(F.coalesce("altered", "leaf")))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    return seen.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
