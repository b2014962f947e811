"""The trie of conversations' prefixes.

A prefix is told by the sums of four 32-bit parts of a SHA-256 digest over each turn's
place, role and text. Sums of parts can be added up in any order, so a long conversation
is worked on in pieces of ``PIECE`` turns, and no task ever holds a whole one.

The least id among the conversations that share a prefix owns its node. Whoever owns a
prefix owns all longer ones of its own, so a conversation's owned nodes are a chain, from
the first depth it owns down to its end; that depth is found by binary search, each step
a join of one probe a conversation against the prefixes' least ids. A chain hangs below a
node of another chain. Sums over subtrees go up that tree of chains, with the reach of a
step doubled each round, and then along each chain.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, tasks_for

#: Turns of a conversation that one window holds at a time.
PIECE = 4096
#: Conversations whose ids have the same multiple of this begin with its first turns.
FAMILY = 20
PARTS = ["s1", "s2", "s3", "s4"]
WORD = r"[^\x20\x09-\x0D]+"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def running_sums(rows: DataFrame, key: str, piece: str, at: str, columns: list) -> DataFrame:
    """``rows`` with every one of ``columns`` replaced by its sum over the rows of the same
    key up to this one. Keys are cut into pieces, numbered upwards: sums run within
    a piece in order of ``at``, and the sums of the pieces before are added."""
    others = [c for c in rows.columns if c not in columns]
    within = Window.partitionBy(key, piece).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select(*others, *(F.sum(c).over(within).alias(c) for c in columns))
    before = Window.partitionBy(key).orderBy(piece)
    totals = rows.groupBy(key, piece).agg(*(F.sum(c).alias(c) for c in columns))
    earlier = totals.select(key, piece, F.row_number().over(before).alias("_k"), *(F.sum(c).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}") for c in columns)).where("_k > 1")
    joined = inside.join(earlier, [key, piece], "left")
    return joined.select(*others, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, digest, words): the rows of every conversation, numbered from 1 in order
    of turn (null first), role and text. A range sort lays a long conversation over many
    tasks; bounds of ranges have the first 64 characters of role and text only."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    long = F.length("role") > 64
    rows = rows.select("*", F.substring("role", 1, 64).alias("r"), long.alias("long"), F.when(~long, F.substring("text", 1, 64)).alias("t"))
    dealt = rows.repartitionByRange(tasks_for(turns.sparkSession), "conv", "turn", "r", "long", "t").sortWithinPartitions("conv", "turn", "role", "text")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    laid = dealt.select("conv", F.monotonically_increasing_id().alias("at"), F.unhex(said).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    laid = materialize(laid, "turns").withColumn("task", F.shiftright("at", 33)).withColumn("pos", F.lit(1).cast("long"))
    return running_sums(laid, "conv", "task", "at", ["pos"]).select("conv", "pos", "digest", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): every conversation (conv, turns) and its rebuilt turns (conv, depth,
    digest, words), both stored. The first h turns come from the family's first
    conversation, h being the id's CRC-32 modulo 4, and replace the own first h."""
    numbered = materialize(numbered_turns(turns), "numbered-turns")
    convs = numbered.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = convs.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    heads = convs.where("conv = base").select("base", F.col("n").alias("there"))
    convs = convs.join(heads, "base", "left").select("conv", "base", "n", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"))
    convs = materialize(convs.select("*", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "conversations")
    firsts = numbered.where(f"pos <= 3 and conv % {FAMILY} = 0").select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "words")
    shared = convs.select("conv", "base", "k").join(firsts, "base").where("depth <= k").select("conv", "depth", "digest", "words")
    own = numbered.join(convs.select("conv", "h", "k"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "words")
    return convs.select("conv", "turns"), materialize(shared.unionByName(own), "rebuilt-turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, s1 to s4, words) of every prefix, from its rebuilt turns; stored."""
    told = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), "digest"), 256)
    parts = [F.conv(F.substring("told", 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(PARTS)]
    cut = rows.select("*", told.alias("told"), F.floor(F.col("depth") / PIECE).alias("piece"))
    summed = running_sums(cut.select("conv", "depth", "piece", "words", *parts), "conv", "piece", "depth", PARTS)
    return materialize(summed.drop("piece"), "prefixes")


def first_owned(convs: DataFrame, paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(conv, turns, first): the least depth of which each conversation is the owner, one
    more than its turns where it owns none; stored."""
    state = convs.select("conv", "turns", F.lit(1).cast("long").alias("lo"), (F.col("turns") + 1).alias("hi"))
    held = None
    while not (open_ := state.where("lo < hi")).isEmpty():
        probes = open_.withColumn("depth", F.expr("(lo + hi) div 2")).join(paths.select("conv", "depth", *PARTS), ["conv", "depth"])
        seen = probes.join(owners.select("depth", *PARTS, "owner"), ["depth", *PARTS])
        mine = F.col("owner") == F.col("conv")
        moved = seen.select("conv", "turns", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = materialize(state.where("lo = hi").unionByName(moved), "owned-depths", few_files=True)
        if held is not None:
            discard(held)
        held = state
    return state.select("conv", "turns", F.col("lo").alias("first"))


def chain_totals(chains: DataFrame, values: list) -> DataFrame:
    """``chains`` (conv, up, values) with each value summed over the chain and all that hang
    below it. Each round adds what is known one reach below and doubles the reach."""
    held = None
    while not (chains.where("up is not null")).isEmpty():
        gains = chains.where("up is not null").groupBy("up").agg(*(F.sum(c).alias(f"_{c}") for c in values)).withColumnRenamed("up", "conv")
        ups = chains.select(F.col("conv").alias("up"), F.col("up").alias("_up"))
        summed = chains.join(gains, "conv", "left").join(ups, "up", "left")
        chains = materialize(summed.select("conv", F.col("_up").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in values)), "chains", few_files=True)
        if held is not None:
            discard(held)
        held = chains
    return chains


def id_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) from (conv, depth, member): the digest of the members'
    ids, ascending, with commas between. SHA-256 takes its bytes in order, so a node's ids
    pass through one task, but as a sorted stream of numbers of which it holds a batch."""
    dealt = ends.repartition(tasks_for(ends.sparkSession), "conv", "depth").sortWithinPartitions("conv", "depth", "member")

    def add(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for key, members in batch.groupby(["conv", "depth"], sort=False)["member"]:
                text = ",".join(map(str, members.tolist())).encode()
                if key == at:
                    state.update(b"," + text)
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text)
            yield pd.DataFrame(out, columns=["conv", "depth", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["conv", "depth", "ends_sha256"])

    return dealt.mapInPandas(add, "conv long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes, as ``NODES``; ``turns`` has conv_id, turn, role and text.

    A null role or text is empty, a null turn comes first, rows of one turn are ordered by
    role and text, repeated rows are turns each; rows without a conv_id belong to no
    conversation. A negative id's family is the multiple towards zero. A conversation that
    is left without turns is a member of the root alone. An empty table has no nodes, not
    even the root. Other columns are not read."""
    spark = turns.sparkSession
    convs, rows = rebuild(turns)
    top, n_all = convs.agg(F.min("conv"), F.count("*")).first()
    if top is None:
        return spark.createDataFrame([], NODES)
    paths = prefixes(rows)
    owners = paths.groupBy("depth", *PARTS).agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.min("words").alias("words"))
    owners = materialize(owners, "prefix-owners")
    owned = first_owned(convs, paths, owners)

    def owner_at(probes: DataFrame) -> DataFrame:
        """With the owner of each probe's (conv, depth)."""
        return probes.join(paths.select("conv", "depth", *PARTS), ["conv", "depth"]).join(owners.select("depth", *PARTS, "owner"), ["depth", *PARTS]).drop(*PARTS)

    root = F.col("conv") == top
    chains = owned.where((F.col("first") <= F.col("turns")) | root).withColumn("first", F.when(root, F.lit(0)).otherwise(F.col("first")))
    hung = owner_at(chains.where("first > 1").select("conv", "turns", "first", (F.col("first") - 1).alias("depth"))).select("conv", "turns", "first", F.col("owner").alias("up"))
    others = chains.where("first <= 1").select("conv", "turns", "first", F.when(~root, F.lit(top)).alias("up"))
    chains = materialize(hung.unionByName(others), "chains")

    nodes = owners.select(F.col("owner").alias("conv"), "depth", "n", ((F.col("n") - 1) * F.col("words")).alias("saved"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit(top).alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(n_all).alias("n"), F.lit(0).cast("long").alias("saved")))
    hooks = chains.where("up is not null").select(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth"), F.col("conv").alias("child"))
    bare = chains.select("conv", F.col("turns").alias("depth")).join(hooks, ["conv", "depth"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaves"))
    alone = chains.join(nodes.groupBy("conv").agg(F.sum("saved").alias("saved")), "conv").join(bare, "conv", "left")
    totals = chain_totals(alone.select("conv", "up", "saved", F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves")), ["saved", "leaves"])

    # along each chain from its end: its own nodes and what hangs at them
    hanging = hooks.join(totals.select(F.col("conv").alias("child"), "saved", "leaves"), "child")
    hanging = hanging.groupBy("conv", "depth").agg(F.count("*").alias("hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    zero = F.lit(0).cast("long")
    there = nodes.join(chains, "conv").join(hanging, ["conv", "depth"], "left").na.fill(0, ["hung", "hung_saved", "hung_leaves"])
    there = there.select(
        "conv", "depth", "n", F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv")).alias("parent"),
        (F.col("hung") + (F.col("depth") < F.col("turns")).cast("long")).alias("children"),
        (F.col("saved") + F.col("hung_saved")).alias("saved"),
        (F.col("hung_leaves") + F.when((F.col("depth") == F.col("turns")) & (F.col("hung") == 0), 1).otherwise(zero)).alias("leaves"),
        (-F.col("depth")).alias("back"), F.floor(-F.col("depth") / PIECE).alias("piece"),
    )
    summed = running_sums(there, "conv", "piece", "back", ["saved", "leaves"])

    mine = owned.where((F.col("first") <= F.col("turns")) | (F.col("turns") == 0)).select(F.when(F.col("turns") == 0, F.lit(top)).otherwise(F.col("conv")).alias("conv"), F.col("turns").alias("depth"), F.col("conv").alias("member"))
    theirs = owner_at(owned.where("first > turns and turns > 0").select("conv", F.col("turns").alias("depth"))).select(F.col("owner").alias("conv"), "depth", F.col("conv").alias("member"))
    digests = id_digests(mine.unionByName(theirs))
    none = F.lit(hashlib.sha256().hexdigest())
    return summed.join(digests, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
