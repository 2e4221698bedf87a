"""Thread assembly and selection over messages (schemas.MESSAGE)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import normalise_subject, strip

from .components import connected_components
from .scratch import Scratch


def body_gate(messages: DataFrame, least: int = schemas.BODY_MIN, body: str = "body") -> DataFrame:
    return messages.where(F.length(body) >= least)


def min_messages(messages: DataFrame, key: str, least: int = schemas.THREAD_MIN) -> DataFrame:
    """Messages of threads that have enough of them: one aggregate and a semi join on the key."""
    enough = messages.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    return messages.join(enough, key, "left_semi")


def earliest(messages: DataFrame, key: str, most: int = schemas.THREAD_MAX, order: tuple[str, ...] = ("ts_raw", "seq")) -> DataFrame:
    """The first ``most`` messages of every thread; a group limit, so rows beyond go before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return messages.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def priority(sender: Column, mailboxes: tuple[str, ...]) -> Column:
    """Whether the sender holds a priority mailbox name written with dots."""
    names = [m.replace("-", ".") for m in mailboxes]
    test = F.lit(False)
    for n in names:
        test = test | F.contains(F.lower(sender), F.lit(n))
    return test


def scores(messages: DataFrame, key: str, mailboxes: tuple[str, ...] = (), sender: str = "sender", body: str = "body") -> DataFrame:
    """Per thread: messages, senders, participants and score (3 a message, 5 a sender, a point per 500 characters, 20 a priority message)."""
    boost = F.when(priority(F.col(sender), mailboxes), 20).otherwise(0)
    out = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"), F.array_sort(F.collect_set(sender)).alias("participants"),
        F.sum(F.length(body)).alias("chars"), F.sum(boost).alias("boost"),
    )
    score = F.col("message_count") * 3 + F.size("participants") * 5 + F.col("chars") / F.lit(500.0) + F.col("boost")
    return out.withColumn("score", score.cast("double"))


def link_edges(messages: DataFrame) -> DataFrame:
    """(seq, ord, child, parent): In-Reply-To first, then References in order."""
    mid, irt = strip(F.col("message_id")), strip(F.col("in_reply_to"))
    linked = messages.where(F.coalesce(mid, F.lit("")) != "")
    targets = F.concat(F.array(F.coalesce(irt, F.lit(""))), F.coalesce(F.col("refs"), F.array().cast("array<string>")))
    out = linked.select("seq", mid.alias("child"), F.posexplode(targets).alias("ord", "parent"))
    return out.where((F.col("parent") != "") & F.col("parent").isNotNull())


def _replay(edges: pd.DataFrame) -> pd.DataFrame:
    """Roots of one component's ordered unions (the right-hand root stays)."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for child, up in edges.sort_values(["seq", "ord"])[["child", "parent"]].itertuples(index=False):
        a, b = root(child), root(up)
        if a != b:
            parent[a] = b
    nodes = sorted(parent)
    return pd.DataFrame({"mid": nodes, "root": [root(n) for n in nodes]}, dtype="str")


def climbed(links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(mid, root) where every message answers at most one other: pointers that reach twice as far in each round. None if one answers several, or in a circle."""
    up = scratch.write(links.where("child <> parent").select(F.col("child").alias("mid"), F.col("parent").alias("root")).distinct(), "up")
    shape = up.agg(F.count(F.lit(1)).alias("links"), F.count_distinct("mid").alias("children")).first()
    if shape.links != shape.children:
        return None
    for turn in range(shape.links.bit_length() + 1):
        over = up.select(F.col("mid").alias("root"), F.col("root").alias("further"))
        moved = up.join(over, "root", "left").select("mid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = scratch.write(moved, f"up-{turn}")
        up = moved.select("mid", "root")
        if moved.where("moved").isEmpty():
            return up
    return None


def replayed(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(mid, root) of any links: components in parallel, then the ordered unions of those that have several links from one message."""
    parts = connected_components(links, a="child", b="parent", scratch=scratch)
    tagged = scratch.write(links.join(parts.select(F.col("node").alias("child"), "component"), "child"), "tagged")
    shape = tagged.groupBy("component", "child").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max("n").alias("most"))
    both = F.array(F.struct(F.col("child").alias("node"), F.lit(1).alias("answers")), F.struct(F.col("parent").alias("node"), F.lit(0).alias("answers")))
    members = tagged.select("component", F.explode(both).alias("m")).groupBy("component", "m.node").agg(F.max("m.answers").alias("answers"))
    tops = members.groupBy("component").agg(F.count_if(F.col("answers") == 0).alias("tops"), F.max(F.when(F.col("answers") == 0, F.col("node"))).alias("root"))
    plain = shape.join(tops, "component").where("most = 1 and tops = 1").select("component", "root")
    roots = members.where("answers = 1").join(plain, "component").select(F.col("node").alias("mid"), "root")
    mixed = tagged.join(plain, "component", "left_anti")
    return roots.unionByName(mixed.groupBy("component").applyInPandas(lambda pdf: _replay(pdf), "mid string, root string"))


def thread_keys(messages: DataFrame) -> DataFrame:
    """``messages`` with ``thread_key`` and ``insert_ord`` (the order in which a thread lists equal timestamps).

    Where every message answers one other at most, the root is the one that answers none, and messages climb to it; otherwise
    components are found, and those with several links from one message have their ordered unions replayed. The component's root message is not a key of the union structure, so it falls to its
    subject; threads whose first message has the same subject are then one.
    """
    scratch = Scratch(messages.sparkSession, "threads")
    links = scratch.write(link_edges(messages), "links")
    roots = climbed(links, scratch)
    if roots is None:
        roots = replayed(links, scratch)
    keyed = messages.withColumn("__mid", strip(F.col("message_id"))).join(roots.withColumnRenamed("mid", "__mid"), "__mid", "left")
    own = F.coalesce("root", F.concat(F.lit("subj::"), normalise_subject(F.col("subject"))))
    keyed = keyed.withColumn("key", own).drop("__mid", "root")
    first = keyed.groupBy("key").agg(F.min(F.struct("seq", "subject")).alias("f"))
    first = first.select("key", F.col("f.seq").alias("first_seq"), normalise_subject(F.col("f.subject")).alias("nsubj"))
    primary = first.where("nsubj <> ''").groupBy("nsubj").agg(F.min(F.struct("first_seq", "key")).alias("p"))
    final = first.join(primary, "nsubj", "left").select("key", "first_seq", F.coalesce("p.key", "key").alias("thread_key"))
    out = keyed.join(final, "key")
    return out.withColumn("insert_ord", F.struct("first_seq", "seq")).drop("key", "first_seq")


def select_threads(messages: DataFrame, *, least: int = schemas.THREAD_MIN, most: int = schemas.THREAD_MAX, target: int = schemas.THREAD_TARGET, mailboxes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(threads, their messages): capped, scored, one per subject, the best ``target``."""
    keyed = min_messages(thread_keys(messages), "thread_key", least)
    kept = earliest(keyed, "thread_key", most, ("ts_raw", "insert_ord"))
    ranked = scores(kept, "thread_key", mailboxes)
    first = kept.where("pos = 1").select("thread_key", F.coalesce("subject", F.lit("(no subject)")).alias("subject"), F.col("insert_ord").alias("first_ord"))
    ranked = ranked.join(first, "thread_key").withColumn("nsubj", normalise_subject(F.col("subject")))
    best = Window.partitionBy("nsubj").orderBy(F.col("score").desc(), "first_ord")
    ranked = ranked.withColumn("rn", F.row_number().over(best)).where("rn = 1").orderBy(F.col("score").desc(), "first_ord").limit(target)
    # One sort of what the limit lets through.
    ranked = ranked.withColumn("thread_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "first_ord")))
    threads = ranked.select(F.substring(F.md5("thread_key"), 1, 10).alias("thread_id"), "thread_key", "subject", "message_count", "participants", "score", "thread_rank")
    return threads, kept.join(threads.select("thread_id", "thread_key"), "thread_key")


def nested(messages: DataFrame, key: str = "thread_id") -> DataFrame:
    """One row per thread of capped size: its messages as an ordered list, the first subject and the senders."""
    mail = F.struct("email_id", "message_id", "in_reply_to", F.array_join(F.coalesce("refs", F.array().cast("array<string>")), " ").alias("references"), F.col("sender").alias("from"), F.col("recipients_raw").alias("to"), "subject", F.col("ts_raw").alias("timestamp"), "body")
    made = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts_raw", "seq", mail.alias("m")))).alias("l"), F.array_sort(F.collect_set("sender")).alias("participants"))
    return made.select(key, F.get("l", F.lit(0))["m"]["subject"].alias("subject"), F.size("l").cast("long").alias("message_count"), "participants", F.transform("l", lambda x: x["m"]).alias("messages"))
