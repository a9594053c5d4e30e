"""Conversations from reply trees: paths from root to leaf, the best branches of each tree, and their formatted text.

Paths are found by doubling: after k self-joins a message knows the ancestor 2**k steps above it, so a chain of a million
replies takes twenty rounds. Only ids and scores travel in these rounds. A chosen leaf's path is laid out from the same tables,
the largest steps first: a stretch of messages is parted in two until each part is one message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED = "assistant"
#: Messages of a path that are formatted as one part.
PART = 64


def escape(text: Column) -> Column:
    """Text without ``<|``: a backslash more between the two signs, however many stand there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role in one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def steps(links: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables (key, up, total) of columns key, parent, score, the k-th of which has the messages with an ancestor ``up`` 2**k steps
    above, and the sum of scores from the one above a message up to it; and the number of a table that only messages on or
    below a circle of parents reach, for the paths of others are shorter."""
    known = links.select(F.col("key").alias("_key"), F.col("score").alias("total"))
    tables = [cut(links.where("parent is not null").join(known, F.col("parent") == F.col("_key")).select("key", F.col("parent").alias("up"), "total"))]
    beyond = links.count().bit_length()
    while len(tables) <= beyond and not tables[-1].isEmpty():
        above = tables[-1].select(F.col("key").alias("_key"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        tables.append(cut(tables[-1].join(above, F.col("up") == F.col("_key")).select("key", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"))))
    return tables, beyond


def branch_ends(links: DataFrame, tables: list[DataFrame], beyond: int) -> DataFrame:
    """(key, far, total) of the messages without replies: their steps from the root, the sum of scores of their path. Each climbs
    from the largest step that it has."""
    first = reduce(DataFrame.unionByName, [t.select(F.col("key").alias("_key"), F.lit(k).alias("k")) for k, t in enumerate(tables)]).groupBy("_key").agg(F.max("k").alias("level"))
    last = links.join(tables[0].select(F.col("up").alias("key")).distinct(), "key", "left_anti")
    last = cut(last.join(first, F.col("key") == F.col("_key"), "left").select("key", F.col("key").alias("at"), F.lit(0).cast("bigint").alias("far"), F.col("score").alias("total"), "level"))
    climbed = last.where("false").drop("level")
    for k in range(min(len(tables), beyond) - 1, -1, -1):
        above = tables[k].select(F.col("key").alias("_key"), "up", F.col("total").alias("_total"))
        both = climbed.unionByName(last.where(F.col("level") == k).drop("level")).join(above, F.col("at") == F.col("_key"), "left")
        step = F.when(F.col("up").isNull(), 0).otherwise(2**k)
        climbed = both.select("key", F.coalesce("up", "at").alias("at"), (F.col("far") + step).alias("far"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"))
    return cut(climbed.unionByName(last.where("level is null").drop("level")).drop("at"))


def chosen_paths(links: DataFrame, branches: int | None = 1) -> DataFrame:
    """(key, branch, pos): the messages of the best branches of each tree, in their order from 0; ``links`` has columns key (a
    struct of tree and message), parent (such a struct, or null), and score. A branch ends in a message without replies;
    the highest sum of scores is branch 1, ties by the last message. ``branches`` None: all of them."""
    links = cut(links.select("key", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    tables, beyond = steps(links)
    ranked = branch_ends(links, tables, beyond).withColumn("branch", F.row_number().over(Window.partitionBy("key.tree").orderBy(F.desc("total"), "key")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    whole = cut(ranked.select("key", "branch", F.col("far").alias("pos"), (F.col("far") + 1).alias("size")))
    rest = whole.where("false")
    for k in range(min(len(tables), beyond) - 1, -1, -1):
        step = 2**k
        above = tables[k].select(F.col("key").alias("_key"), "up")
        now = rest.unionByName(whole.where((F.col("size") > step) & (F.col("size") <= 2 * step)))
        both = now.join(above, (F.col("key") == F.col("_key")) & (F.col("size") > step), "left")
        same = F.struct("key", "pos", "size")
        near = F.struct("key", "pos", F.lit(step).cast("bigint").alias("size"))
        far = F.struct(F.col("up").alias("key"), (F.col("pos") - step).alias("pos"), (F.col("size") - step).alias("size"))
        rest = both.select("branch", F.explode(F.when(F.col("up").isNull(), F.array(same)).otherwise(F.array(near, far))).alias("x")).select("branch", "x.*")
    return rest.unionByName(whole.where("size = 1").select(rest.columns)).select("key", "branch", "pos")


def format_branches(messages: DataFrame, branches: int | None = 1, trained: str = TRAINED, tree_col: str = "tree_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """(tree_id, branch, part, n_turns, text, spans): the chosen branches of reply trees as chats, in parts of 64 messages.

    A branch's chat is its parts' texts in order. A turn is ``<|im_start|>``, role, a new line, text, ``<|im_end|>`` and a new
    line; texts and roles are escaped so that none holds ``<|``, and come back by :func:`read_back`. ``spans``
    (start, end: code points within the part, end exclusive) is the loss mask: the escaped texts of the trained role.

    A null text or role is empty, a null score is 0 (all are, without a column of scores). Messages whose parent is null
    or isn't in their tree are roots; those on or below a circle of parents belong to no path, and messages without an id
    take no part. Ids count within a tree; a null tree is a tree. Of rows with one id the first by parent, role, a hash of
    the text and score is taken. An empty table gives no rows; other columns, however named, are left out. Texts may be of any length.
    A tree or a path of any size is spread: joins are by message, and parts are formatted by themselves.
    """
    key = lambda c: F.when(messages[c].isNotNull(), F.struct(messages[tree_col].alias("tree"), messages[c].alias("id")))
    text = lambda c: F.coalesce(messages[c], F.lit(""))
    score = messages[score_col].cast("double") if score_col else F.lit(0.0)
    rows = messages.select(key(id_col).alias("key"), key(parent_col).alias("parent"), text(role_col).alias("role"), text(text_col).alias("text"), score.alias("score")).where("key is not null")
    links = rows.groupBy("key").agg(F.min(F.struct("parent", "role", F.xxhash64("text").alias("text"), "score")).alias("x")).select("key", "x.parent", "x.score")
    paths = chosen_paths(links, branches)
    own = rows.groupBy("key").agg(F.min(F.struct("parent", "role", F.xxhash64("text"), "score", "text")).alias("x")).select(F.col("key").alias("_key"), "x.role", "x.text")
    turns = paths.join(own, F.col("key") == F.col("_key")).select(
        F.col("key.tree").alias("tree_id"), "branch", F.floor(F.col("pos") / PART).alias("part"), "pos",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("trained"),
    )
    parts = turns.groupBy("tree_id", "branch", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "body", "trained"))).alias("t"))
    tail = END + "\n"
    end = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("end")))
        return F.struct((stop + len(tail)).alias("at"), F.when(x["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return parts.select(
        "tree_id", "branch", "part", F.size("t").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "").alias("text"), F.aggregate("t", end, add)["spans"].alias("spans"),
    )


def read_back(parts: DataFrame) -> DataFrame:
    """(tree_id, branch, part, turns, loss, n_chars) of formatted parts: the turns (role, text) that their text holds, and
    the texts under the loss mask, both unescaped."""
    pieces = F.slice(F.split("text", "<\\|im_start\\|>"), F.lit(2), F.greatest(F.size(F.split("text", "<\\|im_start\\|>")) - 1, F.lit(0)))
    line = lambda x: F.instr(x, "\n")
    role = lambda x: unescape_role(F.substring(x, F.lit(1), line(x) - 1))
    text = lambda x: unescape(F.substring(x, line(x) + 1, F.length(x) - line(x) - len(END) - 1))
    turns = F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return parts.select("tree_id", "branch", "part", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("bigint").alias("n_chars"))


def digests(read: DataFrame) -> DataFrame:
    """(tree_id, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the parts of :func:`read_back`.

    A digest of a whole path is a chain, so one task reads a path's parts in order; it holds a part at a time."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("tree_id", "branch", "part", F.size("turns").cast("bigint").alias("n"), lines.alias("turns"), F.array_join("loss", "").alias("loss"), "n_chars")
    kind = rows.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_one = None, None
        for b in batches:
            done = []
            for tree, branch, n, turns, loss, chars in zip(*(b.column(c) for c in ("tree_id", "branch", "n", "turns", "loss", "n_chars")), strict=True):
                path = (tree.as_py(), branch.as_py())
                if open_one is None or path != now:
                    if open_one is not None:
                        done.append((*now, *open_one))
                    now, open_one = path, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = loss.as_py()
                open_one[0] += n.as_py()
                open_one[1].update(turns.as_py().encode())
                open_one[2] += len(text)
                open_one[3].update(text.encode())
                open_one[4] += chars.as_py()
            if done:
                yield made(done, b.schema.field("tree_id").type)
        if open_one is not None:
            yield made([(*now, *open_one)], b.schema.field("tree_id").type)

    def made(done: list[tuple], tree: pa.DataType) -> pa.RecordBatch:
        trees, branches, n, turns, loss_chars, loss, chars = zip(*done, strict=True)
        return batch(
            tree_id=(trees, tree), branch=(branches, pa.int32()), n_turns=(n, pa.int64()), turns_sha256=([x.hexdigest() for x in turns], pa.string()),
            loss_chars=(loss_chars, pa.int64()), loss_sha256=([x.hexdigest() for x in loss], pa.string()), formatted_chars=(chars, pa.int64()),
        )

    in_order = rows.repartition("tree_id", "branch").sortWithinPartitions("tree_id", "branch", "part")
    return in_order.mapInArrow(run, f"tree_id {kind}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
