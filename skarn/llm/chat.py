r"""5. Chat formatting: reply trees to conversations.

Messages form trees (tree_id, node_id, parent_id). Root-to-leaf paths come from iterative self-joins that double their reach. The first rounds carry
each message's jump 2^k replies up and the sum of the scores it passes, a row per message that is so far from its start, whatever the tree's shape: that gives each leaf's mean
score, by which branches are ranked. Then the chosen leaves alone are paired with their ancestors, by the same jumps, so a conversation
of n turns takes log n rounds, and only paths that are formatted cost as many narrow rows as they have turns.

The template: every turn is `<|turn:ROLE|>`, the text, `<|end|>`. Roles are percent-encoded. Control strings (the
template's own and those of common chat formats) inside texts get a backslash after their first character, and one more
where backslashes already stand there, so that reading takes exactly one away again. The loss mask is a list of
[start, end) places, one span for each assistant text, marks excluded.

Defined results: a null text or role counts as empty; a null score is 0; a message whose parent is null or missing starts a path;
messages on or under a cycle of parents reach no start and give no path; branches of equal score are ranked by leaf; messages repeated (equal tree and node) are all formatted, by text, under the
smallest of their parents and with the largest of their scores; rows with a null tree (unless null_tree is set, as for turns, where a null conversation is one like any other) or node give no path;
a very long text is one turn, a conversation one row; an empty table gives no rows; other columns are not read.
"""

import functools
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Control strings of the template and of common chat formats. None holds its first character again.
CONTROLS = ("<|turn:", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(r"<\|turn:([^|]*)\|>(.*?)<\|end\|>", re.DOTALL)
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turns(turns: list[tuple[str, str]], learn: str) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) in order -> the conversation, and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn:{quote(role, safe='')}|>", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>"]
        at += len(head) + len(body) + len("<|end|>")
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unquote(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def jumps(messages: DataFrame) -> list[DataFrame]:
    """messages(tree_id, node_id, parent_id, score) -> tables (tree_id, node_id, anc, total, n). The kth has the messages with 2^(k-1) replies above them or more (the first: all): where a jump
    of 2^k ends (null: past the start, and the message is in no later table), the sum and number of scores from the message up to there."""
    nodes = messages.where("node_id is not null").groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"), F.max("score").alias("total"))
    known = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    out = [written(nodes.join(known, ["tree_id", "parent_id"], "left").select(
        "tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("anc"), "total", F.lit(1).cast("long").alias("n")))]
    most = out[0].count().bit_length()  # more rounds than that are cycles
    while len(out) <= most:
        live = out[-1].where("anc is not null")
        if live.isEmpty():
            break
        onward = whole_paths(out).unionByName(live).select("tree_id", F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
        out.append(written(live.join(onward, ["tree_id", "anc"]).select(
            "tree_id", "node_id", F.col("anc2").alias("anc"), (F.col("total") + F.col("total2")).alias("total"), (F.col("n") + F.col("n2")).alias("n"))))
    return out


def whole_paths(tables: list[DataFrame]) -> DataFrame:
    """The messages that have reached a start, with the sum and number of all scores up to it."""
    return functools.reduce(DataFrame.unionByName, (t.where("anc is null") for t in tables))


def best_leaves(tables: list[DataFrame], top_k: int) -> DataFrame:
    """tree_id, leaf, rank of the top_k leaves of each tree by the mean score of their paths."""
    parents = tables[0].where("anc is not null").select("tree_id", F.col("anc").alias("node_id")).distinct()
    whole = whole_paths(tables).join(parents, ["tree_id", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("n")), "node_id"))
    return whole.select("tree_id", F.col("node_id").alias("leaf"), rank.alias("rank")).where(F.col("rank") <= top_k)  # limited before the shuffle as well as after it


def paths(tables: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """tree_id, leaf, rank, node_id, up (replies from the leaf) for the whole paths of leaves(tree_id, leaf, rank)."""
    reach = written(leaves.select("tree_id", "leaf", "rank", F.col("leaf").alias("node_id"), F.lit(0).cast("long").alias("up")))
    for k, table in enumerate(tables[:-1]):
        jump = table.where("anc is not null").select("tree_id", "node_id", "anc")
        reach = reach.unionByName(written(reach.join(jump, ["tree_id", "node_id"]).select("tree_id", "leaf", "rank", F.col("anc").alias("node_id"), (F.col("up") + 2**k).alias("up"))))
    return reach


def format_trees(messages: DataFrame, *, top_k: int = 1, learn: str = "assistant", null_tree: bool = False) -> DataFrame:
    """messages(tree_id, node_id, parent_id, role, text, score) -> tree_id, leaf, rank, n_turns, formatted, loss_spans. With null_tree, messages with a null tree are one tree."""
    messages = messages if null_tree else messages.where("tree_id is not null")
    # joins never match nulls: until the end a tree's key is a struct, which is never null
    tree = F.struct(F.col("tree_id").isNull().alias("none"), F.coalesce(F.col("tree_id").cast("long"), F.lit(0).cast("long")).alias("id")).alias("tree_id")
    m = messages.select(tree, F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tables = jumps(m)
    turns = paths(tables, best_leaves(tables, top_k)).join(m, ["tree_id", "node_id"])
    chosen = turns.groupBy("tree_id", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "node_id", "text", "role"))).alias("turns"))

    def run(batches):
        for b in batches:
            done = [format_turns([(t["role"], t["text"]) for t in ts], learn) for ts in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in b.column(3)], "int64"), pa.array([f for f, _ in done], "string"),
                 pa.array([[{"start": x, "end": y} for x, y in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["tree_id", "leaf", "rank", "n_turns", "formatted", "loss_spans"])

    chosen = chosen.select(F.expr("if(tree_id.none, null, tree_id.id)").alias("tree_id"), "leaf", "rank", "turns")
    return chosen.mapInArrow(run, "tree_id long, leaf long, rank int, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def turns_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply chains: each turn answers the one before it (turn, then role and text, tell the order)."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select(F.col("conv_id").cast("long").alias("tree_id"), place.alias("node_id"), "role", "text").select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """format_trees' rows -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the text and spans alone."""
    import hashlib

    def run(batches):
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = ("int64", "int64", "string", "int64", "string", "int64")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
