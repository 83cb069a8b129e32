"""Chat formatting: reply trees, ranked branches, one conversation for each chosen root-to-leaf path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import cut, null_key

#: The template's marks. No escaped text holds any of them.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What escaping breaks up, with a backslash after the first character: the template's own marks and usual foreign ones.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """Text in which no control string is left: backslashes are doubled, then one goes into each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape(): a backslash goes and the character after it stays."""
    return F.regexp_replace(text, r"\\((?s).)", "$1")


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(conv, leaf, node, place): the nodes of the ``keep`` best root-to-leaf paths below each root, place from 0 at the root.

    messages: conv (string), node (long), parent (long, null at a root), score (double). A parent that isn't there makes
    its child a root; null scores count 0; nodes on a cycle belong to no path. Paths rank by summed score, then by length,
    then by the smaller leaf.

    Iterative self-joins double the reach: after round k each node knows its ancestor 2^k up, the hops there and the score
    between, so a tree of depth D takes log2(D) joins, every row stays of constant size, and a node leaves the joins once it has its root. The chosen leaves then walk
    the same tables from far to near, which meets every node of a path exactly once.
    """
    own = messages.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    parents = own.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = own.join(parents, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("sum"))
    up = cut(up.select("conv", "node", "up", F.col("up").isNotNull().cast("long").alias("hops"), F.coalesce("up", "node").alias("top"), "sum"))
    largest = up.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    most, tables = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), [up]
    while 2 ** (len(tables) - 1) < largest and tables[-1].filter(F.col("up").isNotNull()).limit(1).count():
        last = tables[-1]
        far = last.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("top").alias("top2"), F.col("sum").alias("sum2"))
        step = last.filter(F.col("up").isNotNull()).join(far, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("top2").alias("top"), (F.col("sum") + F.col("sum2")).alias("sum"))
        tables.append(cut(step.union(last.filter(F.col("up").isNull())).coalesce(most)))
    done = tables[-1].filter(F.col("up").isNull())
    leaves = done.join(up.select("conv", F.col("up").alias("node")).filter(F.col("node").isNotNull()).distinct(), ["conv", "node"], "left_anti")
    best = Window.partitionBy("conv", "top").orderBy(F.desc("sum"), F.desc("hops"), "node")
    path = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).select("conv", F.col("node").alias("leaf"), "node", F.col("hops").alias("place"))
    path = cut(path)
    for table in reversed(tables[:-1]):
        jump = table.filter(F.col("up").isNotNull()).select("conv", "node", "up", "hops")
        path = path.join(jump, ["conv", "node"], "left").select("conv", "leaf", F.inline(F.array(F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - F.col("hops")).alias("place"))))).filter(F.col("node").isNotNull())
        path = cut(path)
    return path


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv, leaf, formatted, loss_spans) from (conv, leaf, place, role, text): one text a conversation and its loss mask.

    loss_spans: start and length in code points of each assistant text inside formatted. Null role or text: empty.
    """
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(SEP))
    body = escape(F.coalesce("text", F.lit("")))
    rows = turns.select("conv", "leaf", "place", (F.col("role") == "assistant").alias("learn"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.length("head"))
    rows = rows.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "start", F.length("body").cast("long").alias("length"), "learn"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: F.coalesce(x["learn"], F.lit(False))), lambda x: F.struct(x["start"], x["length"]))
    return rows.select("conv", "leaf", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)
    body = lambda x: F.get(F.split(x, r"<\|im_sep\|>"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(unescape(F.get(F.split(x, r"<\|im_sep\|>"), F.lit(0))).alias("role"), unescape(body(x).substr(F.lit(1), F.length(body(x)) - len(END))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of linear conversations: rows by turn, each replying to the row before.

    Equal turns stand by role, then text, null first; repeated rows all stay. Null conv_id is a conversation of its own.
    Null role or text counts as empty. Empty table: no rows. Other columns are ignored.
    """
    rows = conversations.select("conv_id", null_key(F.col("conv_id")).alias("conv"), "turn", "role", "text")
    rows = cut(rows.withColumn("node", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")))
    tree = rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    turns = reply_paths(tree).join(rows, ["conv", "node"])
    ids = rows.filter(F.col("node") == 1).select("conv", "conv_id")
    return format_chats(turns).join(ids, "conv").select("conv_id", "formatted", "loss_spans")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + length('<|im_sep|>') + length(esc) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
