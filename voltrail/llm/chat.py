"""Reply trees to chat texts: paths from root to leaf, ranked, each formatted as one conversation with its loss mask.

A message names the message that it replies to. Self-joins double the reach of every message's link: after k rounds it
leads 2 ** k messages up and carries the score and number of those passed, so the whole path of a leaf is known after the
logarithm of its depth. In each tree the branches are ranked by the mean score of their messages (ties: the leaf that
comes first) and the best `keep` are chosen. The paths of the chosen leaves are then listed by the same links, each round
doubling what is listed; texts join last, and only those on chosen paths. All rounds are written. The rows of a message
with very many replies are split by Spark where they join; a formatted conversation is one row and has to fit in one.

Template: `<|im_start|>role`, newline, text, `<|im_end|>`, newline. Control strings inside roles and texts get a backslash
behind their first character, one more if some are there already, so none is left whole and one step undoes it. Newlines
and per cent signs in roles are written as %0A and %25. The loss mask holds the code-point spans of the assistant's texts.

Defined results: null roles and texts are empty, a null score is 0. A null conversation id is a conversation. A reply to
nothing, to an unknown message, to itself or to one that comes later (by place, then id) starts a tree, so there are no
cycles. Of messages with one id replies go to the first (by place, role, text); all are kept. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.llm.ordering import same
from voltrail.session import send_to_tasks, written

START, END = "<|im_start|>", "<|im_end|>\n"
# What public chat templates use as control strings.
CONTROL = r"/?s>|\|[A-Za-z0-9_]+\|>|/?INST\]|/?<SYS>>|</SYS>>|(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>"
ESCAPABLE = rf"([<\[])(\\*(?:{CONTROL}))"
ESCAPED = rf"([<\[])\\(\\*(?:{CONTROL}))"
TRAINED = "assistant"
LAST_PLACE = 2**63 - 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2", text)


def written_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def read_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations of one branch as messages, each a reply to the one before by turn (null first), role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    known = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    placed = known.withColumn("place", F.row_number().over(order).cast("long"))
    return placed.select(
        "conv_id", F.struct(F.col("place").alias("node"), F.lit(1).alias("copy")).alias("id"),
        (F.col("place") - 1).alias("parent"), "place", "role", "text", F.lit(0.0).alias("score"))


def numbered_copies(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, node, parent, place, role, text, score) with `id`: the node and its number among equals."""
    known = messages.select(
        "conv_id", "node", "parent", F.coalesce("place", F.lit(LAST_PLACE)).alias("place"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")], F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    equals = Window.partitionBy("conv_id", "node").orderBy("place", "role", "text", "score", "parent")
    return known.select(
        "conv_id", F.struct("node", F.row_number().over(equals).alias("copy")).alias("id"), "parent", "place", "role", "text", "score")


def _links(messages: DataFrame) -> DataFrame:
    """conv_id, id, up (null for a root), score, passed, root: the first link of every message."""
    heads = messages.where("id.copy = 1").select(
        F.col("conv_id").alias("_conv"), F.col("id").alias("up"), F.col("place").alias("_place"))
    before = F.struct(F.col("_place"), F.col("up.node")) < F.struct(F.col("place"), F.col("id.node"))
    replies = same(["conv_id"], ["_conv"]) & (F.col("parent") == F.col("up.node")) & before
    return messages.join(heads, replies, "left").select(
        "conv_id", "id", "up", "score", F.lit(1).cast("long").alias("passed"), F.when(F.col("up").isNull(), F.col("id")).alias("root"))


def _doubled(links: DataFrame) -> DataFrame:
    """Links twice as long; those that have arrived stay."""
    far = links.select(
        F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("score").alias("_score"),
        F.col("passed").alias("_passed"), F.col("root").alias("_root"))
    on = links.where("up IS NOT NULL").join(far, same(["conv_id"], ["_conv"]) & (F.col("up") == F.col("_id")))
    return links.where("up IS NULL").unionByName(on.select(
        "conv_id", "id", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"),
        (F.col("passed") + F.col("_passed")).alias("passed"), F.col("_root").alias("root")))


def chosen_paths(messages: DataFrame, keep: int) -> DataFrame:
    """conv_id, root, leaf, branch, branch_score, place (from 1 at the root), id: the messages of the `keep` best branches."""
    rounds = [written(_links(messages.drop("role", "text")), "reply-links")]
    while not rounds[-1].where("up IS NOT NULL").isEmpty():
        rounds.append(written(_doubled(rounds[-1]), "reply-links"))
    replied = rounds[0].where("up IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("up").alias("_up")).distinct()
    leaves = rounds[-1].join(replied, same(["conv_id"], ["_conv"]) & (F.col("id") == F.col("_up")), "left_anti").select(
        "conv_id", "root", F.col("id").alias("leaf"), (F.col("score") / F.col("passed")).alias("branch_score"), "passed")
    best = Window.partitionBy("conv_id", "root").orderBy(F.desc("branch_score"), "leaf")
    ranked = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= keep)
    paths = written(ranked.withColumns({"place": F.col("passed"), "id": F.col("leaf")}).drop("passed"), "reply-paths")
    for reach, links in enumerate(rounds[:-1]):
        steps = links.where("up IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), F.col("up").alias("_up"))
        above = paths.join(steps, same(["conv_id"], ["_conv"]) & (F.col("id") == F.col("_id"))).withColumns(
            {"id": F.col("_up"), "place": F.col("place") - 2**reach}).select(paths.columns)
        paths = written(paths.unionByName(above), "reply-paths")
    return paths


def format_paths(messages: DataFrame, keep: int) -> DataFrame:
    messages = written(messages, "reply-messages")
    said = messages.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), "role", "text")
    turns = chosen_paths(messages, keep).join(said, same(["conv_id", "id"], ["_conv", "_id"])).select(
        "conv_id", "root", "leaf", "branch", "branch_score", "place", (F.col("role") == TRAINED).alias("trained"),
        F.concat(F.lit(START), written_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    path = ["conv_id", "root", "leaf"]
    earlier = Window.partitionBy(*path).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.length("head")
    turns = turns.withColumn("begins", begins)
    span = F.struct("begins", (F.col("begins") + F.length("body")).alias("ends"))
    whole = turns.groupBy(*path, "branch", "branch_score").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss"))
    return whole.select(
        "conv_id", F.col("root.node").alias("root"), F.col("leaf.node").alias("leaf"), "branch", "branch_score",
        F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def format_reply_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, root, leaf, branch, branch_score, formatted, loss (spans begins, ends): a row per chosen branch."""
    return format_paths(numbered_copies(messages), keep)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The same for conversations of one branch: conv_id, turn, role, text."""
    return format_paths(linear(conversations), 1)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """role, text of each turn, as they were before formatting."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition("\n")
        out.append((read_role(role), unescape(text.removesuffix(END))))
    return out


def _read_back(formatted: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for text, starts, stops in zip(formatted, begins, ends):
        turns = read_turns(text)
        said = "".join(f"{role}\n{words}\n" for role, words in turns)
        learned = "".join(unescape(text[a:b]) for a, b in zip(starts, stops))
        rows.append((
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one, -7, whose texts are made of control strings."""
    words = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], schema)
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    send_to_tasks(__name__)
    read = F.pandas_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    rows = format_conversations(with_probe(conversations))
    return rows.withColumn("back", read("formatted", "loss.begins", "loss.ends")).select(
        "conv_id", "back.*", F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql(text: str) -> str:
    return f"regexp_replace({text}, '{ESCAPABLE}', '\\1\\\\\\2', 'g')"


SQL = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nr FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr) AS said,
         coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = '{TRAINED}'), '') AS learned,
         sum({len(START) + 1 + len(END)} + length({_escaped_sql("replace(replace(role, '%', '%25'), chr(10), '%0A')")})
             + length({_escaped_sql('text')})) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c"""
