"""Reply trees as chat transcripts, in DataFrame operations only.

Messages hold an id, the id of the message they answer, a role, a text and a score.
``branches`` enumerates root-to-leaf paths with iterative self-joins that double their reach
each round, so a chain of a million replies takes twenty rounds. ``ranked`` orders the branches of a tree
by score, ``format_paths`` renders each chosen branch as one conversation, and ``parse`` and
``loss_text`` read transcripts back.

Cases: a null role or text is empty. A parent that is missing, null or the message itself
starts a tree; messages that answer each other in a circle are an error. Message ids are unique
in a tree and not null. Equal scores are ordered by the id of the leaf. No messages: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.pii import running_sum
from millrace.session import cut_lineage

# The marks of the template.
OPEN = "<|im_start|>"
CLOSE = "<|im_end|>\n"

# Every round doubles the reach of the paths; no tree is deeper than 2^40.
MAX_ROUNDS = 40


def linear_messages(turns: DataFrame) -> DataFrame:
    """Conversations in rows by turn as messages of one-branch trees.

    Rows are ordered by turn; equal turns are ordered by role and text, so repeated rows stay
    as turns of their own. Returns ``tree, message, parent, role, text, score``.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("tree"),
        F.col("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.select(
        "tree",
        place.cast("bigint").alias("message"),
        F.when(place > 1, (place - 1).cast("bigint")).alias("parent"),
        "role",
        "text",
        F.length("text").cast("double").alias("score"),
    )


def branches(messages: DataFrame) -> DataFrame:
    """Rows ``tree, leaf, message, depth`` for every message on every root-to-leaf path.

    ``steps`` knows each message's ancestor 2^k replies up; joining the members found so far with it
    doubles the known part of each path. Only ids are shuffled, and the loop ends when no
    path has an open end. ``depth`` counts from the root, which is 0.
    """
    ids = messages.select("tree", "message", "parent")
    known = ids.select("tree", F.col("message").alias("parent")).distinct()
    own = ids.where((F.col("parent") != F.col("message")) & F.col("parent").isNotNull())
    steps = cut_lineage(
        own.join(known, [own["tree"].eqNullSafe(known["tree"]), own["parent"] == known["parent"]], "left_semi").select(
            "tree", F.col("message").alias("low"), F.col("parent").alias("high")
        )
    )
    inner = steps.select("tree", F.col("high").alias("message")).distinct()
    leaves = ids.select("tree", "message").join(
        inner, [ids["tree"].eqNullSafe(inner["tree"]), ids["message"] == inner["message"]], "left_anti"
    )
    # Each member of a path with its distance from the leaf.
    members = leaves.select("tree", F.col("message").alias("leaf"), F.col("message"), F.lit(0).cast("bigint").alias("up"))
    reach = 1
    for _ in range(MAX_ROUNDS):
        if steps.isEmpty():
            break
        s = steps.alias("s")
        m = members.alias("m")
        further = m.join(s, F.col("m.tree").eqNullSafe(F.col("s.tree")) & (F.col("m.message") == F.col("s.low"))).select(
            F.col("m.tree"), F.col("m.leaf"), F.col("s.high").alias("message"), (F.col("m.up") + reach).alias("up")
        )
        members = cut_lineage(members.unionByName(further))
        t = steps.alias("t")
        doubled = s.join(t, F.col("s.tree").eqNullSafe(F.col("t.tree")) & (F.col("s.high") == F.col("t.low"))).select(
            F.col("s.tree"), F.col("s.low"), F.col("t.high")
        )
        steps = cut_lineage(doubled)
        reach *= 2
    else:
        raise ValueError("messages answer each other in a circle")
    longest = members.groupBy("tree", "leaf").agg(F.max("up").alias("_longest"))
    joined = members.alias("m").join(
        longest.alias("l"), F.col("m.tree").eqNullSafe(F.col("l.tree")) & (F.col("m.leaf") == F.col("l.leaf"))
    )
    return joined.select(
        F.col("m.tree"), F.col("m.leaf"), F.col("m.message"), (F.col("_longest") - F.col("up")).alias("depth")
    )


def _of_message(paths: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """The rows of paths with columns of their messages."""
    same = F.col("p.tree").eqNullSafe(F.col("f.tree")) & (F.col("p.message") == F.col("f.message"))
    return paths.alias("p").join(facts.select("tree", "message", *columns).alias("f"), same).select("p.*", *columns)


def ranked(paths: DataFrame, messages: DataFrame, keep: int = 1) -> DataFrame:
    """The rows of the ``keep`` branches of each tree with the highest mean score, with their texts.

    Branches are chosen by ids and scores alone; only members of chosen branches meet their texts.
    """
    scored = _of_message(paths, messages, "score")
    scores = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), F.col("leaf"))
    chosen = scores.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= keep)
    same = F.col("m.tree").eqNullSafe(F.col("c.tree")) & (F.col("m.leaf") == F.col("c.leaf"))
    kept = paths.alias("m").join(chosen.alias("c"), same).select("m.*", "branch_rank", "branch_score")
    return _of_message(kept, messages, "role", "text").drop("message")


def escape(text: Column) -> Column:
    """Put a backslash into every ``<|``, one more where there are some: ``<|`` never remains."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """Roles end at a line break, so their own line breaks are written as ``\\n``."""
    slashes = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(slashes, F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # A line break is restored where an odd number of backslashes precedes the n.
    broken = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(broken, F.lit("\\\\"), F.lit("\\"))


def format_paths(chosen: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per branch: ``tree, leaf, branch_rank, formatted, loss_spans``.

    ``loss_spans`` holds the start and end in code points of every text of the role ``learn``
    in ``formatted``, in order; training learns those and masks the rest.
    """
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct("depth", head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn"))
    rows = chosen.groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lengths = F.transform("turns", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE))
    rows = rows.withColumn("ends", running_sum(lengths))

    def span(item: Column, i: Column) -> Column:
        end = F.get("ends", i) - len(CLOSE)
        return F.when(item["learn"], F.struct((end - F.length(item["body"])).alias("start"), end.alias("end")))

    parts = F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))
    return rows.select(
        "tree",
        "leaf",
        "branch_rank",
        F.array_join(parts, "").alias("formatted"),
        F.filter(F.transform("turns", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: str = "formatted") -> Column:
    """The turns of a transcript, as an array of structs of role and text."""
    pieces = F.split(F.col(formatted), r"\Q" + OPEN + r"\E", -1)
    turns = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def fields(piece: Column) -> Column:
        role_end = F.instr(piece, "\n")
        text = F.substr(piece, role_end + 1, F.length(piece) - role_end - len(CLOSE))
        role = F.substr(piece, F.lit(1), role_end - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, fields)


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    texts = F.transform(
        F.col(spans), lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["end"] - s["start"]))
    )
    return F.array_join(texts, "")


def conversations(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Every tree's best branches as transcripts with loss spans."""
    stored = cut_lineage(messages)
    return format_paths(ranked(branches(stored), stored, keep))
