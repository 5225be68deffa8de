"""Reaction / comment jobs.

Scale notes
-----------
* Reaction counts per (post, type) are a partial + final aggregation; the
  ``dense_rank`` over a post then runs on at most one row per reaction type,
  so a post with a third of all reactions is still a tiny window group.
* Comments join the ranked reactions on ``post_id``. A hot post is a skewed
  join key on the comment side only (the ranked side has <= 5 rows per post),
  which AQE's skew-join handling splits.
* The reference concatenates all comments of a (post, type) into one string
  (``string_agg``) or one array (``array_agg``). A post may hold a third of
  all comments, so that group cannot be collected into one value. The default
  output is therefore the long form (one row per comment of a group) plus
  constant-size per-group aggregates; the concatenated forms are offered for
  callers whose groups are known to be small (``collect_top_reaction_texts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators.ranking import ordered_rank

# Reaction codes.
REACTION_CODES = [("LOVE", 0), ("ANGRY", 1), ("HAHA", 2), ("WOW", 3), ("SAD", 4)]


def ranked_reactions(reactions: DataFrame, page: str | None) -> DataFrame:
    """G1 + W2 + F5: count by (post, type) for non-LIKE reactions of a page,
    dense rank per post by count desc. Output (post_id, type, r, c)."""
    r = reactions.where(F.col("type") != "LIKE")
    if page is not None:
        r = r.where(F.col("page") == page)
    agg = r.groupBy("post_id", "type").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("post_id").orderBy(F.col("c").desc())
    return agg.withColumn("r", F.dense_rank().over(w)).select("post_id", "type", "r", "c")


def top_reactions(reactions: DataFrame, page: str | None, max_rank: int = 2, min_count: int = 2) -> DataFrame:
    """The ranked reactions (post_id, type, r, c) with r <= 2 and c >= 2."""
    return ranked_reactions(reactions, page).where((F.col("r") <= max_rank) & (F.col("c") >= min_count))


def long_messages(comments: DataFrame, min_chars: int = 140) -> DataFrame:
    """(post_id, message) of the comments longer than 140 characters."""
    return comments.select("post_id", T.json_text(F.col("comment"), "message").alias("message")) \
        .where(F.char_length("message") > min_chars)


def top_reaction_comments(reactions: DataFrame, comments: DataFrame, page: str | None,
                          max_rank: int = 2, min_count: int = 2, min_chars: int = 140) -> DataFrame:
    """J8 + F6: long form of the top-reaction comment fetch (S4 / S5): one row
    per (post, type, r, c, message) with r <= 2, c >= 2 and a message longer
    than 140 characters (a null message drops out)."""
    top = top_reactions(reactions, page, max_rank, min_count)
    return top.join(long_messages(comments, min_chars), "post_id").select("post_id", "type", "r", "c", "message")


def top_reaction_groups(long: DataFrame) -> DataFrame:
    """G2 with constant-size state: per (post, type, r, c) the number of
    comments and their total length."""
    return long.groupBy("post_id", "type", "r", "c").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(F.char_length("message")).cast("bigint").alias("n_chars"))


def collect_top_reaction_texts(long: DataFrame, form: str = "string") -> DataFrame:
    """S4 / S5 in the reference's shape: ``string`` joins the messages with a
    newline (``listagg``), ``array`` gives a sorted array. One value per
    group, so use only where groups are known to be small."""
    g = long.groupBy("post_id", "type", "r", "c")
    if form == "string":
        return g.agg(F.expr("listagg(message, '\\n') WITHIN GROUP (ORDER BY message)").alias("text"))
    return g.agg(F.array_sort(F.collect_list("message")).alias("texts"))


def post_labels(top: DataFrame) -> DataFrame:
    """Per post, the list of reaction codes (in rank order). At most one
    row per reaction type per post, so the list is bounded."""
    codes = F.create_map(*[x for k, v in REACTION_CODES for x in (F.lit(k), F.lit(v))])
    t = top.select("post_id", "r", "type", F.element_at(codes, F.col("type")).alias("code"))
    return t.groupBy("post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "code"))), lambda x: x["code"]).alias("labels"))


def labelled_lines(long: DataFrame) -> DataFrame:
    """G7 + T17: (post_id, labels, line) — every stripped line of every top
    comment of a post, with the post's reaction codes. Comments are the same
    for every type of a post (the join is on post only), so they are taken
    once per post."""
    top = long.select("post_id", "type", "r").distinct()
    labels = post_labels(top)
    msgs = long.select("post_id", "message").distinct()
    lines = msgs.select("post_id", F.explode(T.lines(F.col("message"))).alias("line"))
    return lines.join(labels, "post_id")


def posts_with_many_long_comments(comments: DataFrame, min_chars: int = 140, min_comments: int = 4) -> DataFrame:
    """posts with more than ``min_comments`` comments of at least
    ``min_chars`` characters (count per post, then a having-filter)."""
    msg = comments.select("post_id", T.json_text(F.col("comment"), "message").alias("message")) \
        .where(F.char_length("message") >= min_chars)
    return msg.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_comments")) \
        .where(F.col("n_comments") > min_comments)


def running_index(df: DataFrame, group_col: str, order_cols: Sequence[str]) -> DataFrame:
    """0-based running index within a group (``c += 1``). A post may hold
    a third of all comments, so the rank is computed without a per-post
    window (``ordered_rank``)."""
    r = ordered_rank(df, [group_col], list(order_cols), "__rn", broadcast_runs=False)
    return r.withColumn("c", (F.col("__rn") - 1).cast("int")).drop("__rn")


def articles_in_categories(abstracts: DataFrame, categories: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """S6 (J9, J10, G3, W3): articles having a category in ``wanted``, with
    all their categories (sorted list; an article has few) and their abstract
    (``min`` — the reference's first_value over an unordered window)."""
    chosen = categories.where(F.col("category").isin(list(wanted))).select("article").distinct()
    ab = abstracts.join(chosen, "article", "left_semi")
    cats = categories.join(chosen, "article", "left_semi").groupBy("article") \
        .agg(F.array_sort(F.collect_list("category")).alias("categories"))
    first_abs = ab.groupBy("article").agg(F.min("abstract").alias("abstract"))
    return cats.join(first_abs, "article")
