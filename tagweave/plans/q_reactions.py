"""Registered queries: reaction and comment jobs (S4-S6, G1-G3, G7, W2-W4,
J8-J10, F5, F6, F13, T17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators import reactions as R
from tagweave.operators.ranking import ordered_rank
from tagweave.plans.registry import register

PAGE = "page1"

# The rules, from counts to comments: likes don't count, a post's reactions are
# ranked by how often they came, and its long comments go with the top ones.
_AGG_SQL = f"""tally AS (
  SELECT post_id, type, count(*) AS c FROM (FROM v_reactions WHERE page = '{PAGE}') WHERE type <> 'LIKE' GROUP BY ALL),
ranked AS (
  SELECT t.*, CAST(1 + count(DISTINCT b.c) AS INTEGER) AS r
  FROM tally t LEFT JOIN tally b ON b.post_id = t.post_id AND b.c > t.c GROUP BY ALL)"""

_LONG_SQL = f"""{_AGG_SQL},
spoken AS (SELECT post_id, json_extract_string(comment, '$.message') AS message FROM v_comments),
top AS (
  SELECT post_id, type, r, c, message FROM spoken
  JOIN (SELECT * FROM ranked WHERE r < 3 AND c > 1) USING (post_id)
  WHERE length(message) >= 141)"""


def _top(t):
    return R.top_reaction_comments(t.views.reactions(), t.views.comments(), PAGE)


@register("g1_w2_ranked_reactions", f"WITH {_AGG_SQL} SELECT post_id, type, r, c FROM ranked", ("v_reactions",))
def g1_w2_ranked_reactions(t):
    """G1 + W2 + F5: reaction counts per (post, type), dense rank per post."""
    return R.ranked_reactions(t.views.reactions(), PAGE)


@register("s4_top_reaction_comments", f"WITH {_LONG_SQL} SELECT * FROM top", ("v_reactions", "v_comments"))
def s4_top_reaction_comments(t):
    """S4 / S5 (J8, F6, T16) long form: one row per comment of each top
    (post, type) group; rank <= 2, count >= 2, message > 140 chars."""
    return _top(t)


@register("g2_top_reaction_groups", f"""WITH {_LONG_SQL}
SELECT post_id, type, r, c, count(*) AS n_comments, CAST(sum(char_length(message)) AS BIGINT) AS n_chars
FROM top GROUP BY post_id, type, r, c""", ("v_reactions", "v_comments"))
def g2_top_reaction_groups(t):
    """G2 with constant-size state: comments and characters per group."""
    return R.top_reaction_groups(_top(t))


@register("l3_ordered_reactions", f"""WITH {_LONG_SQL},
g AS (SELECT post_id, r, type, c, count(*) AS n_comments FROM top GROUP BY ALL)
SELECT row_number() OVER (ORDER BY post_id, r, type) AS pos, * FROM g""", ("v_reactions", "v_comments"))
def l3_ordered_reactions(t):
    """L3: the top reaction groups listed by post, then rank (then type), with
    their position in the listing (a distributed global sort)."""
    g = R.top_reaction_groups(_top(t)).select("post_id", "r", "type", "c", "n_comments")
    return ordered_rank(g, [], ["post_id", "r", "type"], "pos").select("pos", "post_id", "r", "type", "c", "n_comments")


@register("s4_top_reaction_text", f"""WITH {_LONG_SQL}
SELECT post_id, type, r, c, md5(string_agg(message, chr(10) ORDER BY message)) AS text_md5
FROM top GROUP BY post_id, type, r, c""", ("v_reactions", "v_comments"))
def s4_top_reaction_text(t):
    """S4 in the reference's shape: messages of a group joined by newline
    (``listagg`` sorted; groups here are small), shown as md5."""
    g = R.collect_top_reaction_texts(_top(t), "string")
    return g.select("post_id", "type", "r", "c", F.md5("text").alias("text_md5"))


@register("s5_top_reaction_arrays", f"""WITH {_LONG_SQL}
SELECT post_id, type, r, c, len(list(message)) AS n, md5(array_to_string(list_sort(list(message)), '|')) AS texts_md5
FROM top GROUP BY post_id, type, r, c""", ("v_reactions", "v_comments"))
def s5_top_reaction_arrays(t):
    """S5 in the reference's shape: sorted array of the group's messages."""
    g = R.collect_top_reaction_texts(_top(t), "array")
    return g.select("post_id", "type", "r", "c", F.size("texts").cast("bigint").alias("n"),
                    F.md5(F.array_join("texts", "|")).alias("texts_md5"))


_CODES_SQL = "CASE type WHEN 'LOVE' THEN 0 WHEN 'ANGRY' THEN 1 WHEN 'HAHA' THEN 2 WHEN 'WOW' THEN 3 ELSE 4 END"


@register("g7_post_labels", f"""WITH {_LONG_SQL},
tt AS (SELECT DISTINCT post_id, type, r FROM top)
SELECT post_id, array_to_string(list({_CODES_SQL} ORDER BY r, {_CODES_SQL}), ',') AS labels
FROM tt GROUP BY post_id""", ("v_reactions", "v_comments"))
def g7_post_labels(t):
    """Per post, the reaction codes of its top groups in rank order."""
    top = _top(t).select("post_id", "type", "r").distinct()
    lab = R.post_labels(top)
    return lab.select("post_id", F.array_join("labels", ",").alias("labels"))


@register("g7_t17_labelled_lines", f"""WITH {_LONG_SQL},
tt AS (SELECT DISTINCT post_id, type, r FROM top),
labels AS (SELECT post_id, array_to_string(list({_CODES_SQL} ORDER BY r, {_CODES_SQL}), ',') AS labels
           FROM tt GROUP BY post_id),
msgs AS (SELECT DISTINCT post_id, message FROM top),
lines AS (SELECT post_id, regexp_replace(unnest(string_split(message, chr(10))),
                 '^[{T.PY_SPACE}]+|[{T.PY_SPACE}]+$', '', 'g') AS line FROM msgs)
SELECT l.post_id, b.labels, md5(l.line) AS line_md5, count(*) AS n
FROM lines l JOIN labels b ON l.post_id = b.post_id GROUP BY ALL""", ("v_reactions", "v_comments"))
def g7_t17_labelled_lines(t):
    """G7 + T17: every stripped line of the top comments with the post's
    labels (the multi-label training rows of the reaction job)."""
    x = R.labelled_lines(_top(t))
    return (x.select("post_id", F.array_join("labels", ",").alias("labels"), F.md5("line").alias("line_md5"))
            .groupBy("post_id", "labels", "line_md5").agg(F.count(F.lit(1)).alias("n")))


@register("f13_posts_many_long_comments", """SELECT post_id, count(*) AS n_comments FROM v_comments
WHERE char_length(comment->>'message') >= 140 GROUP BY post_id HAVING count(*) > 4""", ("v_comments",))
def f13_posts_many_long_comments(t):
    """posts with more than 4 comments of >= 140 characters."""
    return R.posts_with_many_long_comments(t.views.comments())


@register("w4_running_index", """SELECT post_id, CAST(row_number() OVER (PARTITION BY post_id ORDER BY doc_id) - 1 AS INTEGER) AS c,
  doc_id FROM (SELECT doc_id % 150 AS post_id, doc_id FROM documents WHERE lang = 'en')""")
def w4_running_index(t):
    """W4 (+F7 on the given language): running comment index per post, English only."""
    d = t.documents.where(F.col("lang") == "en").select(F.pmod("doc_id", F.lit(150)).alias("post_id"), "doc_id")
    return R.running_index(d, "post_id", ["doc_id"]).select("post_id", "c", "doc_id")


_WANTED = ["de", "src3", "src5"]


_ARTICLES_SQL = """wanted AS (SELECT DISTINCT article FROM v_categories WHERE list_contains(['de', 'src3', 'src5'], category)),
cats AS (SELECT article, string_agg(category, ',' ORDER BY category) AS categories FROM v_categories GROUP BY article),
a AS (SELECT article, categories, any_value(abstract) AS abstract
      FROM wanted JOIN cats USING (article) JOIN v_abstracts USING (article) GROUP BY ALL)"""


@register("s6_articles_in_categories", f"WITH {_ARTICLES_SQL} SELECT article, categories, abstract FROM a",
          ("v_abstracts", "v_categories"))
def s6_articles_in_categories(t):
    """S6 (J9, J10, G3, W3): article, its categories and abstract, for
    articles in a category set."""
    a = R.articles_in_categories(t.views.abstracts(), t.views.categories(), _WANTED)
    return a.select("article", F.array_join("categories", ",").alias("categories"), "abstract")


@register("s6_t17_article_lines", f"""WITH {_ARTICLES_SQL},
n AS (SELECT article, categories, unnest(string_split(abstract, chr(10))) AS line,
             generate_subscripts(string_split(abstract, chr(10)), 1) - 1 AS line_no FROM a)
SELECT article, categories, CAST(line_no AS INTEGER) AS line_no,
  regexp_replace(line, '^[{T.PY_SPACE}]+|[{T.PY_SPACE}]+$', '', 'g') AS line FROM n""", ("v_abstracts", "v_categories"))
def s6_t17_article_lines(t):
    """S6 + T17: one training row per stripped abstract line."""
    a = R.articles_in_categories(t.views.abstracts(), t.views.categories(), _WANTED)
    return a.select("article", F.array_join("categories", ",").alias("categories"),
                    F.posexplode(T.lines(F.col("abstract"))).alias("line_no", "line"))
