"""Stand-in views: the relational inputs the reference's SQL reads
(data, tagging, tag_tagset, source, language, text, time, fingerprint,
translation, reactions, comments, abstracts, categories, retina positions),
derived from the test tables by plain projections and joins.

Each view only gives rows in the schema the jobs expect; it does none of the
jobs' work. The DuckDB spelling of every view lives in
``tagweave.plans.oracle_views`` and must stay equivalent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.fingerprint import fingerprint


class Views:
    def __init__(self, tables):
        self.t = tables

    # --- tagging data model ---------------------------------------------------
    def data(self) -> DataFrame:
        d = self.t.documents
        return d.select(F.col("doc_id").alias("id"),
                        F.substring("source", 4, 100).cast("int").alias("source_id"))

    def source(self) -> DataFrame:
        d = self.t.documents
        return d.select(F.substring("source", 4, 100).cast("int").alias("id")).distinct()

    def text(self) -> DataFrame:
        d = self.t.documents
        return d.select((F.col("doc_id") + 1000000).alias("id"), F.col("doc_id").alias("data_id"), "text")

    def language(self) -> DataFrame:
        d = self.t.documents
        return d.select(F.col("doc_id").alias("data_id"), F.col("lang").alias("language"))

    def time(self) -> DataFrame:
        d = self.t.documents.select("doc_id")
        e = self.t.events.select("event_id", "ts")
        return d.join(e, e.event_id == d.doc_id).select(F.col("doc_id").alias("data_id"),
                                                        F.col("ts").alias("time"))

    def tagging(self) -> DataFrame:
        lab = self.t.labels
        q = lab.select(F.col("doc_id").alias("data_id"), (F.lit(10) + F.col("quality")).alias("tag_id"))
        x = lab.select(F.col("doc_id").alias("data_id"), (F.lit(20) + F.col("toxic")).alias("tag_id"))
        return q.unionByName(x)

    def tag_tagset(self) -> DataFrame:
        return self.t.spark.createDataFrame([(10, 1), (11, 1), (20, 2), (21, 2)],
                                            "tag_id int, tagset_id int")

    def translation(self) -> DataFrame:
        d = self.t.documents.where((F.col("lang") == "de") & (F.pmod("doc_id", F.lit(2)) == 0))
        b = self.t.benchmark
        n_items = b.select(F.count(F.lit(1))).scalar()
        return d.join(b, b.item_id == F.pmod(d.doc_id, n_items)).select(
            (d.doc_id + 1000000).alias("text_id"), F.lit("en").alias("target_language"),
            b.text.alias("translation"))

    def fingerprint(self) -> DataFrame:
        d = self.t.documents
        return d.select(F.col("doc_id").alias("data_id"), fingerprint(F.col("text")).alias("fingerprint"))

    # --- reactions / comments ------------------------------------------------
    def reactions(self) -> DataFrame:
        e = self.t.events
        typ = (F.when(F.col("event_type") == "view", "LIKE").when(F.col("event_type") == "click", "LOVE")
               .when(F.col("event_type") == "error", "ANGRY").when(F.col("event_type") == "signup", "HAHA")
               .otherwise("WOW"))
        return e.select(F.col("user_id").alias("post_id"), typ.alias("type"),
                        F.concat(F.lit("page"), F.pmod("user_id", F.lit(2)).cast("string")).alias("page"))

    def comments(self) -> DataFrame:
        d = self.t.documents
        pid = F.pmod("doc_id", F.lit(150))
        return d.select(pid.alias("post_id"),
                        F.concat(F.lit("page"), F.pmod(pid, F.lit(2)).cast("string")).alias("page"),
                        F.to_json(F.struct(F.col("text").alias("message"))).alias("comment"))

    def comments_with_language(self) -> DataFrame:
        """The comments with the language their platform gave them."""
        d = self.t.documents
        return d.select(F.pmod("doc_id", F.lit(150)).alias("post_id"), F.col("lang").alias("language"),
                        F.to_json(F.struct(F.col("text").alias("message"))).alias("comment"))

    # --- articles ---------------------------------------------------------------
    def abstracts(self) -> DataFrame:
        d = self.t.documents
        return d.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("article"),
                        F.col("text").alias("abstract"))

    def categories(self) -> DataFrame:
        d = self.t.documents
        art = F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("article")
        return d.select(art, F.col("lang").alias("category")).unionByName(
            d.select(art, F.col("source").alias("category")))

    # --- fingerprints of pages (retina) ----------------------------------------
    def retina_pos(self) -> DataFrame:
        e = self.t.embeddings
        ex = e.select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
        pos = (F.col("p") * 256 + F.floor((F.col("e").cast("double") + F.lit(1.0)) * 128).cast("int"))
        return ex.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("slug"),
                         pos.cast("int").alias("pos"))

    def retina(self) -> DataFrame:
        """Retina entries (slug, retina ARRAY<INT>): positions of a vector sorted."""
        e = self.t.embeddings
        idx = F.sequence(F.lit(0), F.size("embedding") - 1)
        pos = F.transform(idx, lambda p: (p * 256 + F.floor(
            (F.element_at("embedding", p + 1).cast("double") + F.lit(1.0)) * 128).cast("int")).cast("int"))
        return e.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("slug"),
                        F.array_sort(pos).alias("retina"))

    # --- legacy tagger inputs ----------------------------------------------------
    def legacy_comments(self) -> DataFrame:
        """Legacy comments: (id, data JSON {message}, meta JSON {fingerprint, lang, page});
        every 5th document has no fingerprint."""
        d = self.t.documents
        fp = F.when(F.pmod("doc_id", F.lit(5)) != 0, F.array(F.pmod("doc_id", F.lit(16384)).cast("int")))
        meta = F.to_json(F.struct(fp.alias("fingerprint"), F.col("lang").alias("lang"),
                                  F.concat(F.lit("page"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("page")))
        return d.select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.col("text").alias("message"))).alias("data"),
                        meta.alias("meta"))

    def user_tag_comment(self) -> DataFrame:
        """(user_id, tag, comment_id): user 1 tags quality as good/bad, user 2 tags toxic."""
        lab = self.t.labels
        a = lab.select(F.lit(1).alias("user_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tag"),
                       F.col("doc_id").alias("comment_id"))
        b = lab.where(F.col("toxic") == 1).select(F.lit(2).alias("user_id"), F.lit("toxic").alias("tag"),
                                                  F.col("doc_id").alias("comment_id"))
        return a.unionByName(b)

    def tagset_tags(self) -> DataFrame:
        """(tagset_id, tag): a tagset for each order status, its tags the priorities that its orders have."""
        o = self.t.orders
        return o.select(F.col("o_orderstatus").alias("tagset_id"), F.col("o_orderpriority").alias("tag"))

    def user_tagset(self) -> DataFrame:
        """(user_id, tagset_id): the tagsets of the orders a customer has."""
        o = self.t.orders
        return o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("tagset_id")).distinct()

    def grants(self) -> DataFrame:
        """Sources a user may read: the sources of the documents behind the user's events."""
        e = self.t.events.select("event_id", "user_id")
        d = self.t.documents.select("doc_id", F.substring("source", 4, 100).cast("int").alias("source_id"))
        return e.join(d, e.event_id == d.doc_id).select("user_id", "source_id").distinct()

    def models(self) -> DataFrame:
        """Model registry rows (one per signup event)."""
        e = self.t.events.where(F.col("event_type") == "signup")
        return e.select(F.col("event_id").alias("model_id"), (F.lit(1) + F.pmod("user_id", F.lit(2))).cast("int")
                        .alias("tagset_id"), "user_id", (F.col("value") / 100.0).alias("score"),
                        F.col("ts").alias("trained_ts"))

    def legacy_models(self) -> DataFrame:
        """The registry with the stored parameters of each model as JSON."""
        from tagweave.operators import sampling as S
        key = F.col("model_id").cast("string")
        drawn = {"tokens_k": S.uniform_int(3, key, "tokens_k", 1, 64), "emoji_k": S.uniform_int(3, key, "emoji_k", 1, 64),
                 "punct_k": S.uniform_int(3, key, "punct_k", 1, 64), "fp_k": S.uniform_int(3, key, "fp_k", 1, 5),
                 "resolution": S.uniform_int(3, key, "resolution", 1, 6), "gamma": F.round(S.expon(3, key, "gamma", 20.0), 6)}
        return self.models().withColumn("params", F.to_json(F.struct(*[c.alias(n) for n, c in drawn.items()])))

    # --- labelled corpus --------------------------------------------------------
    def corpus(self) -> DataFrame:
        """Labelled corpus (doc_id, text, category, subset): category = lang,
        subset = train/test by a hash draw (75 / 25)."""
        from tagweave.functions.hashing import hash01
        d = self.t.documents
        return d.select("doc_id", "text", F.col("lang").alias("category"),
                        F.when(hash01(7, 0, F.col("doc_id")) < 0.75, "train").otherwise("test").alias("subset"))
