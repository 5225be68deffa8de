"""Row functions against the reference's stated examples and Python semantics."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from tagweave.functions import fingerprint as FP
from tagweave.functions import text as T
from tagweave.functions import timeofday as TOD


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


def test_time_of_day_goldens(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 17, 0),), (datetime(2024, 1, 1, 0, 30),),
                                (datetime(2024, 1, 1, 1, 30),), (datetime(2024, 1, 1, 23, 45),)], "ts timestamp_ntz")
    r = df.select(TOD.time_of_day(F.col("ts"), 3).alias("r3"), TOD.time_of_day(F.col("ts"), 1).alias("r1")).collect()
    assert r[0]["r3"] == 51                      # res 3, 17:00 -> 51
    assert [x["r1"] for x in r[1:]] == [0, 2, 0]  # half-even: 00:30 -> 0, 01:30 -> 2, 23:45 -> 0


def test_time_of_day_matches_python_round(spark):
    rows = [(datetime(2024, 1, 1, h, m, s),) for h in range(24) for m in (0, 10, 20, 30, 45) for s in (0, 30)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    for res in (1, 3, 5):
        got = [r[0] for r in df.select(TOD.time_of_day(F.col("ts"), res)).collect()]
        want = [int(round(((t.hour * 3600 + t.minute * 60 + t.second) / 60) / (60 / res))) % (24 * res)
                for (t,) in rows]
        assert got == want


def test_onehot_width_and_position(spark):
    r = one(spark, lambda c: TOD.time_of_day_onehot(c, 2), datetime(2024, 1, 1, 17, 0), "timestamp_ntz")
    assert len(r) == 48 and r.index(1.0) == 34 and sum(r) == 1.0


def test_emoji_runs(spark):
    assert one(spark, T.emoji, "a😀😀b🚀") == ["😀😀", "🚀"]


def test_punctuation(spark):
    assert one(spark, lambda c: T.punctuation(c, True), "Hi! (ok).") == ["!", "."]
    assert one(spark, lambda c: T.punctuation(c, False), "Hi! (ok).") == ["!", "(", ")", "."]


def test_noisy_punctuation_matches_python(spark):
    text = "Ça va? Oui — très_bien… (3½) «quote» ¿qué? x y z #tag @me 1.5%"
    want = re.findall(r"[^\w\d\s]", text)
    assert one(spark, lambda c: T.punctuation(c, False), text) == want


def test_capitalization(spark):
    assert one(spark, T.capitalization, "") == 0.0
    assert one(spark, T.capitalization, "ÄB c") == 0.5
    assert one(spark, lambda c: T.capitalization(c, fraction=False), "ABc") == 2.0


def test_urls(spark):
    assert one(spark, T.urls, "see http://a.bc/x") == ["http://a.bc/x"]
    assert one(spark, lambda c: T.urls(c, short_url=True), "see http://a.bc/x") == ["a.bc"]
    assert one(spark, T.urls, "a.bc/x") == ["://a.bc/x"]


def test_output_shapes(spark):
    df = spark.createDataFrame([(["hello", "world"],)], "v array<string>")
    r = df.select(T.as_output(F.col("v"), "list").alias("l"), T.as_output(F.col("v"), "str").alias("s"),
                  T.as_output(F.col("v"), "dict").alias("d")).collect()[0]
    assert r["l"] == ["hello", "world"] and r["s"] == "hello world" and r["d"] == {"hello": 1, "world": 1}


def test_token_counts_match_counter(spark):
    from collections import Counter
    toks = "a b a c b a d".split()
    assert one(spark, T.token_counts, toks, "array<string>") == dict(Counter(toks))
    assert one(spark, T.token_counts, [], "array<string>") == {}


def test_whitespace_tokens_match_split(spark):
    text = "  a\tb c\x1cd  e\n"
    assert one(spark, T.whitespace_tokens, text) == text.split()


def test_ngrams_guard_and_order(spark):
    assert one(spark, lambda c: T.word_ngrams(c, 1, 3), ["a", "b", "c"], "array<string>") == \
        ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, lambda c: T.word_ngrams(c, 1, 3), ["a"], "array<string>") == ["a"]


def test_char_windows(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    got = one(spark, lambda c: T.char_windows(c, 25, 3), text)
    want = [(text[i:i + 25], text[i + 25]) for i in range(0, len(text) - 25, 3)]
    assert [(g["window"], g["next_char"]) for g in got] == want


def test_trim80_and_lines(spark):
    assert one(spark, T.trim80, "x" * 81) == "x" * 77 + "..."
    assert one(spark, T.trim80, "x" * 80) == "x" * 80
    assert one(spark, T.lines, " a \n\tb\n") == ["a", "b", ""]


def test_fingerprint_properties(spark):
    fp = one(spark, FP.fingerprint, "the quick brown fox jumps over the lazy dog " * 50)
    assert fp == sorted(set(fp)) and all(0 <= p < 16384 for p in fp) and 0 < len(fp) <= 328
    assert one(spark, FP.sparse_fingerprint, [1, 1, 5], "array<int>") == [1, 5]


def test_fingerprint_out_of_grid_raises(spark):
    import pytest
    with pytest.raises(Exception):
        one(spark, FP.sparse_fingerprint, [16384], "array<int>")


def test_multi_hot_roundtrip(spark):
    df = spark.createDataFrame([(["de", "fr"],)], "v array<string>")
    r = df.select(T.multi_hot(F.col("v"), ["de", "en", "es", "fr"]).alias("b")).collect()[0]["b"]
    assert r == [1, 0, 0, 1]
    back = spark.createDataFrame([(r,)], "b array<int>").select(
        T.multi_hot_inverse(F.col("b"), ["de", "en", "es", "fr"])).collect()[0][0]
    assert back == ["de", "fr"]


def test_transformers_keep_params_and_run(spark):
    from datetime import datetime as dt
    from pyspark.ml import Pipeline
    from tagweave.functions.transformers import (CapitalizationTransformer, LemmaTokenTransformer,
                                                 PunctuationTransformer, TimeOfDayTransformer)
    p = PunctuationTransformer(strict=False, outputType="list")
    assert p.copy().getOrDefault(p.strict) is False                     # Q2: strict survives a copy
    lt = LemmaTokenTransformer(passThrough=True, outputType="str")
    assert lt.copy().getOrDefault(lt.passThrough) is True               # Q3: pass_through survives a copy
    df = spark.createDataFrame([("Hi! (ok). Big dogs", dt(2024, 1, 1, 17, 0))], "text string, time timestamp_ntz")
    pipe = Pipeline(stages=[p, CapitalizationTransformer(), TimeOfDayTransformer(resolution=3), lt]).fit(df)
    r = pipe.transform(df).collect()[0]
    assert r["punctuation"] == ["!", "(", ")", "."] and r["timeofday"] == 51 and r["tokens"] == "Hi! (ok). Big dogs"


def test_sql_functions_equal_column_functions(spark, tables):
    from tagweave.functions.sql import register_sql_functions
    register_sql_functions(spark)
    tables.documents.createOrReplaceTempView("docs_sqlfn")
    tables.events.createOrReplaceTempView("events_sqlfn")
    got = spark.sql("""SELECT doc_id, tw_capitalization(text) c, tw_punctuation_strict(text) ps,
        tw_punctuation_noisy(text) pn, tw_url_hosts(text) h, tw_trim80(text) t80, tw_whitespace_tokens(text) w
        FROM docs_sqlfn""").orderBy("doc_id").collect()
    want = tables.documents.select("doc_id", T.capitalization(F.col("text")).alias("c"),
                                   T.punctuation(F.col("text"), True).alias("ps"),
                                   T.punctuation(F.col("text"), False).alias("pn"),
                                   T.urls(F.col("text"), True).alias("h"), T.trim80(F.col("text")).alias("t80"),
                                   T.whitespace_tokens(F.col("text")).alias("w")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    tod = spark.sql("SELECT event_id, tw_time_of_day(ts, 3) v FROM events_sqlfn").orderBy("event_id").collect()
    tod2 = tables.events.select("event_id", TOD.time_of_day(F.col("ts"), 3).alias("v")).orderBy("event_id").collect()
    assert [tuple(r) for r in tod] == [tuple(r) for r in tod2]
    assert spark.sql("SELECT tw_emoji('a😀😀b🚀') e").collect()[0]["e"] == ["😀😀", "🚀"]


def test_accents_of_all_code_points(spark):
    import unicodedata
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    texts = ["x" + "y".join(chars[i:i + 64]) for i in range(0, len(chars), 64)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").repartition(4)
    got = {r["i"]: r["r"] for r in rows.select("i", T.strip_accents(F.col("v")).alias("r")).collect()}
    assert [i for i, s in enumerate(texts) if got[i] != fold(s)] == []
    for s in ("", "plain", "\ud55c\uad6d\uc5b4 \u1e9b\u0323 \ufb01n \u0130 e\u0301 \u0915\u093e \u00bd \U0001d552", None):
        assert one(spark, T.strip_accents, s) == (s and fold(s))


def _murmur3(data, seed=0):
    """Byte by byte, as published."""
    rot = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    mix = lambda k: rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h, n = seed, len(data) // 4 * 4
    for i in range(0, n, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= mix(int.from_bytes(data[n:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_murmur3(spark, duck):
    import random

    from tagweave.functions.hashing import murmur3
    from tagweave.plans.oracle_views import murmur3_sql
    # Published values of the hash.
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    rng = random.Random(3)
    words = [*known, "a", "ab", "abc", "abcd", "\u00e9", "\u4e2d\u6587\U0001f600"] + [
        "".join(chr(rng.choice([97, 122, 233, 0x4E2D, 0x1F600])) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert all(_murmur3(w.encode()) == h for w, h in known.items())
    rows = spark.createDataFrame([(w,) for w in words], "v string").repartition(3)
    assert all(r["h"] == _murmur3(r["v"].encode()) for r in rows.select("v", murmur3(F.col("v")).alias("h")).collect())
    assert all(r["h"] == _murmur3(r["v"].encode(), 7) for r in rows.select("v", murmur3(F.col("v"), 7).alias("h")).collect())
    assert one(spark, murmur3, None) is None
    for w, h in duck.execute(f"SELECT w, {murmur3_sql('w')} FROM (SELECT unnest(?) AS w)", [words]).fetchall():
        assert h == _murmur3(w.encode())


def test_signed_hashing_collisions(spark):
    """Tokens of one bucket add or cancel by the sign of their hashes."""
    from tagweave.operators import vectors as V
    tokens = [f"w{i}" for i in range(60)]
    docs = [(1, tokens), (2, tokens[:7] * 3 + tokens[20:]), (3, []), (4, None)]
    want = set()
    for i, toks in docs:
        sums = {}
        for w in toks or []:
            h = _murmur3(w.encode())
            sums[abs(h) % 8] = sums.get(abs(h) % 8, 0) + (1 if h >= 0 else -1)
        want |= {(i, b, abs(s)) for b, s in sums.items() if s}
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    got = V.signed_hashed_counts(df, "id", "tokens", 8).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(n for i, _, n in want if i == 1) < len(tokens)
