"""Exact duplicates, source divergence and periodic runs: against brute force, SQL and the library's own vectors."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.llm import divergence, exact, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_runs string, vector string, run string, kept string"
WIDE = ("x",) * 4
LONG = "Long text of many words, " * 20_000
ODD = [
    (1, None, "en", "a", *WIDE),
    (2, "", "en", None, *WIDE),
    (3, " \n\t", None, "b", *WIDE),
    (4, "One two", "en", "a", *WIDE),
    (4, "one TWO", "en", "a", *WIDE),
    (5, "one two", "en", "b", *WIDE),
    (None, "one two", "en", "b", *WIDE),
    (None, "no id at all", "fr", None, *WIDE),
    (None, "No id at all", None, None, *WIDE),
    (6, "ÄÖÜ İ K ﬁ é one two", "de", "c", *WIDE),
    (7, "äöü İ K ﬁ é one two", "de", "c", *WIDE),
    (8, LONG, "en", "a", *WIDE),
    (9, LONG.upper(), "en", "c", *WIDE),
    (10, "a a a a a a b" * 3, "en", "c", *WIDE),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(5)


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- exact duplicates ----------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_classes_on_odd_rows(odd, keep, fan_in):
    got = exact.exact_classes(odd, keep, fan_in).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[hashlib.sha256(small(text).encode()).hexdigest()].append(doc_id)
    assert len(got) == len(ODD)
    for digest, ids in groups.items():
        rows = [r for r in got if r["text_sha256"] == digest]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]  # one row, be the id repeated or null


def test_rows_that_stay_keep_their_columns(odd):
    out = exact.deduplicated(odd.withColumn("_digest", F.lit(1)))
    assert out.columns == [*odd.columns, "_digest"]
    texts = [small(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({small(t) for _, t, *_ in ODD})


def test_rounds_merge_many_runs_of_a_hot_text(spark):
    docs = spark.range(4000, numPartitions=40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("text"))
    rows = exact.entries(docs)
    assert rows.agg(F.max("run")).first()[0] == 39
    merged = {bytes(r["digest"]): (r["doc_id"], r["n"]) for r in exact.merged_runs(rows, fan_in=2).collect()}
    want = collections.defaultdict(list)
    for i in range(4000):
        want[hashlib.sha256((b"hot" if i % 3 == 0 else b"t%d" % (i % 900))).digest()].append(i)
    assert merged == {k: (max(v), len(v)) for k, v in want.items()}


def test_entries_merge_only_if_verified(spark):
    rows = spark.createDataFrame([(0, 0, 5, b"d", 3, 1), (1, 0, 6, b"d", 3, 2), (2, 1, 7, b"d", 4, 1), (3, 1, 8, b"d", 3, 1)], "row long, run int, doc_id long, digest binary, n_bytes int, check long")
    assert sorted((r["doc_id"], r["n"]) for r in exact.merged_runs(rows).collect()) == [(6, 1), (7, 1), (8, 2)]


def test_exact_duplicates_of_an_empty_table_and_their_plan(spark, odd):
    assert exact.exact_classes(odd.limit(0)).count() == 0
    assert exact.deduplicated(odd.limit(0)).count() == 0
    plan = exact.exact_classes(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        exact.exact_classes(odd, "any")


# --- source divergence ---------------------------------------------------------------------------


def plain_divergence(rows, min_df, top=10):
    """(lang, source, part, item, value, rank) by plain loops over all terms."""
    df, hits = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(text))
        df[lang or ""].update(set(terms))
        hits[lang or "", source or ""].update(terms)
    out = []
    for lang in df:
        kept = {t for t, n in df[lang].items() if n >= min_df}
        groups = {s: c for (l, s), c in hits.items() if l == lang}
        whole = collections.Counter()
        for c in groups.values():
            whole.update({t: c[t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def made_rows(n=600):
    r = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["Été", "É", "ss1ss", "x-y", "ПРИВЕТ"]
    rows = []
    for _ in range(n):
        s = r.randrange(12)
        rows.append((" ".join(r.choice(words[s * 5 : s * 5 + 120] + words[-5:]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "fr", None]), f"s{s}" if s else None))
    return [*rows, ("rare words here", "xx", "only"), (None, "xx", "other"), ("", "en", "silent")]


@pytest.mark.parametrize("sizes", [(256, 64), (7, 3)])
def test_divergence_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", sizes[0])
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sizes[1])
    rows = made_rows()
    got = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 10)


def test_divergence_on_odd_rows(spark, odd):
    got = sorted(map(tuple, divergence.divergence(odd, 2).collect()))
    assert got == plain_divergence([(t, l, s) for _, t, l, s, *_ in ODD], 2)
    assert divergence.divergence(odd.limit(0)).count() == 0
    assert divergence.count_vectors(odd).columns == [*[c for c in odd.columns if c != "vector"], "vector"]


def test_sums_equal_those_of_the_library(spark):
    """Vectors, vocabulary and sums are those of Spark's CountVectorizer with minDF and the largest vocabSize, and its Summarizer (sums there are means times weights, so they are rounded)."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.stat import Summarizer

    rows = made_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    sums = divergence.group_sums(divergence.count_vectors(docs), ["lang", "source"])
    kept = sums.join(divergence.vocabulary(sums).select("lang", "term"), ["lang", "term"])
    ours = {(r["lang"], r["source"], r["term"]): r["hits"] for r in kept.collect()}
    theirs = {}
    for lang in ("en", "fr", ""):
        lists = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(t)), s or "") for t, l, s in rows if (l or "") == lang]
        frame = spark.createDataFrame(lists, "terms array<string>, source string")
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=10, vocabSize=2**31 - 1).fit(frame)
        for r in model.transform(frame).groupBy("source").agg(Summarizer.sum(F.col("v")).alias("s")).collect():
            theirs |= {(lang, r["source"], t): round(n) for t, n in zip(model.vocabulary, r["s"].toArray(), strict=True) if n}
    assert ours == theirs


def test_shares_are_exact(spark):
    r = random.Random(2)
    rows = [(n := r.randrange(10**r.randint(1, 17)), n + r.randrange(10**17), r.randrange(1, 10**9)) for _ in range(300)] + [(0, 0, 0), (5, 5, 1)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p")).collect()
    assert all(p == (1 + 10**9 * (n + 2) // (total + 2 * v) if v else 1) for n, total, v, p in got)


# --- periodic runs -------------------------------------------------------------------------------


def plain_runs(words):
    """Every maximal stretch on every diagonal, its smallest period tried by hand."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(r):
    k = r.choice([1, 2, 3, 5])
    words = [r.randrange(k) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 4)):
        unit = [r.randrange(k) for _ in range(r.randint(1, 15))]
        words += (unit * r.randint(2, 8))[: r.randint(0, 90)] + [r.randrange(k + 2) for _ in range(r.randint(0, 6))]
        words = (words * r.choice([1, 1, 1, 2, 4]))[:260]
    return words


def test_runs_equal_brute_force():
    r, found = random.Random(3), 0
    for _ in range(800):
        words = made_words(r)
        want = plain_runs(words)
        got = periodic.runs_of(np.fromiter(map({}.setdefault, words, count()), np.int64, len(words)))
        assert [tuple(x) for x in got.tolist()] == want
        found += len(want)
    assert found > 1000


@pytest.mark.parametrize("length", range(20, 90, 7))
def test_runs_of_each_period_are_found_at_their_least_length(length):
    for q in range(1, length):
        unit = [f"u{i}" for i in range(q)]
        for n, hit in ((max(6, 4 * q), 1), (max(6, 4 * q) - 1, 0)):
            words = ["before", *(unit * 7)[:n], "after"]
            ids = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
            assert periodic.runs_of(ids).tolist() == [[1, n, q]] * hit


def plain_digest(doc_id, text):
    """A row of the query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_query_equals_brute_force(spark):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{x}" for x in made_words(r))) for i in range(400)]
    docs += [(i, " ".join(str(x) for x in range(r.randint(0, 100)))) for i in range(400, 700)]
    docs += [(None, "a " * 9), (-5, None), (700, ""), (701, " \t\n\x0b\x0c\r"), (702, "a\x85a\xa0a a\x1ca " + "é é é é é é é")]
    got = periodic.run_digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((plain_digest(*d) for d in docs), key=key)
    assert sum(1 for x in got if x["n_runs"]) > 100


def test_runs_query_on_the_given_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(got[d[0]] == plain_digest(*d) for d in docs)


def test_runs_keep_columns_and_odd_rows(spark, odd):
    out = periodic.with_runs(odd)
    assert out.columns == [*[c for c in odd.columns if c != "n_runs"], "n_runs", "runs", "strongest", "collapsed"]
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert rows[1, None]["collapsed"] == "" and rows[1, None]["strongest"] is None and rows[1, None]["runs"] == []
    long = rows[8, LONG]
    assert [tuple(x) for x in long["runs"]] == [(0, 100_000, 5)] and long["collapsed"] == "Long text of many words,"
    assert periodic.with_runs(odd.limit(0)).count() == 0 and periodic.run_digests(odd.limit(0)).count() == 0


def test_stages_broadcast_no_table_that_grows_with_the_documents(spark):
    import corpus_pipeline
    from larkaudit.llm import line_dedup, mixing

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", f"s{i % 12}", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    laid = mixing.lay_out(docs)
    for df in (corpus_pipeline.near_duplicates(spark, docs, ""), line_dedup.clean_lines(docs), mixing.before_by_ranges(laid.select("src", "at", "size"), ["src"], "at", "size", "sum")):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
