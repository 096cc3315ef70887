"""Tokens, markup, licenses, lines, quality and mixing: against libraries, SQL or brute force, and odd rows."""

import collections
import hashlib
import html
import random
import re
import time

import numpy as np
import pytest
from conftest import canon, close, duck
from pyspark.sql import functions as F

from larkaudit.llm import bpe, codec, html_text, licenses, line_dedup, mixing, quality, queries, shingles, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, batch string, cls string, taken string"
DOCS_NAMES = [c.split()[0] for c in DOCS.split(", ")]
ODD = [
    (1, None, "en", "a", 0, "x", "x", "x", "x"),
    (2, "", "en", None, 0, "x", "x", "x", "x"),
    (3, "   \n\t", None, "b", 5, "x", "x", "x", "x"),
    (4, "one two", "en", "a", 7, "x", "x", "x", "x"),
    (4, "one two", "en", "a", 7, "x", "x", "x", "x"),
    (5, "word " * 60_000, "en", "b", 300_000, "x", "x", "x", "x"),
    (None, "no id at all here now", "en", None, None, "x", "x", "x", "x"),
    (6, "x" * 200_000, "en", "c", 200_000, "x", "x", "x", "x"),
    (7, "Licensed under the Apache License, Version 2.0.\r\nΟΔΥΣΣΕΥΣ <|endoftext|> it's 12 é́", "en", "c", 1, "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    letters = "abcdefghijklmnop é'<|>\n\t12!?ßñ🙂한Σ́\x1c\x85"
    made = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(400)]
    made += ["".join(r.choice("eothainrs") for _ in range(r.randint(1, 200))) for _ in range(200)]
    return [*made, "", "<|endoftext|>a<|startoftext|> <|endoftext|", "a" * 1000 + "b", "it's we'll I'D '''s", "İ ﬁ ½ ǅ", *[t for _, t, *_ in ODD if t]]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_ids_and_texts_equal_the_library(texts, library):
    v = bpe.vocabulary(bpe.default_path())
    encoder, decoder = bpe.Encoder(v), bpe.Decoder(bpe.default_path())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert decoder.decode(got).decode() == library.decode(want, skip_special_tokens=False)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(bpe.vocabulary(bpe.default_path()))


def test_counts_do_not_depend_on_chunks(texts, library, machine):
    for t in texts:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert {token_counts.count_text(t, machine, k) for k in ((1, 3, 7, 1000) if len(t) < 2000 else (997, token_counts.CHUNK))} == {n}


def test_state_maps_compose_associatively(texts, machine):
    words = " ".join(machine.vocabulary.pre_tokens(" ".join(t for t in texts if len(t) < 300))).encode()
    maps = lambda: token_counts.chunk_maps(words, machine, 5)
    r = random.Random(2)
    for _ in range(50):
        i = r.randrange(len(words) // 5 - 3)
        a, b, c = maps()[i : i + 3]
        for entry in (machine.start, *a.arcs):
            left, right = token_counts.compose(token_counts.compose(a, b), c), token_counts.compose(a, token_counts.compose(b, c))
            assert left.through(entry) == right.through(entry) == token_counts.read(entry, machine.symbols(words, 5 * i, 5 * i + 15))


def test_an_entry_not_met_before_is_read_until_states_agree(machine):
    words = b"internationalisation" * 20
    late = token_counts.chunk_maps(words, machine, 100)[1]
    for n in range(1, 20):
        entry = token_counts.read(machine.start, machine.symbols(words, 0, n))[0]
        assert late.through(entry) == token_counts.read(entry, machine.symbols(words, 100, 200))


def test_counts_come_from_the_scan(texts, library, machine, monkeypatch):
    scanned = []
    whole = token_counts.prefix_scan
    monkeypatch.setattr(token_counts, "prefix_scan", lambda maps: scanned.append(len(maps)) or whole(maps))
    text = "two words " * 500
    assert token_counts.count_text(text, machine) == 1000 and scanned == [3]
    monkeypatch.setattr(token_counts, "prefix_scan", lambda maps: maps)
    assert token_counts.count_text(text, machine) < 1000


def test_counting_takes_memory_in_proportion(machine):
    import tracemalloc

    peaks = []
    for n in (1 << 18, 1 << 20):
        text = "abcdefgh" * (n // 8)
        token_counts.count_text(text, machine)
        tracemalloc.start()
        token_counts.count_text(text, machine)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 16 << 20


def test_a_full_transducer_starts_afresh(texts, library):
    small = token_counts.Transducer(bpe.vocabulary(bpe.default_path()), max_states=10)
    for t in texts[:100]:
        assert token_counts.count_text(t, small) == len(library.encode(t, add_special_tokens=False).ids)


def test_a_long_text_is_read_in_spans_with_bounded_states(library, monkeypatch):
    import base64

    text = base64.b64encode(random.Random(7).randbytes(300_000)).decode() + " and words\n" * 3000
    small = token_counts.Transducer(bpe.vocabulary(bpe.default_path()), max_states=2000)
    monkeypatch.setattr(token_counts, "SPAN", 10_000)
    most, reset = [], small.reset
    monkeypatch.setattr(small, "reset", lambda: (most.append(len(small.states)), reset()))
    assert token_counts.count_text(text, small) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(most) > 10 and max(most) < 2000 + 3 * 10_000


def test_token_queries_on_odd_rows(odd, library):
    counts = token_counts.count_tokens(odd).collect()
    assert len(counts) == len(ODD)
    want = collections.Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ODD)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in counts) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in counts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = collections.Counter()
    for d, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())] += 1
    assert collections.Counter(map(tuple, codec.encoding_digests(odd).collect())) == wanted
    clashing = codec.encode_documents(odd.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("x")))
    assert clashing.columns == [*DOCS_NAMES, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    decoded = {(r["doc_id"], r["d"]) for r in clashing.select("doc_id", codec.decode(F.col("ids")).alias("d")).collect()}
    assert decoded == {(d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t, *_ in ODD}
    assert codec.encoding_digests(odd.limit(0)).count() == 0


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
    <header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, a very long notice about what is kept and why it is kept so long.</div>
    <article><h1>Head&nbsp;line &amp; more</h1><p>First   para
    graph.<p>Second <b>bold<br>text</b> &#233; a &lt; b.</p><div class="ad">Buy now</div><p class="notice">Mind this<p>Kept.</p><article class="comment"><p>Me too!</p></article><form><label>Mail</label></form><p>End.</p>
    <section class="comments"><p>Reader says so.</p></section></article>
    <aside>Side</aside><footer>&copy; X</footer></body></html>"""
    assert html_text.main_text(page) == "Head line & more\nFirst para graph.\nSecond bold text é a < b.\nKept.\nEnd."
    plain = "<body><div id='menu'><a href='/'>Home</a></div><div><h1>Title</h1><p>" + "Long text here. " * 20 + "</p><p>Short.</p><p>" + "More text again. " * 20 + "</p></div><div class='sidebar'>Links</div><div class=footer>Foot</div></body>"
    assert html_text.main_text(plain).split("\n") == ["Title", ("Long text here. " * 20).strip(), "Short.", ("More text again. " * 20).strip()]
    assert [html_text.main_text(x) for x in (None, "", "<html></html>", "<article>", "<p>unclosed <")][:4] == [""] * 4


def test_broken_and_unusual_pages():
    text = html_text.main_text
    assert text("<article><p>before</p><svg class=i/><p>after</p></article>") == "before\nafter"
    assert text("<script>var a='<!--';</script><article><p>text</p></article>") == "text"
    assert text('<article><p>a</p><section class="search-results-analysis"><p>b</p></section><div class="share-of-market">c</div></article>') == "a\nb\nc"
    assert text("<html><body><p>Hello short page</p></body></html>") == "Hello short page"
    assert text("<article><p>let <math><mi>x</mi>=<mn>1</mn></math> be</p></article>") == "let x=1 be"
    assert text('<div class="layout has-sidebar"><article><p>in</p></article></div>') == "in"
    assert text("<head><title>t</title><meta charset=x><article><p>no head end <button>x</article>") == "no head end x"
    assert text('<article><p>one</p><div class="comment-list"><p>two</p></div><div class="ad-slot-3">three</div></article><div id="site-footer">four</div>') == "one"
    assert text("<p>a < b and <3 <") == "a < b and <3 <"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<button>", "<div><p>x", "<!--", "</div><div>", "<b title='\">", "<script"])
def test_broken_pages_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * ((1 << 20) // len(part)))
    assert time.process_time() - began < 8


def plain_article(page):
    """What lies in the page's article, by patterns that do for well-formed pages."""
    out = []
    for article in re.findall(r"(?s)<article>(.*?)</article>", page or ""):
        for line in re.split(r"</?(?:p|h[1-6]|div|li|ul|section)\b[^>]*>", article):
            out.append(" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", line))).split()))
    return "\n".join(x for x in out if x)


def test_pages_query_equals_brute_force(spark, sf):
    want = {r["page_id"]: (plain_article(r["html"]), len(plain_article(r["html"]))) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.queries()["op5_html_text"](spark, sf).collect()} == want


def test_windows_decide_where_nothing_is_marked(monkeypatch):
    page = "<body>" + "<div>Go</div>" * 12 + "<h1>Title</h1>" + "<p>A paragraph of the text, long enough to weigh.</p>" * 6 + "<p>Short.</p>" + "<div><a href=x>link to elsewhere</a></div>" * 12 + "</body>"
    kept = html_text.main_text(page).split("\n")
    assert "Title" in kept and kept.count("A paragraph of the text, long enough to weigh.") == 6 and "Short." in kept and "link to elsewhere" not in kept
    monkeypatch.setattr(html_text, "SURGE_SHARE", 1.1)
    monkeypatch.setattr(html_text, "SURGE", 1e9)
    assert html_text.main_text(page) == html_text.main_text("<article><p>x</p></article>") == ""


def test_spans_equal_brute_force():
    r = random.Random(9)
    for _ in range(300):
        w = [r.choice([0, 0, 0, 1, 3, 50, 200.0]) for _ in range(r.randint(1, 30))]
        sums = [sum(w[i : i + 3]) for i in range(len(w))] + [0]
        surge = min(80, max(sums) / 4)
        inside, state = [], False
        for i in range(len(w)):
            state = surge > 0 and (sums[i] >= surge or state and sums[i] >= surge / 16)
            inside.append(state)
        got = [False] * len(w)
        for a, b in html_text.spans(w):
            assert w[a] >= surge / 32 and w[b - 1] >= surge / 32
            got[a:b] = [True] * (b - a)
        assert all(x or not y for x, y in zip(inside, got, strict=True)) and all(g for g, i, x in zip(got, inside, w, strict=True) if i and x >= surge / 32)


def test_pages_query_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<article><p>é a</p></article>", "x"), (2, "u", "<article><p>é a</p></article>", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract_pages(pages).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "é a", 3), (2, "u", "é a", 3)], key=repr)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_licenses(spark, odd):
    got = licenses.scan_lines(odd).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, "Apache-2.0", 1.0)]
    rows = [
        (1, "This work is licensed under the GNU General Public Licence, version 3"), (2, "all rights reserved"), (2, "all rights reserved"), (3, "rights"), (4, "All rights reserved. All rights reserved."),
        (5, "Intro\nAll rights\n\nreserved\nplain line\nLicensed under CC BY 4.0.\n" + "word " * 5000), (None, "/* " + licenses.TEMPLATES["MIT-text"].replace(", ", ",\n * ") + " */\nint main;"),
        (6, "Copyright someone\n\n" + licenses.TEMPLATES["BSD-3-Clause-text"] + "\n\nReleased under the MIT License."),
    ]
    near = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((r["doc_id"] or 0, r["line_no"], r["last_line"], r["license"]) for r in licenses.scan_lines(near).collect())
    assert [g for g in got if g[0]] == [(1, 0, 0, "GPL-3.0"), (2, 0, 0, "reserved"), (2, 0, 0, "reserved"), (4, 0, 0, "reserved"), (5, 1, 3, "reserved"), (5, 5, 5, "CC-BY-4.0"), (6, 2, 6, "BSD-3-Clause-text"), (6, 8, 8, "MIT")]
    assert [g[3] for g in got if not g[0]] == ["MIT-text"]
    assert licenses.scan_lines(odd.limit(0)).count() == 0


def test_licenses_in_long_texts(spark):
    """Texts of very many lines, without line ends, and of one notice over and over, in seconds and little memory."""
    notice, mit = "All rights reserved.", licenses.TEMPLATES["MIT-text"]
    rows = [
        (1, "\n".join(f"short line of text {i}" for i in range(30_000)) + "\n" + notice), (2, (notice + "\n") * 3_000), (3, "\n" * 300_000 + notice), (4, "of the software is provided as is " * 50_000),
        (5, " ".join([notice] * 40)), (6, (mit + "\nsome other words here\n\n\n") * 20),
    ]
    began = time.time()
    got = licenses.scan_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted((r["doc_id"], r["line_no"], r["last_line"], r["license"]) for r in got)
    want = [(1, 30_000, 30_000, "reserved"), *[(2, i, i, "reserved") for i in range(3_000)], (3, 300_000, 300_000, "reserved"), (5, 0, 0, "reserved"), *[(6, 6 * i, 6 * i + 2, "MIT-text") for i in range(20)]]
    assert found == want
    assert time.time() - began < 120


def test_needles_leave_too_few_pairs():
    for text in licenses.TEMPLATES.values():
        pairs = licenses.template_pairs(text)
        found = set(licenses.needles(pairs, 0.8))
        assert len([p for p in pairs if not found & set(p.split())]) < licenses.least_shared(len(pairs), 0.8)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), duck(sf, queries.oracle_sql()[name])
    assert close(canon(ours), canon(theirs))


def test_boilerplate_lines(spark, odd):
    rows = [(i, f"Shared line\nown text {i}\n\nShared line", "en", f"site{i % 12}", 0, "x", "x", "x", "x") for i in range(40)] + [(99, "Rare\nRare", "en", "site1", 0, "x", "x", "x", "x")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.clean_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == ("Shared line\nown text 0\n", 4, 1) and got[7] == ("own text 7\n", 4, 2) and got[99] == ("Rare\nRare", 2, 0)
    assert {r["n_removed"] for r in line_dedup.clean_lines(spark.createDataFrame(rows, DOCS), least=13).collect()} == {0}
    cleaned = line_dedup.clean_lines(odd)
    assert cleaned.count() == len(ODD) and cleaned.where("text is null").count() == 1
    assert line_dedup.clean_lines(odd.limit(0)).count() == 0


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / free for s in names if s not in full}
        over = {s for s, v in share.items() if v >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing(spark, odd):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 900), "en", r.choice(["a", "a", "a", "b", "c", None, "tiny"] if i % 50 else ["tiny"]), 0, "x", "x", "x", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.taken_words(docs).collect()
    source = {d: s for d, _, _, s, *_ in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for x in got:
        sizes[source[x["doc_id"]]] += x["size"]
        taken[source[x["doc_id"]]] += x["taken"]
        assert 0 <= x["taken"] <= 3 * x["size"]
    targets = expected_targets(dict(sizes))
    for x in got:
        assert x["target"] == pytest.approx(targets[source[x["doc_id"]]]) and x["source_size"] == sizes[source[x["doc_id"]]]
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK_WORDS for s in targets)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()), key=repr)
    assert mixing.taken_words(odd).count() == len(ODD) and mixing.taken_words(odd.limit(0)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 5, 63, 64, 65, 129, 1000):
        got = [r[0] for r in mixing.with_permuted(spark.range(n), "image", F.col("id"), F.lit(n).cast("long"), F.lit("k")).select("image").collect()]
        assert sorted(got) == list(range(n))


def slots_of(spark, sizes):
    return spark.createDataFrame([(f"={s}", n, n) for s, n in sizes.items()], "src string, blocks long, slots long").withColumn("size", F.lit(1))


def test_shards_draw_multinomial_counts(spark):
    sizes = {"a": 40_000, "b": 15_000, "c": 5_000}
    sources, total = mixing.slot_totals(slots_of(spark, sizes))
    drawn = collections.defaultdict(dict)
    for r in mixing.draw_counts(sources, total).collect():
        drawn[r["src"]][r["shard"]] = r["drawn"]
    whole = range(total // mixing.SHARD_SLOTS)
    assert all(sum(d.get(k, 0) for d in drawn.values()) == mixing.SHARD_SLOTS for k in whole)
    for s, n in sizes.items():
        p, counts = n / total, np.array([drawn[f"={s}"].get(k, 0) for k in whole])
        assert abs(counts.mean() - mixing.SHARD_SLOTS * p) < 6
        assert 0.4 < counts.var() / (mixing.SHARD_SLOTS * p * (1 - p)) < 2  # neither fixed counts nor one source a shard


def test_corrected_counts_meet_the_totals_and_stay_near_the_draw(spark):
    sizes = {"a": 4_000, "b": 1_500, "c": 500, "d": 1}
    sources, total = mixing.slot_totals(slots_of(spark, sizes))
    rows = mixing.shard_counts(sources, total).collect()
    for s, n in sizes.items():
        numbers = sorted(i for r in rows if r["src"] == f"={s}" for i in range(r["first"], r["first"] + r["n"]))
        assert numbers == list(range(n))
    drawn = collections.Counter({(r["shard"], r["src"]): r["drawn"] for r in mixing.draw_counts(sources, total).collect()})
    kept = collections.Counter()
    for r in rows:
        kept[r["shard"], r["src"]] += r["n"]
    by_shard = lambda c: {k: sum(n for (x, _), n in c.items() if x == k) for k in {x for x, _ in c}}
    assert by_shard(drawn) == by_shard(kept)
    surplus = sum(max(0, sum(n for (_, s), n in drawn.items() if s == f"={name}") - size) for name, size in sizes.items())
    assert sum((drawn - kept).values()) == surplus < 200


def test_the_mix_holds_what_the_shards_drew(spark, monkeypatch):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(640)), "en", "ab"[i % 2], 0, "x", "x", "x", "x") for i in range(60)]
    laid = mixing.lay_out(spark.createDataFrame(rows, DOCS))
    sources, total = mixing.slot_totals(laid)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    count = lambda df: {(r["shard"], r["src"]): r["n"] for r in df.collect()}
    want = count(mixing.shard_counts(sources, total).groupBy("shard", "src").agg(F.sum("n").alias("n")))
    assert count(mixing.draw_slots(laid).groupBy("shard", "src").agg(F.count("*").alias("n"))) == want
    monkeypatch.setattr(mixing, "draw_counts", lambda sources, total: sources.select(F.lit(0).alias("shard"), "src", F.col("slots").alias("drawn")))
    assert {k for k, _ in count(mixing.draw_slots(laid).groupBy("shard", "src").agg(F.count("*").alias("n")))} == {0}


def test_mixed_documents(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(200)), "en", "ab"[i % 2], 0, "x", "x", "x", "x") for i in range(40)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, DOCS)).collect()
    words = {i: set(t.split()) for i, t, *_ in rows}
    assert got and all(set(r["text"].split()) <= words[r["doc_id"]] and r["text"] for r in got)
    assert abs(mixing.draw_slots(mixing.lay_out(spark.createDataFrame(rows, DOCS))).count() - 8000 / mixing.BLOCK_WORDS) <= 2


def test_mixing_keeps_rows_of_null_and_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}w{k}" for k in range(200))
    rows = [(None, text("n0")), (None, text("n1")), (7, text("s0")), (7, text("s1")), (8, text("e")), (8, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "x", "x", "x", "x") for i, t in rows], DOCS)
    got = mixing.mixed_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}w{k}" for k in range(50))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (9, text("e")), (9, text("e")), (None, text("f")), (None, text("g")), (None, text("a")), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "x", "x", "x", "x") for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(3, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (9, text("e")), (None, text("f")), (None, text("g")), (2, ""), (2, "")]
    assert collections.Counter(got) == collections.Counter(want)


def test_quality(spark, odd, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = quality.grade_documents(docs, labels).select("doc_id", "tail_probability", "expected_grade", "selected")
    b = {r["doc_id"]: r["tail_probability"] for r in quality.grade_documents(docs.repartition(5), labels).collect()}
    for r in a.collect():
        assert b[r["doc_id"]] == pytest.approx(r["tail_probability"]) and 0 <= r["tail_probability"] <= r["expected_grade"] <= 2
    assert quality.grade_documents(odd, labels).count() == len(ODD)
    assert quality.grade_documents(odd, labels.limit(0)).count() == len(ODD)
    assert quality.grade_documents(docs.limit(0), labels).count() == 0


def features(texts):
    return [index[a:b].astype(np.int32) for index, bounds in quality.feature_sets(texts) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_long_texts_are_read_whole_and_by_pieces(monkeypatch):
    texts = ["word " * 200 + "tail", "x" * 700 + "é" * 40, None, "", "The end. " * 50]
    whole = features(texts)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 300)
    parts = features(texts)
    assert all(set(a) <= set(b) for a, b in zip(parts[:1] + parts[2:], whole[:1] + whole[2:], strict=True))
    assert all(len(set(b) - set(a)) <= 1 for a, b in zip(parts, whole, strict=True) if len(b))  # the shape of a word that begins a piece
    assert set(features(["a" * 5000 + "toxic" * 9])[0]) != set(features(["a" * 5000 + "clean" * 9])[0])


def plain_features(text):
    """The features of one text, word by word in plain Python."""
    m = (1 << 64) - 1

    def mix(h, seed):
        h = (h + seed) & m
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m
        return h ^ (h >> 31)

    def span(b):
        return mix((sum((x + 1) * pow(int(shingles.BASE), i, 1 << 64) for i, x in enumerate(b)) + len(b)) & m, 0)

    out, before = set(), None
    for raw in re.findall(rb"[^ \t-\r]+", text.encode()):
        w = raw.translate(shingles.LOWER)
        upper, digit = sum(65 <= x <= 90 for x in raw), sum(48 <= x <= 57 for x in raw)
        sign = sum(x < 128 and not chr(x).isalnum() for x in raw)
        shape = min(upper, 3) + 4 * (upper == len(raw)) + 8 * min(digit, 2) + 24 * min(sign, 4) + 120 * (w == before) + 240 * min(len(raw) // 8, 3)
        made = [mix(span(w), 11), mix(span(w[: quality.PREFIX]), 12), mix(span(w[-quality.SUFFIX :]), 13), mix(shape, 14)]
        if len(w) > quality.LONG:
            made += [mix(span(w[i : i + quality.GRAM]), 15) for i in range(len(w) - quality.GRAM + 1)]
        out |= {h >> (64 - quality.BITS) for h in made}
        before = w
    return sorted(out)


def plain_fit(found, grades, n_grades=3):
    """The regression row by row: dense gradients of each batch, and AdaGrad steps."""
    n = 1 << quality.BITS
    w, g2, theta_free, t2 = np.zeros(n), np.full(n, 1e-2), np.zeros(n_grades - 1), np.full(n_grades - 1, 1e-2)
    rng = np.random.default_rng(20260701)
    cut = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), 64):
            rows, gw, gt = order[at : at + 64], np.zeros(n), np.zeros(n_grades - 1)
            theta = np.concatenate([theta_free[:1], theta_free[0] + np.cumsum(np.exp(theta_free[1:]))])
            for r in rows:
                scale, y = len(found[r]) ** -0.25 if len(found[r]) else 1.0, grades[r]
                s = w[found[r]].sum() * scale
                up, lo = (cut(theta[y] - s) if y < n_grades - 1 else cut(1e9)), (cut(theta[y - 1] - s) if y else cut(-1e9))
                p = max(up - lo, 1e-9)
                gw[found[r]] += (up * (1 - up) - lo * (1 - lo)) / p * scale / len(rows)
                if y < n_grades - 1:
                    gt[y] -= up * (1 - up) / p / len(rows)
                if y:
                    gt[y - 1] += lo * (1 - lo) / p / len(rows)
            free = np.array([gt.sum(), *[gt[k:].sum() * np.exp(theta_free[k]) for k in range(1, n_grades - 1)]])
            g2 += gw**2
            w -= quality.RATE * gw / np.sqrt(g2)
            t2 += free**2
            theta_free = theta_free - quality.RATE * free / np.sqrt(t2)
    return w, np.concatenate([theta_free[:1], theta_free[0] + np.cumsum(np.exp(theta_free[1:]))])


def test_quality_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2)
    r = random.Random(6)
    vocabulary = ["the", "River", "STONE", "light9", "a-b", "x" * 30, "ñandú", "of"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))), i % 2, int(i % 5 == 0)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(None, "the River"), (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    found = [plain_features(t) for _, t, *_ in rows]
    assert [f.tolist() for f in features([t for _, t, *_ in rows])] == found
    w, theta = plain_fit([np.array(f, np.int64) for f in found], np.array([0 if t else 1 if not q else 2 for _, _, q, t in rows]))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.grade_documents(docs, labels, epochs=2).select("doc_id", "expected_grade", "tail_probability", "selected").collect()}
    for i, t in [*[(i, t) for i, t, *_ in rows], (None, "the River"), (999, "")]:
        f = plain_features(t)
        tails = [1 / (1 + np.exp(-(w[f].sum() / max(len(f), 1) ** 0.25 - k))) for k in theta]
        assert got[i][:2] == pytest.approx((sum(tails), tails[-1]), abs=1e-4) and got[i][2] == (tails[-1] >= 0.5)


def test_held_out_accuracy():
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "of", "and", "river", "stone", "light", "house"]) for _ in range(r.randint(20, 200))) for _ in range(600)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:150]]
    toxic = [t + " " + " ".join(r.choice(["scum", "idiot"]) for _ in range(3)) for t in good[150:300]]
    texts, grades = good[300:] + junk + toxic, np.array([2] * 300 + [1] * 150 + [0] * 150)
    order = np.random.default_rng(0).permutation(len(texts))
    fit, test = order[:400], order[400:]
    made = features([texts[i] for i in fit])
    w, theta = quality.fit(made, grades[fit])
    s = quality.scores(w, [texts[i] for i in test])
    assert theta[0] < theta[1]
    assert ((s[:, None] > theta[None, :]).sum(axis=1) == grades[test]).mean() > 0.95
    # Numbers of features do not depend on how texts are batched.
    assert np.allclose(s[:3], [quality.scores(w, [texts[i]])[0] for i in test[:3]])


def test_word_pattern_is_the_contract():
    assert re.findall(mixing.WORD, "a\x0bb\xa0c\x0cd e") == ["a", "b\xa0c", "d", "e"]
