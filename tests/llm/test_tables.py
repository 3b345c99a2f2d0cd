"""HTML extraction, chat formatting, neighbours, mixing, URL filter and the pipeline against plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, chat_format, html_extract, mixing, quality, queries, secret_scan, url_filter
from millrace.llm.common import join_counted

SF = "/root/testdata/sf0.001"

# HTML

PAGES = {
    "<p>a<p>b<b>c</b>d": "a bcd",
    '<div class="ad">x</div><main><p>y &amp; z&nbsp;w</p></main><footer>f': "y & z w",
    '<nav>n</nav><article><h1>T</h1><section class="comments"><p>no</p></section><p>a<br>b</p><aside>s</aside></article>more': "T a b",
    "<ul><li>a<li>b</ul><form>f</form>": "a b",
    "<p title='a>b'>x</p><!-- <p>no</p> -->": "x",
    '<article>x<script>var a="</article>"</script>y</article>': "xy",
    "<p hidden>x</p><p>y": "y",
    "a<b": "a",
    '<article class="post has-comments with-sidebar" data-id="ads" title="id=menu">kept<article class="comment">no</article></article>': "kept",
    '<div class="content no-ads">kept<div id="Site-Footer">no</div><div style="display: none">no</div></div>': "kept",
    "": "",
    None: "",
    "plain &lt;text&gt;  of\n\ttwo": "plain <text> of two",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1 2 3",
    "<div>" * 3000 + "deep": "deep",
    # names of boilerplate around the article
    '<h1>T</h1><div class="content sidebar-right"><p>all of the text</p><div class="sidebar">s</div></div>': "T all of the text",
    '<form action="/"><div><p>page in a form</p></div><form><input></form></form>': "page in a form",
    '<form><nav>n</nav><article>in a form</article><div class="post-comments">c</div></form>': "in a form",
    '<article class="post comments-open">kept</article><div class="comments"><article>a long comment</article></div>': "kept",
    '<main class="promo-page">kept</main>': "kept",
    '<div id="page" class="nav-fixed"><nav>n</nav>kept</div>': "kept",
    '<div class="share-price-report">kept</div><div class="relatedPosts">no</div><div id=site-footer>no</div>': "kept",
    # the region by its share
    "<article><h1>T</h1></article><p>the body of the page stands here": "T the body of the page stands here",
    "<main><h1>Title</h1><p>a long text of the page</p><article>teaser</article></main><p>more": "Title a long text of the page teaser",
    "<article>a</article><article>b</article>": "a b",
    '<article>short</article><section id="comments">' + "<p>a very long comment of a reader</p>" * 4 + "</section>": "short",
}


def test_pages(spark):
    rows = [(i, "http://h.org/", html, i) for i, html in enumerate(list(PAGES) * 2)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, _mr_x int")
    got = {r.page_id: r.text for r in html_extract.main_text(frame).collect()}
    assert [got[i] for i in range(len(rows))] == list(PAGES.values()) * 2
    assert html_extract.main_text(frame.limit(0)).columns == ["page_id", "url", "_mr_x", "text"]


def test_site_templates_go_and_articles_stay(spark):
    site = lambda i: f"<div>Home of the site</div><div id=x><p>Shared line<p>Text number {i} says {i * i} and more</div><div>Made by us</div>"
    copied = "<div>Home of the site</div><div id=x><p>One long article that many pages copy</div><div>Made by us</div>"
    rows = [(i, f"http://one.org/{i}", site(i)) for i in range(9)] + [(20 + i, f"http://one.org/c{i}", copied) for i in range(9)] + [(40 + i, f"http://h{i}.org/", site(i)) for i in range(9)] + [(60, None, site(1))]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[3] == "Shared line Text number 3 says 9 and more"
    assert got[20] == "One long article that many pages copy"
    assert got[43] == "Home of the site Shared line Text number 3 says 9 and more Made by us" and got[60].startswith("Home")


def test_copies_of_a_page_hide_no_template(spark):
    site = lambda i: f"<div>Menu of the site</div><p>Text number {i} says {i * i} and more"
    rows = [(i, f"http://one.org/{i}", site(i)) for i in range(10)] + [(10 + i, f"http://one.org/c{i}", site(99)) for i in range(90)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"Text number {k} says {k * k} and more" for i in range(100) for k in [i if i < 10 else 99]}


def site_pages(hosts=3, each=14):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("ash birch cedar elm fir hazel lime maple oak pine rowan yew".split()) + str(rng.randrange(50)) for _ in range(n))
    rows, texts = [], {}
    for h in range(hosts):
        nav, ads, foot = f"<ul><li>{say(2)}<li>{say(1)}</ul>", [f"<div>{say(4)}</div>" for _ in range(2)], f"<div>{say(5)}<table><tr><td>{say(2)}</table></div>"
        for i in range(each - h * 5):
            text = [say(rng.randint(10, 30)) for _ in range(3)]
            body = "".join(f"<p>{t}</p>" for t in text)
            rows.append((len(rows), f"http://h{h}.org/{i}", f"<html><body><nav>{nav}</nav>{ads[i % 2]}<div>{body}</div><footer>{foot}</footer>"))
            texts[len(rows) - 1] = " ".join(text)
    return rows, texts


def test_templates_alone_remove_nav_advert_and_footer(spark):
    rows, texts = site_pages()
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string"), named=False).collect()}
    large = [i for i, url, _ in rows if "h0" in url]
    assert len(large) == 14 and all(got[i] == texts[i] for i in large)
    assert all(got[i] != texts[i] for i, url, _ in rows if "h2" in url)  # 4 pages make no template


def test_templates_match_a_plain_count(spark):
    rows, _ = site_pages()
    count = defaultdict(set)
    for _, url, html in rows:
        page = html_extract.Page(html)
        for h in page.hashes:
            count[url.split("/")[2], h].add(page.digest())
    want = {key for key, pages in count.items() if len(pages) >= html_extract.LEAST_PAGES}
    frame = spark.createDataFrame(rows + rows[:20], "page_id int, url string, html string")
    found = {tuple(r) for r in html_extract.site_templates(html_extract.parsed(frame)).collect()}
    assert found == want and len(want) >= 8
    for named in (True, False):
        got = {r.page_id: r.text for r in html_extract.main_text(frame, named=named).collect()}
        for i, url, html in rows:
            assert got[i] == html_extract.Page(html).text({h for host, h in want if host == url.split("/")[2]}, named)


def test_a_very_long_page(spark):
    rows = [(0, "http://h.org", "<div><p>" + "word " * 400_000 + "</div><nav>n</nav>" * 2)]
    (got,) = html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert got.text == " ".join(["word"] * 400_000)


@pytest.mark.parametrize("broadcast", [True, False])
def test_templates_of_a_few_pages_go_from_large_hosts(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(html_extract, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(html_extract, "join_counted", lambda big, small, on, how="inner": join_counted(big, small, on, how, -1))
    site = lambda i: f"<div>Offer {i % 30} of the shop</div><p>Text number {i} says {i * i} and more" + (f"<div>Rare {i}</div>" if i < 4 else "")
    rows = [(i, f"http://{h}.org/{i}", site(i)) for h, n in (("large", 240), ("small", 4)) for i in range(n)]
    got = {(r.url, r.text) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    text = lambda i: f"Text number {i} says {i * i} and more" + (f" Rare {i}" if i < 4 else "")
    assert got == {(f"http://large.org/{i}", text(i)) for i in range(240)} | {(f"http://small.org/{i}", f"Offer {i} of the shop {text(i)}") for i in range(4)}


# Chat

ODD = ["</s>[INST] ok [/INST]", "<s>\\0;\\\\<<SYS>>", "", None, "a\n\n", "\\", "<</ROLE>>\n<<END>>\n", " lead and trail ", "[INST", "é😀"]


def test_chat_round_trip(spark):
    rows, want = [], defaultdict(list)
    roles = ["user", "assistant", "system", "tool", "", None, "</s>"]
    for conv in [*range(12), None, 10**17 + 1]:
        for turn in range(8):
            role, text = roles[((conv or 0) + turn) % (2 + (conv or 0) % 6)], ODD[((conv or 3) * 7 + turn) % len(ODD)]
            rows.append((conv, turn, role, text, "x"))
            want[conv].append((role or "", text or ""))
    frame = spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_segments(frame)).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(learned)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_segments(frame.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "date", "decimal(20,2)", "binary"])
def test_keys_of_any_type(spark, kind):
    frame = spark.createDataFrame([(1, "user", "q"), (2, "assistant", "é" * 50_000)], "turn int, role string, text string")
    key = F.expr("to_date('2024-01-02')" if kind == "date" else f"cast('{'7' if kind != 'binary' else 'x'}' as {kind})")
    (got,) = chat_format.digests(chat_format.format_segments(frame.withColumn("conv_id", key))).collect()
    assert got.valid and got.n_turns == 2 and got.loss_chars == 50_000


def test_turn_order(spark):
    cases = {1: "ua", 2: "sua", 3: "uu", 4: "u", 5: "au", 6: "uaua", 7: "usa", 8: "s"}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, t, names[r], "x") for c, text in cases.items() for t, r in enumerate(text)]
    found = chat_format.digests(chat_format.format_segments(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    assert {r.conv_id for r in found.collect() if r.valid} == {1, 2, 6}
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, None, "system", "first")]
    texts = chat_format.format_segments(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("segment").collect()
    assert [r.text for r in texts][1::3] == ["first", "z", "b", "b"] and [r.loss for r in texts if r.text == "z"] == [True]


# Neighbours

def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(900, 24)) * rng.uniform(0.2, 3, 900)[:, None]
    rows[100:160] = rows[100] + rng.normal(size=(60, 24)) * 0.01
    rows[200:260] = rows[200]
    data = [(i, [float(x) for x in v], i) for i, v in enumerate(rows)]
    bad = [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [float("inf")] + [1.0] * 23, 0), (2080, [None] + [1.0] * 23, 0), (2100, [1.0, 2.0], 0), (None, [1.0] * 24, 0)]
    frame = spark.createDataFrame(data + bad, "vec_id bigint, embedding array<double>, rank int")
    found = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, got in found.items():
        score = rows @ rows[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:10]
        assert [r for r, *_ in got] == list(range(1, 11)) and all(math.isclose(s, score[i], rel_tol=1e-12) for _, i, s in got)
        hits += len(set(best) & {i for _, i, _ in got})
        if q == 220:
            assert [i for _, i, _ in got] == best
    assert hits >= 0.9 * 10 * len(found)


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0]), (20, [3.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 3.0), (20, 2, 1, 3.0), (20, 3, 2, 2.5)]
    assert ann.search(frame, F.lit(False)).count() == 0 and ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_repeated_ids_lose_no_candidate(spark):
    frame = spark.createDataFrame([(20, [1.0, 2.0])] * 30 + [(41, [1.0, 2.0]), (42, [0.5, 0.5])] + [(43, [1.0, 2.0])] * 3, "vec_id bigint, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in ann.search(frame, F.col("vec_id") == 20, k=20).orderBy("rank").collect()]
    assert got == [(1, 41), (2, 43), (3, 43), (4, 43), (5, 42)]


def test_ties_go_to_smaller_ids_wherever_rows_stand(spark):
    rng = np.random.default_rng(4)
    one, other = rng.normal(size=33), rng.normal(size=33)
    for turn in range(3):
        ids = rng.permutation(400)
        data = [(int(i), (one if i % 2 else other + i % 3 * 1e-3).tolist()) for i in ids]
        got = defaultdict(list)
        for r in ann.search(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 1, k=20).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q, found in got.items():
            assert found == [i for i in range(1, 60, 2) if i != q][:20]


def test_recall_on_many_rows(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(20_000, 64)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for r in ann.search(frame, F.col("vec_id") % 200 == 0, k=20).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        score = rows @ rows[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits >= 0.95 * 20 * 100


# Mixing

def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_names, left = {}, set(names), share * sum(sizes.values())
    while open_names:
        level = left / sum(weight[n] for n in open_names)
        full = {n for n in open_names if weight[n] * level > most * sizes[n]}
        if not full:
            return target | {n: weight[n] * level for n in open_names}
        target |= {n: most * sizes[n] for n in full}
        left -= sum(most * sizes[n] for n in full)
        open_names -= full
    return target


def test_mix(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(1, 300)), ["a", "b", "ß", None, "c", ""][i % 6] if i % 3 else "a", "clash") for i in range(900)]
    rows += [(5000, None, "a", ""), (5001, "", None, ""), (5002, " \n", "empty", ""), (None, "x y", "b", "")] + [(6000, "q " * 50, "b", "")] * 40
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mixing.mix(frame, (3, 1, 2), 1.5).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(taken[n] == pytest.approx(want[n], rel=0.01, abs=3) for n in sizes)
    again = mixing.mix(frame.repartition(7), (3, 1, 2), 1.5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(frame.limit(0), (3, 1, 2), 1.5).count() == 0


def plain_multiplier(sizes, target, most):
    """The dual's optimum of one source by bisection in numpy: tokens grow with the multiplier."""
    low, high = -100.0, 100.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (sizes * np.exp(np.minimum(math.log(most), middle * sizes))).sum() < target else (low, middle)
    return (low + high) / 2


def test_newton_solves_the_dual(spark):
    rng = np.random.default_rng(19)
    sizes = {f"s{k}": rng.lognormal(4, 1.2, int(rng.integers(1, 200))).astype(int) + 1 for k in range(12)}
    rows = [(k, n, "w " * int(size)) for k, each in sizes.items() for n, size in enumerate(each)]
    frame = spark.createDataFrame([(f"{k}-{n}", k, text) for k, n, text in rows], "doc_id string, source string, text string")
    got = mixing.mix(frame, (3, 1, 2, 0.2), 1.2).collect()
    assert len(got) == len(rows) and len({r.rate for r in got}) > 20
    for r in got:
        of = sizes[r.source].astype(float)
        want = 2.0 if r.target >= 2 * of.sum() * (1 - 1e-9) else min(2.0, math.exp(plain_multiplier(of, r.target, 2.0) * r.size))
        assert r.rate == pytest.approx(want, rel=1e-6), (r.source, r.size)
    for k, of in sizes.items():
        mine = [r for r in got if r.source == k]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(mine[0].target, rel=1e-6)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= of.max()
        if len(mine) >= 50:
            assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.02)


def test_mix_of_a_repeated_null_key(spark):
    rows = [(None, "a", "x y z")] * 3000 + [(i, "a", "q " * (1 + i % 40)) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, source string, text string"), (1,), 1.5).collect()
    assert len(got) == 3500 and max(r.copies for r in got) <= 2
    assert sum(r.taken for r in got) == pytest.approx(got[0].target, rel=0.001)


# URLs

URLS = [None, "", "nothing", "http://a.org", "http://a.org/x", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://notexample.org/en/12", "https://x.com/fr/a", "x.com/fr/", "http://x.com/de/#", "http://x.com?u=http://y.org/", "http://Bad.net:80/p/?a", "http://www.bad.net/p", "http://bad.net/q", "a://b://c/d", "http://İ.com/\n/x", "http://x.org#/es/"]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string, block int").drop("rule")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,), ("other.net/",)], "entry string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame, listed, queries.URL_RULES).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS):
        head, colon, rest = (url or "").partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [r for r in queries.URL_RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        verdict = best.action if best else "block" if i in (12, 13) else "allow"
        assert got[i] == got[i + len(URLS)] == (host, path, best and best.host + best.path, verdict), url
    assert url_filter.filter_urls(frame, listed.limit(0), ()).where("verdict <> 'allow'").count() == 0
    assert url_filter.filter_urls(frame.limit(0), listed, queries.URL_RULES).count() == 0


def test_of_equally_long_rules_the_earlier_decides(spark):
    frame = spark.createDataFrame([(1, "http://a.b.org/x/y")], "page_id int, url string")
    rules = [url_filter.Rule("allow", "b.org", "/x"), url_filter.Rule("block", "org", "/x/y"), url_filter.Rule("block", "b.org", "/x")]
    for chosen in (rules, rules[::-1]):
        (got,) = url_filter.filter_urls(frame, spark.createDataFrame([], "entry string"), chosen).collect()
        longest = [r for r in chosen if len(r.host + r.path) == max(len(x.host + x.path) for x in chosen)]
        assert (got.rule, got.verdict) == (longest[0].host + longest[0].path, longest[0].action)


def test_bloom_loses_nothing_and_passes_little(spark):
    listed = spark.range(4000).select(F.concat(F.lit("h.net/"), "id").alias("entry"))
    pages = spark.range(12000).select("id", F.concat(F.lit("http://www.h.net/"), "id", F.lit(".html")).alias("url"))
    assert url_filter.filter_urls(pages, listed, ()).where("verdict = 'block'").count() == 4000


# Queries and pipeline

def test_contract_columns(spark):
    want = {
        "op1_": "doc_id n_assign n_access n_hex base_sha256 spans", "op2_": "doc_id held_out score predicted", "op3_": "page_id url text n_chars",
        "op4_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5_": "query_id rank vec_id score", "op6_": "doc_id class_id n_links",
        "op7_": "doc_id size source_size target taken", "op8_": "doc_id item_id", "op9_": "doc_id n_words n_removed kept_sha256", "op10_": "page_id host path rule verdict",
    }
    for start, columns in want.items():
        (name,) = [n for n in queries.QUERIES if n.startswith(start)]
        found = queries.QUERIES[name](spark, SF)
        assert found.columns[: len(columns.split())] == columns.split()


def test_pipeline_matches_plain_stages(spark):
    """Every stage, run on all that the plain version of the one before kept, against a plain version of itself."""
    from test_texts import plain_buckets, plain_leaks, plain_links, plain_spans

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    docs = {r.doc_id: r for r in frame.collect()}

    def stage(name, kept):
        return {r.doc_id: r for r in stages[name](spark, spark.createDataFrame(list(kept.values()), frame.schema), SF).collect()}

    model = quality.fit(frame, labels)

    def score(text):
        found = plain_buckets(text or "")
        return 1 / (1 + math.exp(-model.offset - (float(np.mean(model.weight[found], dtype=np.float64)) if found else 0.0)))

    want = {k: r for k, r in docs.items() if score(r.text) >= 0.7}
    assert stage("quality_classifier", docs) == want and 0 < len(want) < len(docs)

    docs, keys = want, sorted(want)
    _, group = plain_links([docs[k].text for k in keys])
    want = {k: docs[k] for i, k in enumerate(keys) if group[i] == i}
    assert stage("ngram_jaccard_join", docs) == want and len(want) < len(docs)

    docs, keys = want, sorted(want)
    leaked = {keys[d] for d, _ in plain_leaks([docs[k].text for k in keys], items)}
    want = {k: r for k, r in docs.items() if k not in leaked}
    assert stage("benchmark_decontamination", docs) == want

    docs, want = want, {}
    for k, r in docs.items():
        text, covered = list(r.text or ""), [False] * len(r.text or "")
        for _, start, end in plain_spans(r.text, secret_scan.RULES):
            covered[start:end] = [True] * (end - start)
        starts = {start for _, start, _ in plain_spans(r.text, secret_scan.RULES)}
        for i, gone in enumerate(covered):
            if gone:
                text[i] = "[SECRET]" if i in starts and (i == 0 or not covered[i - 1]) else ""
        want[k] = "".join(text)
    got = stage("secret_scan", docs)
    assert {k: (r.text or "", r.n_chars) for k, r in got.items()} == {k: (t, len(t)) for k, t in want.items()}

    sizes, of = defaultdict(int), {}
    for k, r in got.items():
        of[k] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += of[k]
    targets = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = defaultdict(int)
    for k, r in stage("mixing", got).items():
        own = np.array([of[i] for i, x in got.items() if x.source == r.source], float)
        rate = 2.0 if targets[r.source] >= 2 * own.sum() * (1 - 1e-9) else min(2.0, math.exp(plain_multiplier(own, targets[r.source], 2.0) * of[k]))
        assert (r.size, r.source_size) == (of[k], sizes[r.source]) and r.target == pytest.approx(targets[r.source]) and r.rate == pytest.approx(rate, rel=1e-6)
        assert r.taken == r.copies * r.size and r.copies <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[n] - targets[n]) <= max([of[k] for k, x in got.items() if x.source == n]) for n in sizes)


def test_pipeline_keeps_columns_and_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(kept) <= ids and len(kept) == len(set(kept)) and (docs.columns == columns or k == 4)
        assert k < 3 or set(kept) == ids
        ids = set(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
