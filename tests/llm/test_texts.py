"""BPE, fingerprints, mixing, quality and pages against brute force."""

import hashlib
import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import bpe, merkle, mixing, pages, quality
from tests.conftest import SF_SMALL
from tests.llm.cases import ODD, clashing, documents

PATH = bpe.vocabulary_path()


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("leaf", [4, 16, 2048])
def test_codec_equals_the_library(leaf):
    lib, own, rnd = library(), bpe.Codec(PATH, leaf), random.Random(leaf)
    kinds = ["ab", "a", "the", "etaoinshrdlu", "abcXYZ'0!.,", "éaüßxñÀİΣς", "aA'sS tT\n", "日本語漢字a", "é̌J", "   x<|>"]
    for k in range(200):
        t = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 300)))
        if k % 7 == 0:
            t = f"{t}<|endoftext|>{t} <|STARTOFTEXT|>"
        ids = own.encode([t.encode()])[0]
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("long_text", [20, 1 << 20])
def test_bpe_rows(spark, long_text):
    lib = library()
    docs = clashing(documents(spark, ODD))
    got = sorted(((r.doc_id is None, r.doc_id, bytes(r.ids), r.text) for r in bpe.round_trip(docs, PATH, long_text, leaf=64).collect()), key=repr)
    want = []
    for i, t, _, _ in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    again = bpe.decode(bpe.encode(docs, PATH, long_text), PATH)
    assert sorted(((r.doc_id is None, r.doc_id, bytes(r.ids), r.text) for r in again.collect()), key=repr) == got
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


def test_merkle_neighbours(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    docs = sorted((i, t or "") for i, t in table)
    got = {r.doc_id: r for r in merkle.op7_merkle_fingerprint(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(t), merkle.fingerprint(edited))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (t == edited)


def test_merkle_likeness_and_differing_branches():
    rnd = random.Random(1)
    text = "\n".join(" ".join(f"w{rnd.randint(0, 999)}" for _ in range(40)) + "." for _ in range(50))
    changed = text.replace(text.split("\n")[20], "quite another paragraph.")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert a != b and 0.9 < merkle.likeness(a, b) < 1 == merkle.likeness(a, a)
    start = text.index(text.split("\n")[20])
    spans = merkle.differing(a, b)
    assert spans and all(start <= s < e <= start + len(text.split("\n")[20]) + 1 for s, e in spans)
    assert merkle.likeness(a, merkle.fingerprint("nothing alike")) == 0
    assert merkle.likeness(merkle.fingerprint(""), a) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1


def plain_likeness(a, b):
    """Characters in branches that both trees have, largest first, counted from the trees themselves."""
    x, y = merkle.tree(a), merkle.tree(b)
    total, matched = len(a) + len(b), 0
    if a == b:
        return 1.0
    for depth in range(3):
        names = [n[0] for n in y]
        rest = []
        for n in x:
            if n[0] in names:
                names.remove(n[0])
                matched += 2 * n[1]
            else:
                rest.append(n)
        left, gone = [], [n[0] for n in y]
        for n in names:
            gone.remove(n)
        for n in y:
            if n[0] in gone:
                gone.remove(n[0])
            else:
                left.append(n)
        if depth < 2:
            x, y = [c for n in rest for c in n[2]], [c for n in left for c in n[2]]
    return matched / total if total else 1.0


def test_merkle_likeness_against_plain_matching(spark):
    docs = sorted((tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in merkle.with_next(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    for k, (i, text) in enumerate(docs):
        text, other = text or "", docs[(k + 1) % len(docs)][1] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + other[:quarter]
        assert got[i].edited_text == edited
        assert math.isclose(got[i].near_edited, plain_likeness(text, edited)) and math.isclose(got[i].near_next, plain_likeness(text, other))


def test_merkle_many_rows_with_one_id_are_cut(spark):
    docs = documents(spark, [(None, f"text {i}", "en", "a") for i in range(400)] + [(7, f"other {i}", "en", "a") for i in range(400)])
    sizes = [r["count"] for r in merkle._in_ranges(docs, 20).where("after = 0").groupBy("range").count().collect()]
    assert sum(sizes) == 800 and max(sizes) < 200 and len(sizes) > 20
    got = merkle.with_next(docs, 20).collect()
    assert len(got) == 800 and sorted(r.text for r in got) == sorted(r.text for r in docs.collect())


@pytest.mark.parametrize("rows", [1, 3, 500])
def test_merkle_odd_rows(spark, rows):
    got = merkle.with_next(clashing(documents(spark, ODD)), rows).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr((i, t or "")) for i, t, _, _ in ODD)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    assert by_id[8].edited_text == "one" and by_id[4].edited_text.startswith("before shared0")
    assert merkle.with_next(documents(spark, [])).count() == 0
    only = merkle.with_next(documents(spark, [(3, "abcd efgh", "en", "a")])).first()
    assert only.edited_text == "abcd efab" and only.near_next == 1.0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, budget = {}, set(names), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            target |= {s: budget * weight[s] / total for s in left}
            break
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        left -= over
    return target


def check_mix(rows, got):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, taken = brute_targets(sizes), {}
    assert sorted(repr((r.doc_id, r.source, r.size)) for r in got) == sorted(repr((i, s, size(t))) for i, t, _, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert target[s] - 2 - len(rows) * 0.01 <= taken[s] <= target[s] + 1e-6


def test_mix_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = mixing.mix_sources(docs).collect()
    check_mix(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))


def test_mix_odd_rows(spark):
    docs = clashing(documents(spark, ODD))
    check_mix(ODD, mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert mixing.mix_sources(documents(spark, [(1, None, "en", None), (2, "", "en", "a")])).count() == 2


def test_mixed_documents_have_the_taken_words(spark):
    docs = clashing(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("n"))
    words = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert sorted(map(tuple, taken.where("n > 0").collect())) == sorted(map(tuple, words.collect()))
    originals = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    cut = 0
    for r in out.collect():
        if r.text != originals[r.doc_id]:
            cut += 1
            head = r.text.split(" ")
            assert originals[r.doc_id].encode().split()[: len(head)] == [w.encode() for w in head] and r.n_chars == len(r.text)
    assert cut <= 20


def check_quality(spark, docs):
    got = quality.judge(docs)
    con = duckdb.connect()
    table = docs.select("doc_id", "text").toArrow()
    con.register("documents", table)
    rel = con.sql(quality.ORACLE_SQL)
    assert rel.columns == got.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_quality_against_sql(spark):
    check_quality(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    check_quality(spark, clashing(documents(spark, ODD)))
    assert quality.judge(documents(spark, [])).count() == 0


def test_cascade_order_is_by_rejection_per_cost_and_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    order = quality.rule_order(docs)
    assert [n for n, _, _ in order] and sorted(n for n, _, _ in order) == sorted(quality.RULES)
    rates = [share / max(cost, 1e-6) for _, share, cost in order]
    assert rates == sorted(rates, reverse=True)
    base = quality.measured(docs)
    one, two = (base.select("doc_id", quality.verdict(o).isNull().alias("k")).collect() for o in (list(quality.RULES), list(quality.RULES)[::-1]))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = ('<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
        '<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save</div><article><header><h1>Head&shy;line</h1></header>'
        '<p>First   &lt;b&gt; par<b>a</b>graph<p>Second<br>line&nbsp;two<div class="share">Share this</div><ul><li>one<li>two</ul>'
        '<form><input>Name</form><section id="comments"><p>I disagree</p></section></article><aside>Side</aside><footer>&copy; x</footer>'
        '<script>var a="</p>";</script></body></html>')


def test_page_text():
    assert pages.main_text(PAGE, set()) == "Head­line\n\nFirst <b> paragraph\n\nSecond line two\n\none\n\ntwo"
    assert pages.main_text(None, set()) == pages.main_text("", set()) == pages.main_text("<p></p>", set()) == ""
    assert pages.main_text("<article><p>cut &am", set()) == "cut &am" and pages.main_text("<article><p>a</p><p>b</artic", set()) == "a\n\nb"
    assert pages.main_text("<p>1 < 2 & 3 > 2</p>", set()) == "1 < 2 & 3 > 2"
    assert pages.main_text("<!-- x --><div>plain</div><!-- open", set()) == "plain"


def test_style_tree_finds_what_markup_does_not_name(spark):
    rows = [(k, f"https://h.example/{k}", f'<html><body><article><h1>Title {k}</h1><div class="x9">Join our club today!</div>'
             f'<p>Text number {k}.</p><p>All pages say this.</p></article><div class="foo"><p>own {k}</p></div></body></html>') for k in range(40)]
    rows += [(100, None, None), (100, None, None), (101, "https://h.example/e", ""), (102, "ftp://other/", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(clashing(df)).collect()}
    assert got[7] == "Title 7\n\nText number 7.\n\nAll pages say this."
    assert got[100] == got[101] == "" and got[102] == "alone" and pages.extract(df).count() == len(rows)
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("before, after", [('<html><body class="home">', "</body></html>"), ('<html class="no-js"><body id="b">', "</body></html>"),
                                           ("", ""), ("<div>", "</div>")])
def test_style_tree_acts_whatever_the_root(spark, before, after):
    rows = [(k, f"https://h.example/{k}", f'{before}<div class="x9">Join our club today!</div><div class="foo"><p>own {k}</p></div>{after}') for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {k: f"own {k}" for k in range(40)}


def test_names_do_not_cut_the_main_text():
    text = lambda html: pages.main_text(html, set())
    assert text('<div class="content-sidebar-wrap"><main><p>Main text.</p></main><div class="sidebar">x</div></div>') == "Main text."
    assert text('<form><div class="menu">m</div><article><p>A text that is longer.</p></article></form>') == "A text that is longer."
    assert text('<form id="aspnetForm"><p>Most of the text of this page.</p></form><p>rest</p>') == "Most of the text of this page.\n\nrest"
    assert text('<article><h2 id="related-work">Related</h2><section id="social-history"><p>Past</p></section><p class="notice-period">Term</p>'
                '<div class="share-buttons">Share</div><section id="comments"><p>No, a comment that is longer than all else</p></section></article>'
                ) == "Related\n\nPast\n\nTerm"
    assert text('<div><h2 id="related-work">Work</h2><p class="notice-period">Term of notice</p></div>') == "Work\n\nTerm of notice"
    assert text('<p>A body that is long enough.</p><aside><article>teaser</article></aside><div class="promo-of-day">buy</div>') == "A body that is long enough."


def test_high_importance_overrules_a_doubtful_name(spark):
    rows = [(k, f"https://h.example/{k}", f'<body><div class="notice-text"><p>own {k}</p></div><div class="promo-of-day">Buy now</div>'
             f'<div class="menu">entry {k}</div><p>Some longer text of page {k}, not named.</p></body>') for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {k: f"own {k}\n\nSome longer text of page {k}, not named." for k in range(40)}


def test_importance_against_plain_counts(spark):
    """Entropies and importances of every node recomputed page by page."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(k, f"https://h{k % 3}.example/{k}", f'<body><ul class="m"><li><a href="/{rnd.choice(words)}">{text(1)}</a><li>same</ul><div class="x">{text(3)}</div>'
             + "".join(rnd.choice([f"<p>{text(9)}</p>", "<p>shared words</p>", f"<div><b>{text(2)}</b></div>"]) for _ in range(rnd.randint(0, 4)))) for k in range(50)]
    got = {(r.host, r.node): r for r in pages.importance(pages.style_counts(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    for host in range(3):
        site = [pages.parse(html) for k, _, html in rows if k % 3 == host]
        has = {}        # node -> pages, styles, (leaf, feature) -> pages, occurrences
        for i, page in enumerate(site):
            for n in page.nodes:
                has.setdefault(n.id, (set(), {}, {}))[0].add(i)
            for node, style in page.styles:
                has[node][1].setdefault(style, set()).add(i)
            for b in page.blocks:
                leaf = page.nodes[b.node]
                for feature, times in pages.block_features(b, leaf.tag).items():
                    k, above = b.node, set()
                    while True:
                        above.add(page.nodes[k].id)
                        if k == 0:
                            break
                        k = page.nodes[k].up
                    for node in above:
                        of = has[node][2].setdefault((leaf.id, feature), [set(), 0])
                        of[0].add(i)
                        of[1] += times
        for node, (on, styles, features) in has.items():
            if not features:
                assert (f"h{host}.example", node) not in got
                continue
            m, r = len(on), got[f"h{host}.example", node]
            kept = sum(t * (1 - math.log(len(p)) / math.log(max(len(has[leaf][0]), 2))) for (leaf, _), (p, t) in features.items())
            content = (m * max(0.0, kept / sum(t for _, t in features.values())) + 2) / (m + 4)
            total = sum(len(p) for p in styles.values())
            entropy = -sum(len(p) / total * math.log(len(p) / total) for p in styles.values()) / math.log(max(m, 2))
            presentation = (m * min(1.0, entropy) + 2) / (m + 4)
            weight = 0.9 ** len(styles)
            assert r.pages == m and math.isclose(r.content, content, abs_tol=1e-9) and math.isclose(r.presentation, presentation, abs_tol=1e-9)
            assert math.isclose(r.composite, (1 - weight) * presentation + weight * content, abs_tol=1e-9)


def test_no_element_named_like_an_article_discards_the_rest():
    rest = "All the rest of a long article that goes on."
    for name in ("content", "story", "post"):
        assert pages.main_text(f'<div class="{name}"><p>Short intro.</p></div><div class="text"><p>{rest}</p></div>') == f"Short intro.\n\n{rest}"
    assert pages.main_text(f"<article><p>Teaser.</p></article><div><p>{rest}</p></div>") == f"Teaser.\n\n{rest}"
    assert pages.main_text(f"<article><p>{rest}</p></article><div><p>Teaser.</p></div>") == rest


@pytest.mark.parametrize("name", ["topnav", "commentlist", "cookiebar", "adbox", "social-links", "navbar_top"])
def test_joined_names_say_noise(name):
    assert pages.main_text(f'<div class="{name}">x y</div><p>The text of the page.</p>') == "The text of the page."


def test_deep_nesting_is_linear():
    depth = 40_000
    began = time.perf_counter()
    page = "<div>" * depth + "<p>deep</p>" + "</div>" * depth + "<p>end</p>"
    assert pages.main_text(page) == "deep\n\nend"
    counts = pages.page_counts(page)
    assert time.perf_counter() - began < 10 and len(counts) < 10 * pages.DEEP


def test_pages_table(spark):
    got = pages.op2_site_style_tree(spark, SF_SMALL)
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "<" not in r.text[:1] and "&copy" not in r.text for r in rows)


def test_a_worker_gives_back_what_a_stage_took():
    """Workers outlive a stage: unused memory is released after it, and the codec's caches stay small."""
    import pyarrow as pa
    from shelfcast.llm import bpe
    from shelfcast.llm.common import tidied
    seen = []
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert [b.num_rows for b in tidied(lambda it: (seen.append(b) or b for b in it))(iter([batch, batch]))] == [1, 1] and len(seen) == 2
    codec = bpe.Codec(bpe.vocabulary_path())
    for k in range(4):
        words = [("".join(chr(97 + int(d)) for d in str(k * 30_000 + i)) + "x").encode() for i in range(30_000)]
        codec.encode([b" ".join(words)])
    assert max(len(codec.cache), len(codec.words)) <= 110_000
