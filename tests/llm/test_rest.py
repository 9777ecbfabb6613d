"""Operators 2, 3, 4 and 8, and the pipeline."""

from __future__ import annotations

import collections
import json
import math
import os
import random
import re

import numpy as np
import pytest

from shroud.llm import quality
from shroud.llm.chat import SCHEMAS, canonical, format_chat, references, tool_turns, violations
from shroud.llm.html_text import MIN_PAGES, extract, parse
from shroud.llm.simhash import fingerprint
from shroud.llm.top_k import ROUNDS, Index, top_k

# pages


def text_of(html):
    return parse(html).text()


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">no</a></li></ul></nav><!-- no <p>no</p> --><div class="cookie-notice">no</div>
<article class="post"><header><h1>A  title&amp;more</h1></header><p><b>First   para&nbsp;graph <i>with</i><br>break &#233;.<p>Second 1 &lt; 2
<div class="ad">no</div><ul><li>one<li>two</ul><form><input name="q">no</form><aside>no</aside>
<section id="comments"><p>no</p></section><blockquote>Quoted</blockquote></article>
<footer>&copy; no</footer></body>"""


def test_article_text():
    assert text_of(PAGE) == "A title&more\nFirst para graph with break é.\nSecond 1 < 2\none\ntwo\nQuoted"
    assert text_of("") == "" and text_of("plain &amp; simple") == "plain & simple"
    assert text_of("<p>a<p>b</p>c<div>d</div>") == "a\nb\nc\nd"
    assert text_of("<article><p>x <span class='ad'>no</span> y</p></article><p>out") == "x y"
    assert text_of("<p>cut &am") == "cut &am" and text_of("<p>cut <a href='") == "cut <a href='"
    assert text_of("<script>never closed <p>no") == "" and text_of("a <!-- open") == "a"


def test_templates_by_host(spark):
    rows = []
    for k in range(40):
        widget = "<div><p>Our best offers, every day</p></div>" if k % 2 else "<div><p>Another box</p></div>"
        host = "https://big.example/" if k < 30 else "https://small.example/"
        rows.append((k, host + str(k), f"<body>{widget}<div>own text {k}</div><div>own text {k} again</div></body>", "clash", 5))
    copy = "<article><p>One article that a host shows on many pages</p><div>Read more</div></article>"
    rows += [(100 + k, f"http://copy.example/{k}", copy, "clash", 5) for k in range(20)]
    rows += [(None, None, None, "clash", 5), (None, "http://copy.example/n", "", "clash", 5), (7, "not a url", "<p>no host", "clash", 5)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {(r.page_id, r.url): r for r in extract(df).collect()}
    assert got[(1, "https://big.example/1")].text == "own text 1\nown text 1 again"
    assert got[(0, "https://big.example/0")].text == "own text 0\nown text 0 again"
    assert got[(31, "https://small.example/31")].text == "Our best offers, every day\nown text 31\nown text 31 again"  # five pages are not many
    assert got[(105, "http://copy.example/5")].text == "One article that a host shows on many pages"
    assert got[(None, None)].text == "" and got[(None, "http://copy.example/n")].text == "" and got[(7, "not a url")].text == "no host"
    assert all(r.n_chars == len(r.text) for r in got.values()) and extract(df).count() == len(rows)
    assert extract(df.limit(0)).count() == 0


def test_copies_keep_their_text(spark):
    bodies = ["<div>All text of copy {}</div><section>in two boxes</section>", "<article><h1>Title</h1><div><p>Text {}</p><ul><li>item</li></ul></div></article>",
              "<main><section>Text {} in a section</section></main>", "<p>Plain {}</p><table><tr><td>cell</td></tr></table>"]
    rows = [(40 * n + k, f"http://copies{n}.example/{k}", f"<body>{b.format(n)}</body>") for n, b in enumerate(bodies) for k in range(40)]
    rows += [(900 + k, f"http://mixed.example/{k}", f"<body><div>The box of the site</div><div>Own text {k if k < 20 else 7}</div></body>") for k in range(60)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = ["All text of copy 0\nin two boxes", "Title\nText 1\nitem", "Text 2 in a section", "Plain 3\ncell"]
    assert all(got[40 * n + k] == w for n, w in enumerate(want) for k in range(40))
    assert all(got[900 + k] == f"Own text {k if k < 20 else 7}" for k in range(60))


def test_templates_at_every_host_size(spark):
    page = lambda host, k, boxed: (k, f"http://{host}.example/{k}", f"<body>{'<div>A box</div>' if boxed else ''}<div>{host} {k}</div></body>")
    rows = [page("small", k, True) for k in range(6)] + [page("large", k, k % 50 == 0) for k in range(400)]
    got = {r.url: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[url] == url[7:].replace(".example/", " ") for _, url, _ in rows)


def test_text_of_articles_is_not_counted(spark):
    page = "<article><h2>Contents</h2><p>Paragraph of near copies</p><p>Sentence {}</p><ul><li>Salt</li><li>{}</li></ul><blockquote>A quotation</blockquote></article>"
    rows = [(k, f"http://near.example/{k}", page.format(k, k)) for k in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Contents\nParagraph of near copies\nSentence 3\nSalt\n3\nA quotation"


def test_classes_name_what_an_element_is():
    article = "<article><h1>T</h1><p>text</p></article>"
    assert text_of(f'<div class="layout has-sidebar">{article}<div class="sidebar">no</div></div>') == "T\ntext"
    assert text_of('<div class="post no-comments"><p>text</p></div>') == "text"
    assert text_of(f'<div id="sidebar">{article}</div>') == "T\ntext"  # it holds the only article
    assert text_of(f'<div id="sidebar">{article}<p class="ad">no</p></div><p>out') == "T\ntext"
    assert text_of(f'{article}<div class="related-posts"><article><p>no</p></article></div>') == "T\ntext"
    assert text_of('<article><div class="entry-header"><h1>T</h1></div><p>x</p><div class="siteFooter">no</div></article>') == "T\nx"
    assert text_of('<div class="site-header">no</div><div class="adsBox">no</div><div class="shadow">yes</div>') == "yes"


def test_reader_comments_in_articles_go():
    assert text_of('<article><p>text</p></article><article class="comment"><p>no</p></article>') == "text"
    assert text_of('<article id="comment-12"><p>no</p></article><p>text</p>') == "text"
    assert text_of('<main><p>text</p><article class="comment-body reply"><p>no</p></article></main>') == "text"


def test_inline_elements_end_where_they_end():
    assert text_of('<p>Hello <span class="ad">x <i>y</span> world</p>') == "Hello world"
    assert text_of('<p>See the <a class="related" href="/r">earlier report</a> on this.</p>') == "See the earlier report on this."
    assert text_of('<div>Text <a class="share" href="#">Share</a></div>') == "Text"
    assert text_of('<p>a <b aria-hidden="true">no</b> b <span hidden>no</span> c</p><p>d <em class="ad">no</p><p>e</p>') == "a b c\nd\ne"


def test_deep_nesting_is_linear():
    import time

    took = []
    for levels in (20_000, 80_000):
        source = "<div>x" * levels + "</b></td>" * levels
        begin = time.process_time()
        page = parse(source)
        took.append(time.process_time() - begin)
        assert len(page.blocks) == levels == len(page.tree)
        assert page.text({page.tree[1][0]}) == "x"
    assert took[1] < 8 * took[0]


def test_counting_equals_plain_subtree_counter(spark):
    """Against a counter over nested tuples: subtrees compared whole, deleted where they recur with enough texts."""
    rng = random.Random(4)
    shared = [("section", [("p", [f"shared {k}"]), ("div", [f"box {k}"])]) for k in range(4)]

    def tree(k):
        parts = [rng.choice(shared) for _ in range(rng.randrange(3))] + [("div", [f"own {k} {n}"]) for n in range(2)]
        rng.shuffle(parts)
        return ("div", parts)

    def written(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"

    def texts(node, gone=()):
        if isinstance(node, str):
            return [node]
        return [] if repr(node) in gone else [t for child in node[1] for t in texts(child, gone)]

    def subtrees(node):
        return set() if isinstance(node, str) else {repr(node)}.union(*(subtrees(c) for c in node[1]))

    pages = {(host, k): tree(f"{host}{k}") for host in "ab" for k in range(8 if host == "a" else 60)}
    pages["a", 100] = pages["a", 0]  # a copy counts once
    seen = collections.defaultdict(set)
    for (host, _), node in pages.items():
        for s in subtrees(node):
            seen[host, s].add("\n".join(texts(node)))
    rows = [(k, f"http://{host}.example/{k}", f"<body>{written(node)}</body>") for (host, k), node in pages.items()]
    got = {(r.url[7], r.page_id): r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    gone = {host: {s for (h, s), found in seen.items() if h == host and len(found) >= MIN_PAGES} for host in "ab"}
    assert gone["b"] and got == {(host, k): "\n".join(texts(node, gone[host])) for (host, k), node in pages.items()}


# exact top-k


def brute_top(rows, k, every):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(ok) if b != a)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return collections.Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)).astype(np.float32)
    rows = [(k, base[k % 390].tolist()) for k in range(400)]
    rows += [(500, None), (600, []), (700, [1.0, None]), (800, [float("nan")]), (900, [float("inf")] * 12), (None, [0.5] * 12), (1000, [0.25] * 12),
             (1000, [0.25] * 12), (1100, [3.0]), (1200, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, score int, slot string")
    assert collections.Counter(map(tuple, top_k(df).collect())) == brute_top(rows, 10, 100)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert collections.Counter(map(tuple, top_k(few).collect())) == brute_top(rows[:4], 10, 100)
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 0")).count() == 0


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(3000, 20)) * 200 * rng.random((3000, 1)) ** 4).astype(np.int64)
    index = Index(vectors)
    for q in vectors[::150]:
        at, score = index.top(q, 5, -1)
        exact = vectors @ q
        assert sorted(score.tolist(), reverse=True)[:5] == sorted(exact.tolist(), reverse=True)[:5]
        assert set(at.tolist()) >= set(np.flatnonzero(exact > sorted(exact.tolist())[-5]).tolist())


def test_index_prunes_the_given_embeddings(spark):
    """On the embeddings of the larger test tables a tenth of the vectors is left for rescoring, proven, before all segments are read."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("driver test data not present")
    vectors = np.floor(1024 * np.array([r.embedding for r in spark.read.parquet(path).orderBy("vec_id").select("embedding").collect()], float)).astype(np.int64)
    index, left, rounds = Index(vectors), [], []
    for k in range(0, len(vectors), 100):
        _, score = index.top(vectors[k], 10, k)
        exact = vectors @ vectors[k]
        exact[k] = -(1 << 60)
        assert sorted(score.tolist())[-10:] == sorted(exact.tolist())[-10:]
        rounds.append(index.last[0])
        left.append(index.last[1] / len(vectors))
    assert np.median(left) < 0.1 and np.median(rounds) < ROUNDS


# quality rules


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def good(rnd):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(rnd.randint(60, 200)))


def test_quality_rules(spark):
    rnd = random.Random(8)
    docs = [(k, good(rnd)) for k in range(300)]
    docs += [(k, " ".join(w + "***" for w in good(rnd).split())) for k in range(300, 340)]
    docs += [(400, None), (401, ""), (402, "a b a b a b c\n\n \na b c\na b c"), (403, "word " * 5000), (403, "word " * 5000), (None, good(rnd)), (404, "\x1c　é# " * 60)]
    labels = [(k, 1 if k < 300 else 0) for k in range(0, 340, 2)] + [(0, 1), (2, None), (None, 0), (999, 0)]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in docs], "doc_id long, text string, kept int, quality string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.quality_rules(df, marked).collect()
    want = collections.Counter((i, *brute_counts(t or "")) for i, t in docs)
    assert collections.Counter(tuple(r[:6]) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    assert sum(kept[k] for k in range(300)) >= 294 and sum(kept[k] for k in range(300, 340)) <= 2
    stay = quality.keep_good(df, marked)
    assert stay.columns == df.columns and collections.Counter(r.doc_id for r in stay.collect()) == collections.Counter(r.doc_id for r in rows if r.kept)
    plain = quality.quality_rules(df, marked.limit(0)).collect()  # no labels, no forest
    assert all(r.kept != r.base_failed for r in plain)
    assert quality.quality_rules(df.limit(0), marked).count() == 0


def test_threshold_weighs_good_rows_without_a_limit():
    assert not hasattr(quality, "GOOD_LOST") and "GOOD_LOST" not in quality.__doc__ and "GOOD_WEIGHT" in quality.__doc__
    assert quality.best_bin(np.array([0, 4, 96]), np.array([0, 100, 0])) == 1  # 100 % of the bad rows for 4 % of the good ones
    assert quality.best_bin(np.array([0, 6, 94]), np.array([0, 100, 0])) == 0  # not for 6 %
    assert quality.best_bin(np.array([0, 0, 100]), np.array([10, 30, 60])) == 1


# chat


def test_schema_and_references():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    assert violations({"a": 2, "b": ["x"]}, schema) == [] and violations({"a": {"$result": "1"}}, schema) == []
    assert violations({"a": True, "b": ["y"], "c": 1}, schema) == ["$.a: not integer", "$.b[0]: not in enum", "$.c: unknown"]
    assert violations({}, schema) == ["$.a: missing"] and violations({"a": 1}, schema) == ["$.a: out of bounds"]
    assert references({"a": [{"$result": "x"}, {"b": {"$result": "y"}}], "c": 1}) == {"x", "y"}
    assert canonical({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}'


def test_format_chat(spark):
    tools = {"f": {"type": "object", "required": ["q"], "properties": {"q": {}}}}
    messages = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 9, None, None, "x"), (None, None, "system", "", "x")], "conv_id long, turn long, role string, text string, json string")
    calls = spark.createDataFrame(
        [(1, 1, "a", "f", '{"q": 1}'), (1, 2, "b", "f", '{"q": {"$result": "a"}}'), (1, 3, "c", "f", '{"q":{"$result":"b"}}'), (1, 4, "d", "g", "{}"), (1, 5, "e", "f", "no json"),
         (1, 6, "a", "f", '{"q": 2}'), (1, 7, None, "f", '{"q": 2}'), (2, 1, "a", "f", '{"q":{"$result":"a"}}'), (None, 0, "n", "f", '{"q":0}')],
        "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 8, "a", "late"), (1, 2, "b", "early"), (1, 3, "zz", "orphan"), (1, 0, "c", None), (None, 3, "n", "ok")], "conv_id long, turn long, call_id string, content string")
    rows = format_chat(messages, calls, results, tools).collect()
    assert len(rows) == 3 + 9 + 5
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.place, r.step, r.kind, r.call_id or "", r.turn))
    at = {(r.kind, r.call_id): k for k, r in enumerate(one) if r.status in ("ok", "before its call")}
    assert at["call", "a"] < at["result", "a"] < at["call", "b"] < at["result", "b"] < at["call", "c"] < at["result", "c"]
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in rows}
    assert status[1, "call", "d", 4] == "unknown tool" and status[1, "call", "e", 5] == "no JSON object" and status[1, "call", "a", 6] == "repeated id"
    assert status[1, "call", None, 7] == "no id" and status[1, "result", "zz", 3] == "no call" and status[1, "result", "c", 0] == "before its call"
    assert status[2, "call", "a", 1] == "no result" and status[None, "call", "n", 0] == "ok" and status[None, "result", "n", 3] == "ok"
    line = next(r.json for r in rows if r.conv_id == 1 and r.call_id == "a" and r.turn == 1)
    assert line == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"q":1},"name":"f"},"id":"a","type":"function"}]}'
    assert all(json.loads(r.json) for r in rows)


def test_chat_query_links_every_answer(spark):
    turns = [(c, k, "user" if k % 2 == 0 else "assistant", "question that is long enough to be asked of the tool " * (k % 3)) for c in range(3) for k in range(8)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = format_chat(*tool_turns(df), SCHEMAS).collect()
    assert len(rows) == 24 and all(r.status == "ok" for r in rows if r.kind == "result")
    assert format_chat(*tool_turns(df.limit(0)), SCHEMAS).count() == 0


def test_odd_arguments_get_a_status(spark):
    odd = {"surrogate": '{"q": "\\ud800x"}', "nan": '{"q": NaN}', "large": '{"q": 1e999}', "deep": '{"q": ' + "[" * 200_000 + "]" * 200_000 + "}", "whole": '{"$result": "surrogate"}',
           "self": '{"q": {"$result": "self"}}', "unknown": '{"q": {"$result": "nowhere"}}', "later": '{"q": {"$result": "zz"}}', "zz": '{"q": 1}', "null": None}
    calls = spark.createDataFrame([(1, k, i, "f", a) for k, (i, a) in enumerate(odd.items())], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 100 + k, i, "r") for k, i in enumerate(odd)], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = format_chat(messages, calls, results, {"f": {"type": "object", "required": ["q"], "properties": {"q": {}}}}).collect()
    status = {r.call_id: r.status for r in rows if r.kind == "call"}
    assert status == {"surrogate": "ok", "nan": "no JSON object", "large": "no JSON object", "deep": "nested too deep", "whole": "$.q: missing", "self": "unknown reference",
                      "unknown": "unknown reference", "later": "unknown reference", "zz": "ok", "null": "no JSON object"}
    lines = {r.call_id: json.loads(r.json) for r in rows if r.kind == "call"}
    assert lines["surrogate"]["tool_calls"][0]["function"]["arguments"] == {"q": "\ud800x"}


def linked_by_hand(calls, results):
    """{(turn, call_id): (place, step, status)} of one conversation by fixed-point iteration over plain dictionaries."""
    first = {}
    for turn, call, needs in sorted(calls):
        first.setdefault(call, (turn, needs))
    answer = {}
    for turn, call in sorted(results):
        answer.setdefault(call, turn)
    at = {c: (t, 0) for c, (t, _) in first.items()}
    for _ in range(len(first) + 1):
        for c, (t, needs) in first.items():
            for n in needs:
                if n in first and first[n][0] < t:
                    at[c] = max(at[c], (max(at[n][0], answer.get(n, at[n][0])), at[n][1] + 2))
    out = {}
    for turn, call, needs in calls:
        if turn != first[call][0]:
            status = "repeated id"
        elif call not in answer:
            status = "no result"
        else:
            status = "ok" if all(n in first and first[n][0] < turn for n in needs) else "unknown reference"
        out[turn, call] = (*at[call], status)
    return out


def test_linking_equals_a_plain_linker(spark):
    rng = random.Random(12)
    want, calls, results = {}, [], []
    for conv in range(12):
        names = [f"c{k}" for k in range(6)]
        mine = [(t, rng.choice(names), sorted(rng.sample([*names, "none"], rng.randrange(3)))) for t in range(10)]
        back = [(rng.randrange(3, 20), c) for c in names if rng.random() < 0.8]
        want.update({(conv, *k): v for k, v in linked_by_hand(mine, back).items()})
        calls += [(conv, t, c, "f", json.dumps({"q": [{"$result": n} for n in needs]})) for t, c, needs in mine]
        results += [(conv, t, c, "r") for t, c in back]
    rows = format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
                       spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"),
                       spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), {"f": {"type": "object"}}).collect()
    assert {(r.conv_id, r.turn, r.call_id): (r.place, r.step, r.status) for r in rows if r.kind == "call"} == want


# the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(6)
    folder = tmp_path_factory.mktemp("corpus")
    unique = [" ".join("".join(rnd.choice(["ta", "ro", "min", "el", "ös", "k"]) for _ in range(rnd.randint(1, 3))) for _ in range(150)) for _ in range(30)]
    shared = unique[0][:400]
    docs = [(k, f"{t}\n{unique[(k + 1) % 30][:50]} {k}", "en", "s", 9) for k, t in enumerate(unique)]
    docs += [(100, docs[3][1], "en", "s", 9), (101, docs[4][1].replace("ta", "to", 1), "en", "s", 9), (102, "short", "en", "s", 9), (103, None, "en", "s", 9),
             (104, " ".join(unique[5].split()[:70]) + " " + shared + " " + " ".join(unique[6].split()[70:]), "en", "s", 9), (None, unique[7] + " x", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {d[0]: d[1] for d in docs}


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline
    from shroud.llm.common import stored

    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r.doc_id: r.text for r in docs.collect()})
    rules, lines, near, cut = seen[1:]
    assert 102 not in rules and 103 not in rules and len(rules) >= 30
    assert 100 in rules and 100 not in lines  # a copy loses all its lines, and goes
    prints = {k: fingerprint(t or "") for k, t in lines.items()}
    close = lambda a, b: a != b and (prints[a] ^ prints[b]).bit_count() <= 4
    assert not any(close(a, b) for a in near for b in near)
    assert all(any(close(a, b) for b in lines) for a in set(lines) - set(near))
    joined = "\0".join(cut.values()).encode()
    windows = collections.Counter(x[k:k + 200] for x in [t.encode() for t in near.values()] for k in range(len(x) - 199))
    assert not any(n > 1 and w in joined for w, n in windows.items())
    packed = corpus_pipeline.run(spark, folder)
    assert set(r.doc_id for r in packed.select("doc_id").distinct().collect()) == set(cut)
