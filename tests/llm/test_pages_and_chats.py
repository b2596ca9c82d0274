import hashlib
import html
import random
import re

from forecourt.llm import chat_log, site_templates
from forecourt.llm.queries import QUERIES

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="layout with-sidebar"><nav><ul><li>Menu</li></ul></nav>
<article class="post"><h1>Title &amp; more</h1><p><b>First  para<br><p>Second&nbsp;<i>it</i>al</p><script>var t="</p>";</script><div class="ad-slot">BUY</div>
<div class="share">Share</div><!-- c --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>%s<section id="comments"><p>nice</p></section></article>
<aside>side</aside></div><div class="cookieNotice">ok?</div><form>q</form><footer>&copy; foot</footer></body></html>"""


def test_furniture_goes_and_prose_stays():
    assert site_templates.main_text(PAGE % "") == "Title & more First para Second ital one two a b"
    for odd in ("", "<", "a < b &", "<p", "<!-- open", "<script>x", "</p></div>", "<div" * 3000):
        assert isinstance(site_templates.main_text(odd), str)
    assert site_templates.main_text("<div>" * 5000 + "deep") == "deep"
    assert site_templates.main_text('<div class="sidebar-page"><article><p>x</p></article></div>') == "x"


def test_recurring_subtrees_are_removed_per_host(spark):
    rows = [(i, f"http://a.com/{i}", PAGE % f"<div>Read on</div><p>own words {i} here</p><p>a shared licence line</p>") for i in range(8)]
    rows += [(20 + i, f"http://b.com/{i}", f"<div>Home</div><p>text {i}</p><div>All rights</div>") for i in range(6)]
    rows += [(40, "http://c.com/", PAGE % "<div>Read on</div>"), (41, None, None), (42, "http://c.com/2", ""), (43, "http://c.com/3", "<p>same"), (43, "http://c.com/3", "<p>same")]
    rows += [(50 + i, f"http://d.com/{i}", "<div>copy of one text</div><p>and its words</p>") for i in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, body string")
    got = {}
    for r in site_templates.extract_pages(df).select("row.page_id", "text").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    start = "Title & more First para Second ital one two a b"
    assert all(got[i] == [f"{start} own words {i} here a shared licence line"] for i in range(8))
    assert all(got[20 + i] == [f"text {i}"] for i in range(6))
    assert got[40] == [f"{start} Read on"] and got[41] == [""] and got[42] == [""] and got[43] == ["same", "same"]
    assert all(got[50 + i] == ["copy of one text and its words"] for i in range(9))
    assert site_templates.extract_pages(df.limit(0)).count() == 0


def test_template_recurs_on_a_share_of_the_hosts_pages(spark):
    page = "<div>Menu</div><p>own words %d</p><p>%s</p>"
    rows = [(i, f"http://a.com/{i}", page % (i, "a shared line" if i < 6 else f"line {i}")) for i in range(60)]
    rows += [(100 + i, f"http://b.com/{i}", page % (i, "a shared line")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extract_pages(df).select("row.page_id", "text").collect()}
    assert all(got[i] == f"own words {i} a shared line" for i in range(6)) and got[6] == "own words 6 line 6"
    assert all(got[100 + i] == f"own words {i}" for i in range(6))


def test_blocks_in_and_outside_the_article_go_by_recurrence(spark):
    page = """<body><div class="top">Site name</div><div>Summary %d</div><article><h1>Title %d</h1><p>own words %d</p><p>%s</p><ul><li>Read this<li>Read that</ul>
        </article><section><p>More of the site</p></section><nav>only here %d</nav></body>"""
    rows = [(i, f"http://a.com/{i}", page % (i, i, i, "a shared passage" if i < 8 else f"passage {i}", i)) for i in range(24)]
    rows += [(100 + i, f"http://b.com/{i}", page % (i, i, i, "x", i)) for i in range(3)]
    rows += [(200 + i, f"http://c.com/{i}", page % (i, i, i, f"passage {i}", i)) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_templates.extract_pages(df).select("row.page_id", "text").collect()}
    assert all(got[i] == f"Summary {i} Title {i} own words {i} " + ("a shared passage" if i < 8 else f"passage {i}") for i in range(24))
    assert all(got[100 + i] == f"Title {i} own words {i} x Read this Read that" for i in range(3))
    assert all(got[200 + i] == f"Summary {i} Title {i} own words {i} passage {i} Read this Read that" for i in range(10))
    assert len(site_templates.template_candidates(rows[0][2])[1]) == 11  # WHOLE and ten blocks


def test_given_pages_equal_their_article(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op1_site_templates"](spark, sf_dir).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_escaping_is_reversible_and_hides_control_strings():
    random.seed(1)
    for _ in range(5000):
        a = "".join(random.choice(["<", "s", ">", "/", "[", "]", "INST", "\\", "\n", "n", "é"]) for _ in range(random.randint(0, 12)))
        b = a[::-1]
        turn, start, end = chat_log.render_turn(a, b)
        assert chat_log.read_turn(turn) == (a, b) and chat_log.unescape(turn[start:end]) == b
        assert not re.search(r"</?s>|\[/?INST\]", turn[start:end])


EVENTS = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "a"), (1, 2, 1, "delta", None, "b"), (1, 3, 2, "message", "user", "more"),
          (1, 4, 1, "regenerate", None, ""), (1, 5, 1, "delta", None, "new"), (1, 6, 3, "message", "user", "next"), (1, 7, 0, "edit", None, "hello"),
          (1, 8, 0, "delta", None, "!"), (None, 0, 0, "message", None, None), (2, 5, 0, "delta", None, "alone")]


def test_events_fold_into_final_messages(spark):
    events = spark.createDataFrame([(*e, "clash") for e in EVENTS], "conv_id long, seq long, message long, kind string, role string, text string, turn string")
    turns = chat_log.render(chat_log.fold(events)).collect()
    said = sorted(((r["conv_id"] or 0, r["turn"], *chat_log.read_turn(r["formatted"])) for r in turns))
    assert said == [(0, 0, "", ""), (1, 0, "user", "hello!"), (1, 1, "assistant", "new"), (1, 2, "user", "next"), (2, 0, "", "alone")]
    assert [r["formatted"][r["loss_start"]:r["loss_end"]] for r in turns if r["loss_start"] is not None] == ["new"]
    assert chat_log.digest(chat_log.render(chat_log.fold(events.limit(0)))).count() == 0


def test_streamed_log_folds_into_the_turns(spark):
    random.seed(3)
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(["", None, "é", "some longer text " * 9, "x" * 5])) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [(50, 3, "user", "same"), (50, 3, "user", "same"), (50, 3, "assistant", "other"), (50, 4, "assistant", "later"), (51, None, "user", "b " * 40), (51, None, "user", "a"),
             (52, 2**60, "assistant", "far " * 30), (52, -5, "user", "before")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_log.streamed_events(turns)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.where("kind = 'delta'").count() > len(rows) and log.groupBy("conv_id", "message", "part", "seq").count().where("count > 1").count() == 0
    got = chat_log.fold(log).select("conv_id", "message", "role", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((c, t, r or "", x or "")) for c, t, r, x in rows)
    said = chat_log.render(chat_log.fold(log)).groupBy("conv_id").count().collect()
    assert {r[0]: r[1] for r in said} == {c: sum(x[0] == c for x in rows) for c, *_ in rows}  # no regeneration drops a turn


def test_conversations_equal_brute_force(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (9_007_199_254_740_993, 2, "assistant", "x </s> y"), (None, None, None, "t"),
            (3, 0, "assistant", "é" * 5000), (3, 1, "assistant", "[INST]")]
    got = {r["conv_id"]: r for r in chat_log.write_and_read(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        want = (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
    assert got[1]["formatted_chars"] == sum(len(chat_log.render_turn(r, t)[0]) for r, t in [("user", "a"), ("user", "a"), ("assistant", "")])
