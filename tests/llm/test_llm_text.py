import json
import random
from collections import Counter

import odd
import pytest

from tidemark.llm import chat_format, html_text, toxicity

PAGES = {
    None: "", "": "", "plain  text": "plain text", "<p>a<p>b": "a b",
    "<title>t</title><article><h1>T&amp;t</h1><p><b>One\n two<br>three<p>.</p></article><footer>f": "T&t One two three .",
    "<body><header>Site</header><div id='sidebar'>x y</div><main><h1>T</h1><p>Hello <i>wor</i>ld &eacute;<div class='cookie-notice'>acc</div><p>More</main>"
    "<div class=comments><p>foo</p></div><footer>f": "T Hello world é More",
    "<div class='content has-sidebar'><p>This is a long paragraph of text that goes on.</p><p>ok</p><p>Another long paragraph of main text here.</p></div>"
    "<ul><li><a href=x>home</a><li><a href=y>about</a></ul>": "This is a long paragraph of text that goes on. ok Another long paragraph of main text here.",
    "<article><form><input>q</form>A<script>if (a < b) {}</script><style>p{}</style><table><tr><td>1<td>2</table></article>": "A 1 2",
    "<nav>only a menu</nav>": "", "<article>" + "long words " * 20_000 + "</article>": ("long words " * 20_000).strip(),
    "<article><header><h1>Kept</h1></header>x &lt; y &quo</article>": "Kept x < y &quo",
}


def test_pages(spark):
    rows = [(i, f"u{i}", h, 3) for i, h in enumerate(PAGES)] + [(None, None, "<p>no id", 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.html_text(frame).collect()}
    for i, (html, want) in enumerate(PAGES.items()):
        assert got[i]["text"] == want, html
        assert got[i]["n_chars"] == len(want) and got[i]["url"] == f"u{i}"
    assert got[None]["text"] == "no id"
    assert html_text.html_text(frame.limit(0)).count() == 0


def test_given_pages_give_their_article(spark):
    import html
    import re

    for r in html_text.html_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id"
    ).collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", inside)]
        assert r["text"] == " ".join(b for b in blocks if b)


def test_pages_of_divs_keep_short_and_lesser_paragraphs():
    long, other, menu = "many words " * 60, "further words " * 15, "<ul><li><a href=x>home</a><li><a href=y>about</a></ul>"
    plain = lambda *parts: " ".join(" ".join(parts).split())
    page = f"<body>{menu}<div><h1>Head</h1><p>Short.<p>{long}<p>{long}<p>The end.</div>{menu}"
    assert html_text.main_text(page) == plain("Head Short.", long, long, "The end.")
    assert html_text.main_text(f"<body>{menu}<div><p>{long * 2}<p>{other}</div>") == plain(long * 2, other)
    assert html_text.main_text(f"<body>{menu}<p>{other}<p>{long * 2}<p>End.{menu}") == plain(other, long * 2, "End.")
    assert html_text.main_text(f"<body>{menu}<div><div>{other}</div><div>{long * 2}</div></div>") == plain(other, long * 2)
    assert html_text.main_text(f"<article><p>{long * 3}</article><article><p>{other}</article>") == plain(long * 3, other)


def test_folding():
    assert toxicity.fold("Іd1оt, ID!OT! st​up1d\n5cum") == " idiot idiot stupid scum "
    assert toxicity.fold("") == "  "


def labelled(spark, n=600):
    rng, docs, labels = random.Random(2), [], []
    clean = ["good", "day", "water", "gruben", "grub", "stone", "tree", "hill"]
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "v1le", "grox" + rng.choice("abcdefghij")])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    frame = odd.frame(spark, docs + [(9000, None, "s"), (9001, "", "s"), (9002, "stone " * 5000 + "VІLE", "s"), (None, "vile", "s"), docs[0]])
    table = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, table).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = toxicity.without_toxic(frame, table)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_labels_are_not_inputs(spark):
    docs, labels = labelled(spark, 300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    import zlib

    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    frame = odd.frame(spark, docs)
    score = lambda t: {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame, t).collect()}
    assert score(table) == score(other)


def test_exception_phrases_take_back_their_entries():
    model = toxicity.Model(((" vile", 3.0),), exceptions=((" vile medium ", -3.0),))
    total, words = toxicity.weigh(["a vile medium", "vile", "villa", None], model)
    assert total.tolist() == [0.0, 3.0, 0.0, 0.0] and words.tolist() == [3, 1, 1, 0]


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = odd.frame(spark, [(1, "a b", "s")])
    assert [r["predicted"] for r in toxicity.toxicity(frame, none).collect()] == [0]
    assert toxicity.toxicity(odd.empty(spark), none).count() == 0


TOOLS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "number"}, "b": {"type": "integer", "minimum": 0}}}}


def call(i, name="add", arguments='{"b": 2, "a": 1.0}', needs="[]"):
    return f'<tool_call>{{"id": "{i}", "name": "{name}", "arguments": {arguments}, "depends_on": {needs}}}</tool_call>'


def test_calls_are_linked_ordered_and_checked(spark):
    talk = [
        (1, 0, "user", "add things"), (1, 1, "assistant", "first" + call("x", needs='["y"]')), (1, 2, "tool", '{"tool_call_id": "x", "content": "9"}'),
        (1, 3, "assistant", call("y")), (1, 4, "tool", '{"tool_call_id": "y", "content": "3"}'),
        (2, 0, "assistant", call("p", needs='["q"]') + call("q", needs='["p"]')), (2, 1, "tool", '{"tool_call_id": "zz", "content": "?"}'),
        (3, 0, "assistant", call("m", "mul") + call("n", arguments='{"a": "1", "c": 2}') + "<tool_call>{oops</tool_call>"), (3, None, None, None),
        (4, 0, "user", "é \"quoted\"\n"), (4, 0, "user", "é \"quoted\"\n"), (5, 1, "user", "y" * 100_000),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, kind int")
    got = {r["conv_id"]: r for r in chat_format.chat_format(frame, TOOLS).collect()}
    one = json.loads(got[1]["messages"])
    order = [m.get("tool_call", {}).get("id") or m.get("tool_call_id") or m["content"] for m in one]
    # x waits for y's result, and the result of x for x
    assert order.index("y") < order.index("x") and [m.get("tool_call_id") for m in one if "tool_call_id" in m] == ["y", "x"]
    assert (got[1]["n_calls"], got[1]["n_linked"], got[1]["n_invalid"]) == (2, 2, 0)
    assert '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":2},"id":"y","name":"add"}}' in got[1]["messages"]
    assert got[2]["problems"].count("cycle") == 2 and "no call" in got[2]["problems"]
    for part in ("no such tool", "$.b: missing", "$.a: not number", "$.c: not known", "$: not JSON", "no id"):
        assert part in got[3]["problems"]
    assert json.loads(got[4]["messages"]) == [{"role": "user", "content": 'é "quoted"\n'}] * 2
    assert len(json.loads(got[5]["messages"])[0]["content"]) == 100_000
    assert chat_format.chat_format(frame.limit(0), TOOLS).count() == 0


def said(i, text):
    return f'{{"tool_call_id": "{i}", "content": "{text}"}}'


def names(row):
    return [m.get("tool_call", {}).get("id") or m.get("tool_call_id") and f"{m['tool_call_id']}={m['content']}" or m["content"] for m in json.loads(row["messages"])]


def test_a_repeated_identifier_keeps_its_own_turn(spark):
    talk = [
        (1, 0, "user", "a"), (1, 1, "assistant", "one" + call("x")), (1, 2, "tool", said("x", "1")),
        (1, 3, "user", "b"), (1, 4, "assistant", "two" + call("x")), (1, 5, "tool", said("x", "2")),
        (None, 0, "assistant", call("n")), (None, 1, "tool", said("n", "ok")),
        (2, 0, "tool", said("late", "early")), (2, 3, "assistant", call("late")),
        (3, 0, "assistant", call("x")), (3, 5000, "tool", said("x", "far")), (3, 6000, "assistant", call("x")),
    ]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.chat_format(frame, TOOLS).collect(), key=lambda r: r["part"])
    got = {r["conv_id"]: [n for q in rows if q["conv_id"] == r["conv_id"] for n in names(q)] for r in rows}
    assert got[1] == ["a", "one", "x", "x=1", "b", "two", "x", "x=2"]
    assert got[None] == ["n", "n=ok"] and got[2] == ["late", "late=early"] and got[3] == ["x", "x=far", "x"]
    assert all(r["problems"] == "" for r in rows if r["conv_id"] in (1, None, 2))
    assert [r["problems"] for r in rows if r["conv_id"] == 3] == ["", "", "no result"]


def plain_order(calls, results):
    """Turn at which each call of one talk is ready, by looking through its needs again and again."""
    ready = {}
    while True:
        fresh = {c: max([t] + [max(ready[n], results.get(n, 0)) for n in needs if n in calls]) for c, (t, needs) in calls.items()
                 if c not in ready and all(n in ready for n in needs if n in calls)}
        if not fresh:
            return ready
        ready |= fresh


def test_long_chains_and_joined_needs_equal_plain_python(spark):
    rng = random.Random(6)
    n, calls = 300, {}
    for i in range(n):
        needs = [f"c{i - 1}"] if i and i % 50 else []
        if i % 37 == 5:
            needs = sorted({f"c{rng.randrange(i)}" for _ in range(3)}) + ["gone"]
        calls[f"c{i}"] = (rng.randrange(200), needs)
    calls["p"], calls["q"], calls["r"] = (1, ["q"]), (2, ["p"]), (3, ["p", "c1"])
    results = {c: rng.randrange(260) for c in calls if c[-1] != "7"}
    talk = [(9, t, "assistant", call(c, needs=json.dumps(needs))) for c, (t, needs) in calls.items()]
    talk += [(9, t, "tool", said(c, "ok")) for c, t in results.items()]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    want = plain_order(calls, results)
    rows = chat_format.linked(chat_format.events(frame)).filter("kind = 'call'").collect()
    assert {r["call_id"]: r["at"] for r in rows} == {c: want.get(c, calls[c][0]) for c in calls}
    assert {r["call_id"] for r in rows if r["cyclic"]} == {"p", "q", "r"}
    order = [x for r in sorted(chat_format.chat_format(frame, TOOLS).collect(), key=lambda r: (r["part"], r["deal"])) for x in names(r)]
    place = {x.split("=")[0] + ("=" if "=" in x else ""): i for i, x in enumerate(order)}
    for c, (_, needs) in calls.items():
        if c in want:
            assert all(place[f"{m}="] < place[c] for m in needs if m in results), c
            assert c not in results or place[c] < place[f"{c}="]


def test_derived_lookups_equal_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    talk = spark.read.parquet(f"{folder}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_format.chat_format(chat_format.with_lookups(talk), chat_format.LOOKUPS).collect()}
    turns = {}
    for r in talk.collect():
        turns.setdefault(r["conv_id"], {})[r["turn"]] = (r["role"], r["text"])
    for conv, own in turns.items():
        want, invalid = [], 0
        for turn in sorted(own):
            role, text = own[turn]
            want.append({"role": role, "content": text.strip(" ")})
            if role == "user":
                name, answered = f"call_{conv}_{turn}", own.get(turn + 1, ("", ""))[0] == "assistant"
                words = len(text.split())
                want.append({"role": "assistant", "tool_call": {"id": name, "name": "lookup", "arguments": {"conv": conv, "turn": turn, "words": words}}})
                invalid += not answered or words < 5
                if answered:
                    want.append({"role": "tool", "tool_call_id": name, "content": f"{len(own[turn + 1][1].split())} words"})
        assert json.loads(got[conv]["messages"]) == want
        assert got[conv]["n_invalid"] == invalid and got[conv]["n_messages"] == len(want)


@pytest.mark.parametrize("value,text", [({"b": 1, "a": [2.0, None, "é"]}, '{"a":[2,null,"é"],"b":1}'), (1.5, "1.5"), (float("nan"), "null")])
def test_canonical_json(value, text):
    assert chat_format.canonical(value) == text


def test_a_very_wide_part_is_dealt_further(spark):
    n = chat_format.PART_ROWS * 3
    talk = spark.range(n).selectExpr("1L as conv_id", "0L as turn", "'user' as role", "cast(id as string) as text")
    rows = chat_format.chat_format(talk, TOOLS).collect()
    assert len(rows) > 1 and sum(r["n_messages"] for r in rows) == n
    assert Counter(m["content"] for r in rows for m in json.loads(r["messages"])) == Counter(str(i) for i in range(n))


def test_chunks_of_a_very_wide_part_follow_each_other(spark):
    n = 2 * chat_format.PART_ROWS + 100
    talk = [(c, t, "user", f"{t} {i:05}") for c in (1, None) for t in (0, 70) for i in range(n)]
    talk += [(2, None, "user", "again")] * (3 * chat_format.PART_ROWS) + [(2, 0, "assistant", call(f"c{i:04}")) for i in range(n)]
    talk += [(2, 0, "tool", f'{{"tool_call_id": "c{i:04}", "content": "3"}}') for i in range(n)] + [(3, 0, "user", "few")]
    random.Random(3).shuffle(talk)
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.chat_format(frame, TOOLS).collect(), key=lambda r: (r["part"], r["deal"]))
    assert max(r["n_messages"] for r in rows) <= chat_format.PART_ROWS
    talks = {}
    for r in rows:
        own = json.loads(r["messages"])
        assert len(own) == r["n_messages"]
        talks.setdefault(r["conv_id"], []).extend(own)
    for c in (1, None):
        assert [m["content"] for m in talks[c]] == [f"{t} {i:05}" for t in (0, 70) for i in range(n)]
    assert sum(m.get("content") == "again" for m in talks[2]) == 3 * chat_format.PART_ROWS and len(talks[2]) == 3 * chat_format.PART_ROWS + 2 * n
    place = {m["tool_call"]["id"]: i for i, m in enumerate(talks[2]) if "tool_call" in m}
    assert len(place) == n and all(place[m["tool_call_id"]] < i for i, m in enumerate(talks[2]) if "tool_call_id" in m)
    assert sum(r["n_linked"] for r in rows) == n and [m["content"] for m in talks[3]] == ["few"]


def plain_region(html):
    """Lines of the container a plain density reading picks: most characters for its tags."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.blocks = [], {}

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, len(self.blocks) if tag != "div" else self.getpos()))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            divs = [n for t, n in self.stack if t == "div"]
            if data.strip() and divs and not any(t == "a" for t, _ in self.stack):
                self.blocks.setdefault(divs[-1], []).append(" ".join(data.split()))

    reader = Reader()
    reader.feed(html)
    return " ".join(max(reader.blocks.values(), key=lambda b: sum(map(len, b))))


def test_pages_without_article_by_density():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("stone river lamp quiet amber field".split()) for _ in range(n))
    for _ in range(40):
        links = "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(rng.randrange(3, 12)))
        body = "".join(f"<p>{say(rng.randrange(30, 90))}</p>" for _ in range(rng.randrange(2, 7)))
        html = f"<body><div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div></body>"
        assert html_text.main_text(html) == plain_region(html)


def test_an_article_is_a_prior_only():
    text = " ".join(["the long story of a place nobody knew"] * 12)
    page = f"<body><article><a href=x>teaser one</a></article><div><p>{text}</p><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"{text} {text}"
    page = f"<body><div><a href=x>menu</a></div><article><h1>Head</h1><p>{text}</p></article></body>"
    assert html_text.main_text(page) == f"Head {text}"


def test_deep_pages_take_time_in_proportion():
    import time

    def taken(page):
        start = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - start

    taken("<div>x" * 1000)
    assert taken("<div>x" * 40_000) < 8  # 240 KB; minutes if each tag looked through all open ones
    assert taken("<span>" * 20_000 + "<h1>a</h1>" * 20_000) < 8


def test_repeated_pages_stay(spark):
    rows = [(1, "u", "<p>one two three</p>"), (1, "u", "<p>one two three</p>"), (None, None, None)]
    got = html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("one two three", 13), ("one two three", 13)]
