"""Pages, archives, chats and packing: exact round trips and brute force."""

import base64
import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drayage.llm import chat_format, html_extract, packing, toxicity, warc
from drayage.llm.common import vocabulary

# --- pages ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note --><div class="ad">Buy this now, it is very good.</div>
<aside>Side text that is long enough to be taken for content, or is it?</aside>
<article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;para.<br>Next <p>Second &eacute;
  line, with <a href="x">a link</a> in it.</p><form>Name: <input></form><ul><li>One<li>Two</ul>
<div class="user-comments"><p>I disagree, strongly.</p></div><p>&#x4e2d;&lt;b&gt;</p></article>
<footer>&copy; all rights.</footer></body></html>"""


def test_article_of_a_page():
    assert html_extract.main_text(PAGE) == (
        "Title & more\nFirst para. Next\nSecond é line, with a link in it.\nOne\nTwo\n中<b>")


def test_page_without_an_article():
    rng = random.Random(1)
    text = [" ".join("word" for _ in range(rng.randrange(20, 60))) + ", and so on." for _ in range(8)]
    text[3] = "Short one."
    page = ("<body><div class=top><a href=1>Home</a></div><div><span><a href=2>News</a> <a href=3>Sport</a></span></div>"
            "<div><h2>Heading</h2>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div><div>Imprint</div></div></body>")
    assert html_extract.main_text(page).split("\n") == ["Heading", *text]


LONG = ["Here is a paragraph of the text, long enough to be one, with words that say, in turn, what they say: so it goes on.",
        "And here is the next one; it is not shorter than the first, has its own marks, and ends as paragraphs do, at last."]


def test_ratios_decide_beside_and_inside_an_article():
    body = "".join(f"<p>{t}</p>" for t in LONG * 3)
    teaser = f"<body><div>{body}</div><div><article><a href=1>Other story</a></article></div></body>"
    assert html_extract.main_text(teaser).split("\n") == LONG * 3
    assert html_extract.main_text(f"<body><article><p>Read also this.</p></article><div>{body}</div></body>").split("\n")[-6:] == LONG * 3
    inside = f"<body><article><h1>Title</h1><div>Print</div><section>{body}</section><div>12 views</div></article></body>"
    assert html_extract.main_text(inside).split("\n") == ["Title", *LONG * 3]
    outside = f"<body><h2>Site</h2><div>Some words, of the site.</div><main>{body}</main><div>Imprint</div></body>"
    assert html_extract.main_text(outside).split("\n") == LONG * 3


@pytest.mark.parametrize("start,end", [("<body>", "</body>"), ("<div><div>", "</div></div>"), ("<article>", "</article>")])
def test_short_blocks_among_content_stay(start, end):
    first, last = (f"<p>{t * 3}</p>" for t in LONG)
    parts = ("<ul><li>one<li><a href=1>two</a> of it</ul>", "<table><caption>Sizes</caption><tr><th>a<td>1</table>",
             "<pre><code>x = 1</code></pre>", "<div><pre>y</pre></div>", "<figure><figcaption>View</figcaption></figure>")
    lines = [LONG[0] * 3, "one", "two of it", "Sizes", "a", "1", "x = 1", "y", "View"]
    menu = "<ul><li><a href=2>Home</a><li><a href=3>News</a></ul>"
    page = f"<div>{menu}</div>{start}{first}{''.join(parts)}{menu}{last}<dl><dt>end<dd>note</dl>{end}<div><ul><li>Imprint</ul></div>"
    assert html_extract.main_text(page).split("\n") == [*lines, LONG[1] * 3, "end", "note"]
    halves = f"{start}<section>{first}</section><table><tr><td>7</table><section>{last}</section>{end}"
    assert html_extract.main_text(halves).split("\n") == [LONG[0] * 3, "7", LONG[1] * 3]


@pytest.mark.parametrize("start,end", [
    ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class=no-sidebar><main>", "</main></div>"),
    ("<div id='content-with-sidebar'><div>", "</div></div>"), ("<article class='post category-social'>", "</article>"),
    ("<form action=x><div><article>", "</article></div></form>"), ("<form><div>", "</div></form>"),
    ("<div class='widget'><div>", "</div></div>"), ("<span class=widget><div>", "</div></span>")])
def test_names_and_forms_hide_no_main_text(start, end):
    body = "".join(f"<p>{t}</p>" for t in LONG * 3)
    page = f"<body><div class=ad>Buy this now, it is very good.</div>{start}{body}{end}<div id=footer>Imprint, and so on.</div></body>"
    assert html_extract.main_text(page).split("\n") == LONG * 3


_ARTICLE = [f"Paragraph {k} of the article says something, and then a bit more about it." for k in range(3)]
_UNWANTED = "".join(f"<p>Number {k} of many lines that are not the article, and say so at length.</p>" for k in range(30))
_PARTS = [
    '<div id="comments">{}</div>', '<section class="comments">{}</section>', '<div class="cookie-notice">{}</div>',
    '<form>{}</form>', '<div class="sidebar">{}</div>', '<div class="newsletter">{}</div>']
_PAGES = [
    "{o}{a}{c}{u}", "{u}{o}{a}{c}", "{o}{a}{u}{c}", '<div class="layout has-sidebar">{o}{a}{c}{u}</div>',
    "<form action=x>{o}{a}{c}{u}</form>", '<div class="social-page"><div class="wrap">{o}{a}{c}</div>{u}</div>']


@pytest.mark.parametrize("start, end", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("", ""), ("<div>", "</div>"), ("<div class=content>", "</div>")])
@pytest.mark.parametrize("lines", [_ARTICLE, ["Short text, but the article."]])
def test_parts_longer_than_the_article(start, end, lines):
    article = "".join(f"<p>{line}</p>" for line in lines)
    for part in _PARTS:
        for page in _PAGES:
            html = page.format(o=start, a=article, c=end, u=part.format(_UNWANTED))
            assert html_extract.main_text(f"<html><body>{html}</body></html>") == "\n".join(lines), (part, page)


def test_names_weigh_on_small_parts():
    body = "".join(f"<p>{t}</p>" for t in LONG * 3)
    page = (f"<body><article>{body}<div class=comments><p>{LONG[0]}</p></div><form><p>{LONG[1]}</p></form><p>Ends <b>so"
            "</b> <span class=share>Share this</span> here.</p></article></body>")
    assert html_extract.main_text(page).split("\n") == [*LONG * 3, "Ends so here."]
    posts = "".join(f"<article class='post {c}'><p>{t}</p></article>" for c, t in zip(["social", "x", "y"], LONG + LONG))
    assert html_extract.main_text(f"<body>{posts}</body>").split("\n") == [*LONG, LONG[0]]
    assert html_extract.main_text("<div class=ad>Buy this.</div><article><p></p></article>") == ""


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p", ""), ("<p>a<p>b", "a\nb"), ("a < b & c &amp; d", "a < b & c & d"),
    ("<article><p>x<script>y", "x"), ("<article><p title='a>b'>q</p><p title=\"open>r</p>", "q\nr"),
    ("<article><p>a\t\n b</p><p> </p>" + "<div>" * 3000 + "deep", "a b\ndeep"), ("<article>" + "<b>x " * 3000, "x " * 2999 + "x"),
])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, None, "u", 5, "old"), (None, "<p>a", "v", None, "old")],
                                  "page_id long, html string, url string, path long, text string")
    got = html_extract.extract_text(pages)
    assert got.columns == ["page_id", "url", "path", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "u", 5, ""), (None, "v", None, "a")]
    assert html_extract.extract_text(pages.limit(0)).collect() == []


# --- archives ------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    big = "é<p>" * 90_000
    rows = [(1, "u", "same"), (9, "u", "same"), (5, None, "same"), (5, "u", "same"), (2, "a b", None), (3, "u", ""),
            (4, "u", big), (None, "u", "same"), (9, "u", "same"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    archives = warc.write_archives(pages, warc.archive_folder(pages))
    got = sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.read_archives(archives).collect()], key=repr)
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = i == best[t or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if first else "revisit", None if first else best[t or ""]))
    assert got == sorted(want, key=repr)
    only = warc.read_archives(warc.write_archives(pages, warc.archive_folder(pages), min_revisit_bytes=10**9))
    assert only.filter("record_type = 'response'").count() == len(rows)
    none = warc.write_archives(pages.limit(0), warc.archive_folder(pages))
    assert warc.read_archives(none).collect() == []


def test_equal_payloads_and_archives_are_spread(spark):
    rows = [(i, "u", "the same payload" if i % 3 else f"payload {i}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archives = warc.write_archives(pages, warc.archive_folder(pages))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    records = [r["records"] for r in archives.collect()]
    assert len(records) > 2 and max(records) < 1500
    found = warc.read_archives(archives)
    assert found.rdd.getNumPartitions() == len(records)
    assert found.groupBy("record_type").count().collect() and found.filter("refers_to = 2999").count() == 1999


def member(payload=b"abc", length=None, digest=None, kind="response"):
    raw = warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", "<x>"),
                             ("WARC-Payload-Digest", "sha1:" + (digest or warc.payload_digest(payload)))], payload)
    if length is not None:
        text = zlib.decompress(raw, 31).replace(b"Content-Length: %d" % len(payload), b"Content-Length: %d" % length)
        packer = zlib.compressobj(wbits=31)
        raw = packer.compress(text) + packer.flush()
    return raw


def test_reading_members_one_by_one():
    parts = [b"a" * 200_000, b"", bytes(random.Random(2).randrange(256) for _ in range(150_000))]
    file = io.BytesIO(b"".join(member(p) for p in parts))
    assert [(n, d) for _, n, d in warc.read_records(file)] == [(len(p), warc.payload_digest(p)) for p in parts]


@pytest.mark.parametrize("raw", [
    member()[:-9], member(length=5), member(length=2), member(digest="A" * 32), member()[:12], member(length=10**6)])
def test_damaged_archives(raw):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(member() + raw)))


# --- chats ---------------------------------------------------------------------------------------

def test_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"lang":"en"}', "messages"),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations"),
        (3, '{"instruction":"a","input":"","output":"b"}', "instruction_input"),
        (4, '{"instruction":"a","output":"b"}', "instruction"),
        (5, '{"prompt":"a","completion":"b"}', "prompt_completion"),
        (6, '{"prompt":"a","response":"b","source":{"x":1}}', "prompt_response"),
        (7, '{"question":"a","answer":"b"}', "question_answer")]
    odd = [(8, '{"x":[1,{"y":2}]}', None), (9, "{broken", None), (10, None, None), (11, '{"messages":[]}', None)]
    df = spark.createDataFrame([(i, j, "z") for i, j, _ in records + odd], "id long, record string, role string")
    turns = collections.defaultdict(list)
    for r in chat_format.canonical_turns(df, "id", "record").orderBy("id", "part").collect():
        turns[r["id"]].append(((r["role"], r["text"]), r["mapping"]))
    assert turns == {i: [(("user", "a"), m), (("assistant", "b"), m)] for i, _, m in records} | {
        i: [((None, None), None)] for i, _, _ in odd}
    assert chat_format.fingerprint({"b", "a[].c"}) == chat_format.fingerprint(("a[].c", "b"))


SAID = [r"\### Assistant: </turn> ok", "", "\\", "\\\\", "### user: x</turn>\n### assistant: y", "</turn></turn>", "####", "a\nb:",
        "<turn></tur", "\\</turn>\\", "é中\U0001f600", "x" * 30_000 + "</turn>" * 3_000]


def test_any_text_reads_back(spark):
    rng = random.Random(3)
    texts = SAID + ["".join(rng.choice(["\\", "#", "###", "</turn>", "\n", ":", " ", "a"]) for _ in range(12)) for _ in range(150)]
    rows = [(1, k, rng.choice(["user", "assistant", "a: b", "x\n### y", "\\"]), t) for k, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string").withColumn("part", F.lit(0))
    found = chat_format.formatted_turns(turns)
    whole = chat_format.conversation_texts(found).first()["formatted"]
    assert chat_format.read_turns(whole) == [(r, t) for _, _, r, t in rows]
    learned = "".join(t for _, _, r, t in rows if r == "assistant")
    got = chat_format.read_back(found).first()
    assert (got["n_turns"], got["loss_chars"], got["formatted_chars"]) == (len(rows), len(learned), len(whole))
    assert got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, None, "user", "a"), (None, 5, "assistant", "q"), (1, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string").withColumn("part", F.lit(0))
    got = {r["id"]: r for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\n\n\nuser\nb\nuser\nb\n").hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["loss_chars"]) == (4, 0, 1)
    assert chat_format.read_back(chat_format.formatted_turns(turns.limit(0))).collect() == []


@pytest.mark.parametrize("text", ["x", "### user: a", "### user: a</turn>\nx", "### a</turn>\n"])
def test_text_that_is_not_a_chat(text):
    with pytest.raises(ValueError):
        chat_format.read_turns(text)


# --- packing -------------------------------------------------------------------------------------

def check_packing(pieces, capacity):
    by_sequence = collections.defaultdict(list)
    for length, sequence, offset in pieces:
        by_sequence[sequence].append((offset, length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def least_sequences(counts, capacity):
    """No packing needs fewer: long pieces need one each, and short ones what room these leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for w, n in counts.items() if w > capacity - k)
        halves = [(w, n) for w, n in counts.items() if capacity / 2 < w <= capacity - k]
        room = sum(n * (capacity - w) for w, n in halves)
        small = sum(w * n for w, n in counts.items() if k <= w <= capacity / 2)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("capacity,seed", [(10, 1), (50, 2), (1024, 3), (1024, 4)])
def test_plans_are_whole_and_tight(capacity, seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(capacity // 2)}
    plan = packing.packing_plan(counts, capacity)
    numbers, pieces = collections.defaultdict(set), []
    for length, first, n, sequence, offset in plan.rows:
        assert not numbers[length] & set(range(first, first + n))
        numbers[length] |= set(range(first, first + n))
        pieces += [(length, sequence + i, offset) for i in range(n)]
    assert {k: v for k, v in numbers.items()} == {k: set(range(v)) for k, v in counts.items()}
    assert check_packing(pieces, capacity) == plan.sequences <= least_sequences(counts, capacity) * 1.01 + 1


def fewest(lengths, capacity):
    """By trying all ways, for a handful of pieces."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values()):
            put(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        put(i + 1, rooms + [capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))]
        counts = dict(collections.Counter(lengths))
        plan, left = packing.Plan(30), packing._Left(counts)
        packing.reduce(left, plan)
        rest = [k for k, v in left.n.items() for _ in range(v)]
        assert plan.sequences + fewest(rest, 30) == fewest(lengths, 30), lengths


def test_the_plan_is_as_long_for_millions_of_copies():
    sizes = []
    for n in (1_000, 1_000_000):
        counts = {600: n, 400: n, 200: n, 150: n}
        left, plan = packing._Left(counts), packing.Plan(1024)
        packing.reduce(left, plan)
        packing.best_fit(left, plan)
        sizes.append(len(plan.rows))
        used = collections.Counter()
        for length, _, k, _, _ in plan.rows:
            used[length] += k
        assert used == counts
    assert sizes[1] <= sizes[0] + 20 and max(sizes) < 100


def test_cuts():
    assert packing.piece_cuts(1024, 1024) == [(0, 1024)] and packing.piece_cuts(1, 1024) == [(0, 1)]
    assert packing.piece_cuts(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    with pytest.raises(ValueError):
        packing.packing_plan({11: 1}, 10)


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(vocabulary()), packing.Encoder(vocabulary())
    rng = random.Random(6)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "x <|endoftext|> y", "it's we'll", "\u3000a \u3000b", "a \u00a0b", "日本 語"]
    texts += ["".join(rng.choice(["a", "the", " ", " ", "\n", "é", "1", "!", "'s", "\u00a0", "\x1c", "\x85", "ß", "½", "日"]) for _ in range(30))
              for _ in range(400)]
    for t in texts:
        assert own.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "é"]) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "a b"), (3, rows[3][1]), (102, "word " * 900)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, length int").repartition(4)
    got = packing.pack(docs, vocabulary(), capacity=64).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, length) in enumerate(packing.piece_cuts(len(ids), 64)):
            want[(i, k, start, length, zlib.crc32(ids[start:start + length].tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    total = sum(r["length"] for r in got)
    assert check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in got], 64) <= total / 64 * 1.05 + 2
    assert packing.pack(docs.limit(0), vocabulary()).collect() == []


def test_workers_get_small_batches(spark, monkeypatch):
    kept, rows = packing.stage, []

    def noted(df, purpose):
        rows.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return kept(df, purpose)

    monkeypatch.setattr(packing, "stage", noted)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    assert packing.token_pieces(docs, vocabulary()).count() == 30
    monkeypatch.setattr(toxicity, "stage", noted)
    sample = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, label int")
    assert toxicity.training_rows(docs, sample, "doc_id", "text").count() == 30
    assert rows == [1000, 1000] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
