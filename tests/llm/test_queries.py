"""The registered queries over the smallest tables: against their SQL, and the pipeline by steps."""

import base64
import collections
import hashlib
import html
import re

import duckdb
import pytest

import corpus_pipeline
from drayage.llm import packing, toxicity
from drayage.llm.common import table, vocabulary
from drayage.llm.queries import ORACLES, QUERIES

from .test_selection import targets
from .test_text_dedup import groups

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted([tuple(r) for r in got.select(columns).collect()], key=repr) == sorted(want, key=repr)


def test_pages_and_their_records(spark):
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    texts = QUERIES["op2_tag_path_ratios"](spark, SF).collect()
    assert {r["page_id"] for r in texts} == set(pages)
    for r in texts:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        # The generated articles hold nothing but blocks of text.
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])
    records = QUERIES["op3_warc"](spark, SF).collect()
    last = {}
    for i, p in sorted(pages.items()):
        last[p["html"]] = i
    assert sorted(map(tuple, records)) == sorted(
        (i, len(p["html"].encode()), base64.b32encode(hashlib.sha1(p["html"].encode()).digest()).decode(),
         "response" if last[p["html"]] == i else "revisit", None if last[p["html"]] == i else last[p["html"]])
        for i, p in pages.items())


def test_pipeline_by_steps(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").collect()]
    columns = table(spark, SF, "documents").columns
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    features = toxicity.Features(set(model.weights))
    rows = [dict(zip(columns, r, strict=True)) for r in docs]
    rows = [r for r in rows if model.score(features.of(r["text"])) < 0.5]
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[ \t\n\x0b\x0c\r]+", " ", r["text"]), r)
    rows = list(first.values())
    roots = {i: c for i, _, c in groups([(r["doc_id"], r["text"]) for r in rows], 80, 5)}
    rows = [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]

    now = table(spark, SF, "documents")
    kept = []
    for name, function in corpus_pipeline.STAGES[:3]:
        now = function(spark, now, SF)
        assert now.columns == columns
    kept = now.collect()
    assert sorted(map(tuple, kept)) == sorted(tuple(r[c] for c in columns) for r in rows)

    mixed = corpus_pipeline.mixed(spark, now, SF)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    want = targets(sizes)
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    for s, t in want.items():
        taken = sum(n * size[i] for i, n in copies.items() if source[i] == s)
        assert abs(taken - t) <= 0.5 * t + 500
        assert all(int(t // sizes[s]) <= copies[i] <= int(t // sizes[s]) + 1 for i in size if source[i] == s)

    packed = corpus_pipeline.run(spark, SF).collect()
    encoder = packing.Encoder(vocabulary())
    text = {r["doc_id"]: r["text"] for r in rows}
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed)
    expected = collections.Counter()
    for i, n in copies.items():
        for k, (start, length) in enumerate(packing.piece_cuts(len(encoder.ids(text[i])) // 4 + 1, 1024)):
            expected[(i, k, start, length)] += n
    assert pieces == expected
